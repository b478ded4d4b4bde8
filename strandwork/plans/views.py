"""Methylation tables derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, bin, lang, seq: a document's letters that are bases."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("contig"), F.col("source").alias("bin"), "lang", F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq"))


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, bin, position, mod_type, strand, fraction_mod, Nvalid_cov from line items and their suppliers."""
    items, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    rows = items.join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rows.select(
        F.col("l_suppkey").cast("string").alias("contig"), F.col("s_nationkey").cast("string").alias("bin"), day.alias("position"), F.col("l_returnflag").alias("mod_type"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (F.col("l_discount") * 10).alias("fraction_mod"), F.col("l_quantity").cast("long").alias("Nvalid_cov"),
    )


def event_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, contig (user), position (hour), mod_type, strand, fraction_mod, Nvalid_cov from events."""
    e = table(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("long")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("contig"), hours.alias("position"), F.col("event_type").alias("mod_type"), F.lit("+").alias("strand"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("fraction_mod"), F.regexp_extract("props", r'"k": ?([0-9]+)', 1).cast("long").alias("Nvalid_cov"),
    )


def adenine_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, bin, lang, position, mod_type, strand, fraction_mod, Nvalid_cov at every A of both strands of ``sequences``."""
    s = sequences(spark, sf_dir)
    bases = s.select("contig", "bin", "lang", F.posexplode(F.split("seq", "")).alias("at", "base")).where(F.col("base").isin("A", "T"))
    key = F.col("contig").cast("long")
    both = bases.withColumns({"position": F.col("at").cast("long"), "strand": F.when(F.col("base") == "A", "+").otherwise("-")})
    return both.select(
        "contig", "bin", "lang", "position", F.lit("a").alias("mod_type"), "strand",
        (F.pmod(key * 31 + F.col("position") * 17, F.lit(101)) / 100.0).alias("fraction_mod"), F.pmod(key * 7 + F.col("position") * 13, F.lit(40)).alias("Nvalid_cov"),
    )


SEQUENCES = "v_seq as (select cast(doc_id as varchar) as contig, source as bin, lang, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as seq from documents)"
PILEUP = """v_pileup as (select cast(l_suppkey as varchar) as contig, cast(s_nationkey as varchar) as bin,
  cast(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as bigint) as position, l_returnflag as mod_type,
  case when l_linestatus = 'O' then '+' else '-' end as strand, l_discount * 10 as fraction_mod, cast(l_quantity as bigint) as Nvalid_cov
  from lineitem join supplier on s_suppkey = l_suppkey)"""
EVENTS = """v_events as (select event_id, cast(user_id as varchar) as contig, cast(floor(epoch(ts - timestamp '2024-01-01 00:00:00') / 3600) as bigint) as position,
  event_type as mod_type, '+' as strand, least(value / 100, cast(1 as double)) as fraction_mod,
  cast(regexp_extract(props, '"k": ?([0-9]+)', 1) as bigint) as Nvalid_cov from events)"""
ADENINES = f"""{SEQUENCES}, v_base as (select contig, bin, lang, unnest(string_split(seq, '')) as base, unnest(range(0, len(seq))) as position from v_seq where len(seq) > 0),
  v_meth as (select contig, bin, lang, position, 'a' as mod_type, case base when 'A' then '+' else '-' end as strand,
  ((cast(contig as bigint) * 31 + position * 17) % 101) / cast(100 as double) as fraction_mod, (cast(contig as bigint) * 7 + position * 13) % 40 as Nvalid_cov
  from v_base where base in ('A', 'T'))"""


def hits_sql(motifs: list[tuple[str, int, str, int]]) -> str:
    """v_hit: contig, motif, mod_position, strand, position from (motif, position, reverse complement, its position)."""
    parts = []
    for text, at, other, other_at in motifs:
        for strand, x, i in (("+", text, at), ("-", other, other_at)):
            parts.append(
                f"select contig, '{text}' as motif, {at} as mod_position, '{strand}' as strand, s + {i} as position from"
                f" (select contig, seq, unnest(range(0, len(seq) - {len(text) - 1})) as s from v_seq) where regexp_full_match(substr(seq, cast(s + 1 as bigint), {len(text)}), '{x}')"
            )
    return "v_hit as (" + " union all ".join(parts) + ")"
