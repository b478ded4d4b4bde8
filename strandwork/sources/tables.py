"""Tab-separated tables in and out, cached intermediate tables, and graph files."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOTIF_COLUMNS = [
    "reference", "motif", "mod_position", "mod_type", "n_mod", "n_nomod", "motif_type",
    "motif_complement", "mod_position_complement", "n_mod_complement", "n_nomod_complement",
]
METHYLATION_SCHEMA = "contig string, motif string, mod_type string, mod_position tinyint, methylation_value double, mean_read_cov double, n_motif_obs int"


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if schema:
        return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def write_tsv(df: DataFrame, path: str, header: bool = True, order: list[str] | None = None) -> None:
    """One file at ``path``: results for people, small by nature. Only the last step, sorting and writing, is one task's."""
    one = df.repartition(1)
    staged = f"{path}.parts"
    (one.sortWithinPartitions(*order) if order else one).write.mode("overwrite").csv(staged, sep="\t", header=header, emptyValue="")
    spark = df.sparkSession
    folder, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), None)
    fs.delete(target, True)
    if part is not None:
        fs.rename(part, target)
    else:
        out = fs.create(target)
        out.write(("\t".join(df.columns) + "\n").encode() if header else b"")
        out.close()
    fs.delete(folder, True)


def read_contamination(spark: SparkSession, path: str) -> DataFrame:
    out = read_tsv(spark, path)
    if "contig" not in out.columns:
        raise ValueError(f"{path} has no column contig")
    return out


def write_motifs(motifs: DataFrame, path: str) -> None:
    """The formatted motif table, sorted; columns of structs are left out."""
    have = [c for c in MOTIF_COLUMNS if c in motifs.columns]
    write_tsv(motifs.select(*have), path, order=["reference", "mod_type", "motif"])


def write_plain(df: DataFrame, path: str) -> None:
    """A debug table without its nested columns."""
    write_tsv(df.select(*(n for n, t in df.dtypes if not t.startswith(("struct", "array", "map")))), path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``, made and written first if it isn't there or ``force`` is set."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if force or not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_tsv(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame], inputs: dict, force: bool = False) -> DataFrame:
    """The table at ``path``, made first if it isn't there, ``force`` is set or it was made from other inputs.

    What it was made from lies beside it; a table without that record is taken as it is.
    """
    record = Path(path + ".inputs.json")
    same = not record.exists() or json.loads(record.read_text()) == inputs
    if force or not same or not Path(path).is_file():
        record.unlink(missing_ok=True)
        write_tsv(make(), path)
        record.write_text(json.dumps(inputs))
    return read_tsv(spark, path, schema)


def combine_positions(parts: DataFrame) -> DataFrame:
    """(contig, mod_type, motif, positions): motif positions from many files, each once, sorted."""
    return parts.groupBy("contig", "mod_type", "motif").agg(F.array_sort(F.collect_set("position")).alias("positions"))


def require(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns present, cast and in order; bin or contig may stand for reference. ValueError names what is missing."""
    for other in ("bin", "contig"):
        if "reference" in columns and "reference" not in df.columns and other in df.columns:
            df = df.withColumnRenamed(other, "reference")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()), *(c for c in df.columns if c not in columns))


def write_graph(nodes: list[dict], edges: list[tuple[str, str]], path: str) -> None:
    """A motif graph of one search as GML (by ending) or JSON; attributes that aren't numbers, strings or flags are left out."""
    plain = [{k: v for k, v in n.items() if isinstance(v, (int, float, str, bool))} for n in nodes]
    if path.endswith(".json"):
        Path(path).write_text(json.dumps({"nodes": plain, "links": [{"source": a, "target": b} for a, b in edges]}))
        return
    number = {n["id"]: i for i, n in enumerate(plain)}
    value = lambda v: str(int(v)) if isinstance(v, bool) else json.dumps(v)
    lines = ["graph [", "  directed 1"]
    for n in plain:
        lines += ["  node [", f"    id {number[n['id']]}", f"    label {json.dumps(n['id'].strip('.'))}", *(f"    {k} {value(v)}" for k, v in n.items() if k != "id"), "  ]"]
    for a, b in edges:
        lines += ["  edge [", f"    source {number[a]}", f"    target {number[b]}", "  ]"]
    Path(path).write_text("\n".join([*lines, "]"]) + "\n")
