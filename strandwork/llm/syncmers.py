"""Document fingerprints of closed syncmers with their places, in DataFrame expressions only.

A text is a row of tokens (runs of non-space of at most eight characters, cut from a word's start).
A k-mer of tokens is an anchor if its smallest inner s-mer, by hash, is its first or its last one.
That choice looks at nothing outside the k-mer, so an edit moves only the anchors that it touches.
The fingerprint is all anchors of the whole text with their places. Two texts match where an anchor
is followed by the same anchor at the same distance in both: runs of such steps are passages that both
have, wherever they stand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens in a k-mer and in an inner s-mer: of seven s-mers two are at the edges, so 2 in 7 k-mers are anchors.
K, S = 8, 2
TOKEN = r"[^\s]{1,8}"
#: Bytes of text in a slice of the table, slices at most, and ids sampled for each slice's bound.
SLICE_BYTES, MOST_SLICES, FOR_EACH_CUT = 4 << 20, 65_536, 32


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with column ``out``: (place, hash) of all closed syncmers of the whole ``text`` column, in order.

    Places count tokens from 0. A text without an anchor has one of its own: its hash at place 0. The hashes
    of tokens and of s-mers are columns of their own, so that each text is cut up once.
    """
    at = F.get
    hashed = df.withColumn("_h", F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    hashed = hashed.withColumn("_s", F.transform("_h", lambda t, i: F.xxhash64(t, at("_h", i + 1))))

    def anchor(first: Column, i: Column) -> Column:
        last = at("_s", i + (K - S))
        edge = F.least(first, last)
        closed = at("_h", i + (K - 1)).isNotNull() & (edge <= F.least(*(at("_s", i + j) for j in range(1, K - S))))
        whole = F.xxhash64(first, *(at("_s", i + j) for j in range(S, K - S, S)), last)
        return F.when(closed, F.struct(i.alias("place"), whole.alias("hash")))

    alone = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(F.concat(F.lit("whole:"), F.col(text))).alias("hash")))
    found = hashed.withColumn(out, F.array_compact(F.transform("_s", anchor))).drop("_h", "_s")
    return found.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(alone))


def steps(anchors: str) -> Column:
    """The distinct steps of a text: an anchor, the distance to the next anchor, and that one; the last anchor alone."""

    def step(a: Column, i: Column) -> Column:
        after = F.get(F.col(anchors), i + 1)
        return F.xxhash64(a["hash"], after["place"] - a["place"], after["hash"])  # the last one has no distance

    return F.array_distinct(F.transform(anchors, step))


def printed(anchors: str) -> Column:
    """hash@place of all anchors, the hash as its upper 32 bits, comma-joined."""
    one = lambda a: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(a["hash"], 32))), 8, "0"), F.lit("@"), a["place"])
    return F.array_join(F.transform(anchors, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Steps that both texts have, of all steps: 1 for equal rows of anchors, 0 for texts without a common step."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _count_below(cuts: list[int], key: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``key``: a search among the ends of stretches, then inside one stretch."""
    if not cuts:
        return F.lit(0)
    width = max(16, math.isqrt(len(cuts)))
    stretches = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    before = F.size(F.filter(longs([x[-1] for x in stretches]), lambda x: x < key))
    inside = F.coalesce(F.get(F.array(*map(longs, stretches)), before), longs([]))
    return F.least(before * width, F.lit(len(cuts))) + F.size(F.filter(inside, lambda x: x < key))


def dealt_in_order(df: DataFrame, key: str, by: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``df`` with _slice, a range of ``key`` of about ``slice_bytes`` of ``by``, and _more; each slice ends with a copy of the row after it.

    Copies have _more false; the last slice ends with the table's first row. Rows with one key stay
    in one slice; null keys go first. The bounds of the ranges come from a sample of keys, chosen by
    their hash, of FOR_EACH_CUT for each slice; all rows are dealt. Only the slices' first rows, at most
    MOST_SLICES of them, are ordered in one task.
    """
    rows, size = df.agg(F.count(key), F.sum(F.octet_length(by))).first()
    slices = min(MOST_SLICES, -(-(size or 0) // slice_bytes))
    cuts: list[int] = []
    if slices > 1:
        every = max(1, rows // (slices * FOR_EACH_CUT))
        keys = df.where(F.pmod(F.xxhash64(key, F.lit("cut")), F.lit(every)) == 0).select(key).where(F.col(key).isNotNull()).toArrow().column(0)
        keys = keys.combine_chunks().sort()
        cuts = sorted({keys[i * len(keys) // slices].as_py() for i in range(1, slices)}) if len(keys) else []
    place = _count_below(cuts, F.col(key))
    rows = df.withColumn("_slice", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place)).withColumn("_more", F.lit(True))
    firsts = rows.groupBy("_slice").agg(F.min(F.struct(key, by)).alias("_f"))
    upto = Window.orderBy("_slice")
    last = Window.orderBy(F.col("_slice").desc())
    ends = firsts.select("_f", F.coalesce(F.lag("_slice").over(upto), F.first("_slice").over(last)).alias("_slice"))
    return rows.unionByName(ends.select(F.col("_f")[key].alias(key), F.col("_f")[by].alias(by), "_slice", F.lit(False).alias("_more")))


def fingerprints(documents: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document's text, by ascending doc_id. A fingerprint is all anchors of the whole
    text, as hash@place; likeness is the share of the two texts' distinct steps that both have. A null
    text counts as empty; rows of one doc_id follow each other by their text. A text without an anchor,
    empty ones and those of fewer than eight tokens included, has its own hash as its only anchor, so
    likeness is 1 for equal ones and else 0. Of a table with one row, the next document is the same row.
    An empty table gives an empty result; further columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Texts move once, bare; what is computed from them stays in the slice's task.
    rows = with_anchors(dealt_in_order(docs, "doc_id", "text", slice_bytes).repartition("_slice"), "text", "anchors").withColumn("steps", steps("anchors"))
    inside = Window.partitionBy("_slice").orderBy(F.col("_more").desc(), F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(inside) for c in ("text", "steps")}).where("_more")
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "anchors", "steps", "next_steps", edited.alias("edited"))
    rows = with_anchors(rows, "edited", "edited_anchors").withColumn("edited_steps", steps("edited_anchors"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed("anchors").alias("fingerprint"), printed("edited_anchors").alias("edited_fingerprint"),
        likeness(F.col("steps"), F.col("edited_steps")).alias("near_edited"),
        likeness(F.col("steps"), F.col("next_steps")).alias("near_next"),
    )
