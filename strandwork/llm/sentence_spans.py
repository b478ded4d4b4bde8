"""Substring deduplication by sliding spans of sentences.

Every run of three consecutive sentences, or of as many more as make ten words, is hashed over the whole corpus; a run that has occurred
before, in the order of documents and places, marks its sentences, and marked sentences go.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, small_batches

SPAN, LEAST_WORDS, LONGEST = 3, 10, 8
#: A sentence ends after its mark and what follows it without space, or at a line's end.
_END = re.compile(r"[.!?]+[^\s\w]*(?=\s)|\n+")
_WORD = re.compile(r"\S+")
_STEPS = (1, 2, 4)  # that double a row up to LONGEST words


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def _starts(words: list[str], heads: np.ndarray) -> np.ndarray:
    """The first words of all units: heads of sentences, and words whose hash with the next is the least of any LONGEST in a row.

    A row that holds a head has no other least, so a sentence of up to LONGEST words isn't cut. Nothing
    but the LONGEST words on either side of a word decides on it.
    """
    n = len(words)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    after = np.append(h[1:], np.uint64(0))
    after[heads[1:] - 1] = 0  # a sentence's last word is taken alone
    mixed = (h ^ (after << np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    value = np.zeros(n + 2 * LONGEST, np.uint64)
    value[LONGEST : LONGEST + n] = (mixed ^ (mixed >> np.uint64(29))) | np.uint64(1)
    value[LONGEST + heads] = 0
    least = value
    for step in _STEPS:
        least = np.minimum(least[:-step], least[step:])
    for step in _STEPS:
        least = np.maximum(least[:-step], least[step:])
    return np.flatnonzero(least[1 : n + 1] == value[LONGEST : LONGEST + n])


def sentences(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, end, hash, words) of the units of a text, in order.

    A unit is a sentence with the space before it; one of more than LONGEST words is cut into units of at
    most so many, at places that its words choose, so that a passage of over 50 words has the same three
    units or more wherever it begins. Words are runs without space; the hash is over them in lower case.
    Stretches without words are no units, and stay.
    """
    text = text or ""
    words = text.lower().split()
    if not words:
        return []
    starts = [m.start() for m in _WORD.finditer(text)]
    ends = [m.end() for m in _END.finditer(text)]
    ends.append(len(text))
    places = np.searchsorted(starts, [0, *ends])
    full = np.flatnonzero(places[1:] > places[:-1]).tolist()
    begins = [0, *ends]
    # By the first word of a sentence: where the text of its first unit starts, and where the sentence before ended.
    heads = {int(places[j]): begins[j] for j in full}
    lasts = {int(places[j + 1]): begins[j + 1] for j in full}
    cuts = _starts(words, np.array(list(heads)))
    out = []
    for i, k in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)]):
        a = heads[i] if i in heads else starts[i]
        b = lasts[k] if k in lasts else starts[k]
        out.append((a, b, xxhash.xxh3_64_intdigest(" ".join(words[i:k])), k - i))
    return out


def span_ends(units: list[tuple[int, int, int, int]], span: int = SPAN, least: int = LEAST_WORDS) -> np.ndarray:
    """By first unit, where its run ends: after ``span`` units, or as many more as make ``least`` words. Units without a whole run have none."""
    w = np.cumsum([0, *(u[3] for u in units)])
    ends = np.maximum(np.searchsorted(w, w[:-1] + least, "left"), np.arange(len(units)) + span)
    return ends[: np.searchsorted(ends, len(units), "right")]


def spans(units: list[tuple[int, int, int, int]], span: int = SPAN, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, hash) of every run of ``span`` units, or as many more as make ``least`` words."""
    ends = span_ends(units, span, least)
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.array([u[2] for u in units], np.uint64)
    first = np.arange(n)
    mixed = np.zeros(n, np.uint64)
    for i in range(int((ends - first).max())):
        on = first[first + i < ends]
        m = (mixed[on] ^ h[on + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed[on] = m ^ (m >> np.uint64(29))
    return first, mixed.view(np.int64)


def _span_rows(rows: DataFrame, span: int, least: int) -> DataFrame:
    """(key, same, hash, at): all spans of the rows (key, same, text)."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, hashes, at = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                a, h = spans(sentences(t), span, least)
                rows.append(np.full(len(a), i))
                at.append(a)
                hashes.append(h)
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            row = pa.array(join(rows))
            return pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns[:2]), pa.array(join(hashes)), pa.array(join(at).astype(np.int32))], ["key", "same", "hash", "at"])

        return one

    return in_arrow(rows, make, "key long, same long, hash long, at int")


def drop_repeated_spans(documents: DataFrame, span: int = SPAN, least: int = LEAST_WORDS) -> DataFrame:
    """Per document: doc_id, text without the covered sentences, n_removed, removed.

    A sentence is removed if any run of ``span`` sentences (or of as many more as make ``least`` words
    together) that covers it occurred before: in an earlier row, or earlier in the same one. The first
    occurrence stays. removed lists the places (start:end in code points, end exclusive) that
    went, comma-joined; white space around a removed sentence stays with its neighbours.

    Null texts count as empty and come back empty. Places are those of rows, not of ids: rows are ordered
    by doc_id (null ones last), then by a hash of the text, so rows that share an id, or have none, each
    keep what no earlier row had. Of rows equal in id and text the first is treated as any other and each
    further one loses all its spans. Texts of fewer than ``span`` sentences or ``least`` words stay. An
    empty table gives an empty result; further columns are ignored.
    """
    small_batches(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("key"), F.xxhash64(F.col("doc_id").isNull(), text).alias("same"), "doc_id", text.alias("text")
    )
    rows = cut(_span_rows(docs.select("key", "same", "text"), span, least))
    # Counts and first places combine in each task before the shuffle, so that a very common span is a few rows.
    first = rows.groupBy("hash").agg(F.min(F.struct("key", "same", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("hash", F.col("first.key").alias("first_key"), F.col("first.same").alias("first_same"), F.col("first.at").alias("first_at")))
    later = rows.join(first, "hash").where("key <> first_key or same <> first_same or at <> first_at")
    covered = later.groupBy("key", "same").agg(F.collect_set("at").alias("at"))  # at most a row's own places
    # Rows equal in id and text are one row with a count; they meet in each task before the shuffle.
    once = docs.groupBy("key", "same").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    marked = once.join(covered, ["key", "same"], "left").select("doc_id", "text", "at", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, gone, removed = [], [], []
            for text, at, copy in zip(*(c.to_pylist() for c in batch.columns[1:])):
                units = sentences(text) if at or copy > 1 else []
                ends = span_ends(units, span, least).tolist()
                marks = {k for i in (at or () if copy == 1 else range(len(ends))) for k in range(i, ends[i])}
                places, kept, end = [], [], 0
                for i in sorted(marks):
                    a, b = units[i][:2]
                    kept.append(text[end:a])
                    end = b
                    if places and places[-1][1] == a:
                        places[-1][1] = b
                    else:
                        places.append([a, b])
                texts.append("".join(kept) + text[end:])
                gone.append(len(marks))
                removed.append(",".join(f"{a}:{b}" for a, b in places))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(removed, pa.string())],
                ["doc_id", "text", "n_removed", "removed"],
            )

        return one

    return in_arrow(marked, make, "doc_id long, text string, n_removed long, removed string")
