"""Packing of tokenised documents into sequences: a configuration linear program over the length histogram.

Lengths up to the sequence length are classes, so the program has at most that many rows however
large the corpus is. Multiplicative weights over the classes price their tokens; a knapsack dynamic
program finds the pattern that is worth most at these prices. The patterns' shares are rounded down,
and what they leave is packed best-fit decreasing, by whole classes. Pieces then take their places
by rank within their class, which is a join with the bounded table of places.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_arrow, small_batches

SEQUENCE, END_ID, SALTS, ROUNDS = 2048, 0, 64, 300
#: White space before a space: only then a run of spaces belongs to two words.
_SPACES = re.compile(r"\s ")
_SPECIAL = re.compile(r"<\|[^|]*\|>")

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: how byte-level BPE cuts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The tokenizer's ids by their bytes, if its merges come in the order of the ids they make and cut as PIECES; else None.

    Then the lowest id among neighbours is the first merge, so an encoder by ranks gives the same ids.
    """
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    before, vocabulary, merges = model.get("pre_tokenizer") or {}, model["model"]["vocab"], model["model"].get("merges", [])
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not model.get("normalizer")
    if not plain or model["model"].get("ignore_merges") or model["model"].get("dropout"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    made = [vocabulary.get(a + b) for a, b in pairs]
    if None in made or any(y <= x for x, y in zip(made, made[1:])):
        return None
    # Printable bytes stand for themselves, the others for the characters from 256 on.
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in set(own)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    words = [w for w in vocabulary if w not in special]
    return {bytes(byte[c] for c in w): vocabulary[w] for w in words} if all(c in byte for w in words for c in w) else None


class Encoder:
    """Token ids as little-endian bytes. Words with the space before them are encoded apart: byte-level BPE never joins over such a space.

    Short words are encoded once. Texts in which white space meets a space, or with special tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 400_000, longest: int = 16):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.words: dict[str, bytes] = {}
        ranks = byte_ranks(path)
        if ranks is not None:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        else:
            self.ranked = None

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        ids = self.ranked.encode_ordinary(word)
        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        if len(word) <= self.longest:
            self.words[word] = out.tobytes()
        return out.tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        if len(self.words) > self.most:
            self.words.clear()
        known, encode = self.words.get, self._word
        for t in texts:
            if self.ranked is None or _SPACES.search(t) or _SPECIAL.search(t):
                out.append(None)
                continue
            first, *rest = t.split(" ")
            parts = [known(w) or encode(w) for w in [" " + x for x in rest]]
            out.append((encode(first) if first else b"") + b"".join(parts))
        whole = iter(self._plain([t for t, x in zip(texts, out) if x is None]))
        return [next(whole) if x is None else x for x in out]


def cut_points(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, after a first piece that may be shorter."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(documents: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, then id 0, cut where longer than ``size``."""
    small_batches(documents.sparkSession)

    def make():
        encoder = Encoder(tokenizer)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            at: list[int] = []
            for i, ids in enumerate(encoder.batch([t or "" for t in batch.column(1).to_pylist()])):
                ids += END_ID.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, size)):
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            piece, start, length, crc = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

        return one

    return in_arrow(documents.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def worth_most(lengths: np.ndarray, prices: np.ndarray, size: int) -> Pattern:
    """The pattern within ``size`` whose pieces are worth most: an unbounded knapsack by dynamic programming."""
    value, last = np.zeros(size + 1), np.zeros(size + 1, int)
    fitting = np.searchsorted(lengths, np.arange(size + 1), "right")
    for w in range(1, size + 1):
        value[w] = value[w - 1]
        if n := fitting[w]:
            v = value[w - lengths[:n]] + prices[:n]
            k = int(v.argmax())
            if v[k] > value[w]:
                value[w], last[w] = v[k], lengths[k]
    pattern, w = Counter(), size
    while w > 0:
        if last[w]:
            pattern[int(last[w])] += 1
            w -= int(last[w])
        else:
            w -= 1
    return tuple(sorted(pattern.items(), reverse=True))


def solve(counts: dict[int, int], size: int, rounds: int = ROUNDS) -> list[tuple[Pattern, float]]:
    """Patterns with the number of sequences of each that together hold about all pieces, by multiplicative weights."""
    lengths = np.array(sorted(counts))
    demand = np.array([counts[x] for x in lengths.tolist()], float)
    sequences = max(1.0, float((lengths * demand).sum()) / size)
    prices = lengths / size
    used: Counter[Pattern] = Counter()
    place = {x: i for i, x in enumerate(lengths.tolist())}
    covered = np.zeros(len(lengths))
    for t in range(1, rounds + 1):
        pattern = worth_most(lengths, prices, size)
        used[pattern] += 1
        for x, a in pattern:
            covered[place[x]] += a
        # A class that its share of the rounds has over-served becomes cheaper, an under-served one dearer.
        surplus = covered * sequences / demand / t - 1
        rate = 0.5 / np.sqrt(t)
        prices = prices * np.exp(-rate * np.clip(surplus, -1, 1))
        prices = np.clip(prices, lengths / size * 0.5, lengths / size * 1.5)
    return [(p, sequences * n / rounds) for p, n in used.items()]


def best_fit(counts: Counter, size: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing by whole classes: all sequences with one pattern fill alike, so counts of any size cost the same."""
    groups: dict[int, list[tuple[Pattern, int]]] = {size: []}  # by room left
    for x in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        left = counts[x]
        for room in sorted(r for r in groups if r >= x):
            if not left or room == size:
                break
            most, kept = room // x, []
            for pattern, n in groups[room]:
                full = min(n, left // most)
                if full:
                    groups.setdefault(room - most * x, []).append(((*pattern, (x, most)), full))
                    left -= full * most
                if n > full and 0 < left < most:
                    groups.setdefault(room - left * x, []).append(((*pattern, (x, left)), 1))
                    left, full = 0, full + 1
                if n > full:
                    kept.append((pattern, n - full))
            groups[room] = kept
        if left:
            most = size // x
            if left // most:
                groups.setdefault(size - most * x, []).append((((x, most),), left // most))
            if left % most:
                groups.setdefault(size - (left % most) * x, []).append((((x, left % most),), 1))
    return [g for room, gs in groups.items() for g in gs]


def plan(counts: dict[int, int], size: int = SEQUENCE, rounds: int = ROUNDS) -> list[tuple[Pattern, int]]:
    """(pattern, number of sequences) that hold exactly ``counts`` pieces of each length.

    The program's patterns are rounded down in turn, fullest first, as far as the pieces last; what is
    left goes through the program once more, and then best-fit decreasing.
    """
    left = Counter({x: n for x, n in counts.items() if n > 0})
    out: list[tuple[Pattern, int]] = []
    for again in range(2):
        if sum(left.values()) < 200:
            break
        solved = solve(dict(left), size, rounds if not again else rounds // 3)
        for pattern, share in sorted(solved, key=lambda p: (-sum(x * a for x, a in p[0]), -p[1], p[0])):
            if sum(x * a for x, a in pattern) < 0.995 * size:
                continue
            n = min(int(share), *(left[x] // a for x, a in pattern))
            if n:
                out.append((pattern, n))
                for x, a in pattern:
                    left[x] -= a * n
                left = +left
    return out + best_fit(left, size)


def places(planned: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, pieces in one sequence, first sequence and offset of each run of places, by rank."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for pattern, n in planned:
        offset = 0
        for x, a in pattern:
            runs.setdefault(x, []).append((ranks[x], a, sequence, offset))
            ranks[x] += a * n
            offset += a * x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


def pack(documents: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: none), then id 0. Longer ones than ``size`` are cut into
    whole sequences after a first piece that may be shorter. Sequences hold at most ``size`` ids without
    gaps. Repeated rows and ids are documents of their own. An empty table gives an empty result;
    further columns are ignored.
    """
    cutup = cut(pieces(documents, tokenizer or default_tokenizer(), size))
    histogram = {r.length: r.n for r in cutup.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    table = places(plan(histogram, size))
    # Ranks within a class: inside each salt of it, after the counts of the lesser salts.
    salted = cutup.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    tops = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start"))
    # The table of salts has at most size x SALTS rows whatever the corpus.
    ranked = salted.withColumn("inside", inside).join(F.broadcast(tops), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                (at,) = np.nonzero(length == x)
                first, each, start, place = table[x]
                k = np.searchsorted(first, rank[at], "right") - 1
                beyond = rank[at] - first[k]
                sequence[at] = start[k] + beyond // each[k]
                offset[at] = place[k] + beyond % each[k] * x
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

        return one

    return in_arrow(ranked, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
