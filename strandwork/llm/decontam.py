"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus are rows of a hashed TF-IDF matrix. One pass sums its randomised sketch: with
T the term counts and O a random test matrix, T'T O (terms by a few dozen columns) and the document
frequencies. Frequencies rescale rows and test matrix afterwards, so that pass is enough for the
leading right singular vectors of the weighted matrix. A second pass embeds all windows of all texts
(sums of term vectors) and compares them with windows over the whole of each of the benchmark's items, a
stated query set; windows near an item are confirmed by the longest common subsequence and the item's
answer. No gate on a likeness in few dimensions can be sure of that, so stretches are also searched by
the number of an item's words in them, which the common subsequence can't exceed: that loses none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TERMS, RANK, COLUMNS, PASSAGE = 4096, 48, 56, 32
WINDOWS = (12, 24, 48)  # each twice the one before, and four strides of a multiple of three words
SHORT = 8  # items of fewer words have no windows: they are searched as runs of words
WHOLE = 3  # items of fewer words leak only as whole texts
MOST_ITEMS, QUERIES = 20_000, 4096  # items in one pass over the documents; query windows in one product
COSINE, SHORT_COSINE, SAME, ALIKE, ANSWER = 0.75, 0.65, 0.75, 0.6, 0.8
STEP, STRETCH, BLOCK = WINDOWS[0] // 4, 6, 256  # words in a step, and between the starts of counted stretches; items counted at a time
COMMON = 0.1  # occurrences of a common term in a stretch, for each in the item
_SLICE = 60_000  # tokens at a time
#: Letters, digits, the low line and all characters beyond ASCII make words.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() or b == 0x5F else 0x20 for b in range(256))


class TermColumns(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        c = self[word] = xxhash.xxh3_64_intdigest(word) % TERMS
        return c

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def test_matrix() -> np.ndarray:
    """The random test matrix, with a row of zeros for padding."""
    o = np.random.default_rng(11).standard_normal((TERMS, COLUMNS)).astype(np.float32)
    return np.vstack([o, np.zeros((1, COLUMNS), np.float32)])


def _streams(arrays: list[np.ndarray], pad: int, multiple: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(tokens, starts, first array) of slices of whole arrays, each followed by ``pad`` or more padding tokens up to ``multiple``."""
    held, starts, size, first = [], [], 0, 0
    for i, a in enumerate(arrays):
        if held and size + len(a) > _SLICE:
            yield np.concatenate(held), np.array(starts), first
            held, starts, size, first = [], [], 0, i
        n = len(a) + pad
        n += -n % multiple
        starts.append(size)
        held.append(np.concatenate([a, np.full(n - len(a), TERMS, np.int32)]))
        size += n
    if held:
        yield np.concatenate(held), np.array(starts), first


def _sketch_pass(documents: DataFrame) -> DataFrame:
    """By term: document frequency over passages, the row of T'T O, and the number of passages at term -1."""
    names = [f"c{i}" for i in range(COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, o = TermColumns(), test_matrix()
        frequency = np.zeros(TERMS + 1, np.int64)
        sums = np.zeros((COLUMNS, TERMS + 1))
        passages = 0
        for batch in batches:
            for tokens, _, _ in _streams([columns.of(words_of(t)) for t in batch.column(0).to_pylist()], 0, PASSAGE):
                rows = tokens.reshape(-1, PASSAGE)
                passages += len(rows)
                y = o.take(rows[:, 0], 0)
                for i in range(1, PASSAGE):
                    y += o.take(rows[:, i], 0)
                for c in range(COLUMNS):
                    sums[c] += np.bincount(tokens, weights=np.repeat(y[:, c], PASSAGE), minlength=TERMS + 1)
                ordered = np.sort(rows, axis=1)
                new = np.ones(ordered.shape, bool)
                new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
                frequency += np.bincount(ordered[new], minlength=TERMS + 1)
        (some,) = np.nonzero(frequency[:TERMS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(frequency[some], passages)), *(pa.array(np.append(sums[c, some], 0.0)) for c in range(COLUMNS))],
            ["term", "frequency", *names],
        )

    rows = documents.select("text").mapInArrow(run, "term int, frequency long, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("term").agg(F.sum("frequency").alias("frequency"), *(F.sum(n).alias(n) for n in names))


def latent_terms(documents: DataFrame) -> np.ndarray:
    """Term vectors (TERMS + 1 by RANK, the last row zero) from the leading right singular vectors.

    A text folds in as its weighted terms times the vectors over the singular values, so that what all
    texts of a language share doesn't outweigh the rest. A randomised decomposition over all passages
    of all documents; the driver gets TERMS rows.
    """
    frequency, product, passages = np.zeros(TERMS), np.zeros((TERMS, COLUMNS)), 0
    for r in _sketch_pass(documents).collect():  # one row for each hashed term
        if r.term < 0:
            passages = r.frequency
        else:
            frequency[r.term], product[r.term] = r.frequency, r[2:]
    idf = np.log((passages + 1) / (frequency + 1)) + 0.1
    core = test_matrix()[:TERMS].T.astype(float) @ product
    core = (core + core.T) / 2
    scale = max(float(np.trace(core)), 1e-9)
    values, vectors = np.linalg.eigh(core + np.eye(COLUMNS) * scale * 1e-10)
    half = (idf[:, None] * product) @ (vectors / np.sqrt(np.maximum(values, scale * 1e-10)))
    left, roots, _ = np.linalg.svd(half, full_matrices=False)
    vectors = idf[:, None] ** 2 * left[:, :RANK] / np.maximum(roots[:RANK], max(float(roots[0]), 1e-9) * 1e-4)
    return np.vstack([vectors / max(float(np.abs(vectors).max()), 1e-30), np.zeros((1, RANK))]).astype(np.float32)


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]
    masks: dict[bytes, int]
    answer_masks: dict[bytes, int]
    window: int

    @property
    def reach(self) -> int:
        """Words in a passage that is held against the item."""
        return len(self.words) + 2 * max(4, len(self.words) // 4)

    @property
    def least(self) -> int:
        """Words of the item that a leak has in order, at least."""
        return math.ceil(ALIKE * len(self.words) - 1e-9)

    def offsets(self) -> list[int]:
        """Starts of the query windows: half a window apart, and the last one ends with the item."""
        last = max(0, len(self.words) - self.window)
        return sorted({*range(0, last, self.window // 2), last})


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(masks: dict[bytes, int], size: int, other: list[bytes]) -> int:
    """Length of the longest common subsequence with ``other``, bit-parallel over the first sequence's ``size`` places."""
    full = (1 << size) - 1
    v = full
    for w in other:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def benchmark_items(benchmark: DataFrame) -> list[Item]:
    """The query set, on the driver: the benchmark's items with a word or more. An item's answer is its last sentence of three words or more."""
    out = []
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = words_of(r.text)
        if not words:
            continue
        ends = [s for x in re.split(r"[.!?]+\s|\n+", r.text) if len(s := words_of(x)) >= 3]
        answer = ends[-1] if ends else words
        out.append(Item(r.item_id, words, answer, _masks(words), _masks(answer), max((w for w in WINDOWS if w <= len(words)), default=WINDOWS[0])))
    return out


class WordCounts:
    """Stretches that may hold an item: as many of its words, and as many of them in order, as a leak has.

    A stretch starts at every STRETCH-th word and is long enough for all passages that start before the
    next one. Words are told apart by hashed term and repeated words count again, so a count is never
    too low; nor is the common subsequence of terms, which is held against the item's first 64 words and,
    of a longer item, all others counted as found. Terms that are common in the first texts aren't
    counted but taken as found: that changes how many stretches are looked at, and never the result.
    """

    def __init__(self, items: list[Item], columns: TermColumns):
        self.items, self.blocks = items, []
        self.places = [columns.of(i.words) for i in items]
        self.words = np.array([i.reach + STRETCH - 1 for i in items])
        self.full = np.array([(1 << min(64, len(i.words))) - 1 for i in items], np.uint64)
        self.slack = np.array([len(i.words) - i.least for i in items])

    def _build(self, tokens: np.ndarray) -> None:
        items = self.items
        share = np.bincount(tokens, minlength=TERMS + 1)[:TERMS] / max(1, np.count_nonzero(tokens != TERMS))
        steps = -(-self.words // STRETCH)
        steps += steps % 2
        order = np.argsort(self.words, kind="stable")
        for a in range(0, len(items), BLOCK):
            at = order[a : a + BLOCK]
            m = steps[at]
            least = np.array([items[k].least for k in at])
            own = np.zeros((TERMS + 1, len(at)), np.uint8 if m[-1] * STRETCH < 256 else np.uint32)
            masks = np.zeros((len(at), TERMS + 1), np.uint64)
            for c, k in enumerate(at.tolist()):
                for i, term in enumerate(self.places[k][:64].tolist()):
                    masks[c, term] |= np.uint64(1 << i)
                terms, times = np.unique(self.places[k], return_counts=True)
                own[terms, c] = 1
                for i in np.argsort(-share[terms] / times).tolist():
                    if share[terms[i]] * self.words[k] < COMMON * times[i] or least[c] - times[i] < 3:
                        break
                    own[terms[i], c] = 0
                    least[c] -= times[i]
            edges = [0, *(np.flatnonzero(np.diff(m)) + 1).tolist(), len(at)]
            self.blocks.append((at, own, masks.ravel(), [(x, y, int(m[x]), least[x:y].astype(own.dtype)) for x, y in zip(edges, edges[1:])]))

    def near(self, tokens: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) of all stretches that have enough of the item's words in order."""
        if not self.blocks:
            self._build(tokens)
        n = len(tokens) // STRETCH
        for at, own, masks, groups in self.blocks:
            most = groups[-1][2]
            sums = [np.zeros((n + most, len(at)), own.dtype)]
            for i in range(STRETCH):
                sums[0][:n] += own.take(tokens[i::STRETCH], 0)
            while 2 << len(sums) - 1 <= most:
                half = 1 << len(sums) - 1
                sums.append(sums[-1][:-half] + sums[-1][half:])
            enough = np.empty((n, len(at)), bool)
            for x, y, m, least in groups:
                parts, done = [], 0
                for bit in range(m.bit_length()):
                    if m >> bit & 1:
                        parts.append(sums[bit][done : done + n, x:y])
                        done += 1 << bit
                total = parts[0]
                for part in parts[1:]:
                    total = total + part
                np.greater_equal(total, least, out=enough[:, x:y])
            flat = np.flatnonzero(enough)
            rows, cols = flat // len(at), flat % len(at)
            by = np.argsort(cols, kind="stable")
            items, places = at[cols[by]], rows[by] * STRETCH
            inside = self._in_order(cols[by], items, masks, tokens, places)
            yield from zip(places[inside].tolist(), items[inside].tolist())

    def _in_order(self, cols: np.ndarray, items: np.ndarray, masks: np.ndarray, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which stretches, by the width of their items, share a long enough subsequence of terms: bit-parallel over all of them."""
        if not len(places):
            return np.zeros(0, bool)
        widths = self.words[items]
        padded = np.concatenate([tokens, np.full(widths[-1], TERMS, np.int32)])
        full = self.full[items]
        v, base = full.copy(), cols * (TERMS + 1)
        for i in range(widths[-1]):
            a = int(np.searchsorted(widths, i, "right"))
            here = v[a:]
            u = here & masks[base[a:] + padded[places[a:] + i]]
            v[a:] = ((here + u) | (here - u)) & full[a:]
        return np.bitwise_count(v) <= self.slack[items]


class ShortItems:
    """Items of fewer than SHORT words, found as runs of whole words by one Aho-Corasick pass over a text's words."""

    def __init__(self, items: list[Item]):
        self.found_in, self.whole = None, {}
        by_words: dict[str, list[int]] = {}
        for item in items:
            run = f" {b' '.join(item.words).decode('latin-1')} "
            if len(item.words) < WHOLE:
                self.whole.setdefault(run, []).append(item.item_id)
            else:
                by_words.setdefault(run, []).append(item.item_id)
        if by_words:
            import ahocorasick

            self.found_in = ahocorasick.Automaton()
            for run, ids in by_words.items():
                self.found_in.add_word(run, ids)
            self.found_in.make_automaton()

    def near(self, words: list[bytes]) -> list[int]:
        """item_ids that stand in the text, as often as the benchmark has them."""
        if not self.whole and self.found_in is None:
            return []
        run = f" {b' '.join(words).decode('latin-1')} "
        found = {id(ids): ids for _, ids in self.found_in.iter(run)} if self.found_in is not None else {}
        return [*self.whole.get(run, []), *(x for ids in found.values() for x in ids)]


class Search:
    """All items against batches of texts. Built once in each task."""

    def __init__(self, items: list[Item], terms: np.ndarray, cosine: float):
        self.terms, self.columns = terms, TermColumns()
        self.items = [i for i in items if len(i.words) >= SHORT]
        self.short = ShortItems([i for i in items if len(i.words) < SHORT])
        self.queries: dict[int, Queries] = {}
        for w in sorted({i.window for i in self.items}):
            own = [(k, o) for k, i in enumerate(self.items) if i.window == w for o in i.offsets()]
            q = np.stack([terms[self.columns.of(self.items[k].words[o : o + w])].sum(0) for k, o in own])
            least = np.array([cosine if len(self.items[k].words) >= w else min(cosine, SHORT_COSINE) for k, _ in own], np.float32)
            self.queries[w] = Queries(own, (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).T.astype(np.float32), least)
        self.counts = WordCounts(self.items, self.columns)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """(row, item_id, cosine, lcs) of every text and item that leaks into it."""
        out: list[tuple[int, int, float, float]] = []
        terms: list[np.ndarray] = []
        for row, t in enumerate(texts):
            words = words_of(t)
            out += [(row, item, 1.0, 1.0) for item in self.short.near(words)]
            terms.append(self.columns.of(words))
        if self.items:
            for tokens, starts, first in _streams(terms, WINDOWS[-1], WINDOWS[-1]):
                out += self._in_stream(tokens, starts, texts, first)
        return out

    def _in_stream(self, tokens: np.ndarray, starts: np.ndarray, texts: list[str | None], first: int) -> Iterator[tuple[int, int, float, float]]:
        found: set[tuple[int, int]] = set()
        words = _Words(texts, first)
        windows: dict[int, np.ndarray] = {}
        steps = self.terms.take(tokens[0::STEP], 0)
        for i in range(1, STEP):
            steps += self.terms.take(tokens[i::STEP], 0)
        for w, query in self.queries.items():
            while len(tokens) // len(steps) < w // 4:
                steps = steps[0::2] + steps[1::2]
            e = steps[:-3] + steps[1:-2] + steps[2:-1] + steps[3:]
            e /= np.maximum(np.sqrt(np.einsum("ij,ij->i", e, e)), 1e-6)[:, None]
            windows[w] = e
            for a in range(0, len(query.own), QUERIES):
                like = e @ query.vectors[:, a : a + QUERIES]
                near = np.flatnonzero(like >= query.least[a : a + QUERIES])
                for r, c in zip(*(x.tolist() for x in np.divmod(near, like.shape[1]))):
                    doc = int(np.searchsorted(starts, r * (w // 4) + w // 8, "right")) - 1
                    k, o = query.own[a + c]
                    if (doc, k) not in found and (lcs := confirm(self.items[k], words[doc], int(r * (w // 4) - starts[doc]) - o)) is not None:
                        found.add((doc, k))
                        yield first + doc, self.items[k].item_id, float(like[r, c]), lcs
        for place, k in self.counts.near(tokens):
            doc = int(np.searchsorted(starts, place, "right")) - 1
            start = int(place - starts[doc])
            if (doc, k) in found or start >= len(words[doc]):
                continue
            item = self.items[k]
            if (lcs := confirm_near(item, words[doc], start)) is not None:
                e, query, w = windows[item.window], self.queries[item.window], item.window
                here = slice(place // (w // 4), (place + item.reach) // (w // 4) + 1)
                like = e[here] @ query.vectors[:, query.of(k)]
                found.add((doc, k))
                yield first + doc, item.item_id, float(like.max(initial=-1.0)), lcs


class _Words(dict):
    """By document of a stream, its words, cut up when they are first asked for."""

    def __init__(self, texts: list[str | None], first: int):
        super().__init__()
        self.texts, self.first = texts, first

    def __missing__(self, doc: int) -> list[bytes]:
        out = self[doc] = words_of(self.texts[self.first + doc])
        return out


@dataclass
class Queries:
    """The query windows of one width: (item, offset) of each, their unit vectors as columns, and the least cosine."""

    own: list[tuple[int, int]]
    vectors: np.ndarray
    least: np.ndarray
    by_item: dict[int, list[int]] = field(default_factory=dict)

    def of(self, item: int) -> list[int]:
        if not self.by_item:
            for c, (k, _) in enumerate(self.own):
                self.by_item.setdefault(k, []).append(c)
        return self.by_item[item]


def _searches(documents: DataFrame, benchmark: DataFrame) -> list:
    """A broadcast of (items, term vectors) for each pass over the documents: MOST_ITEMS items at a time, so no broadcast outgrows them."""
    spark = documents.sparkSession
    small_batches(spark, 1000)
    items = benchmark_items(benchmark)
    terms = latent_terms(documents) if items else None
    return [spark.sparkContext.broadcast((items[a : a + MOST_ITEMS], terms)) for a in range(0, len(items), MOST_ITEMS)]


def leaks(documents: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per document and item that leaks into it: doc_id, item_id, cosine, lcs.

    lcs is the longest common subsequence of the item's and the passage's words over the item's words.
    A passage leaks the item if lcs is SAME or more, or ALIKE or more with ANSWER or more of the answer's
    words in order. cosine is the latent likeness of the confirmed window.

    A passage is any stretch of the item's words and a quarter (or four words) more on either side.
    Whole texts are searched, and every such passage is held against every item that it has enough words
    of, whatever its latent likeness; cosine is then the highest of the passage's windows. An item of
    three to seven words leaks where they stand in a row, one of one or two only into a text that has no
    others (cosine and lcs are 1). Null and empty texts leak nothing. Repeated rows of documents or
    items give repeated results. An empty table on either side gives an empty result; further columns
    are ignored.
    """
    names, schema = ["doc_id", "item_id", "cosine", "lcs"], "doc_id long, item_id long, cosine double, lcs double"
    passes = []
    for shared in _searches(documents, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(*shared.value, cosine)
            for batch in batches:
                at, item, c, lcs = zip(*found) if (found := search.find(batch.column(1).to_pylist())) else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(item, pa.int64()), pa.array(c, pa.float64()), pa.array(lcs, pa.float64())], names)

        passes.append(documents.select("doc_id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.union, passes) if passes else documents.sparkSession.createDataFrame([], schema)


def confirm(item: Item, words: list[bytes], start: int) -> float | None:
    """The share of the item that the passage around ``start`` has in order, if that makes it a leak."""
    n = len(item.words)
    slack = max(4, n // 4)
    return _leaked(item, words[max(0, start - slack) : max(0, start + n + slack)])


def confirm_near(item: Item, words: list[bytes], start: int) -> float | None:
    """The same for the passages that start within STRETCH words of ``start``."""
    if common_subsequence(item.masks, len(item.words), words[start : start + STRETCH - 1 + item.reach]) < item.least:
        return None
    for a in range(start, start + STRETCH):
        if (lcs := _leaked(item, words[a : a + item.reach])) is not None:
            return lcs
    return None


def _leaked(item: Item, passage: list[bytes]) -> float | None:
    n = len(item.words)
    lcs = common_subsequence(item.masks, n, passage) / n
    if lcs >= SAME:
        return lcs
    if lcs >= ALIKE and common_subsequence(item.answer_masks, len(item.answer), passage) >= ANSWER * len(item.answer):
        return lcs
    return None


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that any item leaks into; columns as before.

    Each row is judged by its own text, whatever its doc_id, so rows without an id, or that share one, are
    no exception. Null and empty texts stay; an empty benchmark takes nothing.
    """
    at = documents.columns.index("text")
    for shared in _searches(documents, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(*shared.value, COSINE)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in search.find(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
