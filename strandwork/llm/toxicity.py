"""Toxicity by weak supervision.

Twelve voters (mined lexicons, a fixed lexicon, patterns) each fire or stay silent on a text, so a
text's votes are one of 4,096 masks and the corpus' votes are counts of masks. A generative label
model is fitted on those counts: class balance, each voter's accuracy in both classes, and
correlations as a tree in which each voter also depends on its most telling other voter. Its
posteriors are the labels on which a linear classifier over mined word and prefix features is
trained; the classifier scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, in_arrow, small_batches

#: Bounds of the fit: labelled rows and unlabelled rows that lexicons and classifier are fitted on, and mined features.
MOST_LABELLED, MOST_UNLABELLED, MOST_FEATURES, LEXICONS = 20_000, 5_000, 2_000, 6
THRESHOLD = 0.7

#: The base lexicon.
BASE_LEXICON = frozenset(
    """asshole bastard bitch clown cretin disgusting dumb dumbass filth fool idiot idiotic imbecile jerk loser moron
    moronic pathetic scum scumbag stupid trash vermin vile worthless cabron dreck estupido idiota imbecil salaud
    scheisse connard abruti""".split()
)
WORD = re.compile(r"[^\W\d_]+")
_THREAT = re.compile(r"\b(?:shut up|go die|kill (?:you|them|him|her)\w*|i hate (?:you|them)|nobody likes you|(?:you|they) (?:are|all) (?:such )?(?:an? )?(?:idiot|moron|loser|clown|scum)\w*)")
_MASKED = re.compile(r"[^\W\d_][*@#$]{1,4}[^\W\d_]")
_SHOUT = re.compile(r"!!|\b[A-Z]{4,}(?:\W+[A-Z]{2,}){3}")
VOTERS = [*(f"lexicon{i}" for i in range(LEXICONS)), "base", "several", "threat", "masked", "shout", "none"]
M = len(VOTERS)
_BITS = (np.arange(1 << M)[:, None] >> np.arange(M)) & 1


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    names: dict[str, int]  # feature to its place in the weights
    lexicon: dict[int, int]  # mined feature to its lexicon
    weights: np.ndarray
    bias: float
    prior: float = 0.0
    table: np.ndarray | None = None  # (class, voter, parent's vote): how often the voter fires
    parents: list[int] | None = None

    def lookup(self) -> _Lookup:
        return _Lookup(self.names)


class _Lookup(dict):
    """Word to the places of its features; emptied when it holds very many words."""

    def __init__(self, names: dict[str, int]):
        super().__init__()
        self.names = names

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = tuple(self.names[f] for f in features(word) if f in self.names)
        return found


def found_features(words: set[str], lookup: _Lookup) -> set[int]:
    places: set[int] = set()
    for w in words:
        if f := lookup[w]:
            places.update(f)
    return places


#: After the mined features: a base word; one, two, three or more distinct words with a lexicon's feature.
EXTRA = 4


def active(words: set[str], lookup: _Lookup, lexicon: dict[int, int]) -> list[int]:
    """The classifier's features that a text of these distinct words has, in order."""
    places: set[int] = set()
    hits = 0
    for w in words:
        if f := lookup[w]:
            places.update(f)
            hits += any(p in lexicon for p in f)
    width = len(lookup.names)
    if not words.isdisjoint(BASE_LEXICON):
        places.add(width)
    places.update(range(width + 1, width + 1 + min(hits, 3)))
    return sorted(places)


def votes(text: str | None, lookup: _Lookup, lexicon: dict[int, int]) -> int:
    """The mask of the voters that fire on the whole text."""
    text = text or ""
    words = distinct_words(text)
    places = found_features(words, lookup)
    mask = hits = 0
    for p in places:
        if (k := lexicon.get(p)) is not None:
            mask |= 1 << k
            hits += 1
    mask |= (not words.isdisjoint(BASE_LEXICON)) << LEXICONS
    mask |= (hits >= 4) << (LEXICONS + 1)
    low = text.lower()
    mask |= bool(_THREAT.search(low)) << (LEXICONS + 2)
    mask |= bool(_MASKED.search(text)) << (LEXICONS + 3)
    mask |= bool(_SHOUT.search(text)) << (LEXICONS + 4)
    mask |= (not hits) << (LEXICONS + 5)
    return mask


def mined(sample: DataFrame) -> tuple[dict[str, int], dict[int, int]]:
    """Features that tell the labelled rows' classes apart, and the lexicons that toxic ones are dealt to.

    Document frequencies are counted in Spark and ranked by the likelihood-ratio statistic; the driver
    gets MOST_FEATURES of them. A lexicon's features occur with toxic labels at least three times as
    often as the class balance would have it, in four texts or more.
    """

    def counts():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[min(y, 1)].update({f for w in distinct_words(text) for f in features(w)} | {""})
            keys = list(n[0].keys() | n[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in n)], ["feature", "b", "a"])

        return one

    counted = in_arrow(sample.where("y is not null").select("text", "y"), counts, "feature string, b long, a long")
    counted = cut(counted.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 4 or feature = ''"))
    total = counted.where("feature = ''").first()  # every text has the empty feature
    if total is None or not total.a or not total.b:
        discard(counted)
        names = {w: i for i, w in enumerate(sorted(BASE_LEXICON))}
        return names, {i: i % LEXICONS for i in names.values()}
    n1, n0 = float(total.a), float(total.b)

    def log(k: Column, n: float, q: Column) -> Column:
        return k * F.log(F.greatest(q, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - q, F.lit(1e-12)))

    a, b = F.col("a"), F.col("b")
    p = (a + b) / (n1 + n0)
    g = 2 * (log(a, n1, a / n1) + log(b, n0, b / n0) - log(a, n1, p) - log(b, n0, p))
    best = counted.where("feature <> ''").withColumn("g", F.round(g, 6)).where("g > 12").orderBy(F.desc("g"), "feature").limit(MOST_FEATURES).collect()
    discard(counted)
    names = {r.feature: k for k, r in enumerate(best)}
    toxic = [k for k, r in enumerate(best) if r.a >= 4 and r.a / n1 >= 3 * r.b / n0 and r.a >= r.b]
    return names, {k: j % LEXICONS for j, k in enumerate(toxic)}


def label_model(all_masks: np.ndarray, labelled: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float, np.ndarray, list[int]]:
    """(posterior by mask, class balance, firing table, parents) by expectation maximisation.

    all_masks: counts of masks in the corpus; labelled: (2, masks) counts with labels, weighted up to
    count as much as the corpus. The tree joins voters by their mutual information given the class.
    """
    if labelled.sum():
        weight = max(1.0, all_masks.sum() / labelled.sum())
        start = (labelled[1] + 0.05) / (labelled.sum(0) + 1.0)
    else:
        weight = 0.0
        start = np.where(_BITS[:, : LEXICONS + 3].sum(1) >= 2, 0.9, 0.02)
    posterior = start
    parents = [-1] * M
    for step in range(rounds):
        soft = np.stack([all_masks * (1 - posterior), all_masks * posterior]) + weight * labelled
        soft += 1e-3
        if step == 0:
            parents = _tree(soft)
        balance = float(np.clip(soft[1].sum() / soft.sum(), 0.005, 0.5))
        table = np.empty((2, M, 2))
        log = np.log(np.array([1 - balance, balance]))[:, None].repeat(1 << M, 1)
        for j, parent in enumerate(parents):
            on = _BITS[:, parent] if parent >= 0 else np.zeros(1 << M, int)
            for y in (0, 1):
                for v in (0, 1):
                    n = soft[y, on == v].sum()
                    table[y, j, v] = (soft[y, (on == v) & (_BITS[:, j] == 1)].sum() + 0.5) / (n + 1.0)
                q = table[y, j, on]
                log[y] += np.log(np.where(_BITS[:, j] == 1, q, 1 - q))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-5:
            posterior = new
            break
        posterior = new
    return posterior, balance, table, parents


def _tree(soft: np.ndarray) -> list[int]:
    """Each voter's parent (-1: none) in the maximum spanning tree of class-conditional mutual information."""
    info = np.zeros((M, M))
    total = soft.sum()
    for y in (0, 1):
        n = soft[y].sum()
        pair = (_BITS.T * soft[y]) @ _BITS / n  # P(both fire)
        one = np.diag(pair)
        for bi in (0, 1):
            for bj in (0, 1):
                p = pair if bi and bj else one[:, None] - pair if bi else one[None, :] - pair if bj else 1 - one[:, None] - one[None, :] + pair
                q = np.outer(one if bi else 1 - one, one if bj else 1 - one)
                info += n / total * np.where(p > 1e-12, p * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0)
    np.fill_diagonal(info, 0)
    parents, inside = [-1] * M, {0}
    while len(inside) < M:
        gain, child, parent = max((info[j, i], j, i) for i in inside for j in range(M) if j not in inside)
        inside.add(child)
        if gain > 1e-3:
            parents[child] = parent
    return parents


def fit_linear(flat: np.ndarray, lengths: np.ndarray, target: np.ndarray, width: int, ridge: float = 5e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on sets of features, laid end to end with their lengths, by Adam over all rows."""
    rows = len(lengths)
    owner = np.repeat(np.arange(rows), lengths)
    w, b = np.zeros(width), -2.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(owner, weights=w[flat], minlength=rows)
        residual = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.append(np.bincount(flat, weights=residual[owner], minlength=width) / rows + ridge * w, residual.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Bounded rows (text, y, known): labelled ones outside the held-out third, and unlabelled ones, both first by a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    plain = documents.select("doc_id").where("doc_id is not null").distinct()
    plain = plain.orderBy(F.xxhash64("doc_id", F.lit("plain")), "doc_id").limit(MOST_UNLABELLED)
    chosen = plain.join(F.broadcast(known), "doc_id", "full").select("doc_id", "y")
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Mine features from bounded labelled rows, fit the label model on all texts' votes, the classifier on its posteriors."""
    small_batches(documents.sparkSession)
    sample = cut(_training_rows(documents, labels))

    names, lexicon = mined(sample)

    def count_masks():
        lookup = _Lookup(names)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = np.bincount([votes(t, lookup, lexicon) for t in batch.column(0).to_pylist()], minlength=1)
            (some,) = np.nonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["mask", "n"])

        return one

    counted = in_arrow(documents.select("text"), count_masks, "mask int, n long").groupBy("mask").agg(F.sum("n").alias("n"))
    all_masks = np.zeros(1 << M)
    for r in counted.collect():  # at most 4,096 rows
        all_masks[r.mask] = r.n

    def masks_of():
        lookup = _Lookup(names)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(0).to_pylist()
            found = [active(distinct_words(t), lookup, lexicon) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([votes(t, lookup, lexicon) for t in texts], pa.int32()), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["key", "mask", "y", "places"]
            )

        return one

    keyed = sample.select("text", "y", F.xxhash64("text"))
    rows = in_arrow(keyed, masks_of, "key long, mask int, y int, places array<int>").toArrow().sort_by([("key", "ascending"), ("y", "ascending")])  # bounded by the sample
    discard(sample)
    masks, y = rows.column("mask").to_numpy(), rows.column("y").fill_null(-1).to_numpy()
    labelled = np.stack([np.bincount(masks[y == 0], minlength=1 << M), np.bincount(masks[y >= 1], minlength=1 << M)]).astype(float)
    posterior, balance, table, parents = label_model(all_masks, labelled)
    weights, bias = np.zeros(len(names) + EXTRA), -2.0
    if rows.num_rows:
        lists = rows.column("places").combine_chunks()
        weights, bias = fit_linear(lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()), posterior[masks], len(names) + EXTRA)
    return Model(names, lexicon, weights, bias, balance, table, parents)


def score_texts(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of ``documents``."""

    def make():
        lookup = model.lookup()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            z = np.array([model.bias + model.weights[active(distinct_words(t), lookup, model.lexicon)].sum() for t in batch.column(2).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

        return one

    return in_arrow(documents.select("doc_id", held_out(F.col("doc_id")), "text"), make, "doc_id long, held_out boolean, score double, predicted int")


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on), scored on the whole text.

    Labels are learnt from rows whose crc32(doc_id) mod 3 isn't 1 only, at most MOST_LABELLED of them;
    labels of one doc_id count once, as toxic if any of them is. Null and empty texts have no features
    and get the classifier's base score. Rows with null doc_id aren't held out. Without labels of both
    classes the base lexicon takes the place of the mined ones. Repeated rows stay; an empty table
    gives an empty result; further columns are ignored.
    """
    return score_texts(documents, fit(documents, labels))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without the rejected ones; columns as before."""
    model = fit(documents, labels)

    def make():
        lookup = model.lookup()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            z = [model.bias + model.weights[active(distinct_words(t), lookup, model.lexicon)].sum() for t in batch.column("text").to_pylist()]
            keep = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40))) < THRESHOLD
            return batch.filter(pa.array(keep))

        return one

    return in_arrow(documents, make, documents.schema)
