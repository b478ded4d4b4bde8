"""N-gram Jaccard join by chosen paths.

Texts are sets of hashed five-word shingles. Equal sets are one node from the start. A path splits
nodes on a token that they share: the smallest shingle under a hash function, which the path itself
picks. Buckets that stay small are compared by brute force; larger ones are split further, each time
by BRANCHES tokens, so that a pair whose bucket is crowded is lost no more often than another. A
crowded bucket that a token leaves nearly whole is verified as one group in place of that. Runs
repeat with other hash functions until a pair at the threshold is found with the target recall.

What a bucket brings together is not counted there. It joins candidate groups, and each group is
then verified once with its exact sets, in blocks, so that every link inside it counts once and a
pair that all paths missed still counts if both ends are in one group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, discard, in_arrow, join_by_count, runs, small_batches
from .shingles import WordHashes, shingle_set

COORDINATES, DEPTH, MOST_DEPTH, BUCKET, BRANCHES = 64, 2, 6, 128, 2
#: A crowded bucket of which one token keeps so large a part together isn't split further: it is alike throughout.
ALIKE = 0.85
#: A verified group is cut into blocks of about so many nodes, and so many tokens at most.
BLOCK, BLOCK_TOKENS = 1024, 1_000_000
TARGET_RECALL = 0.9999


def survival(threshold: float, depth: int, branches: int = BRANCHES) -> float:
    """The probability that a run brings a pair at the threshold together at ``depth``: on at least one branch of each split beyond DEPTH."""
    below = 1.0
    for _ in range(depth - DEPTH):
        below = 1 - (1 - threshold * below) ** branches
    return threshold**DEPTH * below


def runs_needed(threshold: float, recall: float = TARGET_RECALL) -> int:
    """Runs until a pair at the threshold shares a bucket with probability ``recall``, however far its buckets are split."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, MOST_DEPTH)))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(tokens: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest token under each hash function, as its upper 32 bits."""
    low = np.full(len(multipliers), 2**64 - 1, np.uint64)
    for i in range(0, len(tokens), 4096):
        np.minimum(low, (tokens[i : i + 4096, None] * multipliers).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _summaries(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n (shingles), node (hash of the set), path tokens sig; one row per document."""

    def make():
        words, multipliers = WordHashes(), _multipliers()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, keys, texts = batch.columns
            n, nodes, sigs = [], [], []
            for t in texts.to_pylist():
                s = shingle_set(words.of(t))
                n.append(len(s))
                nodes.append(words_hash(s))
                sigs.append(minima(s, multipliers))
            flat = pa.array(np.concatenate(sigs))
            offsets = pa.array(np.arange(0, COORDINATES * (len(n) + 1), COORDINATES, dtype=np.int32))
            return pa.RecordBatch.from_arrays([ids, keys, pa.array(n, pa.int32()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "key", "n", "node", "sig"])

        return one

    return in_arrow(docs.select("doc_id", F.xxhash64("text"), "text"), make, "doc_id long, key long, n int, node long, sig array<int>")


def words_hash(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _next_path(path: Column, branch: int = 0) -> Column:
    """The path, lengthened by the token at the coordinate that it picks itself, another one for each ``branch``."""
    first = F.xxhash64(path, F.lit("pick"))
    # Steps along the coordinates, so that no two branches pick the same one.
    at = F.pmod(first + branch * (1 + F.pmod(F.shiftright(first, 32), F.lit(COORDINATES // BRANCHES))), F.lit(COORDINATES)).cast("int")
    return F.xxhash64(path, at, F.get("sig", at))


def _near(sig: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket whose path tokens and sizes allow ``threshold``: within four standard errors of it."""
    slack = 4 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    same = np.zeros((len(n), len(n)), np.int32)
    for c in range(0, COORDINATES, 16):
        same += (sig[:, None, c : c + 16] == sig[None, :, c : c + 16]).sum(2, dtype=np.int32)
    fit = (same >= (threshold - slack) * COORDINATES) & (np.minimum.outer(n, n) >= threshold * np.maximum.outer(n, n))
    return np.nonzero(np.triu(fit, 1))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the least member that pairs (a, b) connect it to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def _candidate_edges(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(u, v) that connect all nodes whose pairs the paths have brought together and the sketches allow."""
    start = F.explode(F.sequence(F.lit(0), F.lit(runs_needed(threshold, recall) - 1)))
    rows = nodes.select("node", "n", "sig", start.alias("run")).withColumn("path", F.xxhash64("run"))
    for _ in range(DEPTH):
        rows = rows.withColumn("path", _next_path(F.col("path")))
    rows = rows.select("node", "path", F.lit(None).cast("long").alias("held"))  # held: nodes of the bucket that was split
    small, dense, old = None, None, None
    for depth in range(DEPTH, MOST_DEPTH + 1):
        rows = cut(rows)
        discard(old)
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        sized = cut(rows.join(sizes, "path"))
        fits = sized.where(F.col("size") <= BUCKET).select("node", "path")
        small = fits if small is None else small.union(fits)
        large = sized.where(F.col("size") > BUCKET)
        alike = F.lit(depth == MOST_DEPTH) | F.coalesce(F.col("size") >= ALIKE * F.col("held"), F.lit(False))
        kept = large.where(alike).select("node", "path")
        dense = kept if dense is None else dense.union(kept)
        old = rows
        large = large.where(~alike).select("node", "path", F.col("size").alias("held"))
        if depth == MOST_DEPTH or large.isEmpty():
            break
        split = F.explode(F.array(*(_next_path(F.col("path"), i) for i in range(BRANCHES))))
        rows = large.join(nodes.select("node", "sig"), "node").select("node", split.alias("path"), "held")

    def brute(batches):
        for t in runs(batches, ["path"]):
            if t.num_rows < 2:
                continue
            node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(n), COORDINATES)
            root = forest(len(n), *_near(sig, n, threshold))
            (tied,) = np.nonzero(root != np.arange(len(n)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]])], ["u", "v"])

    with_sig = small.join(nodes.select("node", "n", "sig"), "node")
    edges = with_sig.repartition("path").sortWithinPartitions("path", "node").mapInArrow(brute, "u long, v long")
    # What stays together however it is split, or shares six sampled tokens and still fills a bucket, goes to verification as one group.
    center = dense.groupBy("path").agg(F.min("node").alias("v"))
    edges = edges.union(dense.join(center, "path").where("node <> v").select(F.col("node").alias("u"), "v"))
    return edges.distinct()


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from rows (comp, i, j, block, node, size, tokens): every pair of a block pair once.

    links is the number of documents in nodes at the threshold or above; root a node that these
    links connect it to. Intersections come from products of 0/1 matrices over the shared tokens.
    """

    def blocks(batches):
        for t in runs(batches, ["comp", "i", "j"]):
            node = t.column("node").to_numpy()
            if len(node) > 1 and (again := node[1:] == node[:-1]).any():  # the holder's row was repeated
                t = t.filter(pa.array(~np.concatenate([[False], again])))
            node, size, block = (t.column(c).to_numpy() for c in ("node", "size", "block"))
            lists = t.column("tokens").combine_chunks()
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy()
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            inter = intersections(flat, n)
            union = n[:, None] + n[None, :] - inter
            linked = (inter >= threshold * union - 1e-9) & (inter > 0)
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= block[:, None] != block[None, :]
            links = linked @ size
            root = forest(len(n), *np.nonzero(np.triu(linked)))
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, links, node[root])], ["node", "links", "root"])

    return members.mapInArrow(blocks, "node long, links long, root long")


def intersections(flat: np.ndarray, n: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of sets, laid end to end in ``flat`` with lengths ``n``."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(flat, kind="stable")
    tokens, owner = flat[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.zeros(0, bool)
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros((len(n), len(n)), np.float32)
    first = 0
    while first < len(column):
        last = np.searchsorted(column, column[first] + width)
        a = np.zeros((len(n), column[last - 1] - column[first] + 1), np.float32)
        a[owner[first:last], column[first:last] - column[first]] = 1
        out += a @ a.T
        first = last
    return np.rint(out).astype(np.int64)


def _classes(documents: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, n, node; nodes: node, size, copy_id, component, class_id, n_links and the class's first row's doc_id and key).

    A row's class depends on its text alone, so rows that share or lack an id are told apart by ``key``, a hash of the text.
    """
    small_batches(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    each = cut(_summaries(docs))
    # Equal sets have equal path tokens; the row with the least id lends its text to the verification.
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "key"))
    sets = each.where("n > 0").groupBy("node").agg(holder.alias("h"), F.count("*").alias("size"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    nodes = cut(sets.select("node", "n", "sig", "size", "h"))
    groups = cut(connected_components(_candidate_edges(nodes, threshold, recall)))
    grouped = groups.join(nodes.select("node", F.col("h.doc_id").alias("copy_id"), F.col("h.key").alias("holder"), "size", "n"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int")
    chosen = grouped.join(grouped.groupBy("component").agg(blocks.alias("blocks")), "component")
    blocks = F.col("blocks")
    chosen = chosen.select("node", "copy_id", "holder", "size", F.col("component").alias("comp"), blocks.alias("blocks"), F.pmod(F.hash("node"), blocks).alias("block"))
    keyed = docs.withColumn("key", F.xxhash64("text"))
    texts = keyed.join(chosen.hint("shuffle_hash"), (keyed.key == chosen.holder) & keyed.doc_id.eqNullSafe(chosen.copy_id))
    members = _token_sets(texts.select("node", "size", "comp", "blocks", "block", "text"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = members.select("*", other.alias("other")).select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "size", "tokens"
    )
    spread = spread.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
    verified = cut(_verify(spread, threshold))
    discard(groups)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = links.join(classes, "node", "left").join(nodes.select("node", "h"), "node")
    linked = linked.select("node", "links", F.coalesce("component", "node").alias("component"), "h")
    least = linked.groupBy("component").agg(F.min("h").alias("first"))
    by_node = nodes.select("node", "h", "size").join(linked.join(least, "component").select("node", "links", "first"), "node", "left")
    first = F.coalesce("first", "h")
    by_node = by_node.select(
        "node", "size", F.col("h.doc_id").alias("copy_id"), first["doc_id"].alias("class_id"), first["key"].alias("class_key"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    by_node = cut(by_node)
    discard(verified)
    discard(nodes)
    return each, by_node


def jaccard_classes(documents: DataFrame, threshold: float = 0.8, recall: float = TARGET_RECALL) -> DataFrame:
    """Per document: doc_id, class_id, n_links, copy_id.

    copy_id stands for the documents with the same set of five-word shingles (the least doc_id of
    them); n_links counts the other documents at Jaccard ``threshold`` or above, copies included;
    class_id is the least doc_id of the documents that links connect. Words are runs of word
    characters in lower case; a text of one to four words is a single shingle. Texts without words,
    null ones included, are alone: class_id and copy_id are their doc_id, without links.
    Every row comes back, repeated ones too (they are copies of each other). Rows without doc_id keep
    their links; an id is then missing only if no member of the class has one. An empty table gives an
    empty result; further columns are ignored.
    """
    each, by_node = _classes(documents, threshold, recall)
    rows = each.select("doc_id", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    out = join_by_count(rows, by_node.select("node", "size", "copy_id", "class_id", "n_links"), "node", "size")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"))


def _token_sets(rows: DataFrame) -> DataFrame:
    """``rows`` with their text turned into the sorted shingle hashes; one row per node."""

    def make():
        words = WordHashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(words.of(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            keep = np.array([words_hash(s) for s in sets], np.int64) == batch.column(0).to_numpy()
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*batch.schema.names[:-1], "tokens"])
            return out.filter(pa.array(keep))

        return one

    return in_arrow(rows, make, "node long, size long, comp long, blocks int, block int, tokens array<bigint>")


def one_of_each_class(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``documents`` with one row of each class: of the least doc_id (null ones last), then the least hash of the text. Columns as before.

    Rows that share an id, or have none, are told apart by their texts. Of rows equal in both one stays.
    Texts without words are alone, so all of them stay.
    """
    each, by_node = _classes(documents, threshold, TARGET_RECALL)
    lacks, known = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    first = by_node.select(F.col("class_id").alias("doc_id"), F.col("class_key").alias("key"), F.lit(False).alias("alone"))
    alone = each.where("n = 0").select("doc_id", "key", F.lit(True).alias("alone"))
    stay = first.union(alone).select(lacks.alias("lacks"), known.alias("known"), "key", "alone").distinct()
    bare = documents.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("key"))  # no name can clash
    kept = bare.select("row", lacks.alias("lacks"), known.alias("known"), "key").join(stay.hint("shuffle_hash"), ["lacks", "known", "key"])
    once = kept.where("not alone").groupBy("lacks", "known", "key").agg(F.first("row").alias("row")).select("row")
    return once.union(kept.where("alone").select("row")).select("row.*")
