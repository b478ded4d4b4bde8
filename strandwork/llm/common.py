"""Helpers shared by the corpus operators: shared-folder tables, Arrow streams and components."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; without it a temporary one, in local mode alone, where all tasks see the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or _own_folder()).rstrip("/")


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="strandwork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends at durable files.

    The files go when the session's file systems close; ``discard`` removes them earlier.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandwork/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandwork_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_strandwork_path", None)
    if path:
        fs, target = _file_system(df.sparkSession, path)
        fs.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch of long texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables with the rows of one key each, from batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            column = np.asarray(batch.column(batch.schema.get_field_index(k)))
            change[1:] |= column[1:] != column[:-1]
        first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        change[0] = first != last
        starts = np.flatnonzero(change)
        ends = [*starts.tolist(), n]
        if ends[0] > 0:
            held.append(batch.slice(0, ends[0]))
        for a, b in zip(ends, ends[1:]):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = tuple(batch.column(batch.schema.get_field_index(k))[n - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that is reachable over ``edges`` (u, v).

    Alternates large-star and small-star steps, each a map-side combined minimum and a join, so that
    no step gathers a component in one task. Ends when the edges are stars, checked exactly; more than
    ``most_rounds`` rounds, where a path of n nodes takes about log n, raise an error rather than give a
    part. Nulls and loops are ignored; nodes without an edge to another node aren't returned. An empty
    edge table gives an empty result.
    """
    e = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low).distinct()
        )
        new = cut(small)
        discard(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now[0] == 0 or now == before and _stars(e):
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _stars(e: DataFrame) -> bool:
    """Whether every node has one centre and no centre has one itself: then nothing changes any more."""
    if not e.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


#: Keys that hold so large a share of the rows (1 / HOT) are hot; there are HOT of them at most.
HOT = 4096


def join_by_count(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key``, of which no task gets all rows of a hot key.

    ``right`` has a row for each key and in ``count`` the rows of ``left`` that it has. Keys with 1 / HOT
    of them or more, HOT at most, are broadcast; the others meet by the key. A null key matches nothing.
    Column ``count`` isn't returned. Both sides are read twice: give tables, not plans.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) * HOT >= max(total, 1)).drop(count)
    cold = right.where(F.col(count) * HOT < max(total, 1)).drop(count)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return left.join(F.broadcast(hot), key).unionByName(rest)


def in_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Map Arrow batches with the function that ``make`` builds once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
