"""k nearest rows of a stated query set, in blocks of queries."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 5_000


def nearest_rows(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """query_id, key, rank, distance: the k rows nearest to each query but itself, by Euclidean distance (to ``digits``), then key.

    Each block of queries goes to all tasks, which keep k rows a query; the tasks' best are ranked together.
    """
    spark = rows.sparkSession
    todo = queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator()
    out = None
    while block := list(itertools.islice(todo, BLOCK)):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], float)))

        def search(batches, shared=shared):
            ids, q = shared.value
            for b in batches:
                own = b.column(0).to_numpy()
                if not len(own):
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
                order = np.argsort(own, kind="stable")
                own, x = own[order], x[order]
                for a in range(0, len(ids), 256):
                    part = ids[a : a + 256]
                    d = np.sqrt(np.maximum((q[a : a + 256] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q[a : a + 256] @ x.T, 0))
                    d = np.where(part[:, None] == own[None], np.inf, d)
                    top = np.argsort(d.round(digits), axis=1, kind="stable")[:, :k]
                    chosen = np.take_along_axis(d, top, 1)
                    good = np.isfinite(chosen).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(part, top.shape[1])[good], own[top.ravel()][good], chosen.ravel()[good])], ["query_id", key, "distance"])

        found = rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(search, f"query_id long, {key} long, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, {key} long, rank int, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", digits), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "rank", "distance")
