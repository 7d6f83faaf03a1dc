"""What the two vector searches share: valid vectors, queries dealt to blocks, bounded top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Rows of a block of vectors, about; a fuller group is split.
BLOCK = 4096


def valid(df: DataFrame, id_col: str, vec_col: str, zero_ok: bool) -> DataFrame:
    """(vec_id long, v array<double>) of the rows whose vector is whole: no null, no null or non-finite component, not empty, and not zero unless zero_ok."""
    v = F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero_ok:
        ok = ok & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(ok, F.lit(False)))


def matrix(col) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def first_k(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest scores in order, ties to the smaller id."""
    if len(score) > k:
        near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], score[near]))][:k]


def ranked(found: DataFrame, k: int, nearest: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the first k per query of (query_id, vec_id, score), each pair once."""
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = [F.col("score") if nearest else F.desc("score"), F.col("vec_id")]
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
