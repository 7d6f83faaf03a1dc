"""Similarity search of vectors in a codebook (idx, v): cleanup, invert, top-k, all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.similarity import METRICS

#: A codebook of at most these bytes is sent to every task; a larger one is searched in blocks.
BROADCAST_BYTES = 64 << 20
BLOCK = 4096


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m.astype(float) ** 2).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros(m.shape), where=n > 1e-10)


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(float) if len(col) else np.zeros((0, 1))


def _cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines from exact integer dots and norms, so that equal inputs give equal results."""
    nq, nc = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    d = np.outer(nq, nc)
    return np.divide(q @ c.T, d, out=np.zeros(d.shape), where=(nq > 1e-10)[:, None] & (nc > 1e-10)[None])


def topk_similar(queries: DataFrame, codebook: DataFrame, k: int, threshold: float | None = None, qid: str = "qid") -> DataFrame:
    """(qid, rank, idx, sim): the k most similar codebook rows by cosine per row of queries (qid, v), ties to the smaller idx; with threshold only those that reach it.

    The codebook's size is counted first: a small one goes to every task, queries stream past it in batches. A large one is cut into blocks of about BLOCK rows, as the queries are, each pair of blocks meets in a group of its own, and only k rows per query and block are shuffled.
    """
    n = codebook.count()
    first = codebook.select(F.size("v")).first()
    dims = first[0] if first else 0

    def best(ids, q, idx, c):
        s = _cosines(q, c)
        out = []
        for i, row in zip(ids, s, strict=True):
            ok = np.arange(len(row)) if threshold is None else np.flatnonzero(row >= threshold)
            if len(ok) > k:
                ok = ok[row[ok] >= np.partition(row[ok], len(ok) - k)[len(ok) - k]]
            ok = ok[np.lexsort((idx[ok], -row[ok]))][:k]
            out += [(i, int(idx[j]), float(row[j])) for j in ok]
        return out

    def batch(rows):
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["qid", "idx", "sim"])

    form = "qid long, idx long, sim double"
    q = queries.select(F.col(qid).cast("long").alias("qid"), F.col("v").cast("array<tinyint>").alias("v")).where("v is not null")
    book = codebook.select(F.col("idx").cast("long").alias("idx"), F.col("v").cast("array<tinyint>").alias("v"))
    if n * max(dims, 1) <= BROADCAST_BYTES:
        rows = book.orderBy("idx").collect()
        idx = np.array([r[0] for r in rows], np.int64)
        c = np.array([r[1] for r in rows], np.int8) if rows else np.zeros((0, 1), np.int8)
        sent = queries.sparkSession.sparkContext.broadcast((idx, c))

        def scan(batches):
            idx, c = sent.value
            c = c.astype(float)
            for b in batches:
                if b.num_rows:
                    yield batch(best(b.column(0).to_pylist(), _matrix(b.column(1)), idx, c) if len(idx) else [])

        found = q.mapInArrow(scan, form)
    else:
        parts, qparts = -(-n // BLOCK), -(-q.count() // BLOCK) or 1
        each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        a = q.withColumn("p", F.pmod(F.xxhash64("qid"), F.lit(qparts))).withColumn("b", each(parts))
        b = book.withColumn("b", F.pmod(F.xxhash64("idx"), F.lit(parts))).withColumn("p", each(qparts))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = best(left.column("qid").to_pylist(), _matrix(left.column("v")), right.column("idx").to_numpy(), _matrix(right.column("v"))) if left.num_rows and right.num_rows else []
            return pa.Table.from_batches([batch(rows)])

        found = a.groupBy("b", "p").cogroup(b.groupBy("b", "p")).applyInArrow(meet, form)
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "idx")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select(F.col("qid").alias(qid), "rank", "idx", "sim")


def cleanup(queries: DataFrame, codebook: DataFrame, qid: str = "qid") -> DataFrame:
    """The single most similar codebook row of each query; an empty codebook gives no rows."""
    return topk_similar(queries, codebook, 1, qid=qid).drop("rank")


def invert(queries: DataFrame, codebook: DataFrame, k: int, threshold: float, qid: str = "qid") -> DataFrame:
    """What a vector is made of: up to k codebook rows of at least this similarity."""
    return topk_similar(queries, codebook, k, threshold, qid)


def similarity_matrix(vectors: DataFrame) -> DataFrame:
    """(i, j, sim) for all pairs of a bounded set (idx, v); the diagonal is 1 even for zeros. The result has n ** 2 rows by definition."""
    n = vectors.count()
    out = topk_similar(vectors.select(F.col("idx").alias("qid"), "v"), vectors, max(n, 1))
    return out.select(F.col("qid").alias("i"), F.col("idx").alias("j"), F.when(F.col("qid") == F.col("idx"), 1.0).otherwise(F.col("sim")).alias("sim"))


def pairwise(pairs: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    return pairs.withColumn(metric, METRICS[metric](F.col(a), F.col(b)))
