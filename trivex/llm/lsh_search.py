"""Nearest neighbours by multiprobe p-stable hashing (operator 7)."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written
from .vectors import BLOCK, first_k, matrix, ranked, valid

#: Tables, hashes in a table's key, buckets visited in a table, and cell width times the median norm.
TABLES, HASHES, PROBES, WIDTH = 8, 5, 64, 1.4
NEAR = "query_id long, vec_id long, score double"


def probe_sequence(frac: np.ndarray, n: int) -> list[tuple[tuple[int, int], ...]]:
    """The n perturbations (hash, step) most likely to hold near vectors, by the sum of squared distances to the cell walls crossed; the own bucket first."""
    z = sorted([(f * f, i, -1) for i, f in enumerate(frac)] + [((1 - f) ** 2, i, 1) for i, f in enumerate(frac)])
    out: list = [()]
    heap = [(z[0][0], (0,))]
    while heap and len(out) < n:
        s, a = heapq.heappop(heap)
        last = a[-1]
        if last + 1 < len(z):
            heapq.heappush(heap, (s - z[last][0] + z[last + 1][0], (*a[:-1], last + 1)))
            heapq.heappush(heap, (s + z[last + 1][0], (*a, last + 1)))
        if len({z[x][1] for x in a}) == len(a):
            out.append(tuple((z[x][1], z[x][2]) for x in a))
    return out


class Hashes:
    """The hash functions of all tables for one dimension."""

    def __init__(self, dim: int, width: float, tables: int, hashes: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        self.a = rng.normal(size=(tables, dim, hashes))
        self.b = rng.random((tables, hashes))
        self.width = width
        self.mul = rng.integers(1, 1 << 62, hashes, np.int64) | 1

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        return x @ self.a[t] / self.width + self.b[t]

    def key(self, cell: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cell.astype(np.int64) * self.mul).sum(-1)


def search(base: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found of base for each row of queries (both vec_id, v array<double>), by Euclidean distance.

    Every row of base is in one bucket of each table; a query visits the buckets most likely to hold its neighbours. Buckets of over BLOCK rows are split into equal parts that the query visits all. Of equal vectors the k + 1 smallest ids are indexed, as no others can be in a result. A query that finds under k rows is searched exactly, in blocks. vec_id is a key of base; a query isn't its own neighbour; vectors of another length than the query's are not candidates; ties go to the smaller vec_id; empty tables give an empty result.
    """
    copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    base = written(base.withColumn("copy", copies).where(F.col("copy") <= k + 1).select("vec_id", "v"), "vectors")
    queries = written(queries, "queries")
    n = base.count()
    norm = base.select(F.percentile_approx(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 0.5, 1000)).first()[0] or 1.0
    w = width * norm

    def keys(batches, probing):
        held: dict[int, Hashes] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = batch.column(1)
            size = v.value_lengths().to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = matrix(v.take(pa.array(at)))
                h = held.setdefault(int(d), Hashes(int(d), w, tables, hashes))
                for t in range(tables):
                    cell = h.cells(x, t)
                    low = np.floor(cell)
                    if probing:
                        seqs = [probe_sequence(f, probes) for f in cell - low]
                        own = np.repeat(np.arange(len(at)), [len(s) for s in seqs])
                        step = np.zeros((len(own), hashes))
                        j = 0
                        for s in seqs:
                            for p in s:
                                for i, by in p:
                                    step[j, i] = by
                                j += 1
                        b = h.key(low[own] + step)
                    else:
                        own, b = np.arange(len(at)), h.key(low)
                    for i in range(0, len(own), 10_000):
                        o = at[own[i : i + 10_000]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), t, np.int32)), pa.array(b[i : i + 10_000] + int(d)), pa.array(ids[o]), v.take(pa.array(o))], ["t", "b", "vec_id", "v"])

    schema = "t int, b long, vec_id long, v array<double>"
    index = base.mapInArrow(lambda x: keys(x, False), schema)
    probe = queries.mapInArrow(lambda x: keys(x, True), schema)
    sizes = written(index.groupBy("t", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1"), "sizes")
    index = index.join(sizes, ["t", "b"], "left").withColumn("s", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    probe = probe.join(sizes, ["t", "b"], "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, qid = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            lv, rv = left.column("v").combine_chunks(), right.column("v").combine_chunks()
            size = lv.value_lengths().to_numpy()
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                c, cid = matrix(lv.take(pa.array(mine))), ids[mine]
                qs = np.flatnonzero(rv.value_lengths().to_numpy() == d)
                for q, x in zip(qid[qs], matrix(rv.take(pa.array(qs))), strict=True):
                    dist = np.sqrt(((c - x) ** 2).sum(1))
                    keep = first_k(np.where(cid == q, np.inf, dist), cid, k)
                    keep = keep[cid[keep] != q]
                    out[0].append(np.full(len(keep), q))
                    out[1].append(cid[keep])
                    out[2].append(dist[keep])
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    by = ["t", "b", "s"]
    pick = [*by, "vec_id", "v"]
    found = index.select(pick).groupBy(*by).cogroup(probe.select(pick).groupBy(*by)).applyInArrow(near, NEAR)
    best = written(ranked(found, k, True), "near")
    short = queries.join(best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if n <= k + 1 or not short.isEmpty():
        parts = -(-n // BLOCK) or 1
        a = base.select(F.lit(0).alias("t"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("b"), F.lit(0).alias("s"), "vec_id", "v")
        b = short.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("b"), F.lit(0).alias("s"), "vec_id", "v")
        exact = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(near, NEAR)
        rest = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        best = rest.union(ranked(exact, k, True))
    return best


def op7(spark, sf_dir: str) -> DataFrame:
    """Whole `embeddings`; queries are the rows whose vec_id is divisible by 100, k is 10."""
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", False)
    return search(rows, rows.where(F.col("vec_id") % 100 == 0), 10)
