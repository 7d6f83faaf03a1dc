"""Exact top-k inner products by norm-bucketed retrieval (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions_for, scratch, written
from .vectors import BLOCK, first_k, matrix, ranked, valid

#: Queries in a block; a local cosine threshold from which single coordinates prune better than lengths.
QUERIES, COORDINATE = 512, 0.75
PAIR = "query_id long, vec_id long, score long"


def _dots(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of integers held as doubles."""
    most = np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * c.shape[1]
    if most < 2**53:
        return c @ q
    if most < 2**63:
        return c.astype(np.int64) @ q.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in c], object)


def bucket_top(c: np.ndarray, ids: np.ndarray, norms: np.ndarray, q: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k largest products of q with a bucket (norms descending) that can reach floor; own is left out.

    The local threshold floor / (|q| * largest norm) is the least cosine that can count. At COORDINATE or more, candidates are kept by the range that this cosine leaves their coordinates on the two largest axes of q; below it by length, as a product is at most |q| times the norm. What is kept is verified by exact products.
    """
    nq = float(np.sqrt((q * q).sum()))
    keep = slice(0, len(ids))
    if floor > 0 and nq > 0 and len(ids):
        floor_ = floor * (1 - 1e-12)
        tau = floor_ / (nq * norms[0]) if norms[0] > 0 else 2.0
        if tau > 1:
            return ids[:0], np.zeros(0, np.int64)
        last = int(np.searchsorted(-norms, -floor_ / nq, "right"))
        keep = slice(0, last)
        if tau >= COORDINATE:
            unit, ok = q / nq, np.ones(last, bool)
            wide = float(np.arccos(min(1.0, tau))) + 1e-7
            for f in np.argsort(-np.abs(unit))[:2]:
                # the angle to axis f of a vector within wide of q differs from that of q by at most wide
                own_angle = float(np.arccos(np.clip(unit[f], -1, 1)))
                lo, hi = np.cos(min(np.pi, own_angle + wide)), np.cos(max(0.0, own_angle - wide))
                x = c[:last, f] / norms[:last]
                ok &= (x >= lo - 1e-9) & (x <= hi + 1e-9)
            keep = np.flatnonzero(ok)
    ids, c = ids[keep], c[keep]
    s = _dots(c, q)
    mine = ids != own
    ids, s = ids[mine], s[mine]
    top = first_k(-s, ids, k)
    return ids[top], s[top]


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """rows (vec_id, v, dim, by, floor) in blocks of up to size rows of one dimension, by descending by: (block, dim, first, last, ids, bys, floors, data), as a written table.

    Rows are dealt by ranges, in which a task cuts its sorted rows as they stream past; values that many rows share are dealt by id too. No bounds are collected, and no block is larger than size.
    """
    form = "block long, dim int, first double, last double, ids binary, bys binary, floors binary, data binary"
    names = [x.split()[0] for x in form.split(", ")]

    def cut(batches):
        from pyspark import TaskContext

        number, held, dim = TaskContext.get().partitionId() << 32, [], None

        def flush(rows):
            nonlocal number
            ids, by, floor, m = (np.concatenate(x) for x in zip(*rows, strict=True))
            number += 1
            cols = [number - 1, m.shape[1], by[0], by[-1], ids.tobytes(), by.tobytes(), floor.tobytes(), np.ascontiguousarray(m).tobytes()]
            types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            dims = b.column(2).to_numpy()
            ids, by, floor = (b.column(i).to_numpy() for i in (0, 3, 4))
            i = 0
            while i < len(dims):
                if held and dims[i] != dim:
                    yield flush(held)
                    held = []
                dim = dims[i]
                j = i + int(np.argmax(dims[i:] != dim)) if (dims[i:] != dim).any() else len(dims)
                j = min(j, i + size - sum(len(x[0]) for x in held))
                held.append((ids[i:j].copy(), by[i:j].copy(), floor[i:j].copy(), matrix(b.column(1).slice(i, j - i)).copy()))
                if sum(len(x[0]) for x in held) == size:
                    yield flush(held)
                    held = []
                i = j
        if held:
            yield flush(held)

    n = partitions_for(rows.sparkSession, rows.count(), 16 * size)
    order = [F.col("dim"), F.desc("by"), F.col("vec_id")]
    dealt = rows.select("vec_id", "v", "dim", "by", F.col("floor").cast("double").alias("floor")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(cut, form), "blocks")


def _meet(k: int):
    """Batches of a block of base and a block of queries each -> the pairs of PAIR that can be among the k best."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                d = r["dim"]
                ids, qids = (np.frombuffer(r[x], np.int64) for x in ("ids", "qids"))
                norms, floors = (np.frombuffer(r[x]) for x in ("bys", "qfloors"))
                c, qs = np.frombuffer(r["data"]).reshape(-1, d), np.frombuffer(r["qdata"]).reshape(-1, d)
                out = []
                for own, q, floor in zip(qids.tolist(), qs, floors.tolist(), strict=True):
                    found, score = bucket_top(c, ids, norms, q, own, floor, k)
                    out.append((np.full(len(found), own), found, score))
                cols = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["query_id", "vec_id", "score"])

    return run


def pairs_to_meet(heads: DataFrame, qheads: DataFrame) -> DataFrame:
    """(block, qblock) of the blocks of base (block, dim, first: largest norm) that a block of queries (qblock, dim, last: least norm that can count) has to see; ids only. Blocks of base are dealt to salts, so that one dimension isn't one key."""
    salts = -(-heads.count() // 1000) or 1
    left = heads.select("block", "dim", "first", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    right = qheads.select("qblock", F.col("dim"), F.col("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return left.join(right, ["dim", "salt"]).where(F.col("first") >= F.col("last") * (1 - 1e-12)).select("block", "qblock")


def search(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products, exactly; base and queries are (vec_id, v) of integers as doubles.

    Rows of base stand in buckets of like norm, BLOCK rows each. Queries meet the bucket of largest norms of their dimension first; a query's k-th product there is a floor for it. A product is at most the product of both norms, so a query needs only the buckets whose largest norm is floor / |q| or more. Queries are put in blocks by that need, and pairs of blocks are chosen by their bounds alone, before any vectors move. In a bucket that is met each query is pruned by its floor again (see bucket_top). Of equal vectors only the k + 1 smallest ids can be in a result, so the others are left out beforehand. vec_id is a key of base, of which rows that repeat one count once, with their best product; a query isn't its own candidate; vectors of another length than the query's are no candidates; ties go to the smaller vec_id; fewer than k candidates are all returned; empty tables give an empty result.
    """
    from pyspark.sql import Window

    with scratch() as kept:
        copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        none = F.lit(0.0)
        base = written(base.withColumn("copy", copies).where(F.col("copy") <= k + 1).select("vec_id", "v", norm.alias("by"), F.size("v").alias("dim"), none.alias("floor")), "vectors")
        queries = written(queries.select("vec_id", "v", norm.alias("norm"), F.size("v").alias("dim")), "queries")
        blocks = kept(blocks_of(base, BLOCK))
        heads = blocks.select("block", "dim", "first")
        lead = written(heads.groupBy("dim").agg(F.max(F.struct("first", "block")).alias("m")).select(F.col("m.block").alias("block")), "lead")

        def meet(pairs: DataFrame | None, part: DataFrame, qblocks: DataFrame) -> DataFrame:
            q = qblocks.select(F.col("block").alias("qblock"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("floors").alias("qfloors"), F.col("data").alias("qdata"))
            both = part.join(q, F.col("dim") == F.col("qdim")) if pairs is None else pairs.join(q, "qblock").join(part, "block")
            return both.select("dim", "ids", "bys", "data", "qids", "qfloors", "qdata").mapInArrow(_meet(k), PAIR)

        first = blocks.join(F.broadcast(lead), "block", "left_semi")  # a block per dimension
        seeds = kept(written(meet(None, first, blocks_of(queries.withColumn("by", none).withColumn("floor", none), QUERIES)), "seeds"))
        floors = ranked(seeds, k, False).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        needing = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
        need = F.when((F.col("floor") > 0) & (F.col("norm") > 0), F.col("floor") / F.col("norm")).otherwise(none)
        qblocks = kept(blocks_of(written(needing.withColumn("by", need), "needs"), QUERIES))
        rest = heads.join(F.broadcast(lead), "block", "left_anti")
        pairs = kept(written(pairs_to_meet(rest, qblocks.select(F.col("block").alias("qblock"), "dim", "last")), "pairs"))
    return ranked(seeds.union(meet(pairs, blocks, qblocks)), k, False)


def op9(spark, sf_dir: str) -> DataFrame:
    """Whole `embeddings` as floor(64 * x); queries are the rows whose vec_id is divisible by 20, k is 20."""
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", True)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 64).cast("double")).alias("v"))
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


SQL9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
