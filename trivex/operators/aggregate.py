"""Aggregates over vectors: bundles, prototypes, accumulators. Sums are partial in every task; a group of any size is one row per task in the shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..config import DEGENERATE

#: Up to here each component is a sum of its own in one native aggregate; above, tasks add matrices with numpy.
NATIVE_DIMS = 128


def vector_sums(df: DataFrame, keys: list[str], vec: str, dims: int, weight: Column | None = None) -> DataFrame:
    """keys, sums array<double>, n long: the weighted sum of vectors per group. Null vectors are skipped; without keys an empty table gives one row of no vectors."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*keys, F.col(vec).alias("_v"), w.alias("_w")).where("_v is not null")
    if dims <= NATIVE_DIMS:
        sums = [F.sum(F.element_at("_v", i + 1).cast("double") * F.col("_w")).alias(f"s{i}") for i in range(dims)]
        agg = rows.groupBy(*keys).agg(*sums, F.count("*").alias("n"))
        return agg.select(*keys, F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(dims)]).alias("sums"), "n")
    fields = [rows.schema[k] for k in keys]

    def partial(batches):
        held: dict[tuple, list] = {}
        types: list = []
        for b in batches:
            types = [b.column(i).type for i in range(len(keys))]
            cols = [b.column(i).to_pylist() for i in range(len(keys))]
            of: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*cols, strict=True) if keys else [()] * b.num_rows):
                of.setdefault(k, []).append(i)
            m = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float) if b.num_rows else np.zeros((0, dims))
            w = b.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            for k, i in of.items():
                s = held.setdefault(k, [np.zeros(dims), 0])
                s[0] += w[i] @ m[i]
                s[1] += len(i)
        if held:
            cols = list(zip(*held, strict=True)) if keys else []
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types, strict=True)], pa.array([s.tolist() for s, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.int64())], [*keys, "part", "n"])

    parts = rows.mapInArrow(partial, StructType([*fields, StructField("part", ArrayType(DoubleType())), StructField("n", LongType())]))
    per = parts.select(*keys, "n", F.posexplode("part").alias("d", "x")).groupBy(*keys, "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("sums"), F.max("n").alias("n"))


def signs(sums: Column) -> Column:
    return F.transform(sums, lambda x: F.signum(x).cast("tinyint"))


def bundle(df: DataFrame, keys: list[str], vec: str, dims: int, weight: Column | None = None) -> DataFrame:
    """keys, v: sign of the (weighted) sum. A group has at least one vector, so none is empty."""
    return vector_sums(df, keys, vec, dims, weight).select(*keys, signs(F.col("sums")).alias("v"))


#: Scaling a sum to unit length doesn't change its signs.
centroid = bundle


def prototype(df: DataFrame, keys: list[str], vec: str, dims: int, threshold: float = 0.5) -> DataFrame:
    """keys, v: signs of the components whose net sum reaches ceil(n * threshold), else 0."""
    s = vector_sums(df, keys, vec, dims)
    m = F.ceil(F.col("n") * F.lit(float(threshold)))
    return s.select(*keys, F.transform("sums", lambda x: F.when(x >= m, 1).when(x <= -m, -1).otherwise(0).cast("tinyint")).alias("v"))


def bundle_with_confidence(df: DataFrame, keys: list[str], vec: str, dims: int) -> DataFrame:
    """keys, v, margin: the bundle, and |sum| / n per component."""
    s = vector_sums(df, keys, vec, dims)
    return s.select(*keys, signs(F.col("sums")).alias("v"), F.transform("sums", lambda x: F.abs(x) / F.col("n")).alias("margin"))


def bundle_f64(df: DataFrame, keys: list[str], vec: str, dims: int) -> DataFrame:
    return vector_sums(df, keys, vec, dims).select(*keys, F.col("sums").alias("v"))


def coherence(df: DataFrame, keys: list[str], vec: str, dims: int) -> DataFrame:
    """keys, coherence: mean cosine over the pairs of a group, in one pass: (|sum of unit vectors|^2 - their number) / (n (n - 1)); a group of one has 1."""
    from ..functions.vectors import nnz, normalized

    unit = df.select(*keys, normalized(F.col(vec)).alias("_u"), (nnz(F.col(vec)) > 0).cast("double").alias("_a"))
    s = vector_sums(unit, keys, "_u", dims)
    active = unit.groupBy(*keys).agg(F.sum("_a").alias("a"))
    s = s.join(active, keys) if keys else s.crossJoin(active)  # one row each
    sq = F.aggregate("sums", F.lit(0.0), lambda t, x: t + x * x)
    return s.select(*keys, F.when(F.col("n") < 2, 1.0).otherwise((sq - F.col("a")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


# accumulators: rows (sums array<double>, n long)

def accumulate(df: DataFrame, keys: list[str], vec: str, dims: int, weight: Column | None = None) -> DataFrame:
    return vector_sums(df, keys, vec, dims, weight)


def decayed(df: DataFrame, keys: list[str], vec: str, dims: int, order: str, factor: float) -> DataFrame:
    """The accumulator after decaying before each further vector in the order of a rank column that counts from 1 in each group."""
    last = df.groupBy(*keys).agg(F.max(order).alias("_last")) if keys else df.agg(F.max(order).alias("_last"))
    rows = df.join(last, keys) if keys else df.crossJoin(F.broadcast(last))  # one row
    return vector_sums(rows, keys, vec, dims, F.pow(F.lit(float(factor)), F.col("_last") - F.col(order)))


def merge(a: DataFrame, b: DataFrame, keys: list[str], dims: int) -> DataFrame:
    both = a.select(*keys, "sums", "n").unionByName(b.select(*keys, "sums", "n"))
    return both.groupBy(*keys).agg(F.array(*[F.sum(F.element_at("sums", i + 1)) for i in range(dims)]).alias("sums"), F.sum("n").alias("n"))


def decay(sums: Column, factor: float) -> Column:
    return F.transform(sums, lambda x: x * F.lit(float(factor)))


def threshold(sums: Column) -> Column:
    return signs(sums)


normalize = threshold


def _power_sum(sums: Column, p: int) -> Column:
    return F.aggregate(sums, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(float(p))))


def normalize_f64(sums: Column) -> Column:
    from ..functions.vectors import let

    return let(F.sqrt(_power_sum(sums, 2)), lambda n: F.transform(sums, lambda x: F.when(n > DEGENERATE, x / n).otherwise(0.0)))


def capacity(sums: Column, codebook: int) -> Column:
    """Share of the room for a codebook's items that is left."""
    if codebook < 2:
        return F.lit(1.0)
    d = F.size(sums)
    used = (_power_sum(sums, 2) / d) / (d / (2 * math.log(codebook)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - used))


def purity(sums: Column, n: Column) -> Column:
    s = _power_sum(sums, 2)
    return F.when((n == 0) | (s < DEGENERATE), 0.0).otherwise(F.least(F.size(sums) / s, F.lit(1.0)))


def participation_ratio(sums: Column) -> Column:
    s4 = _power_sum(sums, 4)
    return F.when(s4 < DEGENERATE, 0.0).otherwise(F.pow(_power_sum(sums, 2), F.lit(2.0)) / s4)
