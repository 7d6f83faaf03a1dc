"""Similarities and distances of two vector columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DEGENERATE
from .vectors import norm, zipped


def dot(a: Column, b: Column) -> Column:
    """Exact integer product of ternary vectors."""
    return F.aggregate(zipped(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is degenerate."""
    na, nb = norm(a), norm(b)
    return F.when((na < DEGENERATE) | (nb < DEGENERATE), 0.0).otherwise(dot(a, b) / (na * nb))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _gap(a: Column, b: Column, f) -> Column:
    return zipped(a, b, lambda x, y: f(x.cast("double") - y))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_gap(a, b, lambda d: d * d)))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _sum(_gap(a, b, F.abs))


def chebyshev_distance(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(_gap(a, b, F.abs)), F.lit(0.0))


def minkowski_distance(a: Column, b: Column, p: float) -> Column:
    if p < 1:
        raise ValueError("p must be at least 1")
    return F.pow(_sum(_gap(a, b, lambda d: F.pow(F.abs(d), F.lit(float(p))))), F.lit(1.0 / p))


def euclidean(a: Column, b: Column) -> Column:
    return 1 / (1 + euclidean_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return 1 / (1 + manhattan_distance(a, b))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return 1 / (1 + minkowski_distance(a, b, p))


def chebyshev(a: Column, b: Column) -> Column:
    d = chebyshev_distance(a, b)
    return F.when(d <= 2, 1 - d / 2).otherwise(0.0)


def _share(a: Column, b: Column, f) -> Column:
    return F.size(F.filter(zipped(a, b, f), lambda x: x)).cast("double")


def hamming(a: Column, b: Column) -> Column:
    """Share of equal components."""
    return _share(a, b, lambda x, y: x == y) / F.size(a)


def overlap(a: Column, b: Column) -> Column:
    """Equal components among those where either is active; 0 if none is."""
    active = _share(a, b, lambda x, y: (x != 0) | (y != 0))
    return F.when(active > 0, _share(a, b, lambda x, y: (x == y) & (x != 0)) / active).otherwise(0.0)


def agreement(a: Column, b: Column) -> Column:
    """(agreeing - disagreeing) / length: for ternary vectors, dot / length."""
    return dot(a, b) / F.size(a)


def weighted_cosine(a: Column, b: Column, w: Column) -> Column:
    aw, bw = (zipped(v, w, lambda x, y: x.cast("double") * y) for v in (a, b))
    prod = lambda p, q: _sum(zipped(p, q, lambda x, y: x * y))
    d = F.sqrt(prod(aw, aw) * prod(bw, bw))
    return F.when(d < DEGENERATE, 0.0).otherwise(prod(aw, bw) / d)


def weighted_euclidean_distance(a: Column, b: Column, w: Column) -> Column:
    return F.sqrt(_sum(zipped(_gap(a, b, lambda d: d * d), w, lambda x, y: x * y)))


def weighted_euclidean(a: Column, b: Column, w: Column) -> Column:
    return 1 / (1 + weighted_euclidean_distance(a, b, w))


def significance(similarity: Column, dims: int | Column) -> Column:
    """z-score of a similarity between random vectors of dims components."""
    return similarity * F.sqrt((F.lit(dims) if isinstance(dims, int) else dims).cast("double"))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean, "manhattan": manhattan, "hamming": hamming, "overlap": overlap, "agreement": agreement, "chebyshev": chebyshev}


def compute(a: Column, b: Column, metric: str) -> Column:
    return METRICS[metric](a, b).cast("double")
