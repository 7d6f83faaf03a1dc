"""Reckoners: discriminants of labelled vectors, and regression over buckets of values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .aggregate import vector_sums
from .ordered import matrix, streamed

TINY = 1e-10


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > TINY)


class Discriminants:
    """What separates each label's prototype from the others'; made from one sum per label."""

    def __init__(self, sums: dict[int, np.ndarray], labels: int):
        self.ready = labels >= 2 and all(i in sums for i in range(labels))
        self.labels = labels
        if not self.ready:
            return
        protos = _unit(np.stack([np.asarray(sums[i], float) for i in range(labels)]))
        self.mean = protos.mean(0)
        gap = protos - (protos.sum(0) - protos) / (labels - 1)
        size = np.sqrt((gap * gap).sum(1))
        self.strength = float(size[-1] / np.sqrt(protos.shape[1]))
        self.has = size > TINY
        self.disc = _unit(gap)
        self.protos = protos
        self.cos_raw = float(_unit(protos[0]) @ _unit(protos[1])) if labels == 2 else 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = _unit(np.asarray(x, float) - self.mean) @ self.disc.T
        return np.where(self.has, s, 0.0)

    def health(self) -> tuple[float, float, float]:
        """Norms of the first two prototypes and their cosine."""
        a, b = self.protos[:2]
        return float(np.sqrt(a @ a)), float(np.sqrt(b @ b)), float(_unit(a) @ _unit(b))


def observed(df: DataFrame, label: str, order: str, vec: str, dims: int, labels: int, interval: int, weight: Column | None = None) -> Discriminants:
    """The discriminants that hold after all rows in their order: made at the last count divisible by interval, from the rows before it. Rows of labels out of range don't count."""
    rows = df.where(F.col(label).between(0, labels - 1))
    n = rows.count()
    last = n - n % interval
    if not last:
        return Discriminants({}, labels)
    from .ordered import numbered

    seen = numbered(rows, order).where(F.col("seq") < last - 1)
    got = vector_sums(seen, [label], vec, dims, weight).collect()  # a row per label
    return Discriminants({r[label]: np.array(r["sums"]) for r in got}, labels)


def predict(rows: DataFrame, vec: str, d: Discriminants) -> DataFrame:
    """rows with direction, raw_cos, conviction and all scores by label; nothing is predicted before the first calibration."""

    @F.pandas_udf("struct<direction: int, raw_cos: double, conviction: double, scores: array<double>>")
    def run(v: pd.Series) -> pd.DataFrame:
        s = d.scores(np.stack(v.to_numpy()))
        best = s.argmax(1)
        raw = s[np.arange(len(s)), best]
        return pd.DataFrame({"direction": best.astype(np.int32), "raw_cos": raw, "conviction": np.abs(raw), "scores": list(s)})

    if not d.ready:
        return rows.select("*", F.lit(None).cast("int").alias("direction"), F.lit(0.0).alias("raw_cos"), F.lit(0.0).alias("conviction"), F.array().cast("array<double>").alias("scores"))
    return rows.withColumn("_p", run(F.col(vec).cast("array<double>"))).select(*rows.columns, "_p.*")


def curve(resolved: DataFrame, conviction: str, correct: str, order: str, labels: int, cap: int = 5000, min_resolved: int = 500, bins: int = 20) -> DataFrame:
    """One row (a, b) of accuracy = 1 / labels + a exp(b conviction), fitted to equal bins of the last cap rows; no row if there is too little to fit."""
    base = 1.0 / labels
    last = resolved.orderBy(F.desc(order)).limit(cap).select(F.col(conviction).alias("c"), F.col(correct).cast("double").alias("w"), F.col(order).alias("o"))
    last = last.withColumn("i", F.row_number().over(Window.orderBy("c", "o")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))  # at most cap rows
    size = F.floor(F.col("n") / bins)
    points = last.where((F.col("n") >= min_resolved) & (size >= 10)).groupBy(F.least(F.floor(F.col("i") / size), F.lit(bins - 1)).alias("bin")).agg(F.avg("c").alias("x"), F.avg("w").alias("acc"))
    points = points.where(F.col("acc") > base + 0.005).withColumn("y", F.log(F.col("acc") - base))
    fit = points.agg(F.count("*").alias("k"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("ln_a"))
    return fit.where("k >= 3 and b is not null").select(F.exp("ln_a").alias("a"), "b")


def accuracy_at(conviction: Column, a: Column, b: Column, labels: int) -> Column:
    return F.least(1.0 / labels + a * F.exp(b * conviction), F.lit(0.99))


class Continuous:
    """Buckets over a range of values that follows what is observed. Targets are taken to be non-negative."""

    def __init__(self, dims: int, k: int = 16, default: float = 0.0):
        self.k, self.default = k, default
        self.sums, self.counts, self.centers = np.zeros((k, dims)), np.zeros(k, int), np.zeros(k)
        self.lo = self.hi = 0.0
        self.seen = self.since = 0

    def _grid(self):
        self.centers = self.lo + (np.arange(self.k) + 0.5) * (self.hi - self.lo) / self.k

    def _rebalance(self):
        live = (self.counts > 0) & (np.sqrt((self.sums**2).sum(1)) > 0.1)
        if live.sum() < 2:
            if self.hi - self.lo > 1e-15 * self.k:
                self._grid()
            return
        lo, hi = self.centers[live].min(), self.centers[live].max()
        if hi - lo < TINY:
            return
        pad = (hi - lo) * 0.1
        self.lo, self.hi = max(lo - pad, 0.0), hi + pad
        old, sums, counts = self.centers, self.sums, self.counts
        self._grid()
        self.sums, self.counts = np.zeros_like(sums), np.zeros_like(counts)
        pour = np.sqrt((sums**2).sum(1)) >= 0.1
        at = np.clip(np.floor((old[pour] - self.lo) / ((self.hi - self.lo) / self.k)), 0, self.k - 1).astype(int)
        np.add.at(self.sums, at, sums[pour])
        np.add.at(self.counts, at, counts[pour])

    def observe(self, x, value: float, weight: float = 1.0):
        self.sums *= 0.999
        if not self.seen:
            self.lo, self.hi = value - 0.001, value + 0.001
            self._grid()
        self.seen += 1
        wider = value < self.lo or value > self.hi
        self.lo = min(self.lo, value)
        if value > self.hi:
            self.hi = value + 1e-10
        if wider:
            self._rebalance()
        width = (self.hi - self.lo) / self.k
        if width > 1e-15:
            i = int(np.clip(np.floor((value - self.lo) / width), 0, self.k - 1))
            self.sums[i] += max(weight, TINY) * np.asarray(x, float)
            self.counts[i] += 1
        self.since += 1
        if self.since >= 100:
            self._rebalance()
            self.since = 0

    def query(self, x) -> float:
        x = np.asarray(x, float)
        c = np.where(self.counts > 0, _unit(self.sums) @ _unit(x), 0.0)
        top = sorted(np.flatnonzero(c > 0), key=lambda i: -c[i])[:3]
        w = c[top].sum() if top else 0.0
        return float((c[top] * self.centers[top]).sum() / w) if w >= TINY else self.default


def regress(df: DataFrame, key: str, order: str, vec: str, value: str, k: int = 16, default: float = 0.0) -> DataFrame:
    """key, order, predicted: what the buckets of a key, fed in order, say of each row before they learn it."""
    kinds = [df.schema[c].dataType.simpleString() for c in (key, order)]

    def feed(state, b):
        m = matrix(b.column(vec))
        r = state.setdefault("model", None) or Continuous(m.shape[1], k, default)
        state["model"], out = r, []
        for x, y in zip(m, b.column(value).to_pylist(), strict=True):
            out.append(r.query(x) if r.seen else default)
            r.observe(x, y)
        return pa.RecordBatch.from_arrays([b.column(key), b.column(order), pa.array(out, pa.float64())], [key, order, "predicted"])

    rows = df.select(key, order, vec, F.col(value).cast("double").alias(value))
    return streamed(rows, [key], order, f"`{key}` {kinds[0]}, `{order}` {kinds[1]}, predicted double", dict, feed)
