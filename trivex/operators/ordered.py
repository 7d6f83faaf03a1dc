"""Operators over ordered streams of vectors (seq, v), one stream or one per key.

seq must be consecutive in its stream (see numbered()). Lags are equi-joins on (key, seq), so one long stream is dealt over all tasks by position; only streams of scalars pass a window.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.similarity import cosine


def numbered(df: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """df with seq from 0 in ascending order, equal values in the order of their rows' hashes, nulls first.

    No stream is gathered: rows are dealt by ranges of the order, so a value that a third of them has is dealt too, and are written once with their number in their range. What is counted and what is numbered is therefore the same; a row's seq is its number and the count of all ranges before. With keys each key's rows are numbered by a window.
    """
    from ..sources.tables import written

    if keys:
        return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    d = df.withColumn("_tie", F.xxhash64(*hashed) if hashed else F.lit(0))
    d = d.repartitionByRange(n, F.col(order), F.col("_tie")).sortWithinPartitions(order, "_tie")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    d = written(d.withColumn("_p", F.spark_partition_id()).withColumn("_i", place).drop("_tie"), "numbered")
    before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = d.groupBy("_p").agg(F.count("*").alias("n")).select(F.col("_p"), F.coalesce(before, F.lit(0).cast("long")).alias("_start"))
    d = d.join(F.broadcast(starts), "_p")  # at most as many rows as shuffle partitions
    return d.select(*[c for c in df.columns if c != "seq"], (F.col("_start") + F.col("_i")).alias("seq"))


def streamed(df: DataFrame, keys: list[str], order: str, schema: str, start: Callable, feed: Callable, finish: Callable | None = None) -> DataFrame:
    """What a state per key makes of its rows in order: feed(state, rows as a record batch) and, after a key's last row, finish(state, key as a tuple) give record batches or None.

    Each row depends on the one before, so a key's rows are one task's; they stream past in sorted batches, and one state is held at a time.
    """

    def run(batches):
        now, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            names = list(zip(*[b.column(k).to_pylist() for k in keys], strict=True))
            cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]] if names[0] != names[-1] else []  # sorted
            for i, j in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if now is None or names[i] != now[0]:
                    if now is not None and finish and (last := finish(state, now[0])) is not None:
                        yield last
                    now, state = (names[i],), start()
                out = feed(state, b.slice(i, j - i))
                if out is not None:
                    yield out
        if now is not None and finish and (last := finish(state, now[0])) is not None:
            yield last

    # a number of partitions of its own: small ones would be merged by their bytes, and few keys that take long would wait for each other
    n = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def matrix(col: pa.Array):
    """The rows of a list column of one length as a matrix of doubles."""
    m = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return m.reshape(len(col), -1)


def _lagged(a: DataFrame, b: DataFrame, max_lag: int, low: int) -> DataFrame:
    """(lag, seq, sim): cosine of a at seq - lag and b at seq."""
    lags = F.explode(F.sequence(F.lit(low), F.lit(max_lag))).alias("lag")
    shifted = a.select(lags, "seq", F.col("v").alias("va")).withColumn("seq", F.col("seq") + F.col("lag"))
    return shifted.join(b.select("seq", F.col("v").alias("vb")), "seq").select("lag", "seq", cosine(F.col("va"), F.col("vb")).alias("sim"))


def autocorrelate(stream: DataFrame, max_lag: int) -> DataFrame:
    """(lag, corr): mean cosine of vectors lag apart; lag 0 is 1; lags stop one short of the length."""
    n = stream.count()
    top = min(max_lag, n - 1)
    zero = stream.sparkSession.range(1 if n else 0).select(F.lit(0).alias("lag"), F.lit(1.0).alias("corr"))
    if top < 1:
        return zero
    return zero.union(_lagged(stream, stream, top, 1).groupBy("lag").agg(F.avg("sim").alias("corr")))


def cross_correlate(a: DataFrame, b: DataFrame, max_lag: int) -> DataFrame:
    """(lag, corr): mean cosine of a at i - lag and b at i; lags stop one short of the shorter stream."""
    n = min(a.count(), b.count())
    a, b = a.where(F.col("seq") < n), b.where(F.col("seq") < n)
    return _lagged(a, b, min(max_lag, n - 1), 0).groupBy("lag").agg(F.avg("sim").alias("corr"))


def consecutive(stream: DataFrame) -> DataFrame:
    """(seq, sim): cosine of each vector and the one before."""
    return _lagged(stream, stream, 1, 1).select("seq", "sim")


def segment(stream: DataFrame, window: int, threshold: float, method: str, dims: int) -> DataFrame:
    """(seq) of breakpoints, 0 included: a vector less similar than threshold to the one before (diff), or to the prototype at one half of the window before (prototype; shorter at the start)."""
    start = stream.where("seq = 0").select("seq")
    if method == "diff":
        return start.union(consecutive(stream).where(F.col("sim") < threshold).select("seq"))
    if method != "prototype":
        raise ValueError(f"unknown method {method}")
    from .aggregate import prototype

    ahead = stream.select(F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + window)).alias("at"), "v")
    protos = prototype(ahead, ["at"], "v", dims, 0.5).select(F.col("at").alias("seq"), F.col("v").alias("p"))
    return start.union(stream.join(protos, "seq").where(cosine(F.col("v"), F.col("p")) < threshold).select("seq"))


def drift_rate(stream: DataFrame, window: int) -> DataFrame:
    """(seq, drift): change of the consecutive similarity, smoothed over the last window of them once there are so many; two fewer rows than vectors."""
    sims = consecutive(stream)
    if window > 1:
        back = sims.select(F.explode(F.sequence(F.col("seq"), F.col("seq") + window - 1)).alias("at"), "sim")
        mean = back.groupBy("at").agg(F.avg("sim").alias("m")).withColumnRenamed("at", "seq")
        sims = sims.join(mean, "seq").select("seq", F.when(F.col("seq") >= window, F.col("m")).otherwise(F.col("sim")).alias("sim"))
    before = sims.select((F.col("seq") + 1).alias("seq"), F.col("sim").alias("b"))
    return sims.join(before, "seq").select("seq", (F.col("sim") - F.col("b")).alias("drift"))


def chains(positions: DataFrame, gap: int) -> DataFrame:
    """(seq, chain) of distinct positions (seq): those at most gap after the one before have its chain, named by its first position. Ranges of positions are looked at apart; what a chain carries over is a row per range."""
    from ..sources.tables import written

    n = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = positions.select(F.col("seq").cast("long").alias("seq")).distinct().repartitionByRange(n, "seq").withColumn("_p", F.spark_partition_id())
    d = written(d, "positions")
    ranges = d.groupBy("_p").agg(F.max("seq").alias("top"))
    by = Window.orderBy("_p")  # a row per range
    d = d.join(F.broadcast(ranges.select("_p", F.lag("top").over(by).alias("_before"))), "_p")
    own = Window.partitionBy("_p").orderBy("seq")
    new = F.col("seq") - F.coalesce(F.lag("seq").over(own), F.col("_before"))
    d = d.withColumn("_first", F.when(new.isNull() | (new > gap), F.col("seq")))
    carried = d.groupBy("_p").agg(F.max("_first").alias("m")).select("_p", F.last("m", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    d = d.join(F.broadcast(carried), "_p")
    return d.select("seq", F.coalesce(F.last("_first", True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_carried").alias("chain"))


def runs(df: DataFrame, pos: str, gap: int, keys: list[str]) -> DataFrame:
    """keys, first, last, n: positions with at most gap between neighbours, merged."""
    w = Window.partitionBy(*keys).orderBy("_p")
    d = df.select(*keys, F.col(pos).alias("_p")).withColumn("_new", (F.col("_p") - F.lag("_p").over(w) > gap).cast("int"))
    d = d.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    return d.groupBy(*keys, "_run").agg(F.min("_p").alias("first"), F.max("_p").alias("last"), F.count("*").alias("n")).drop("_run")
