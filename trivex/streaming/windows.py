"""Vector aggregates over event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.aggregate import signs


def windowed_bundle(df: DataFrame, ts: str, vec: str, dims: int, length: str, slide: str | None = None, late: str | None = None, keys: list[str] | None = None, session: bool = False) -> DataFrame:
    """start, end, keys, v, n: the bundle of each tumbling, sliding or session window. late sets the watermark, which a stream needs to forget windows; the sums per component are native aggregates, so they are kept as partial sums in the state."""
    if late:
        df = df.withWatermark(ts, late)
    w = F.session_window(ts, length) if session else F.window(ts, length, slide) if slide else F.window(ts, length)
    sums = [F.sum(F.element_at(vec, i + 1).cast("long")).alias(f"s{i}") for i in range(dims)]
    agg = df.groupBy(w.alias("w"), *(keys or [])).agg(*sums, F.count("*").alias("n"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), signs(F.array(*[F.coalesce(f"s{i}", F.lit(0)) for i in range(dims)])).alias("v"), "n")
