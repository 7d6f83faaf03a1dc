"""Numbers and times as vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from ..config import Space
from .atoms import atom_array, literal, sign_array
from .vectors import bind, bundle_columns, let

T = "tinyint"


def bases(space: Space, kind: str = "scalar") -> tuple[np.ndarray, np.ndarray]:
    """The two bipolar vectors that a rotation turns between; another kind of number has others."""
    return sign_array(space, f"{kind}_base"), sign_array(space, f"{kind}_ortho")


def _angle(value: Column, turn: float) -> Column:
    return value.cast("double") * F.lit(2 * math.pi / turn)


def _rotated(space: Space, angle: Column, kind: str) -> Column:
    """sign(base cos + ortho sin). The bases are bipolar, so a component depends on the arc between odd multiples of 45 degrees only: four literals, chosen by arc. On a boundary, where the reference of the algebra cancels or not by rounding, the arc that begins there counts."""
    b, o = (x.astype(int) for x in bases(space, kind))
    arcs = F.array(*[literal(x) for x in (b, o, -b, -o)])
    arc = F.floor(F.pmod(angle + math.pi / 4, F.lit(2 * math.pi)) / (math.pi / 2)).cast("int")
    return F.element_at(arcs, F.least(arc, F.lit(3)) + 1)


def encode_linear(space: Space, value: Column, scale: float, kind: str = "scalar") -> Column:
    return _rotated(space, _angle(value, scale), kind)


def encode_circular(space: Space, value: Column, period: float, kind: str = "scalar") -> Column:
    return _rotated(space, _angle(value.cast("double") % F.lit(float(period)), period), kind)


def thermometer_level(value: Column, lo: float, hi: float, dims: int) -> Column:
    """How many leading components are +1."""
    share = F.lit(0.5) if hi == lo else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value.cast("double") - lo) / (hi - lo)))
    return F.round(share * dims).cast("int")


def encode_thermometer(space: Space, value: Column, lo: float, hi: float) -> Column:
    n = thermometer_level(value, lo, hi, space.dims)
    return F.concat(F.array_repeat(F.lit(1).cast(T), n), F.array_repeat(F.lit(-1).cast(T), F.lit(space.dims) - n))


def thermometer_cosine(a: Column, b: Column, lo: float, hi: float, dims: int) -> Column:
    """Cosine of two thermometer vectors, without the vectors."""
    return 1 - 2 * F.abs(thermometer_level(a, lo, hi, dims) - thermometer_level(b, lo, hi, dims)) / F.lit(dims)


def encode_log(space: Space, value: Column, base: float = 10.0, kind: str = "scalar") -> Column:
    """Rotation by the logarithm, ten units a turn; zeros at 0 and below."""
    x = value.cast("double")
    turned = encode_linear(space, F.log(F.when(x > 0, x).otherwise(1.0)) / math.log(base), 10.0, kind)
    return F.when(x > 0, turned).otherwise(F.array_repeat(F.lit(0).cast(T), space.dims))


def encode_f64(space: Space, value: Column, mode: str, a: float, b: float = 0.0, kind: str = "scalar") -> Column:
    """Unthresholded: mode linear(scale a), circular(period a), thermometer(a, b), whose level is truncated here."""
    x = value.cast("double")
    if mode == "thermometer":
        share = F.lit(0.5) if a == b else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
        n = F.floor(share * space.dims).cast("int")
        return F.concat(F.array_repeat(F.lit(1.0), n), F.array_repeat(F.lit(-1.0), F.lit(space.dims) - n))
    theta = _angle(x if mode == "linear" else x % F.lit(float(a)), a)
    base, ortho = (literal(v.tolist(), "double") for v in bases(space, kind))
    r = F.struct(F.cos(theta).alias("c"), F.sin(theta).alias("s"))
    return let(r, lambda r: F.zip_with(base, ortho, lambda p, q: p * r["c"] + q * r["s"]))


def encode(space: Space, value: Column, mode: str, *args: float) -> Column:
    return {"linear": encode_linear, "circular": encode_circular, "thermometer": encode_thermometer, "log": encode_log}[mode](space, value, *args)


def decode_log(space: Space, v: Column, lo: float = 1e-2, hi: float = 1e10, probes: int = 500, kind: str = "scalar") -> Column:
    """The probe of an even grid over log10 whose encoding shares most signs with v, the first of the best: the low end of the arc, as all values of an arc are encoded alike."""
    b, o = (x.astype(int) for x in bases(space, kind))
    arcs = [literal(x) for x in (b, o, -b, -o)]
    score = [F.size(F.filter(F.zip_with(v, a, lambda x, y: x * y), lambda z: z > 0)) for a in arcs]
    a, z = math.log10(lo), math.log10(hi)
    grid = [a + (z - a) * i / max(1, probes - 1) for i in range(probes)]
    first: dict[int, float] = {}
    for g in grid:
        first.setdefault(int(((2 * math.pi * g / 10 + math.pi / 4) % (2 * math.pi)) // (math.pi / 2)) % 4, g)
    best = F.greatest(*[F.struct(score[i].alias("s"), F.lit(-g).alias("g")) for i, g in sorted(first.items())])
    return F.pow(F.lit(10.0), -best["g"])


def positional(space: Space, position: Column, scale: float | Column = 1000.0) -> Column:
    """Signs of sines (even components) and cosines (odd) of position at frequencies scale ** (-i / dims)."""
    wave = lambda x, i: F.signum(F.when(i % 2 == 0, F.sin(x)).otherwise(F.cos(x))).cast(T)
    if isinstance(scale, Column):
        both = F.struct(position.cast("double").alias("p"), scale.cast("double").alias("s"))
        exponents = literal([-i / space.dims for i in range(space.dims)], "double")
        return let(both, lambda b: F.transform(exponents, lambda e, i: wave(b["p"] * F.pow(b["s"], e), i)))
    freq = literal([scale ** (-i / space.dims) for i in range(space.dims)], "double")
    return let(position.cast("double"), lambda p: F.transform(freq, lambda f, i: wave(p * f, i)))


def log_positional(space: Space, value: Column, scale: float | Column = 1000.0) -> Column:
    x = value.cast("double")
    return F.when(x > 0, positional(space, F.log10(x), scale)).otherwise(F.array_repeat(F.lit(0).cast(T), space.dims))


RESOLUTION = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}


def seconds(ts: Column) -> Column:
    """Unix seconds of a number or a timestamp of either kind; the session's time zone is taken to be UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def time_parts(ts: Column) -> Column:
    """Hour of day, day of week (0: Sunday) and month of 30.5 days, from whole unix seconds."""
    secs = ts.cast("double").cast("long")
    days = F.floor(secs / 86400)
    return F.struct((F.pmod(secs, F.lit(86400)) / 3600.0).alias("hour"), F.pmod(days + 4, F.lit(7)).cast("double").alias("dow"), (F.pmod(days, F.lit(365)) / 30.5).alias("month"))


def _turned(space: Space, value: Column, period: float, part: str) -> Column:
    """sign(base cos + ortho sin) of two ternary atoms."""
    b, o = (literal(atom_array(space, f"__time_{x}_{part}__").tolist(), "double") for x in ("base", "ortho"))
    theta = value % F.lit(period) * F.lit(2 * math.pi / period)
    r = F.struct(F.cos(theta).alias("c"), F.sin(theta).alias("s"))
    return let(r, lambda r: F.zip_with(b, o, lambda p, q: F.signum(p * r["c"] + q * r["s"]).cast(T)))


def encode_time(space: Space, ts: Column, resolution: str = "hour") -> Column:
    """A time (unix seconds, or a timestamp) as the signed sum of hour, weekday and month, each turning, and of its place on the line, each bound to its role."""
    if resolution not in RESOLUTION:
        raise ValueError(f"unknown resolution {resolution}")
    ts = seconds(ts)
    p = time_parts(ts)
    parts = {r: _turned(space, p[r], period, r) for r, period in (("hour", 24.0), ("dow", 7.0), ("month", 12.0))}
    parts["position"] = positional(space, ts / RESOLUTION[resolution], 10_000.0)
    return bundle_columns([bind(literal(atom_array(space, f"__time_role_{r}__")), v) for r, v in parts.items()])
