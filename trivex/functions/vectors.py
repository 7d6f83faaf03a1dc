"""Row-wise algebra on vector columns: Column in, Column out. A null vector gives null; unequal lengths raise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from ..config import DEGENERATE
from .atoms import literal

T = "tinyint"


def _sign(x: Column) -> Column:
    return F.signum(x).cast(T)


def let(value: Column, f) -> Column:
    """f(value) with value computed once per row, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def zipped(a: Column, b: Column, f) -> Column:
    """zip_with that refuses vectors of unequal length instead of padding with nulls; each side is computed once."""
    bad = F.raise_error(F.lit("vector lengths differ"))
    return F.zip_with(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), bad).otherwise(f(x, y)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


# containers

def zeros(dims: int) -> Column:
    return F.array_repeat(F.lit(0).cast(T), dims)


def from_f64(v: Column) -> Column:
    """Ternary signs of numbers; NaN counts as 0."""
    return F.transform(v, lambda x: _sign(F.nanvl(x.cast("double"), F.lit(0.0))))


def validated(v: Column) -> Column:
    """v itself, if all components are -1, 0 or 1; else an error."""
    return F.when(F.forall(v, lambda x: x.between(-1, 1)), v).otherwise(F.raise_error(F.lit("not a ternary vector")))


def to_f64(v: Column) -> Column:
    return v.cast("array<double>")


def component(v: Column, i: int) -> Column:
    return F.element_at(v, i + 1)


def dimensions(v: Column) -> Column:
    return F.size(v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit vector; zeros if the norm is degenerate."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > DEGENERATE, x.cast("double") / n).otherwise(0.0)))


def nnz(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x != 0))


# algebra

def bind(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: (x * y).cast(T))


#: Binding undoes itself where the key isn't 0, and is the per-component agreement of two vectors.
unbind = similarity_profile = bind


def profile_counts(p: Column) -> Column:
    """(agree, disagree, inactive) of a profile."""
    n = lambda f: F.size(F.filter(p, f))
    return F.struct(n(lambda x: x > 0).alias("agree"), n(lambda x: x < 0).alias("disagree"), n(lambda x: x == 0).alias("inactive"))


def negate(s: Column, c: Column, method: str = "subtract") -> Column:
    """Removes c from s: subtract and invert are sign(s - c), zero clears where c is active."""
    if method in ("subtract", "invert"):
        return zipped(s, c, lambda x, y: _sign(x.cast("int") - y))
    if method == "zero":
        return zipped(s, c, lambda x, y: F.when(y != 0, F.lit(0).cast(T)).otherwise(x))
    raise ValueError(f"unknown method {method}")


def amplify(s: Column, c: Column, strength: float) -> Column:
    return zipped(s, c, lambda x, y: _sign(x + F.lit(float(strength)) * y))


def prototype_add(p: Column, e: Column, count: int) -> Column:
    """The prototype of count examples with one more: sign of the weighted mean."""
    if count == 0:
        return e
    w = 1.0 / (count + 1)
    return zipped(p, e, lambda x, y: _sign(x * F.lit(1.0 - w) + y * F.lit(w)))


def difference(before: Column, after: Column) -> Column:
    return zipped(before, after, lambda x, y: _sign(y.cast("int") - x))


def blend_weighted(a: Column, b: Column, w1: float, w2: float) -> Column:
    return zipped(a, b, lambda x, y: _sign(F.lit(float(w1)) * x + F.lit(float(w2)) * y))


def blend(a: Column, b: Column, alpha: float) -> Column:
    return blend_weighted(a, b, 1.0 - alpha, alpha)


def resonance(v: Column, reference: Column) -> Column:
    """v where it agrees with the reference, else 0."""
    return zipped(v, reference, lambda x, y: F.when(x == y, x).otherwise(F.lit(0).cast(T)))


def permute(v: Column, k: int | Column) -> Column:
    """Cyclic shift: component i of the result is component i + k of v."""
    def shifted(v: Column) -> Column:
        n = F.pmod(F.lit(k) if isinstance(k, int) else k, F.size(v))
        return F.concat(F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(0))), F.slice(v, F.lit(1), n))

    return let(v, shifted)


def attend(query: Column, memory: Column, strength: float, mode: str) -> Column:
    """hard: resonance of memory with the query; soft: memory weighted by (1 + tanh(s q m)) / 2 of unit vectors' products; amplify: memory scaled by 1 + s on agreement. The last two keep what is beyond half."""
    if mode == "hard":
        return resonance(memory, query)
    keep = lambda x: F.when(x > 0.5, 1).when(x < -0.5, -1).otherwise(0).cast(T)
    if mode == "soft":
        # ternary: a weight is over one half exactly where s q m > 0
        if strength > 0:
            return zipped(query, memory, lambda q, m: F.when(q * m > 0, m).otherwise(F.lit(0).cast(T)))
        return zipped(query, memory, lambda q, m: keep(m * (1 + F.tanh(F.lit(float(strength)) * q * m)) / 2))
    if mode == "amplify":
        return zipped(query, memory, lambda q, m: keep(F.when(q * m > 0, m * F.lit(1.0 + strength)).otherwise(m.cast("double"))))
    raise ValueError(f"unknown mode {mode}")


def analogy(a: Column, b: Column, c: Column) -> Column:
    """c moved by what leads from a to b."""
    return zipped(c, difference(a, b), lambda x, d: _sign(x.cast("int") + d))


def conditional_bind(a: Column, b: Column, gate: Column, mode: str) -> Column:
    passes = {"positive": lambda g: g > 0, "negative": lambda g: g < 0, "nonzero": lambda g: g != 0}[mode]
    return zipped(bind(a, b), gate, lambda x, g: F.when(passes(g), x).otherwise(F.lit(0).cast(T)))


def sparsify(v: Column, k: int) -> Column:
    """The k components of largest magnitude, ties to the smaller index; all if k reaches the length."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"))))
    kept = F.transform(F.slice(ranked, 1, k), lambda s: s["i"])
    thin = let(kept, lambda ks: F.transform(v, lambda x, i: F.when(F.array_contains(ks, i), x).otherwise(F.lit(0).cast(T))))
    return F.when(F.size(v) <= k, v).otherwise(thin)


def flip(v: Column) -> Column:
    return F.transform(v, lambda x: (-x).cast(T))


def projection_matrix(dims: int, target: int, seed: int) -> np.ndarray:
    """target x dims of -1, 0, 1 with chances 1/6, 4/6, 1/6."""
    return np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 0, 0, 0, 0, 1], np.int8), size=(target, dims))


def random_project(v: Column, dims: int, target: int, seed: int) -> Column:
    """Signs of a sparse random projection to target components; only the matrix's nonzero entries are in the plan."""
    out = []
    for row in projection_matrix(dims, target, seed):
        plus, minus = np.flatnonzero(row > 0), np.flatnonzero(row < 0)
        pick = lambda at: F.aggregate(F.array(*[F.lit(int(i) + 1) for i in at]), F.lit(0), lambda s, i: s + F.element_at(v, i).cast("int")) if len(at) else F.lit(0)
        out.append(_sign(pick(plus) - pick(minus)))
    return F.array(*out)


def power(v: Column, exponent: float) -> Column:
    """0: zeros; even: magnitudes; odd or fractional: v itself."""
    if exponent < 0:
        raise ValueError("exponent must not be negative")
    if exponent == 0:
        return F.transform(v, lambda x: F.lit(0).cast(T))
    if exponent == int(exponent) and int(exponent) % 2 == 0:
        return F.transform(v, lambda x: F.abs(x).cast(T))
    return v


def reflect_about_mean(v: Column) -> Column:
    return let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: _sign(2 * mean - x)))


def grover_amplify(signal: Column, background: Column, iterations: int) -> Column:
    """Rounds of damping the background where it doesn't agree with the signal, then reflecting about the mean; signs at the end."""
    v = to_f64(background)
    for _ in range(iterations):
        v = zipped(v, signal, lambda x, y: x * (1 + F.tanh(x * y)) / 2)
        s = F.struct(v.alias("v"), (total(v) / F.size(v)).alias("m"))
        v = let(s, lambda r: F.transform(r["v"], lambda x: 2 * r["m"] - x))
    return F.transform(v, _sign)


def orthonormal(basis: list, orthogonalize: bool = True) -> np.ndarray:
    """Unit rows of a basis given when the plan is made, by Gram-Schmidt or each alone; degenerate ones go."""
    out: list[np.ndarray] = []
    for b in basis:
        r = np.asarray(b, float).copy()
        if orthogonalize:
            for o in out:
                r -= (r @ o) * o
        n = float(np.sqrt(r @ r))
        if n > DEGENERATE:
            out.append(r / n)
    return np.array(out)


def _projection(v: Column, basis: np.ndarray) -> Column:
    x = to_f64(v)
    acc = None
    for row in basis:
        r = literal(row.tolist(), "double")
        c = F.aggregate(F.zip_with(x, r, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
        part = let(c, lambda k: F.transform(r, lambda q: q * k))
        acc = part if acc is None else F.zip_with(acc, part, lambda p, q: p + q)
    return acc


def _cleaned(x: Column) -> Column:
    return F.when(F.abs(x) < DEGENERATE, 0.0).otherwise(x)


def project(v: Column, basis: list, orthogonalize: bool = True) -> Column:
    """Signs of the projection on the span of basis; no basis gives zeros."""
    b = orthonormal(basis, orthogonalize)
    return F.transform(v, lambda x: F.lit(0).cast(T)) if not len(b) else F.transform(_projection(v, b), lambda x: _sign(_cleaned(x)))


def reject(v: Column, basis: list, orthogonalize: bool = True) -> Column:
    """Signs of what the projection leaves; no basis leaves v."""
    b = orthonormal(basis, orthogonalize)
    return v if not len(b) else F.zip_with(to_f64(v), _projection(v, b), lambda x, p: _sign(_cleaned(x - p)))


def _signs(v: Column):
    return [F.size(F.filter(v, f)).cast("double") for f in (lambda x: x > 0, lambda x: x < 0, lambda x: x == 0)]


def complexity(v: Column) -> Column:
    """Half density, half balance of signs, in [0, 1]."""
    p, n, _ = _signs(v)
    balance = F.when(p + n > 0, 2 * F.least(p, n) / (p + n)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * (p + n) / F.size(v) + 0.5 * balance))


def entropy(v: Column) -> Column:
    """Shannon entropy of +, - and 0 over its largest value."""
    d = F.size(v)
    h = sum((F.when(c > 0, -(c / d) * F.log2(c / d)).otherwise(0.0) for c in _signs(v)), F.lit(0.0))
    return h / math.log2(3)


# numbers that aren't thresholded

def bind_f64(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x.cast("double") * y)


def dot_f64(a: Column, b: Column) -> Column:
    return F.aggregate(zipped(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def negate_f64(a: Column, b: Column) -> Column:
    """a less its projection on b."""
    bb = dot_f64(b, b)
    scale = F.when(bb > DEGENERATE, dot_f64(a, b) / bb).otherwise(0.0)
    return let(scale, lambda k: zipped(a, b, lambda x, y: x - k * y))


def cosine_f64(a: Column, b: Column) -> Column:
    d = F.sqrt(dot_f64(a, a) * dot_f64(b, b))
    return F.when(d < DEGENERATE, 0.0).otherwise(dot_f64(a, b) / d)


def bundle_columns(vectors: list[Column]) -> Column:
    """Sign of the sum of several vector columns of one row."""
    if not vectors:
        raise ValueError("nothing to bundle")
    acc = vectors[0].cast("array<int>")
    for v in vectors[1:]:
        acc = zipped(acc, v, lambda x, y: x + y)
    return F.transform(acc, _sign)
