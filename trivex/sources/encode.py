"""Structured records as vectors: columns of struct, map and array type, and JSON texts of any shape.

A scalar is the atom "path.text"; a struct or map bundles bind(atom(path), child), a list binds each item to atom(path.[i]), a set binds the bundle of its items to a marker atom. Hints choose other encodings by path: set, spread, log, linear or time.
"""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, MapType, StringType, StructType, TimestampType

from ..config import Space
from ..functions import scalars
from ..functions.atoms import atom_array, atom_literal, atom_rows, atom_vector
from ..functions.vectors import bind, bundle_columns

SET = "set_indicator"
MARKERS = ("$log", "$linear", "$time")


def path_of(prefix: str | None, key: str) -> str:
    return f"{prefix}.{key}" if prefix else key


def field_stripe(path: str, n: int) -> int:
    """FNV-1a of a path, modulo n."""
    h = 0xCBF29CE484222325
    for b in path.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h % n


# native columns

def text_of(c: Column, kind: DataType) -> Column:
    """The text that a scalar has in its atom; null is "null", whole numbers have no fraction."""
    if isinstance(kind, (DoubleType, FloatType)):
        d = c.cast("double")
        c = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).otherwise(d.cast("string"))
    elif isinstance(kind, BooleanType):
        c = F.when(c, "true").when(~c, "false")
    return F.coalesce(c.cast("string"), F.lit("null"))


def _numeric(space: Space, c: Column, hint: str) -> Column:
    name, _, arg = hint.partition(":")
    if name == "log":
        return scalars.log_positional(space, c, float(arg or 1000))
    if name == "linear":
        return scalars.positional(space, c, float(arg or 1000))
    return scalars.encode_time(space, c, arg or "hour")


def _under(prefix: str | Column | None, key: str | Column) -> str | Column:
    """The path of key below prefix; a Column where either is known at run time only."""
    if isinstance(prefix, Column):
        return F.concat(prefix, F.lit("."), key if isinstance(key, Column) else F.lit(key))
    if isinstance(key, Column):
        return F.concat(F.lit(f"{prefix}." if prefix else ""), key)
    return path_of(prefix, key)


def _atom(space: Space, path: str | Column) -> Column:
    return atom_vector(space, path) if isinstance(path, Column) else atom_literal(space, path)


def encode(space: Space, c: Column, kind: DataType, hints: dict[str, str] | None = None, prefix: str | Column | None = None) -> Column:
    """Vector of a column of any nested type; the plan follows the type, so a record needs no walk at run time.

    hints maps paths to "set", "spread", "log[:scale]", "linear[:scale]" or "time[:resolution]"; items of lists and maps have paths of their own at run time and take none. A struct with a field $log, $linear or $time is that number, at its $scale where it has one. A null struct, map or list is the atom of "null" at its path.
    """
    hints = hints or {}
    hint = hints.get(prefix or "", "") if not isinstance(prefix, Column) else ""
    if hint.split(":")[0] in ("log", "linear", "time"):
        return _numeric(space, c, hint)
    if isinstance(kind, StructType):
        names = kind.fieldNames()
        marker = next((m for m in MARKERS if m in names), None)
        if marker:
            return _marked(space, c, marker, names)
        if not names:
            return _atom(space, _under(prefix, "{}"))
        parts = [bind(_atom(space, p), encode(space, c[f.name], f.dataType, hints, p)) for f in kind for p in [_under(prefix, f.name)]]
        whole = bundle_columns(parts)
    elif isinstance(kind, MapType):

        def entry(e):
            path = _under(prefix, e["key"].cast("string"))
            return bind(_atom(space, path), encode(space, e["value"], kind.valueType, hints, path))

        whole = F.when(F.size(c) == 0, _atom(space, _under(prefix, "{}"))).otherwise(_folded(space, F.transform(F.map_entries(c), entry)))
    elif isinstance(kind, ArrayType):
        if hint == "set":
            items = F.transform(F.array_distinct(c), lambda x: encode(space, x, kind.elementType, None, prefix))
            whole = F.when(F.size(c) == 0, _atom(space, _under(prefix, "#{}"))).otherwise(bind(atom_literal(space, SET), _folded(space, items)))
        else:

            def item(x, i):
                path = _under(prefix, F.concat(F.lit("["), i.cast("string"), F.lit("]")))
                return bind(_atom(space, path), encode(space, x, kind.elementType, hints, path))

            whole = F.when(F.size(c) == 0, _atom(space, _under(prefix, "[]"))).otherwise(_folded(space, F.transform(c, item)))
    else:
        path = prefix if isinstance(prefix, Column) else F.lit(prefix or "")
        return atom_vector(space, F.concat_ws(".", F.nullif(path, F.lit("")), text_of(c, kind)))
    return F.when(c.isNull(), _atom(space, _under(prefix, "null"))).otherwise(whole)


def _marked(space: Space, c: Column, marker: str, names: list[str]) -> Column:
    """The number of a struct that names its encoding; a scale that is missing, null or 0 is 1000. No number gives zeros."""
    if marker == "$time":
        return scalars.encode_time(space, c[marker])
    scale = F.coalesce(F.nullif(c["$scale"].cast("double"), F.lit(0.0)), F.lit(1000.0)) if "$scale" in names else 1000.0
    f = scalars.log_positional if marker == "$log" else scalars.positional
    return F.coalesce(F.when(c[marker].isNotNull(), f(space, c[marker], scale)), F.array_repeat(F.lit(0).cast("tinyint"), space.dims))


def _folded(space: Space, vectors: Column) -> Column:
    zero = F.array_repeat(F.lit(0), space.dims)
    summed = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: F.signum(x).cast("tinyint"))


# native types, in Arrow batches

#: Vectors of items of lists that are held at once.
HELD = 100_000


def _chunks(offsets: np.ndarray):
    """(first, last) of rows that follow each other and have at most HELD items, or are one row."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + HELD, "right")) - 1)
        yield i, j
        i = j


def _lists(col: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Offsets of a list column's rows in its items, the items, and which rows are no list."""
    counts = col.value_lengths().fill_null(0).to_numpy()
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), col.flatten(), col.is_null().to_numpy(zero_copy_only=False)


def _coded(space: Space, texts: pa.Array, name: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts, -1 for null, and the atom of each code's name."""
    coded = texts.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(), atom_rows(space, [name(t) for t in coded.dictionary.to_pylist()])


def _summed(rows: np.ndarray, starts: np.ndarray, how=np.add) -> np.ndarray:
    """Signs of the sum or product of the rows from each start to the next; starts are ascending, none is empty."""
    return np.sign(how.reduceat(rows, starts, 0, dtype=np.int32 if how is np.add else np.int8)).astype(np.int8)


def encode_sequence(space: Space, items: Column, mode: str, n: int = 3) -> Column:
    """bundle; positional (item i shifted by i); chained (product of all); ngram (products of n shifted neighbours, bundled; fewer items: bundle). No items give zeros, a null among them null."""
    if mode not in ("bundle", "positional", "chained", "ngram"):
        raise ValueError(f"unknown mode {mode}")

    def part(atoms, codes, offsets):
        """Vectors of rows with at least one item each; offsets of their codes."""
        counts, starts = np.diff(offsets), offsets[:-1]
        rows = atoms[codes]
        if mode == "positional":
            shift = (np.arange(len(codes)) - np.repeat(starts, counts)) % space.dims
            for k in np.unique(shift[shift > 0]).tolist():
                at = shift == k
                rows[at] = np.roll(rows[at], -k, 1)
        if mode != "ngram" or n == 1:
            return _summed(rows, starts, np.multiply if mode == "chained" else np.add)
        left = np.repeat(offsets[1:], counts) - np.arange(len(codes))  # items from here to the row's end
        grams = rows.copy()
        for k in range(1, n):
            grams[: len(codes) - k] *= np.roll(rows[k:], -k, 1)
        grams[(left < n) & np.repeat(counts >= n, counts)] = 0
        short = np.repeat(counts < n, counts)
        grams[short] = rows[short]
        return _summed(grams, starts)

    @F.arrow_udf("array<tinyint>")
    def run(col: pa.Array) -> pa.Array:
        offsets, flat, none = _lists(col)
        codes, atoms = _coded(space, flat, str)
        out = np.zeros((len(col), space.dims), np.int8)
        for i, j in _chunks(offsets):
            full = np.flatnonzero(np.diff(offsets[i : j + 1])) + i
            if len(full):
                out[full] = part(atoms, codes[offsets[i] : offsets[j]], np.append(offsets[full], offsets[j]) - offsets[i])
        bad = np.bincount(np.repeat(np.arange(len(col)), np.diff(offsets)), codes < 0, len(col)) > 0 if len(codes) else np.zeros(len(col), bool)
        return _masked(listed(out), none | bad)

    return run(items)


def _masked(vectors: pa.Array, none: np.ndarray) -> pa.Array:
    return vectors.take(pa.array(np.arange(len(vectors)), mask=none)) if none.any() else vectors


def encode_rows(space: Space, c: Column, kind: DataType, hints: dict[str, str] | None = None, prefix: str | None = None) -> Column:
    """encode() in Arrow batches: the atom of a text that many rows of a batch have is worked out once, and rows are added as matrices.

    For types of texts, lists of texts, times and structs of these; others are encoded by encode().
    """
    args: list[Column] = []
    hints = hints or {}

    def arg(x: Column) -> int:
        args.append(x)
        return len(args) - 1

    def node(c: Column, kind: DataType, prefix: str | None):
        """rows(cols) -> (vectors, which are null) of a column."""
        hint = hints.get(prefix or "", "")
        if hint.split(":")[0] == "time":
            return _time_rows(space, c, hint.partition(":")[2] or "hour", arg)
        under = lambda key: path_of(prefix, key)
        if isinstance(kind, StructType) and kind.fieldNames() and not set(MARKERS) & set(kind.fieldNames()):
            parts = [(atom_array(space, p), node(c[f.name], f.dataType, p)) for f in kind for p in [under(f.name)]]
            at = arg(c.isNull())

            def struct(cols):
                total, none = 0, False
                for role, child in parts:
                    v, missing = child(cols)
                    total, none = total + (role * v).astype(np.int32), none | missing
                return _instead(space, np.sign(total).astype(np.int8), none, cols[at], under("null"))

            return struct
        plain = lambda kind: not isinstance(kind, (StructType, MapType, ArrayType))
        if plain(kind) and not hint:
            at = arg(text_of(c, kind))

            def leaf(cols):
                codes, atoms = _coded(space, cols[at], under)
                return atoms[codes], np.zeros(len(codes), bool)

            return leaf
        if isinstance(kind, ArrayType) and plain(kind.elementType) and hint in ("", "set") and not any(k.startswith(under("[")) for k in hints):
            of = F.array_distinct(c) if hint else c
            at = arg(F.transform(of, lambda x: text_of(x, kind.elementType)))
            return lambda cols: _list_rows(space, cols[at], under, bool(hint))
        raise NotImplementedError

    try:
        root = node(c, kind, prefix)
    except NotImplementedError:
        return encode(space, c, kind, hints, prefix)

    @F.arrow_udf("array<tinyint>")
    def run(*cols: pa.Array) -> pa.Array:
        v, none = root(cols)
        return _masked(listed(v), none)

    return run(*args)


def _instead(space: Space, rows: np.ndarray, none: np.ndarray, empty: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """rows, but the atom of a name where there is no value."""
    at = empty.to_numpy(zero_copy_only=False)
    if at.any():
        rows[at] = atom_array(space, name)
    return rows, none & ~at


def _list_rows(space: Space, col: pa.Array, under: Callable[[str], str], distinct: bool) -> tuple[np.ndarray, np.ndarray]:
    offsets, flat, none = _lists(col)
    counts = np.diff(offsets)
    if distinct:
        codes, atoms = _coded(space, flat, under)
        empty, outer = under("#{}"), atom_array(space, SET)
    else:
        coded = flat.dictionary_encode()
        texts, place = coded.dictionary.to_pylist(), np.arange(len(flat)) - np.repeat(offsets[:-1], counts)
        pairs, codes = np.unique(place * max(1, len(texts)) + coded.indices.to_numpy(), return_inverse=True)
        places = (pairs // max(1, len(texts))).tolist()
        roles = atom_rows(space, [under(f"[{i}]") for i in range(int(counts.max(initial=0)))])
        atoms = atom_rows(space, [f"{under(f'[{i}]')}.{texts[k]}" for i, k in zip(places, (pairs % max(1, len(texts))).tolist(), strict=True)])
        atoms *= roles[places] if len(places) else 1
        empty, outer = under("[]"), 1
    out = np.zeros((len(col), space.dims), np.int8)
    for i, j in _chunks(offsets):
        full = np.flatnonzero(counts[i:j]) + i
        if len(full):
            out[full] = _summed(atoms[codes[offsets[i] : offsets[j]]], offsets[full] - offsets[i]) * outer
    out[counts == 0] = atom_array(space, empty)
    return _instead(space, out, np.zeros(len(col), bool), pa.array(none), under("null"))


def _time_rows(space: Space, c: Column, resolution: str, arg: Callable[[Column], int]):
    """Times as scalars.encode_time() has them: angles come from columns, signs from matrices."""
    if resolution not in scalars.RESOLUTION:
        raise ValueError(f"unknown resolution {resolution}")
    ts = scalars.seconds(c)
    p = scalars.time_parts(ts)
    turns = []
    for part, period in (("hour", 24.0), ("dow", 7.0), ("month", 12.0)):
        theta = p[part] % F.lit(period) * F.lit(2 * math.pi / period)
        role, base, ortho = (atom_array(space, f"__time_{x}__").astype(float) for x in (f"role_{part}", f"base_{part}", f"ortho_{part}"))
        turns.append((arg(F.cos(theta)), arg(F.sin(theta)), role, base, ortho))
    at, role = arg(ts / scalars.RESOLUTION[resolution]), atom_array(space, "__time_role_position__")
    freq = np.array([10_000.0 ** (-i / space.dims) for i in range(space.dims)])

    def rows(cols):
        number = lambda i: cols[i].to_numpy(zero_copy_only=False)[:, None]
        none = cols[at].is_null().to_numpy(zero_copy_only=False)
        x = np.where(none[:, None], 0.0, number(at)) * freq
        total = np.empty(x.shape)
        total[:, ::2], total[:, 1::2] = np.sin(x[:, ::2]), np.cos(x[:, 1::2])
        total = np.sign(total) * role
        for cos, sin, r, b, o in turns:
            total += r * np.sign(np.where(none[:, None], 0.0, b * number(cos) + o * number(sin)))
        return np.sign(total).astype(np.int8), none

    return rows


# texts of any shape, in Arrow batches

class _Text(float):
    """A JSON number with a fraction or exponent, and how it was written."""

    text = ""


def _number(s: str) -> _Text:
    x = _Text(s)
    x.text = s
    return x


def parse(text: str):
    return json.loads(text, parse_float=_number)


class Encoder:
    """The same encoding in numpy, for a worker; atoms are remembered, the oldest go first."""

    def __init__(self, space: Space, remember: int = 20_000):
        self.space, self.cache, self.most = space, OrderedDict(), remember

    def atom(self, name: str) -> np.ndarray:
        v = self.cache.get(name)
        if v is None:
            v = self.cache[name] = atom_array(self.space, name)
            if len(self.cache) > self.most:
                self.cache.popitem(last=False)
        return v

    def positional(self, x: float, scale: float) -> np.ndarray:
        i = np.arange(self.space.dims)
        f = x * scale ** (-i / self.space.dims)
        return np.sign(np.where(i % 2 == 0, np.sin(f), np.cos(f))).astype(np.int8)

    def marker(self, obj: dict) -> np.ndarray:
        number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        scale = number(obj.get("$scale", 1000.0)) or 1000.0
        if "$log" in obj:
            x = number(obj["$log"])
            return self.positional(math.log10(x), scale) if x is not None and x > 0 else np.zeros(self.space.dims, np.int8)
        x = number(obj["$linear"])
        return self.positional(x, scale) if x is not None else np.zeros(self.space.dims, np.int8)

    @staticmethod
    def text(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        return v.text if isinstance(v, _Text) else str(v)

    def value(self, v, prefix: str | None = None) -> np.ndarray:
        if isinstance(v, dict):
            if "$log" in v or "$linear" in v:
                return self.marker(v)
            if not v:
                return self.atom(path_of(prefix, "{}"))
            parts = [(path_of(prefix, k), x) for k, x in sorted(v.items())]
        elif isinstance(v, list):
            if not v:
                return self.atom(path_of(prefix, "[]"))
            parts = [(path_of(prefix, f"[{i}]"), x) for i, x in enumerate(v)]
        else:
            return self.atom(path_of(prefix, self.text(v)))
        total = np.zeros(self.space.dims, np.int32)
        for p, x in parts:
            total += self.atom(p) * self.value(x, p)
        return np.sign(total).astype(np.int8)

    def leaf(self, v, path: str) -> np.ndarray:
        """What a leaf adds to its stripe; zeros for an object that isn't empty."""
        if isinstance(v, dict) and v and not ("$log" in v or "$linear" in v):
            return np.zeros(self.space.dims, np.int8)
        return self.atom(path) * self.value(v, path)

    def leaves(self, v, prefix: str | None = None):
        """(path, value) of the leaves: objects are walked, a list is one leaf."""
        if isinstance(v, dict) and v and not ("$log" in v or "$linear" in v):
            for k, x in sorted(v.items()):
                yield from self.leaves(x, path_of(prefix, k))
        else:
            yield prefix or "", v

    def striped(self, v, n: int) -> list[np.ndarray]:
        sums = [np.zeros(self.space.dims, np.int32) for _ in range(n)]
        if isinstance(v, dict):
            for path, x in self.leaves(v):
                if path:
                    sums[field_stripe(path, n)] += self.leaf(x, path)
        return [np.sign(s).astype(np.int8) for s in sums]


def listed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of signed bytes as lists; of a block of matrices as lists of lists."""
    out = pa.array(np.ascontiguousarray(rows, np.int8).ravel())
    for n in rows.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(out) // n + 1, dtype=np.int32) * n), out)
    return out


def _once(space: Space, column: Column, kind: str, shape: tuple[int, ...], one: Callable, strict: bool = True) -> Column:
    """one(encoder, value) of each value as a column; values that repeat in a batch are encoded once."""
    held: list[Encoder] = []

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        if not held:
            held.append(Encoder(space))
        coded = values.dictionary_encode()
        rows, good = np.zeros((len(coded.dictionary), *shape), np.int8), np.ones(len(coded.dictionary), bool)
        for i, v in enumerate(coded.dictionary.to_pylist()):
            try:
                rows[i] = one(held[0], v)
            except ValueError:
                if strict:
                    raise
                good[i] = False
        at = coded.indices if good.all() else pc.if_else(pc.take(pa.array(good), coded.indices), coded.indices, None)
        return listed(rows).take(at)

    return run(column)


def atom_once(space: Space, text: Column) -> Column:
    """atom_vector(), in Arrow batches: for texts that repeat."""
    return _once(space, text.cast("string"), "array<tinyint>", (space.dims,), lambda e, t: e.atom(t))


def encode_json(space: Space, text: Column, strict: bool = True) -> Column:
    """Vector of a JSON text of any shape; a text that doesn't parse fails (strict) or gives null."""
    return _once(space, text, "array<tinyint>", (space.dims,), lambda e, t: e.value(parse(t)), strict)


def encode_json_striped(space: Space, text: Column, n: int) -> Column:
    """array of n stripe vectors; each leaf goes to the stripe of its path, an empty stripe is zeros."""
    return _once(space, text, "array<array<tinyint>>", (n, space.dims), lambda e, t: e.striped(parse(t), n))


def leaves(df: DataFrame, text: str) -> DataFrame:
    """df with a row per leaf of a JSON column: path and value as JSON."""

    @F.pandas_udf("array<struct<path: string, value: string>>")
    def run(s):
        import pandas as pd

        e = Encoder(Space(1))
        return pd.Series([[] if t is None else [{"path": p, "value": json.dumps(v)} for p, v in e.leaves(parse(t))] for t in s])

    return df.select("*", F.explode(run(F.col(text))).alias("_leaf")).select(*df.columns, "_leaf.path", "_leaf.value")
