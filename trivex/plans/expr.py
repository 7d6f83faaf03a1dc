"""The algebra as expression trees: typed leaves, operators, holes; canonical bytes, and compilation to columns or literals."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, functions as F

from ..config import Space
from ..functions import scalars, vectors
from ..functions.atoms import literal, words_of
from ..sources.encode import atom_once


class Expr:
    """A node; equal and hashed by its canonical bytes, so numbers are compared by their bits."""

    def __eq__(self, other):
        return isinstance(other, Expr) and canonical(self) == canonical(other)

    def __hash__(self):
        return hash(canonical(self))

    def children(self) -> list[Expr]:
        out = []
        for f in fields(self):
            v = getattr(self, f.name)
            out += [v] if isinstance(v, Expr) else [x for x in v if isinstance(x, Expr)] if isinstance(v, tuple) else []
        return out

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


def _node(cls):
    return dataclass(frozen=True, eq=False)(cls)


@_node
class String(Expr):
    value: str


@_node
class I64(Expr):
    value: int


@_node
class F64(Expr):
    value: float


@_node
class Bool(Expr):
    value: bool


@_node
class Char(Expr):
    value: str


@_node
class Atom(Expr):
    """Another expression, quoted: one opaque vector by its identity."""

    inner: Expr


@_node
class Bind(Expr):
    a: Expr
    b: Expr


@_node
class Bundle(Expr):
    parts: tuple


@_node
class Permute(Expr):
    child: Expr
    k: int


@_node
class Thermometer(Expr):
    value: object  # a number, or a Column
    lo: float
    hi: float


@_node
class Blend(Expr):
    a: Expr
    b: Expr
    w1: float
    w2: float


@_node
class Slot(Expr):
    """A hole in a template."""

    lo: float
    hi: float


@_node
class Field(Expr):
    """The atom of each row's text in a column."""

    column: object


def _classified(kind: str, content: str) -> Expr:
    return Bind(Atom(String(kind)), Atom(String(content)))


def _content(e: Expr, kind: str) -> str | None:
    if isinstance(e, Bind) and isinstance(e.a, Atom) and isinstance(e.b, Atom) and isinstance(e.a.inner, String) and isinstance(e.b.inner, String) and e.a.inner.value == kind:
        return e.b.inner.value
    return None


def symbol(s: str) -> Expr:
    return _classified("Symbol", s)


def keyword(s: str) -> Expr:
    return _classified("Keyword", s.removeprefix(":"))


def tag(s: str) -> Expr:
    return _classified("Tag", s.removeprefix("#"))


def nil() -> Expr:
    return symbol("nil")


def as_symbol(e: Expr) -> str | None:
    return _content(e, "Symbol")


def as_keyword(e: Expr) -> str | None:
    return _content(e, "Keyword")


def as_tag(e: Expr) -> str | None:
    return _content(e, "Tag")


def is_nil(e: Expr) -> bool:
    return as_symbol(e) == "nil"


def value_of(e: Expr, kind: type) -> object:
    """The leaf's value if it is of this kind, else None."""
    return e.value if type(e) is kind and kind in (String, I64, F64, Bool, Char) else None


def atom_inner(e: Expr) -> Expr | None:
    return e.inner if isinstance(e, Atom) else None


def template(e: Expr) -> Expr:
    """e with a hole for each thermometer: what two expressions that differ in numbers only have in common."""
    if isinstance(e, Thermometer):
        return Slot(e.lo, e.hi)
    put = lambda v: template(v) if isinstance(v, Expr) else tuple(map(template, v)) if isinstance(v, tuple) else v
    return type(e)(*[put(getattr(e, f.name)) for f in fields(e)])


def slots(e: Expr) -> list[float]:
    return [x.value for x in e.walk() if isinstance(x, Thermometer)]


def ranges(e: Expr) -> list[tuple[float, float]]:
    return [(x.lo, x.hi) for x in e.walk() if isinstance(x, Thermometer)]


def _sized(b: bytes) -> bytes:
    return struct.pack("<I", len(b)) + b


def canonical(e: Expr) -> bytes:
    """Injective bytes of an expression: a tag per kind, sizes before all that varies."""
    f64 = lambda *x: struct.pack(f"<{len(x)}d", *x)
    if isinstance(e, (String, I64, F64, Bool, Char, Atom)):
        kind, body = {
            String: lambda: ("string", e.value.encode()),
            I64: lambda: ("i64", struct.pack("<q", e.value)),
            F64: lambda: ("f64", f64(e.value)),
            Bool: lambda: ("bool", bytes([e.value])),
            Char: lambda: ("char", struct.pack("<I", ord(e.value))),
            Atom: lambda: ("expr", canonical(e.inner)),
        }[type(e)]()
        return b"\1" + _sized(kind.encode()) + _sized(body)
    if isinstance(e, Bind):
        return b"\2" + _sized(canonical(e.a)) + _sized(canonical(e.b))
    if isinstance(e, Bundle):
        return b"\3" + struct.pack("<I", len(e.parts)) + b"".join(_sized(canonical(p)) for p in e.parts)
    if isinstance(e, Permute):
        return b"\4" + _sized(canonical(e.child)) + struct.pack("<i", e.k)
    if isinstance(e, Thermometer):
        return b"\5" + (f64(e.value, e.lo, e.hi) if not isinstance(e.value, Column) else _sized(str(e.value).encode()) + f64(e.lo, e.hi))
    if isinstance(e, Blend):
        return b"\6" + _sized(canonical(e.a)) + _sized(canonical(e.b)) + f64(e.w1, e.w2)
    if isinstance(e, Slot):
        return b"\7" + f64(e.lo, e.hi)
    return b"\x08" + _sized(str(e.column).encode())


def leaf_name(e: Expr) -> str:
    """The atom that stands for a leaf: its type is part of it, so 1 and "1" differ."""
    return "leaf:" + hashlib.sha256(canonical(e)).hexdigest()


def simplify(e: Expr) -> Expr:
    """Shifts of shifts are one, a shift by 0 none; a bundle of one part is that part."""
    put = lambda v: simplify(v) if isinstance(v, Expr) else tuple(map(simplify, v)) if isinstance(v, tuple) else v
    e = type(e)(*[put(getattr(e, f.name)) for f in fields(e)])
    if isinstance(e, Permute):
        if isinstance(e.child, Permute):
            e = Permute(e.child.child, e.k + e.child.k)
        if e.k == 0:
            return e.child
    if isinstance(e, Bundle) and len(e.parts) == 1:
        return e.parts[0]
    return e


def constant(e: Expr) -> bool:
    return not any(isinstance(x, Field) or isinstance(x, Thermometer) and isinstance(x.value, Column) for x in e.walk())


def array(e: Expr, space: Space) -> np.ndarray:
    """The vector of a constant expression."""
    if isinstance(e, (String, I64, F64, Bool, Char, Atom)):
        return (words_of(space, leaf_name(e)) % 3 - 1).astype(np.int8)
    if isinstance(e, Bind):
        return array(e.a, space) * array(e.b, space)
    if isinstance(e, Bundle):
        return np.sign(sum((array(p, space).astype(int) for p in e.parts), np.zeros(space.dims, int))).astype(np.int8)
    if isinstance(e, Permute):
        return np.roll(array(e.child, space), -e.k)
    if isinstance(e, Thermometer):
        share = 0.5 if e.hi == e.lo else min(1.0, max(0.0, (e.value - e.lo) / (e.hi - e.lo)))
        return np.where(np.arange(space.dims) < np.floor(share * space.dims + 0.5), 1, -1).astype(np.int8)
    if isinstance(e, Blend):
        return np.sign(e.w1 * array(e.a, space) + e.w2 * array(e.b, space)).astype(np.int8)
    raise ValueError("a slot has no vector: fill the template first")


def compile(e: Expr, space: Space) -> Column:
    """A column of an expression; constant parts become literals when the plan is made."""
    e = simplify(e)
    if constant(e):
        return literal(array(e, space))
    if isinstance(e, Field):
        return atom_once(space, F.col(e.column) if isinstance(e.column, str) else e.column)
    if isinstance(e, Bind):
        return vectors.bind(compile(e.a, space), compile(e.b, space))
    if isinstance(e, Bundle):
        return vectors.bundle_columns([compile(p, space) for p in e.parts])
    if isinstance(e, Permute):
        return vectors.permute(compile(e.child, space), e.k)
    if isinstance(e, Thermometer):
        return scalars.encode_thermometer(space, e.value, e.lo, e.hi)
    if isinstance(e, Blend):
        return vectors.blend_weighted(compile(e.a, space), compile(e.b, space), e.w1, e.w2)
    raise ValueError("a quoted expression must be constant")


