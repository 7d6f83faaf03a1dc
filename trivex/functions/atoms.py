"""Atoms: deterministic ternary and bipolar vectors of texts, by SHA-256 in counter mode.

A block of 16 components comes from the digest of "<seed>|<atom>|<block>", 16 bits each: modulo 3 for trits, parity for signs. The same on a column, in plain Python, and in any SQL engine that has sha256.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, functions as F

from ..config import Space

PER_DIGEST = 16
POSITION = "__pos__"


def _words(space: Space, atom: Column) -> Column:
    """array<array<int>>: the 16-bit words of each block's digest."""
    blocks = F.sequence(F.lit(0), F.lit(-(-space.dims // PER_DIGEST) - 1))
    digests = F.transform(blocks, lambda b: F.sha2(F.concat(F.lit(f"{space.seed}|"), atom, F.lit("|"), b.cast("string")), 256))
    cut = lambda h: F.array(*[F.conv(F.substring(h, 4 * j + 1, 4), 16, 10).cast("int") for j in range(PER_DIGEST)])
    return F.flatten(F.transform(digests, cut))


def atom_vector(space: Space, atom: Column) -> Column:
    """Ternary vector array<tinyint> of a text column; each component is -1, 0 or 1 with chance 1/3. Null gives null."""
    return F.slice(F.transform(_words(space, atom.cast("string")), lambda w: (w % 3 - 1).cast("tinyint")), 1, space.dims)


def sign_vector(space: Space, name: Column) -> Column:
    """Bipolar vector of a text column."""
    return F.slice(F.transform(_words(space, name.cast("string")), lambda w: (1 - 2 * (w % 2)).cast("tinyint")), 1, space.dims)


def position_vector(space: Space, position: Column) -> Column:
    return atom_vector(space, F.concat(F.lit(POSITION), position.cast("string")))


def words_of(space: Space, atom: str) -> np.ndarray:
    n = -(-space.dims // PER_DIGEST)
    raw = b"".join(hashlib.sha256(f"{space.seed}|{atom}|{b}".encode()).digest() for b in range(n))
    return np.frombuffer(raw, ">u2")[: space.dims].astype(np.int64)


def atom_array(space: Space, atom: str) -> np.ndarray:
    """atom_vector() of a literal, computed when the plan is made."""
    return (words_of(space, atom) % 3 - 1).astype(np.int8)


def atom_rows(space: Space, atoms: list[str]) -> np.ndarray:
    """atom_array() of each of many texts, a row each."""
    n = -(-space.dims // PER_DIGEST)
    tails, sha = [f"|{b}".encode() for b in range(n)], hashlib.sha256
    raw = b"".join([sha(a + t).digest() for a in (f"{space.seed}|{x}".encode() for x in atoms) for t in tails])
    return (np.frombuffer(raw, ">u2").reshape(len(atoms), n * PER_DIGEST)[:, : space.dims] % 3).astype(np.int8) - np.int8(1)


def sign_array(space: Space, name: str) -> np.ndarray:
    return (1 - 2 * (words_of(space, name) % 2)).astype(np.int8)


def literal(values, kind: str = "tinyint") -> Column:
    """A vector known when the plan is made, as one literal."""
    return F.array(*[F.lit(x.item() if hasattr(x, "item") else x) for x in values]).cast(f"array<{kind}>")


def atom_literal(space: Space, atom: str) -> Column:
    return literal(atom_array(space, atom))
