"""High dimensions: vectors as BINARY cells of one signed byte per component, handled in Arrow batches by numpy.

At D = 4096 an interpreted lambda per component costs more than the whole row does here; the array functions stay best up to a few hundred components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import Space


def pack(v: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, np.int8).tobytes() for x in s])

    return run(v)


def unpack(v: Column) -> Column:
    @F.pandas_udf("array<tinyint>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(x, np.int8) for x in s])

    return run(v)


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """The rows of a binary column without nulls as one matrix, without copying."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, dims), np.int8)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1]
    if offs[-1] - offs[0] != dims * len(col):
        raise ValueError("vector lengths differ")
    return np.frombuffer(data, np.int8)[offs[0] : offs[-1]].reshape(len(col), dims)


def column(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, np.int8)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.py_buffer(m)])


def _run(df: DataFrame, dims: int, cols: list[str], out: str, kind: str, f) -> DataFrame:
    keep = [c for c in df.columns if c not in cols]

    def go(batches):
        for b in batches:
            r = f(*[matrix(b.column(len(keep) + i), dims) for i in range(len(cols))])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], column(r) if kind == "binary" else pa.array(r)], [*keep, out])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{out} {kind}"])
    return df.select(*keep, *cols).mapInArrow(go, schema)


def bind(df: DataFrame, a: str, b: str, space: Space, out: str = "v") -> DataFrame:
    return _run(df, space.dims, [a, b], out, "binary", lambda x, y: x * y)


def cosine(df: DataFrame, a: str, b: str, space: Space, out: str = "sim") -> DataFrame:
    def f(x, y):
        x, y = x.astype(np.float32), y.astype(np.float32)
        dot = np.einsum("ij,ij->i", x, y).astype(float)
        n = np.sqrt(np.einsum("ij,ij->i", x, x).astype(float) * np.einsum("ij,ij->i", y, y).astype(float))
        return np.divide(dot, n, out=np.zeros(len(n)), where=n > 1e-10)

    return _run(df, space.dims, [a, b], out, "double", f)


def cosine_to(df: DataFrame, v: str, query: np.ndarray, space: Space, out: str = "sim") -> DataFrame:
    """Similarity of each row to one vector known when the plan is made."""
    q = np.asarray(query, np.float32)
    nq = float(np.sqrt(q @ q))

    def f(x):
        x = x.astype(np.float32)
        n = np.sqrt(np.einsum("ij,ij->i", x, x).astype(float)) * nq
        return np.divide((x @ q).astype(float), n, out=np.zeros(len(n)), where=n > 1e-10)

    return _run(df, space.dims, [v], out, "double", f)


def bundle(df: DataFrame, keys: list[str], v: str, space: Space) -> DataFrame:
    """keys, v: a task adds its rows per key in integers; a row per key and task is shuffled, and added there."""
    dims = space.dims
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    form = (kinds + ", " if keys else "") + "sums binary"

    def add(batches, first):
        held: dict[tuple, np.ndarray] = {}
        types: list = []
        for b in batches:
            types = [b.column(i).type for i in range(len(keys))]
            names = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * b.num_rows
            m = matrix(b.column(len(keys)), dims) if first else np.stack([np.frombuffer(x.as_py(), np.int64) for x in b.column(len(keys))]) if b.num_rows else np.zeros((0, dims))
            of: dict[tuple, list[int]] = {}
            for i, k in enumerate(names):
                of.setdefault(k, []).append(i)
            for k, at in of.items():
                s = m[at].sum(0, dtype=np.int64)
                held[k] = held[k] + s if k in held else s
        return held, types

    def rows(got, f, name):
        held, types = got
        if held:
            cols = list(zip(*held, strict=True)) if keys else []
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types, strict=True)], pa.array([f(s) for s in held.values()], pa.binary())], [*keys, name])

    part = df.select(*keys, v).where(F.col(v).isNotNull()).mapInArrow(lambda b: rows(add(b, True), lambda s: s.tobytes(), "sums"), form)
    part = part.repartition(*[F.col(k) for k in keys]) if keys else part.coalesce(1)
    return part.mapInArrow(lambda b: rows(add(b, False), lambda s: np.sign(s).astype(np.int8).tobytes(), "v"), form.replace("sums", "v"))


def atoms(df: DataFrame, text: str, space: Space, out: str = "v") -> DataFrame:
    """df with the packed atom of a text column. Values seen before are looked up, at most 20,000 at a time."""
    keep = df.columns

    def go(batches):
        from .atoms import atom_array

        known: dict[str, bytes] = {}
        for b in batches:
            texts = b.column(keep.index(text)).to_pylist()
            if len(known) > 20_000:
                known = {}
            for t in set(texts) - known.keys() - {None}:
                known[t] = atom_array(space, t).tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else known[t] for t in texts], pa.binary())], [*keep, out])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{out} binary"])
    return df.mapInArrow(go, schema)


def encode_json(df: DataFrame, text: str, space: Space, out: str = "v") -> DataFrame:
    """df with the packed vector of a JSON column. Equal texts in a batch, and leaves seen before, are encoded once."""
    keep = df.columns

    def go(batches):
        from ..sources.encode import Encoder, parse

        e = Encoder(space)
        whole: dict[str, np.ndarray] = {}
        for b in batches:
            texts = b.column(keep.index(text)).to_pylist()
            if len(whole) > 20_000:
                whole = {}
            for t in texts:
                if t is not None and t not in whole:
                    whole[t] = e.value(parse(t)).tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else whole[t] for t in texts], pa.binary())], [*keep, out])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{out} binary"])
    return df.mapInArrow(go, schema)
