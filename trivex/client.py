"""One object with the whole algebra for a space: methods take and give columns, or tables where an operation is over many rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .config import Space
from .functions import atoms, scalars, similarity, vectors
from .operators import aggregate, match, ordered
from .operators.engrams import Library
from .operators.subspace import Subspace
from .sources import codebook, encode


class Client:
    """Everything for one space, which its dimensions and seed fix; 4096 dimensions unless told otherwise."""

    def __init__(self, dims: int = 4096, seed: int = 0):
        self.space = Space(dims, seed)

    @property
    def dimensions(self) -> int:
        return self.space.dims

    # encoders

    def get_vector(self, atom: Column | str) -> Column:
        return atoms.atom_literal(self.space, atom) if isinstance(atom, str) else atoms.atom_vector(self.space, atom)

    def get_position_vector(self, position: Column) -> Column:
        return atoms.position_vector(self.space, position)

    def encode_json(self, text: Column, strict: bool = True) -> Column:
        return encode.encode_json(self.space, text, strict)

    def encode_json_striped(self, text: Column, stripes: int) -> Column:
        return encode.encode_json_striped(self.space, text, stripes)

    def encode_value(self, value) -> np.ndarray:
        return encode.Encoder(self.space).value(value)

    def encode_record(self, df: DataFrame, column: str, hints: dict[str, str] | None = None) -> Column:
        from pyspark.sql import functions as F

        return encode.encode(self.space, F.col(column), df.schema[column].dataType, hints)

    def encode_sequence(self, items: Column, mode: str, n: int = 3) -> Column:
        return encode.encode_sequence(self.space, items, mode, n)

    def encode_scalar(self, value: Column, mode: str, *args: float) -> Column:
        return scalars.encode(self.space, value, mode, *args)

    def encode_scalar_log(self, value: Column) -> Column:
        return scalars.encode_log(self.space, value)

    def decode_scalar_log(self, v: Column, lo: float = 1e-2, hi: float = 1e10) -> Column:
        return scalars.decode_log(self.space, v, lo, hi)

    def encode_time(self, ts: Column, resolution: str = "hour") -> Column:
        return scalars.encode_time(self.space, ts, resolution)

    # the algebra of columns: bind, negate, amplify and so on, as in functions.vectors

    def __getattr__(self, name: str):
        for module in (vectors, similarity):
            f = getattr(module, name, None)
            if callable(f) and not name.startswith("_"):
                return f
        raise AttributeError(name)

    def similarity(self, a: Column, b: Column, metric: str = "cosine") -> Column:
        return similarity.compute(a, b, metric)

    def significance(self, sim: Column) -> Column:
        return similarity.significance(sim, self.dimensions)

    def random_project(self, v: Column, target: int, seed: int) -> Column:
        return vectors.random_project(v, self.dimensions, target, seed)

    # over rows

    def bundle(self, df: DataFrame, keys: list[str], vec: str, weight: Column | None = None) -> DataFrame:
        return aggregate.bundle(df, keys, vec, self.dimensions, weight)

    centroid = bundle

    def prototype(self, df: DataFrame, keys: list[str], vec: str, threshold: float = 0.5) -> DataFrame:
        return aggregate.prototype(df, keys, vec, self.dimensions, threshold)

    def bundle_with_confidence(self, df: DataFrame, keys: list[str], vec: str) -> DataFrame:
        return aggregate.bundle_with_confidence(df, keys, vec, self.dimensions)

    def coherence(self, df: DataFrame, keys: list[str], vec: str) -> DataFrame:
        return aggregate.coherence(df, keys, vec, self.dimensions)

    def accumulate(self, df: DataFrame, keys: list[str], vec: str, weight: Column | None = None) -> DataFrame:
        return aggregate.accumulate(df, keys, vec, self.dimensions, weight)

    def cleanup(self, queries: DataFrame, book: DataFrame) -> DataFrame:
        return match.cleanup(queries, book)

    def invert(self, queries: DataFrame, book: DataFrame, k: int, threshold: float) -> DataFrame:
        return match.invert(queries, book, k, threshold)

    def topk_similar(self, queries: DataFrame, book: DataFrame, k: int) -> DataFrame:
        return match.topk_similar(queries, book, k)

    def similarity_matrix(self, vecs: DataFrame) -> DataFrame:
        return match.similarity_matrix(vecs)

    def autocorrelate(self, stream: DataFrame, max_lag: int) -> DataFrame:
        return ordered.autocorrelate(stream, max_lag)

    def cross_correlate(self, a: DataFrame, b: DataFrame, max_lag: int) -> DataFrame:
        return ordered.cross_correlate(a, b, max_lag)

    def segment(self, stream: DataFrame, window: int, threshold: float, method: str) -> DataFrame:
        return ordered.segment(stream, window, threshold, method, self.dimensions)

    def drift_rate(self, stream: DataFrame, window: int) -> DataFrame:
        return ordered.drift_rate(stream, window)

    # stores and learners

    def codebook(self, df: DataFrame, atom: str) -> DataFrame:
        return codebook.codebook(df, atom, self.space)

    def export_codebook(self, book: DataFrame, path: str) -> None:
        codebook.export_codebook(book, path)

    def import_codebook(self, spark, path: str, existing: DataFrame | None = None) -> DataFrame:
        return codebook.import_codebook(spark, path, existing)

    def create_subspace(self, k: int, **params) -> Subspace:
        return Subspace(self.dimensions, k, **params)

    def create_library(self, spark) -> Library:
        return Library.empty(spark)
