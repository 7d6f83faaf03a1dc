"""Codebooks: tables (atom, v) that are computed once per distinct atom, stored, read and joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import Space
from ..functions.atoms import POSITION, atom_vector


def codebook(df: DataFrame, atom: str, space: Space) -> DataFrame:
    """One row per distinct atom of a column."""
    return df.select(F.col(atom).cast("string").alias("atom")).where("atom is not null").distinct().withColumn("v", atom_vector(space, F.col("atom")))


def with_vectors(df: DataFrame, atom: str, book: DataFrame, as_: str = "v") -> DataFrame:
    """df with the vector of each row's atom, by an equi-join whose strategy Spark picks by the codebook's size."""
    return df.join(book.select(F.col("atom").alias(atom), F.col("v").alias(as_)), atom, "left")


def encoded_once(df: DataFrame, column: str, encode: Callable[[Column], Column], as_: str = "v") -> DataFrame:
    """df with encode(column) worked out once per distinct value and joined, for columns that repeat their values, as dates do."""
    book = df.select(F.col(column).alias("_value")).distinct().select("_value", encode(F.col("_value")).alias(as_))
    return df.join(book, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def export_codebook(book: DataFrame, path: str) -> None:
    book.write.mode("overwrite").parquet(path)


def import_codebook(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """A stored codebook; its rows replace those of existing, whose other rows stay."""
    new = spark.read.parquet(path)
    if existing is None:
        return new
    both = new.withColumn("_p", F.lit(0)).unionByName(existing.withColumn("_p", F.lit(1)))
    w = Window.partitionBy("atom").orderBy("_p")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_p", "_r")


def cache_size(book: DataFrame) -> int:
    return book.where(~F.col("atom").startswith(POSITION)).count()


def position_cache_size(book: DataFrame) -> int:
    return book.where(F.col("atom").startswith(POSITION)).count()
