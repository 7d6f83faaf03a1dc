"""Engrams: named subspace models as table rows, stored, matched against vectors, spectra and other models."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .ordered import matrix
from .subspace import FIELDS, GROUP_ROWS, MODEL, SENT_BYTES, Subspace, model_bytes

SCHEMA = f"name string, snapshot struct<{', '.join(': '.join(x.split()) for x in MODEL.split(', '))}>, signature array<double>, surprise map<string,double>, metadata map<string,string>"


def signature(eigenvalues) -> list[float]:
    """Eigenvalues at unit length."""
    e = np.asarray(eigenvalues, float)
    n = np.sqrt(e @ e)
    return (e / n if n > 1e-10 else e).tolist()


class Library:
    """A set of engrams, at most one of a name."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def empty(spark: SparkSession) -> "Library":
        return Library(spark.createDataFrame([], SCHEMA))

    def add(self, name: str, model: Subspace, surprise: dict | None = None, metadata: dict | None = None) -> "Library":
        """With one more engram; it replaces that of the same name."""
        row = (name, tuple(model.snapshot()[f] for f in FIELDS), signature(model.eigenvalues()), surprise or {}, metadata or {})
        new = self.df.sparkSession.createDataFrame([row], SCHEMA)
        return Library(self.df.where(F.col("name") != name).unionByName(new))

    def add_models(self, models: DataFrame, key: str) -> "Library":
        """An engram for each model row, named by its key; those names are replaced."""
        snap = F.struct(*[F.col(f) for f in FIELDS])

        @F.pandas_udf("array<double>")
        def sig(c: pd.Series, k: pd.Series) -> pd.Series:
            return pd.Series([signature(np.sqrt((np.reshape(x, (n, -1)) ** 2).sum(1))) for x, n in zip(c, k, strict=True)])

        new = models.select(F.col(key).cast("string").alias("name"), snap.alias("snapshot"), sig("components", "k").alias("signature"), F.create_map().cast("map<string,double>").alias("surprise"), F.create_map().cast("map<string,string>").alias("metadata"))
        both = new.withColumn("_p", F.lit(0)).unionByName(self.df.withColumn("_p", F.lit(1)))
        first = F.row_number().over(Window.partitionBy("name").orderBy("_p"))
        return Library(both.withColumn("_r", first).where("_r = 1").drop("_p", "_r"))

    def remove(self, name: str) -> "Library":
        return Library(self.df.where(F.col("name") != name))

    def copy(self, old: str, new: str) -> "Library":
        return Library(self.df.where(F.col("name") != new).unionByName(self.df.where(F.col("name") == old).withColumn("name", F.lit(new))))

    def names(self) -> DataFrame:
        return self.df.select("name").orderBy("name")

    def get(self, name: str) -> DataFrame:
        return self.df.where(F.col("name") == name)

    def contains(self, name: str) -> bool:
        return not self.get(name).isEmpty()

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def save(self, path: str, form: str = "parquet") -> None:
        self.df.write.mode("overwrite").format(form).save(path)

    @staticmethod
    def load(spark: SparkSession, path: str, form: str = "parquet") -> "Library":
        return Library(spark.read.schema(SCHEMA).format(form).load(path))

    def match_vec(self, probes: DataFrame, qid: str, vec: str, k: int) -> DataFrame:
        """(qid, rank, name, residual): the k engrams that explain each vector best, ties by name. All are scored; no prefilter.

        A library whose models' bytes are counted to be few is sent to the tasks; a larger one is cut into blocks that blocks of probes meet, and only k rows per probe and block are shuffled.
        """
        spark = probes.sparkSession
        x = probes.select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("x")).where("x is not null")
        size = model_bytes(self.df.select("snapshot.*"))
        form = f"qid {x.schema['qid'].dataType.simpleString()}, name string, residual double"

        def best(ids, m, models):
            names = np.array([n for n, _ in models], object)
            r = np.stack([Subspace.restore(s).residuals(m) for _, s in models], 1)
            top = [np.lexsort((names, row))[:k] for row in r]
            at = np.repeat(np.arange(len(m)), [len(t) for t in top])
            j = np.concatenate(top)
            return pa.table({"qid": ids.take(pa.array(at)), "name": pa.array(names[j].tolist(), pa.string()), "residual": pa.array(r[at, j])})

        if size <= SENT_BYTES:
            sent = spark.sparkContext.broadcast([(r["name"], r["snapshot"].asDict()) for r in self.df.orderBy("name").collect()])

            def scan(batches):
                for b in batches:
                    if sent.value and b.num_rows:
                        yield from best(b.column(0), matrix(b.column(1)), sent.value).to_batches()

            found = x.mapInArrow(scan, form)
        else:
            blocks, parts = -(-size // SENT_BYTES), -(-x.count() // GROUP_ROWS) or 1
            one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
            left = x.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(parts))).withColumn("block", one(blocks))
            right = self.df.select("name", "snapshot", F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block"), one(parts).alias("part"))

            def meet(a: pa.Table, b: pa.Table) -> pa.Table:
                if not a.num_rows or not b.num_rows:
                    return pa.table({"qid": a.column("qid").slice(0, 0), "name": pa.array([], pa.string()), "residual": pa.array([], pa.float64())})
                models = list(zip(b.column("name").to_pylist(), b.column("snapshot").to_pylist(), strict=True))
                return best(a.column("qid").combine_chunks(), matrix(a.column("x").combine_chunks()), models)

            found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, form)
        w = Window.partitionBy("qid").orderBy("residual", "name")
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return ranked.select(F.col("qid").alias(qid), "rank", "name", "residual")

    def match_spectrum(self, eigenvalues, k: int) -> DataFrame:
        """(name, score): engrams by the product of their signature with a spectrum at unit length, over the common length."""
        e = np.asarray(eigenvalues, float)
        n = float(np.sqrt(e @ e))
        if n < 1e-10:
            return self.df.limit(0).select("name", F.lit(0.0).alias("score"))
        probe = F.array(*[F.lit(float(x / n)) for x in e])
        common = F.least(F.size("signature"), F.lit(len(e)))
        score = F.aggregate(F.zip_with(F.slice("signature", F.lit(1), common), F.slice(probe, F.lit(1), common), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return self.df.select("name", score.alias("score")).orderBy(F.desc("score"), "name").limit(k)

    def match_alignment(self, probe: Subspace, k: int) -> DataFrame:
        """(name, score): engrams by the alignment of their subspace with the probe's."""

        @F.pandas_udf("double")
        def run(s: pd.DataFrame) -> pd.Series:
            return pd.Series([probe.alignment(Subspace.restore(r)) for r in s.to_dict("records")])

        return self.df.select("name", run("snapshot").alias("score")).orderBy(F.desc("score"), "name").limit(k)
