"""Language identification by rank-order profiles (operator 1)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches

#: n-grams in a profile, of a language and of a document.
PROFILE = 400
NONE, GAP = 0, 1


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point -> 10-bit symbol: a letter below U+0250 has its own, other letters share by block and low bits, the rest is one gap."""
    table = np.full(0x110000, GAP, np.int32)
    own = [c for c in range(0x250) if chr(c).isalpha()]
    table[own] = np.arange(2, 2 + len(own))
    base = 2 + len(own)
    for c in range(0x250, 0x32000):
        if chr(c).isalpha():
            table[c] = base + (c * 40503 >> 3) % (1023 - base)
    return table


def ngrams(text: str) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of a text's letters; words are set off by single gaps."""
    c = _classes()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    c = np.concatenate(([GAP], c, [GAP]))
    c = c[np.concatenate(([True], (c[1:] != GAP) | (c[:-1] != GAP)))]
    if len(c) < 3:
        return np.zeros(0, np.int32)
    two = c[:-1] << 10 | c[1:]
    three = two[:-1] << 10 | c[2:]
    return np.concatenate((c[c != GAP], two, three[c[1:-1] != GAP])).astype(np.int32)


def ranked(codes: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent codes, most frequent first, ties to the smaller code."""
    if not len(codes):
        return np.zeros(0, np.int32)
    s = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    count = np.diff(np.concatenate((at, [len(s)]))).astype(np.int64)
    key = (-count << 32) | s[at].astype(np.int64)
    if len(key) > k:
        key = np.partition(key, k - 1)[:k]
    return (np.sort(key) & 0xFFFFFFFF).astype(np.int32)


def learn(docs: DataFrame, k: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from (text, lang) rows, all of them: each task counts its n-grams per language, the counts are summed by (language, n-gram), and the k first of each language come to the driver (languages x k rows)."""
    small_batches(docs.sparkSession)

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            parts: dict[str, list] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(ngrams(t))
            for lang, p in parts.items():
                u, n = np.unique(np.concatenate(p), return_counts=True)
                if lang in held:
                    both = np.concatenate((held[lang][0], u))
                    u, inv = np.unique(both, return_inverse=True)
                    n = np.bincount(inv, np.concatenate((held[lang][1], n)), len(u)).astype(np.int64)
                held[lang] = (u, n)
        for lang, (u, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u, pa.int32()), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    counted = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, code int, n long")
    summed = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= k)
    out: dict[str, list[int]] = {}
    for r in first.orderBy("lang", "rank").select("lang", "code").collect():
        out.setdefault(r[0], []).append(r[1])
    return out


class Ranker:
    """Distance of a document's profile to every language's at once."""

    def __init__(self, profiles: dict[str, list[int]], k: int = PROFILE):
        self.langs, self.k = sorted(profiles), k
        self.codes = np.unique(np.concatenate([np.array(profiles[x], np.int32) for x in self.langs])) if profiles else np.zeros(0, np.int32)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), 1 << 30, np.int64)
        for j, x in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[x]), j] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(ngrams(text), self.k) if text else np.zeros(0, np.int32)
        if not len(mine) or not self.langs:
            return "und", 0.0
        i = np.searchsorted(self.codes, mine)
        i[(i == len(self.codes)) | (self.codes[np.minimum(i, len(self.codes) - 1)] != mine)] = len(self.codes)
        far = np.minimum(np.abs(self.ranks[i] - np.arange(len(mine))[:, None]), self.k).sum(0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.k * len(mine)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], k: int = PROFILE) -> DataFrame:
    """lang_pred and score for each row of docs, with the columns of keep; no shuffle.

    A null or letterless text, or no profile at all, gives `und` and 0. Equal distances go to the language first by code point. Repeated rows are predicted alike; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    def run(batches):
        r = Ranker(profiles, k)
        for b in batches:
            got = [r.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`: learned on the documents outside the held-out quarter. A null doc_id is neither held out nor learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    quarter = F.crc32(F.col("doc_id").cast("string")) % 4
    profiles = learn(docs.where(quarter != 2))
    out = predict(docs.withColumn("held_out", F.coalesce(quarter == 2, F.lit(False))), profiles, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
