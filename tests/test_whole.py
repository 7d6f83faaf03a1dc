"""Queries without SQL answer for every row of their table."""

import os

import pytest
from pyspark.sql import functions as F

from trivex.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "table", "key"), [("engram_match", "embeddings", "vec_id"), ("self_training", "events", "event_id")])
def test_every_row(spark, name, table, key):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    want = spark.read.parquet(f"{DATA}/{table}.parquet").select(key).distinct()
    got = QUERIES[name](spark, DATA)
    assert sorted(r[0] for r in got.select(key).distinct().collect()) == sorted(r[0] for r in want.collect())
    assert got.where(F.col(key).isNull()).count() == 0
