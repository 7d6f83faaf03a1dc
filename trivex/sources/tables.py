"""Tables written once to the folder that driver and executors share: they fix what a later job must find unchanged, and cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set with setCheckpointDir. A folder of one machine would lose rows on a cluster, so there is no other default, but for local masters the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_.get() if set_.isDefined() else None
    if not found and spark.sparkContext.master.startswith("local"):
        found = spark.conf.get("spark.sql.warehouse.dir")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
