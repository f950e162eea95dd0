"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import Storage


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. In local mode, where all tasks are in one process, the
    warehouse's folder serves where both are unset; on a cluster that is an error, as a local folder would not be shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not base and (master == "local" or master.startswith("local[")):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    if not base:
        raise Storage("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a durable cut of the lineage, with a known size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
