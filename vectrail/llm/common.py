"""Helpers that the corpus operators share: words, scratch tables, row ids, distributed prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII blanks.
BLANK = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: spark.checkpoint.dir, or the folder given to setCheckpointDir. In local mode
    a folder of the warehouse serves where both are unset; on a cluster that is an error, as local folders aren't shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not base and (master == "local" or master.startswith("local[")):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"  # one process: every task sees it
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders written inside ``temporary`` blocks, the innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` writes inside the block at its end, but those written with keep: what leaves
    the block must not read the others."""
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(token)
        for x in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: cuts the lineage durably and gives
    the planner the true size, so that later joins broadcast it only below spark.sql.autoBroadcastJoinThreshold."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not keep and _written.get():
        _written.get()[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """row_id and row (a struct of all columns) of every row, written once: ids stay the same however often it is read,
    whatever doc_id is (null, repeated), and no column's name can clash."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), name)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: its total over the rows before, in an order of all rows.

    Rows are dealt to ranges of the order and written; each range is summed on its own and offset by the totals of the
    ranges before (one row per range). No window spans more than a range.
    """
    names = {c: f"_own_{c}" for c in sums}
    keys = [x.alias(f"_key{i}") for i, x in enumerate(order)]
    d = df.select("*", *keys, *[x.alias(names[c]) for c, x in sums.items()])
    by = [f"_key{i}" for i in range(len(order))]
    d = materialize(d.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = d.groupBy("_range").agg(*[F.sum(x).alias(f"_of_{c}") for c, x in names.items()])
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = totals.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_of_{c}").over(upto), F.lit(0)).alias(f"_at_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_in_{c}") for c, x in names.items()])
    d = d.join(offsets, d["_range"] == offsets["_r"])
    return d.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_at_{c}") + F.col(f"_in_{c}")).alias(c) for c in sums])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
