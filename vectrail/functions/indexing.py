"""Dense positions over a whole table without a window over all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """df with its position in the ascending order of key, from 0.

    Rows are range-partitioned, sorted and written once with their places inside their partitions. Positions are these plus
    the counts of the partitions before, a table of one row per partition; rows are shuffled once.
    """
    parts = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    placed = materialize(parts.withColumn("__at", F.monotonically_increasing_id()), "ranges")  # partition * 2 ** 33 + place
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(counts), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
