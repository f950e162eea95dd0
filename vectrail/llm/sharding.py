"""Proportional stratified interleaving: seeded shuffle within each source, order by fractional rank, cut evenly.

A row's fractional rank is (rank + u) / rows of its source for its rank in its source's shuffled order and a seeded
offset u of the source in [0, 1), so any contiguous piece of the order holds every source in its share, the many sources
of one row or a few spread over the whole order, and the cut into equal pieces gives each shard the mixture. Ranks come from counts: rows are dealt to BUCKETS ranges of their shuffle key (a hash, so even a
source that holds a third of all rows spreads evenly), ranked inside their bucket, and offset by the counts of the
buckets before it. No window over rows spans a source or the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Ranges of the shuffle key in each source, and of the fractional rank in the whole order; 16 ** HEX of them.
HEX = 3
BUCKETS = 16**HEX


def shuffle_key(seed: int, doc_id: Column, text: Column) -> Column:
    """A hash of the doc_id, or of the text for rows without one, which would all share one key otherwise."""
    other = F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), other)))


def offset(seed: int, source: Column) -> Column:
    """A seeded number in [0, 1) of a source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source)), 1, 8), 16, 10).cast("double") / 2**32


def _offsets(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Per keys and bucket the number of rows in the key's earlier buckets, and in all of them."""
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.sum("_n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return counts.select(*keys, bucket, before.alias("_before"), F.sum("_n").over(w).alias("_total"))


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text, source).

    Counts of the shards differ by at most one (law "rows"), slots run from 0 without gaps. Null text has size 1
    and checksum 0; null source is a source of its own; rows that agree in doc_id and text are ranked next to each
    other, in either order; rows without doc_id are dealt by their text. Texts of any length are only measured, in place. An empty table gives an empty result.
    """
    base = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), shuffle_key(seed, F.col("doc_id"), F.col("text")).alias("_key"),
    ).withColumn("_bucket", F.substring("_key", 1, HEX))
    per = _offsets(base, ["_source"], "_bucket")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "text_crc32", "size")
    ranked = base.withColumn("_rank", F.row_number().over(inside) - 1).join(per, ["_source", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).withColumnRenamed("_total", "_of").drop("_before")
    ranked = ranked.withColumn("_fraction", (F.col("_rank") + offset(seed, F.col("_source"))) / F.col("_of"))
    ranked = ranked.withColumn("_slice", F.floor(F.col("_fraction") * BUCKETS))
    whole = _offsets(ranked.withColumn("_all", F.lit(0)), ["_all"], "_slice").drop("_all")
    order = Window.partitionBy("_slice").orderBy("_fraction", "_source", "_rank")
    at = ranked.withColumn("_at", F.row_number().over(order) - 1).join(whole, "_slice").withColumn("_at", F.col("_at") + F.col("_before"))
    at = at.withColumn("shard", F.expr(f"cast((_at * {shards}) div _total as int)"))
    first = F.expr(f"(cast(shard as bigint) * _total + {shards - 1}) div {shards}")
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))


#: CRC-32 of a text from its bytes, table-driven; for DuckDB, which has no such function.
CRC_SQL = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"""

OP2_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, coalesce('=' || source, '') AS s,
  md5('17:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS k, hex(encode(coalesce(text, ''))) AS hx FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS rk, count(*) OVER (PARTITION BY s) AS n FROM d),
f AS (SELECT *, (rk + ('0x' || substr(md5('17:' || s), 1, 8))::UBIGINT::DOUBLE / 4294967296) / n AS fr FROM r),
g AS (SELECT *, row_number() OVER (ORDER BY fr, s, rk) - 1 AS pos, count(*) OVER () AS total FROM f),
h AS (SELECT *, (pos * 8) // total AS sh FROM g)
SELECT doc_id, size, xor(list_reduce(list_transform(regexp_extract_all(hx, '..'),
    lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32,
  'rows' AS law, sh::INTEGER AS shard, (pos - (sh * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM h, crc
"""
