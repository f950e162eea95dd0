"""Mixing sources to target weights by hash-random keys, range sort, prefix sums and an exact cut.

Each row gets a hash-random key. Rows are dealt to ranges of the key within their source, sorted inside each range,
and their running word counts are offset by the sums of the ranges before: a distributed prefix sum in which no
window over rows spans a source. A source whose budget exceeds its size is taken whole as often as it fits, and the
rest is cut from the start of the order, to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, running, table, words
from .sharding import HEX, shuffle_key

#: A source gives at most so many times its size.
MAX_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and target of each source, from (_source, source_size): one row per source.

    Sources in code point order, null last, get the weights in turn and share the total of all sizes. A target
    above cap times the source's size stops there and the excess is shared by weight among the others, until none is
    above. That fixed point is found directly: in order of cap / weight, the stopped sources are the longest prefix
    that its successors' common level exceeds. Ranks and sums are taken by ranges, so sources may be very many; the
    driver reads three totals.
    """
    s = running(sizes, [F.col("_source").isNull(), F.col("_source")], {"_rank": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("_w", w.cast("long")).withColumn("_cap", F.col("source_size") * cap)
    order = [F.col("_cap").cast("double") / F.col("_w"), F.col("_rank")]
    s = materialize(running(s, order, {"_capped": F.col("_cap"), "_before": F.col("_w")}), "targets")
    all_ = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    # what is left to share, and among what weight, if this source and all after it stay below their caps
    s = s.withColumn("_rest", F.lit(all_.size) - F.col("_capped")).withColumn("_left", F.lit(all_.w) - F.col("_before"))
    wide = "decimal(19,0)"
    s = s.withColumn("_stops", F.col("_rest").cast(wide) * F.col("_w").cast(wide) > F.col("_cap").cast(wide) * F.col("_left").cast(wide))
    level = s.filter(~F.col("_stops")).agg(F.min(F.struct("_capped", "_rest", "_left")).alias("m")).first().m
    shared = F.lit(0.0) if level is None else F.lit(float(level._rest)) * F.col("_w") / F.lit(level._left)
    return s.select("_source", "source_size", F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(shared).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_EPOCHS, seed: int = 23, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of every row of docs (doc_id, text, source), and with
    carry the row itself as a struct ``row`` of all its columns, so that nothing has to be joined back by an id.

    size is the number of words (null text: 0), taken the words that the mix takes, repeats counted; a source's taken
    sum to the floor of its target. copies counts whole documents for pipelines: the full rounds, and one more for
    documents that start before the cut. Rows that agree in doc_id and size may be ordered either way, with equal sums;
    rows without doc_id are ordered by their text; very long texts are only counted, in place. An empty table gives an
    empty result; sources without words have target 0.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    own = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is a source of its own
    base = docs.select(
        "doc_id", own.alias("_name"), F.col("source").alias("_source"), F.size(words(F.col("text"))).cast("long").alias("size"), shuffle_key(seed, F.col("doc_id"), F.col("text")).alias("_key"), *whole
    )
    base = materialize(base.withColumn("_range", F.substring("_key", 1, HEX)), "sizes")
    sums = materialize(base.groupBy("_name", "_source", "_range").agg(F.sum("size").alias("_sum")), "sums")
    t = targets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, cap).withColumn("_t", F.coalesce(F.concat(F.lit("="), "_source"), F.lit(""))).drop("_source")
    upto = Window.partitionBy("_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of 16 ** HEX rows
    sums = sums.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum"))
    sums = sums.join(t, F.col("_name") == F.col("_t")).select(F.col("_name").alias("_s"), F.col("_range").alias("_r"), "_before", "source_size", "target")
    inside = Window.partitionBy("_name", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = base.withColumn("_start", F.sum("size").over(inside) - F.col("size"))
    b = b.join(sums, (F.col("_name") == F.col("_s")) & (F.col("_range") == F.col("_r"))).withColumn("_start", F.col("_start") + F.col("_before"))
    b = b.withColumn("_budget", F.floor("target").cast("long"))
    b = b.withColumn("_rounds", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)))
    b = b.withColumn("_rest", F.col("_budget") - F.col("_rounds") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start")))
    return b.select(
        "doc_id", F.col("_source").alias("source"), "size", "source_size", "target", (F.col("_rounds") * F.col("size") + last).cast("long").alias("taken"),
        (F.col("_rounds") + (last > 0).cast("int")).cast("int").alias("copies"), *(["row"] if carry else []),
    )


def op9_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "copies")


OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
  md5('23:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source),
rounds(n, capped, changed) AS (
  SELECT 0, []::BIGINT[], true
  UNION ALL
  SELECT n + 1, c, len(c) <> len(capped) FROM (
    SELECT r.n, r.capped, (SELECT coalesce(list(o ORDER BY o), []) FROM (
        SELECT row_number() OVER (ORDER BY source ASC NULLS LAST) AS o, w, source_size FROM s) x
      WHERE list_contains(r.capped, o) OR ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM (
        SELECT row_number() OVER (ORDER BY source ASC NULLS LAST) AS o2, source_size FROM s) y WHERE list_contains(r.capped, o2)), 0)) * w
        > 3 * source_size * (SELECT sum(w) FROM (SELECT row_number() OVER (ORDER BY source ASC NULLS LAST) AS o3, w FROM s) z WHERE NOT list_contains(r.capped, o3))) AS c
    FROM rounds r WHERE changed)),
final AS (SELECT capped FROM rounds ORDER BY n DESC LIMIT 1),
o AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS o FROM s),
free AS (SELECT sum(source_size) - coalesce(sum(CASE WHEN list_contains(capped, o) THEN 3 * source_size END), 0) AS rest,
  sum(CASE WHEN NOT list_contains(capped, o) THEN w END) AS lft FROM o, final),
t AS (SELECT source, source_size, CASE WHEN list_contains(capped, o) THEN (3 * source_size)::DOUBLE ELSE rest::DOUBLE * w / lft END AS target FROM o, final, free),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size
  + greatest(0, least(size, floor(target)::BIGINT % source_size - start)) END)::BIGINT AS taken FROM p
"""
