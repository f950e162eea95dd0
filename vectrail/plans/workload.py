"""A measured workload: degree-stratified anchors, operation mixes, and nearest-rank percentiles of run times."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import mutations, query, similarity, traverse
from ..operators.query import EdgeFilter, PropertyQuery
from ..operators.similarity import SimilarityQuery
from ..operators.traverse import Traversal

#: Shares of reads, similarity and changes, in percent.
MIXES = {"traversal_heavy": (80, 10, 10), "similarity_heavy": (30, 60, 10), "update_heavy": (20, 5, 75), "mixed": (50, 25, 25)}


def strata(g: PropertyGraph) -> DataFrame:
    """node_id, out_degree, stratum: nodes with edges out below the first third of degrees are "low", up to the second
    "median", from the last tenth on "hub". Bounds are aggregates; no window spans the nodes."""
    d = g.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY out_degree)")
    bounds = d.agg(q(1 / 3).alias("third"), q(2 / 3).alias("two"), q(0.9).alias("tenth"))  # one row
    k = F.when(F.col("out_degree") >= F.col("tenth"), "hub").when(F.col("out_degree") <= F.col("third"), "low").when(F.col("out_degree") <= F.col("two"), "median")
    return d.join(bounds).select("node_id", "out_degree", k.alias("stratum"))


def draw(g: PropertyGraph, per_stratum: int, seed: int = 42) -> list[int]:
    """Anchors: the same number from each stratum, chosen by hash."""
    s = strata(g).filter("stratum is not null")
    return [r.node_id for k in ("low", "median", "hub") for r in s.filter(F.col("stratum") == k).orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(per_stratum).collect()]


def operations(g: PropertyGraph, anchors: list[int], q: SimilarityQuery | None, prop: PropertyQuery, edge_type: str) -> dict[str, list[Callable[[], int]]]:
    """By bucket, calls that return a counter: neighbours, paths, hits or changed edges."""
    return {
        "neighbors": [lambda a=a: traverse.neighbors(g, [a]).count() for a in anchors],
        "neighbors_batch": [lambda: traverse.neighbors(g, g.spark.createDataFrame([(a,) for a in anchors], "node_id bigint")).count()],
        "traverse_2": [lambda a=a: traverse.traverse(g, a, Traversal(max_hops=2)).count() for a in anchors],
        "property_eq": [lambda: query.nodes_by_property(g, prop).count()],
        "similar": [lambda: similarity.similar_nodes(g, q).count()] if q else [],
        "decay_edges": [lambda: mutations.decay_edges(g, EdgeFilter((edge_type,)), 0.9)[1]],
    }


def mix(name: str, total: int) -> list[str]:
    """Kinds of operation of a mix, interleaved: position i takes the kind that is most behind its share."""
    shares, done, out = dict(zip(("read", "similarity", "change"), MIXES[name], strict=True)), {"read": 0, "similarity": 0, "change": 0}, []
    for i in range(1, total + 1):
        k = max(shares, key=lambda x: (shares[x] * i / 100 - done[x], x))
        done[k] += 1
        out.append(k)
    return out


def measure(spark: SparkSession, plan: dict[str, list[Callable[[], int]]], repeats: int = 3, warm_up: int = 1) -> DataFrame:
    """bucket, sample, seconds, counter of each call, without warm-up runs."""
    rows = []
    for bucket, calls in plan.items():
        for i, call in enumerate(calls):
            for run in range(warm_up + repeats):
                began = time.perf_counter()
                counter = call()
                if run >= warm_up:
                    rows.append((bucket, i, time.perf_counter() - began, counter))
    return spark.createDataFrame(rows, "bucket string, sample int, seconds double, counter bigint")


def summary(runs: DataFrame) -> DataFrame:
    """bucket, n, p50, p95, p99 (nearest rank), per_second, and whether repeated runs had equal counters."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY seconds)")
    steady = runs.groupBy("bucket", "sample").agg((F.min("counter") == F.max("counter")).alias("same")).groupBy("bucket").agg(F.bool_and("same").alias("steady"))
    s = runs.groupBy("bucket").agg(F.count("*").alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), (F.count("*") / F.sum("seconds")).alias("per_second"))
    return s.join(steady, "bucket")
