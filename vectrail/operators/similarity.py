"""Exact top-k vector similarity under filters; always a scan of the candidates, never an approximate index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidPropertyValue, UnsupportedQuery
from ..functions.vectors import METRICS, score, score_rows
from ..graph import PropertyGraph
from .query import PropertyQuery, property_condition
from .traverse import Steps, reachable


@dataclass(frozen=True)
class Reach:
    """Only nodes within max_hops steps of a node, itself included."""

    start: int
    max_hops: int
    steps: Steps = Steps()


@dataclass(frozen=True)
class SimilarityQuery:
    vector: tuple[float, ...]
    metric: str = "cosine"
    k: int = 10
    node_types: tuple[str, ...] | None = None
    property_filter: PropertyQuery | None = None
    within: Reach | None = None
    allow_full_scan: bool = False


def _check(vector, metric: str) -> None:
    if metric not in METRICS:
        raise UnsupportedQuery(metric)
    if not all(math.isfinite(np.float32(x)) for x in vector):
        raise InvalidPropertyValue("the query vector is not finite")


def candidates(g: PropertyGraph, q: SimilarityQuery) -> DataFrame:
    """Nodes that pass the filters, embedding or not: one filter, pushed down, and a semi join for reachability."""
    d = g.nodes
    if q.property_filter is not None:
        d = d.filter(property_condition(g, q.property_filter))
    if q.node_types is not None:
        for t in q.node_types:
            g.type_of(t)
        d = d.filter(F.col("node_type").isin(*q.node_types) if q.node_types else F.lit(False))
    if q.within is not None:
        near = reachable(g, q.within.start, q.within.max_hops, q.within.steps).select("node_id")
        d = d.join(near, "node_id", "left_semi")
    return d


def ensure_ceiling(g: PropertyGraph, d: DataFrame) -> None:
    """Raise if more rows than the ceiling would be looked at; reads at most that many."""
    limit = g.config.scan_ceiling
    if d.select("node_id").limit(limit + 1).count() > limit:
        raise UnsupportedQuery(f"more than {limit} candidates; allow_full_scan permits them")


def similar_nodes(g: PropertyGraph, q: SimilarityQuery) -> DataFrame:
    """node_id, score, rank of the k best candidates of the vector's dimension, ties by node_id.

    Node types declare the dimension of their embeddings, so where none of the types asked for has the vector's, nothing is
    looked at: the result is empty, and the ceiling doesn't matter."""
    _check(q.vector, q.metric)
    d = candidates(g, q)
    if q.node_types is not None and all(g.type_of(t)[1] != len(q.vector) for t in q.node_types):
        d = d.filter(F.lit(False))
    elif not q.allow_full_scan:
        ensure_ceiling(g, d)
    d = d.filter(F.size("embedding") == len(q.vector)).select("node_id", score(F.col("embedding"), list(q.vector), q.metric).alias("score"))
    order = [F.asc("score") if q.metric == "euclidean" else F.desc("score"), F.asc("node_id")]
    top = d.orderBy(*order).limit(q.k)
    return top.select("node_id", "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # of k rows


#: Queries that one matrix of scores covers.
BLOCK = 64


#: Query vectors of a DataFrame that are searched in one pass.
QUERIES = 4096


def similar_batch(g: PropertyGraph, queries: list[tuple[int, tuple[float, ...]]] | DataFrame, metric: str = "cosine", k: int = 10, node_types: tuple[str, ...] | None = None) -> DataFrame:
    """query_id, node_id, score, rank for a stated set of query vectors of one dimension against all candidates.

    One pass over the candidates: tasks score Arrow batches against blocks of queries and keep k rows per query, so
    what is shuffled is k rows per batch and query. Scores have the same bits as ``similar_nodes``. Queries in a DataFrame
    (query_id, embedding) are read in blocks of QUERIES, a pass each.
    """
    if isinstance(queries, DataFrame):
        rows = ((r.query_id, tuple(r.embedding)) for r in queries.select("query_id", "embedding").filter("embedding is not null").orderBy("query_id").toLocalIterator())
        parts = [similar_batch(g, block, metric, k, node_types) for block in iter(lambda: list(islice(rows, QUERIES)), [])]
        return reduce(DataFrame.unionByName, parts) if parts else g.spark.createDataFrame([], "query_id bigint, node_id bigint, score float, rank int")
    for _, v in queries:
        _check(v, metric)
    ids, matrix = [i for i, _ in queries], np.array([v for _, v in queries], np.float32)
    d = candidates(g, SimilarityQuery(tuple(queries[0][1]), metric, k, node_types)).filter(F.size("embedding") == matrix.shape[1])
    sign = 1 if metric == "euclidean" else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1)
            for at in range(0, len(ids), BLOCK):
                scores = score_rows(rows, matrix[at : at + BLOCK], metric)
                for j, query in enumerate(ids[at : at + BLOCK]):
                    best = np.lexsort((nodes, sign * scores[:, j]))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query, np.int64)), pa.array(nodes[best]), pa.array(scores[best, j])], ["query_id", "node_id", "score"])

    top = d.select("node_id", "embedding").mapInArrow(run, "query_id bigint, node_id bigint, score float")
    w = Window.partitionBy("query_id").orderBy(F.asc("score") if metric == "euclidean" else F.desc("score"), F.asc("node_id"))
    return top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
