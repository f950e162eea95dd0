"""Scans, lookups, predicates and counts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidPropertyValue
from ..functions.scalars import matches
from ..graph import PropertyGraph


@dataclass(frozen=True)
class PropertyQuery:
    """Nodes of a type whose property equals eq, or lies in the inclusive range from least to most; either bound may be
    open, and with all three open any scalar matches."""

    node_type: str
    key: str
    eq: Any = None
    least: Any = None
    most: Any = None


@dataclass(frozen=True)
class EdgeFilter:
    """Edges of given types (none given: all; unknown ones match nothing) and of at least a weight."""

    edge_types: tuple[str, ...] = ()
    min_weight: float | None = None

    def condition(self) -> Column:
        if self.min_weight is not None and math.isnan(self.min_weight):
            raise InvalidPropertyValue("min_weight is NaN")
        c = F.lit(True)
        if self.edge_types:
            c = c & F.col("edge_type").isin(*self.edge_types)
        if self.min_weight is not None:
            c = c & (F.col("weight") >= F.lit(self.min_weight).cast("float"))
        return c


def node(g: PropertyGraph, node_id: int) -> DataFrame:
    """The node with an id: one row or none."""
    return g.nodes_with([node_id])


def edge(g: PropertyGraph, edge_id: int) -> DataFrame:
    return g.edges_with([edge_id])


def node_ids(g: PropertyGraph, ordered: bool = False) -> DataFrame:
    """Ids of all nodes, on request in ascending order."""
    ids = g.nodes.select("node_id")
    return ids.orderBy("node_id") if ordered else ids


def scan_nodes(g: PropertyGraph, node_type: str | None = None) -> DataFrame:
    """Ids of the nodes, of one registered type if given. Ordering is left to the reader: a sort is one more shuffle."""
    if node_type is not None:
        return nodes_by_type(g, node_type)
    return node_ids(g)


def scan_edges(g: PropertyGraph, edges: EdgeFilter = EdgeFilter()) -> DataFrame:
    return g.edges.filter(edges.condition()).select("edge_id")


def nodes_by_type(g: PropertyGraph, node_type: str) -> DataFrame:
    g.type_of(node_type)
    return g.nodes.filter(F.col("node_type") == node_type).select("node_id")


def property_condition(g: PropertyGraph, q: PropertyQuery) -> Column:
    """As a filter on nodes. The map is read by key, so over mapped tables the comparison reaches the column's scan;
    stored graphs hold indexed properties as columns of their own (``indexed``)."""
    g.type_of(q.node_type)
    column = indexed_column(q.node_type, q.key)
    value = F.col(column) if column in g.nodes.columns else F.col("props")[q.key]
    return (F.col("node_type") == q.node_type) & matches(value, q.eq, q.least, q.most)


def indexed_column(node_type: str, key: str) -> str:
    return f"ix_{node_type}_{key}"


def indexed(g: PropertyGraph) -> DataFrame:
    """g's nodes with each indexed property as a column of its own."""
    d = g.nodes
    for t, k in g.config.indexed_properties:
        d = d.withColumn(indexed_column(t, k), F.when(F.col("node_type") == t, F.col("props")[k]))
    return d


def nodes_by_property(g: PropertyGraph, q: PropertyQuery) -> DataFrame:
    return g.nodes.filter(property_condition(g, q)).select("node_id")


def counts(g: PropertyGraph) -> DataFrame:
    """One row: n_nodes, n_edges."""
    n = g.nodes.agg(F.count("*").alias("n_nodes"))
    return n.join(g.edges.agg(F.count("*").alias("n_edges")))  # one row each


def counts_by_type(g: PropertyGraph) -> DataFrame:
    n = g.nodes.groupBy(F.col("node_type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    return n.unionByName(g.edges.groupBy(F.col("edge_type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))


def degrees(g: PropertyGraph) -> DataFrame:
    """node_id, out_degree, in_degree, degree of the nodes that have edges; partial sums before the shuffle."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o")))).alias("e"))
    d = ends.groupBy("e.node_id").agg(F.sum("e.o").alias("out_degree"), F.count("*").alias("degree"))
    return d.select("node_id", "out_degree", (F.col("degree") - F.col("out_degree")).alias("in_degree"), "degree")
