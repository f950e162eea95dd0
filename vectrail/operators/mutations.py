"""Changes to a graph. Each returns a new handle over lazily changed DataFrames; checks run before it is returned."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DanglingEdge, DimensionMismatch, EdgeNotFound, InvalidNodeType, InvalidPropertyValue, NodeNotFound
from ..functions.indexing import dense_index
from ..functions.scalars import PROPS, merge
from ..graph import PropertyGraph
from .query import EdgeFilter


@dataclass(frozen=True)
class PropertyPatch:
    """Keys to set (None stores a null) and keys to remove."""

    values: dict[str, Any] = field(default_factory=dict)
    removed: frozenset[str] = frozenset()

    def set(self, key: str, value: Any) -> PropertyPatch:
        return PropertyPatch(self.values | {key: value}, self.removed - {key})

    def remove(self, key: str) -> PropertyPatch:
        return PropertyPatch({k: v for k, v in self.values.items() if k != key}, self.removed | {key})


def _log(g: PropertyGraph, *entry: Any) -> tuple:
    return (*g.pending, entry)


def _not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def _properties(values: dict[str, Any] | None) -> Column:
    return merge(F.create_map().cast(PROPS), values or {}, set())


def add_node(g: PropertyGraph, node_type: str, properties: dict[str, Any] | None = None) -> tuple[PropertyGraph, int]:
    g.writable()
    type_id, _ = g.type_of(node_type)
    i = g.next_node_id
    row = g.spark.range(1).select(
        F.lit(i).cast("long").alias("node_id"), F.lit(node_type).alias("node_type"), F.lit(type_id).alias("type_id"), _properties(properties).alias("props"), F.lit(None).cast("array<float>").alias("embedding")
    )
    return replace(g, nodes=g.plain_nodes().unionByName(row), next_node_id=i + 1, pending=_log(g, "add_node", i)), i


def add_nodes(g: PropertyGraph, rows: DataFrame, key: str) -> PropertyGraph:
    """Add rows (node_type, props and the unique column key) with ids in the order of key."""
    g.writable()
    for r in rows.select("node_type").distinct().collect():
        g.type_of(r.node_type)
    n, types = rows.count(), g.type_table()
    new = dense_index(rows, key, "at").join(F.broadcast(types), F.col("node_type") == F.col("label"))  # registered types: a driver-side dictionary
    new = new.select((F.col("at") + g.next_node_id).alias("node_id"), "node_type", "type_id", "props", F.lit(None).cast("array<float>").alias("embedding"))
    return replace(g, nodes=g.plain_nodes().unionByName(new), next_node_id=g.next_node_id + n, pending=_log(g, "add_nodes", n))


def set_node_embeddings(g: PropertyGraph, embeddings: DataFrame) -> PropertyGraph:
    """Replace the embeddings of nodes by those of embeddings (node_id, embedding), after all checks."""
    g.writable()
    new = embeddings.select("node_id", F.col("embedding").alias("__new"))
    known = new.join(g.nodes.select("node_id", "type_id"), "node_id", "left")
    types = F.broadcast(g.type_table())
    bad = known.join(types, "type_id", "left").select(
        "node_id", F.col("type_id").isNull().alias("missing"), F.exists("__new", _not_finite).alias("infinite"),
        F.col("dim").isNull().alias("undeclared"), F.col("dim"), F.size("__new").alias("size"),
    )
    r = bad.filter("missing or infinite or undeclared or size <> dim").orderBy("node_id").first()
    if r is not None:
        if r.missing:
            raise NodeNotFound(str(r.node_id))
        if r.infinite:
            raise InvalidPropertyValue(f"the embedding of node {r.node_id} is not finite")
        if r.undeclared:
            raise InvalidNodeType(f"the type of node {r.node_id} has no embedding")
        raise DimensionMismatch(f"expected {r.dim}, got {r.size}")
    nodes = g.nodes.join(new, "node_id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).select(*g.nodes.columns)
    return replace(g, nodes=nodes, pending=_log(g, "set_node_embeddings"))


def set_node_embedding(g: PropertyGraph, node_id: int, embedding: list[float]) -> PropertyGraph:
    return set_node_embeddings(g, g.spark.createDataFrame([(node_id, embedding)], "node_id bigint, embedding array<float>"))


def update_node_properties(g: PropertyGraph, node_id: int, patch: PropertyPatch) -> PropertyGraph:
    g.writable()
    g.need_nodes(node_id)
    new = F.when(F.col("node_id") == node_id, merge(F.col("props"), patch.values, set(patch.removed))).otherwise(F.col("props"))
    return replace(g, nodes=g.plain_nodes().withColumn("props", new), pending=_log(g, "update_node_properties", node_id))


def remove_node(g: PropertyGraph, node_id: int, cascade: bool = False) -> PropertyGraph:
    """Remove a node; with incident edges only if cascade, which removes these too."""
    g.writable()
    g.need_nodes(node_id)
    touching = (F.col("src") == node_id) | (F.col("dst") == node_id)
    if not cascade and not g.edges.filter(touching).isEmpty():
        raise DanglingEdge(str(node_id))
    edges = g.edges.filter(~touching) if cascade else g.edges
    return replace(g, nodes=g.nodes.filter(F.col("node_id") != node_id), edges=edges, pending=_log(g, "remove_node", node_id, cascade))


def add_edges(g: PropertyGraph, rows: DataFrame, key: str) -> PropertyGraph:
    """Add rows (src, dst, edge_type, weight, props and the unique column key) with ids in the order of key."""
    g.writable()
    if not rows.filter(_not_finite(F.col("weight"))).isEmpty():
        raise InvalidPropertyValue("a weight is not finite")
    ends = rows.select(F.col("src").alias("node_id")).union(rows.select("dst")).distinct()
    lost = ends.join(g.nodes.select("node_id"), "node_id", "left_anti").first()
    if lost is not None:
        raise NodeNotFound(str(lost.node_id))
    first = dense_index(rows, key, "at")
    labels = [r.edge_type for r in first.groupBy("edge_type").agg(F.min("at").alias("at")).orderBy("at").collect()]
    types = dict(g.edge_types)
    for x in labels:
        types.setdefault(x, len(types))
    ids = F.broadcast(g.spark.createDataFrame(list(types.items()), "edge_type string, etype_id int"))  # a driver-side dictionary
    new = first.join(ids, "edge_type").select((F.col("at") + g.next_edge_id).alias("edge_id"), "src", "dst", "edge_type", "etype_id", F.col("weight").cast("float").alias("weight"), "props")
    n = first.count()
    return replace(g, edges=g.edges.unionByName(new), edge_types=types, next_edge_id=g.next_edge_id + n, pending=_log(g, "add_edges", n))


def add_edge(g: PropertyGraph, src: int, dst: int, edge_type: str, weight: float, properties: dict[str, Any] | None = None) -> tuple[PropertyGraph, int]:
    """Add one edge; self-loops and parallel edges are allowed."""
    g.writable()
    if not math.isfinite(weight):
        raise InvalidPropertyValue("the weight is not finite")
    g.need_nodes(src, dst)
    types = g.edge_types if edge_type in g.edge_types else g.edge_types | {edge_type: len(g.edge_types)}
    i = g.next_edge_id
    row = g.spark.range(1).select(
        F.lit(i).cast("long").alias("edge_id"), F.lit(src).cast("long").alias("src"), F.lit(dst).cast("long").alias("dst"), F.lit(edge_type).alias("edge_type"),
        F.lit(types[edge_type]).alias("etype_id"), F.lit(weight).cast("float").alias("weight"), _properties(properties).alias("props"),
    )
    return replace(g, edges=g.edges.unionByName(row), edge_types=types, next_edge_id=i + 1, pending=_log(g, "add_edge", i)), i


def _need_edge(g: PropertyGraph, edge_id: int) -> None:
    if g.edges.filter(F.col("edge_id") == edge_id).isEmpty():
        raise EdgeNotFound(str(edge_id))


def new_weight(op: str, operand: float, bounds: tuple[float | None, float | None] | None) -> tuple[Column, Column]:
    """The weight after set, add or multiply in 32-bit arithmetic: as computed, and kept inside the bounds."""
    x, w = F.lit(operand).cast("float"), F.col("weight")
    raw = {"set": x, "add": w + x, "multiply": w * x}[op].cast("float")
    out = raw
    if bounds is not None:
        low, high = bounds
        if any(b is not None and math.isnan(b) for b in bounds) or (low is not None and high is not None and low > high):
            raise InvalidPropertyValue("weight bounds")
        out = F.greatest(out, F.lit(low).cast("float")) if low is not None else out
        out = F.least(out, F.lit(high).cast("float")) if high is not None else out
    return raw, out


def update_edge_weight(g: PropertyGraph, edge_id: int, op: str, operand: float, bounds: tuple[float | None, float | None] | None = None) -> tuple[PropertyGraph, float]:
    """Change one weight; a result that is not finite before the bounds apply is an error."""
    return_ = update_edge_weights(g, F.col("edge_id") == edge_id, op, operand, bounds)
    row = return_.edges.filter(F.col("edge_id") == edge_id).select("weight").first()
    if row is None:
        raise EdgeNotFound(str(edge_id))
    return return_, row.weight


def update_edge_weights(g: PropertyGraph, which: Column, op: str, operand: float, bounds: tuple[float | None, float | None] | None = None) -> PropertyGraph:
    """Change the weights of all edges that a condition selects, or none if any result is not finite."""
    g.writable()
    raw, out = new_weight(op, operand, bounds)
    if not g.edges.filter(which).filter(_not_finite(raw)).isEmpty():
        raise InvalidPropertyValue("a weight would not be finite")
    return replace(g, edges=g.edges.withColumn("weight", F.when(which, out).otherwise(F.col("weight"))), pending=_log(g, "update_edge_weights", op, operand))


def update_edge_properties(g: PropertyGraph, edge_id: int, patch: PropertyPatch) -> PropertyGraph:
    g.writable()
    _need_edge(g, edge_id)
    new = F.when(F.col("edge_id") == edge_id, merge(F.col("props"), patch.values, set(patch.removed))).otherwise(F.col("props"))
    return replace(g, edges=g.edges.withColumn("props", new), pending=_log(g, "update_edge_properties", edge_id))


def remove_edge(g: PropertyGraph, edge_id: int) -> PropertyGraph:
    g.writable()
    _need_edge(g, edge_id)
    return replace(g, edges=g.edges.filter(F.col("edge_id") != edge_id), pending=_log(g, "remove_edge", edge_id))


def decay_edges(g: PropertyGraph, edges: EdgeFilter, factor: float) -> tuple[PropertyGraph, int]:
    """Multiply the weights of the edges that match; all or, if a result is not finite, none. Returns their count."""
    if not math.isfinite(factor):
        raise InvalidPropertyValue("the factor is not finite")
    g.writable()
    hit = edges.condition()
    product = (F.col("weight") * F.lit(factor).cast("float")).cast("float")
    r = g.edges.filter(hit).agg(F.count("*").alias("n"), F.count_if(_not_finite(product)).alias("bad")).first()
    if r.bad:
        raise InvalidPropertyValue("a weight would not be finite")
    return replace(g, edges=g.edges.withColumn("weight", F.when(hit, product).otherwise(F.col("weight"))), pending=_log(g, "decay_edges", factor)), r.n

