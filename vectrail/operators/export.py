"""Dense tensors of a graph for learning: positions, features, types and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IndexCorruption
from ..functions.indexing import dense_index
from ..functions.scalars import as_float
from ..functions.scratch import materialize
from ..graph import PropertyGraph
from .query import EdgeFilter


def index_map(g: PropertyGraph) -> DataFrame:
    """node_id, idx: nodes by ascending id."""
    return dense_index(g.nodes.select("node_id"), "node_id")


def check_index(g: PropertyGraph, index: DataFrame) -> None:
    """Raise IndexCorruption if the index names nodes that the graph does not have."""
    lost = index.join(g.nodes.select("node_id"), "node_id", "left_anti").first()
    if lost is not None:
        raise IndexCorruption(f"node {lost.node_id} is gone")


def node_features(g: PropertyGraph, index: DataFrame, keys: tuple[str, ...] = (), embedding: bool = True) -> DataFrame:
    """idx, features: the embedding padded with zeros to the widest declared dimension among the index's types (left out
    if not asked for), then the numbers under keys (0 where missing or not a number)."""
    # one job finds the types and what is gone; values are picked before the join, so no property map is shuffled
    types = index.join(g.nodes.select("node_id", "node_type"), "node_id", "left").groupBy("node_type").agg(F.min("node_id").alias("node_id")).collect()
    for r in types:
        if r.node_type is None:
            raise IndexCorruption(f"node {r.node_id} is gone")
    width = max([0, *(g.node_types[r.node_type][1] or 0 for r in types)]) if embedding else 0
    numbers = [F.coalesce(as_float(F.col("props")[k]), F.lit(0.0).cast("float")) for k in keys]
    picked = [F.col("embedding")] if width else []
    picked += [F.array(*numbers).alias("_numbers")] if numbers else []
    d = index.join(g.nodes.select("node_id", *picked), "node_id")
    own = F.coalesce("embedding", F.array().cast("array<float>"))
    parts = [own, F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size(own))] if width else []
    parts += [F.col("_numbers")] if numbers else []
    return d.select("idx", (F.concat(*parts) if parts else F.array().cast("array<float>")).alias("features"))


def node_type_ids(g: PropertyGraph, index: DataFrame) -> DataFrame:
    """idx, type_id."""
    check_index(g, index)
    return index.join(g.nodes.select("node_id", "type_id"), "node_id").select("idx", "type_id")


def runs(index: DataFrame) -> DataFrame:
    """block, shift, bits: the index in short. One row holds all of 64 consecutive ids (a block) whose positions are their ids
    plus shift, and a bit for each that the index has. So ids without gaps take a 64th of their rows, others at most as
    many as they are; any index is held exactly."""
    bit = F.expr("shiftleft(1L, cast(node_id & 63L as int))")
    return index.groupBy(F.shiftright("node_id", 6).alias("block"), (F.col("idx") - F.col("node_id")).alias("shift")).agg(F.bit_or(bit).alias("bits"))


def edge_index(g: PropertyGraph, index: DataFrame, edges: EdgeFilter = EdgeFilter()) -> DataFrame:
    """edge_id, src_idx, dst_idx, weight, etype_id of the edges, aligned in one table; ascending edge_id is the order.

    Edges look their ends up in the index's runs, which the planner broadcasts while they are few, so edges are shuffled
    only where ids have many gaps."""
    short = materialize(runs(index), "runs")
    d = g.edges.filter(edges.condition())
    for side in ("src", "dst"):
        r = short.select(*[F.col(c).alias(f"_{c}") for c in short.columns])
        held = F.expr(f"shiftright(_bits, cast({side} & 63L as int)) & 1L") == 1
        d = d.join(r, (F.shiftright(side, 6) == F.col("_block")) & held, "left").withColumn(f"{side}_idx", F.col(side) + F.col("_shift")).drop(*r.columns)
    d = materialize(d.select("edge_id", "src_idx", "dst_idx", "weight", "etype_id"), "edge-index")
    lost = d.filter("src_idx is null or dst_idx is null").first()
    if lost is not None:
        raise IndexCorruption(f"the index map lacks an end of edge {lost.edge_id}")
    return d
