"""Neighbours, path enumeration, shortest paths and reachability, as joins of frontiers with edges.

Steps are ordered by (direction, edge type id, edge id), with all outbound before all inbound; that key decides order,
truncation and ties everywhere. Each level is written to the shared folder, which cuts the lineage of loops.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_HOPS
from ..errors import InvalidPropertyValue, UnsupportedQuery
from ..functions.indexing import dense_index
from ..functions.scratch import materialize
from ..graph import PropertyGraph
from .query import EdgeFilter

OUT, IN, BOTH = "out", "in", "both"


@dataclass(frozen=True)
class Steps:
    """Which edges a traversal may take."""

    direction: str = OUT
    edge_types: tuple[str, ...] = ()
    min_weight: float | None = None


@dataclass(frozen=True)
class Traversal:
    steps: Steps = field(default_factory=Steps)
    max_hops: int | None = None
    max_paths: int = 1000
    revisit: bool = False


def steps(g: PropertyGraph, s: Steps, at: list[int] | None = None) -> DataFrame:
    """node, next, edge_id, edge_type, weight, key of every step, or of those from some nodes, whose edges alone are then
    read; with both directions a self-loop counts once."""
    condition = EdgeFilter(s.edge_types, s.min_weight).condition()

    def one(a: str, b: str, rank: int) -> DataFrame:
        e = (g.edges if at is None else g.edges_at(at, a)).filter(condition)
        key = F.struct(F.lit(rank).alias("dir"), F.col("etype_id"), F.col("edge_id"))
        return e.select(F.col(a).alias("node"), F.col(b).alias("next"), "edge_id", "edge_type", "weight", key.alias("key"))

    if s.direction == OUT:
        return one("src", "dst", 0)
    if s.direction == IN:
        return one("dst", "src", 1)
    return one("src", "dst", 0).unionByName(one("dst", "src", 1).filter("node <> next"))


def neighbors(g: PropertyGraph, anchors: list[int] | DataFrame, s: Steps = Steps()) -> DataFrame:
    """anchor, node, via, edge_type, weight and rank (order among the anchor's steps): one row per edge.

    anchors is a list of ids, checked to exist and pushed into the edge scan, or for batches a DataFrame with a column
    node_id, joined.
    """
    if isinstance(anchors, DataFrame):
        found = steps(g, s).join(anchors.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")
    else:
        g.need_nodes(*anchors)
        found = steps(g, s, list(anchors))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("key")) - 1
    return found.select(F.col("node").alias("anchor"), F.col("next").alias("node"), F.col("edge_id").alias("via"), "edge_type", "weight", rank.alias("rank"))


def expand(g: PropertyGraph, node_id: int, s: Steps = Steps()) -> DataFrame:
    """edge, neighbor of the steps from a node."""
    return neighbors(g, [node_id], s).select(F.col("via").alias("edge"), F.col("node").alias("neighbor"))


def _hops(g: PropertyGraph, max_hops: int | None) -> int:
    return min(g.config.default_max_hops if max_hops is None else max_hops, MAX_HOPS)


def traverse(g: PropertyGraph, start: int, t: Traversal = Traversal()) -> DataFrame:
    """nodes, edges, cost (hops), rank of the paths from start in depth-first pre-order, the first max_paths of them.

    Level by level, only the first max_paths paths of a level by key are kept (a distributed top-n): a path among the
    first of all is among the first of its length. So the work is bounded by hops * max_paths * degree.
    """
    g.need_nodes(start)
    moves = steps(g, t.steps)
    level = g.spark.createDataFrame([([start], [], [])], "nodes array<bigint>, edges array<bigint>, keys array<struct<dir:int,etype_id:int,edge_id:bigint>>")
    found: list[DataFrame] = []
    for _ in range(_hops(g, t.max_hops)):
        grown = level.withColumn("node", F.element_at("nodes", -1)).join(moves.select("node", "next", "edge_id", "key"), "node")
        if not t.revisit:
            grown = grown.filter(~F.array_contains("nodes", F.col("next")))
        grown = grown.select(F.concat("nodes", F.array("next")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"), F.concat("keys", F.array("key")).alias("keys"))
        level = materialize(grown.orderBy("keys").limit(t.max_paths), "level")
        if level.isEmpty():
            break
        found.append(level)
    if not found:
        return g.spark.createDataFrame([], "nodes array<bigint>, edges array<bigint>, cost float, rank int")
    paths = found[0]
    for x in found[1:]:
        paths = paths.unionByName(x)
    paths = paths.orderBy("keys").limit(t.max_paths)
    rank = F.row_number().over(Window.orderBy("keys")) - 1  # of max_paths rows
    return paths.select("nodes", "edges", F.size("edges").cast("float").alias("cost"), rank.alias("rank"))


def reachable(g: PropertyGraph, start: int | DataFrame, max_hops: int, s: Steps = Steps()) -> DataFrame:
    """anchor, node_id, hops of the nodes within max_hops of each anchor, itself included.

    A breadth-first loop: frontier join steps, distinct, minus the seen; only new pairs go on. start is an id or a
    DataFrame with a column node_id."""
    if isinstance(start, DataFrame):
        seen = start.select(F.col("node_id").alias("anchor"), "node_id").distinct()
    else:
        g.need_nodes(start)
        seen = g.spark.createDataFrame([(start, start)], "anchor bigint, node_id bigint")
    seen = frontier = seen.withColumn("hops", F.lit(0))
    moves = steps(g, s).select(F.col("node").alias("node_id"), "next")
    for hop in range(1, min(max_hops, MAX_HOPS) + 1):
        new = frontier.join(moves, "node_id").select("anchor", F.col("next").alias("node_id")).distinct()
        frontier = materialize(new.join(seen, ["anchor", "node_id"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _made(g: PropertyGraph, nodes: list[int], edges: list[int], weights: list[float], weighted: bool) -> DataFrame:
    cost = np.float32(0)
    for w in weights:
        cost = np.float32(cost + np.float32(max(w, 0.0))) if weighted else np.float32(cost + 1)
    return g.spark.createDataFrame([(nodes, edges, float(cost))], "nodes array<bigint>, edges array<bigint>, cost float")


def _back(g: PropertyGraph, levels: list[DataFrame], target: int) -> DataFrame:
    """The path to target through levels of (node, before, edge_id, weight), the last one first: one job that joins the
    one row of each level to the next."""
    p = levels[-1].filter(F.col("node") == target).select("before", F.array("node").alias("nodes"), F.array("edge_id").alias("edges"), F.array("weight").alias("weights"))
    for level in reversed(levels[:-1]):
        d = level.select("node", F.col("before").alias("_before"), "edge_id", "weight")
        p = F.broadcast(p).join(d, p["before"] == d["node"]).select(  # one row
            F.col("_before").alias("before"), F.concat(F.array("node"), "nodes").alias("nodes"), F.concat(F.array("edge_id"), "edges").alias("edges"), F.concat(F.array("weight"), "weights").alias("weights"),
        )
    r = p.first()
    return _made(g, [r.before, *r.nodes], r.edges, r.weights, False)


def _walk(g: PropertyGraph, previous: DataFrame, target: int, hops: int) -> DataFrame:
    """The path of so many hops to target along (node, before, edge_id, weight), in jobs of at most 16 steps; in each, one
    row is joined to its predecessor step by step."""
    nodes, edges, weights = [target], [], []
    while hops:
        n = min(hops, 16)
        p = previous.filter(F.col("node") == nodes[0]).select("before", F.array(F.struct("before", "edge_id", "weight")).alias("taken"))
        for _ in range(n - 1):
            d = previous.select(F.col("node").alias("_node"), F.col("before").alias("_before"), "edge_id", "weight")
            step = F.array(F.struct(F.col("_before").alias("before"), "edge_id", "weight"))
            p = F.broadcast(p).join(d, F.col("before") == F.col("_node")).select(F.col("_before").alias("before"), F.concat("taken", step).alias("taken"))  # one row
        for r in p.first().taken:
            edges.insert(0, r.edge_id)
            weights.insert(0, r.weight)
            nodes.insert(0, r.before)
        hops -= n
    return _made(g, nodes, edges, weights, True)


def _none(g: PropertyGraph) -> DataFrame:
    return g.spark.createDataFrame([], "nodes array<bigint>, edges array<bigint>, cost float")


def shortest_path(g: PropertyGraph, start: int, target: int, s: Steps = Steps(), weighted: bool = False, max_steps: int | None = None, max_hops: int | None = None) -> DataFrame:
    """nodes, edges, cost: one row, or none if target is out of reach, needs more than max_steps expansions or, where hops
    are counted, is more than max_hops away."""
    if weighted and max_hops is not None:
        raise UnsupportedQuery("max_hops bounds paths of fewest hops only")
    g.need_nodes(start, target)
    if s.min_weight is not None and math.isnan(s.min_weight):
        raise InvalidPropertyValue("min_weight is NaN")
    if start == target:
        return g.spark.createDataFrame([([start], [], 0.0)], "nodes array<bigint>, edges array<bigint>, cost float")
    return _weighted(g, start, target, s, max_steps) if weighted else _fewest(g, start, target, s, max_steps, max_hops)


def _fewest(g: PropertyGraph, start: int, target: int, s: Steps, max_steps: int | None, max_hops: int | None) -> DataFrame:
    """Breadth-first with discovery ranks: a node is found by its least (parent's rank, step key)."""
    moves = steps(g, s).select("node", "next", "edge_id", "weight", "key")
    frontier = g.spark.createDataFrame([(start, 0)], "node bigint, rank bigint")
    seen, levels, before = frontier.select("node"), [], 1
    while max_hops is None or len(levels) < max_hops:
        new = frontier.join(moves, "node").join(seen.withColumnRenamed("node", "next"), "next", "left_anti")
        new = new.groupBy("next").agg(F.min(F.struct("rank", "key", F.col("node").alias("before"), "edge_id", "weight")).alias("by"))
        level = materialize(new.select(F.col("next").alias("node"), "by"), "level")
        n = level.count()
        if not n:
            return _none(g)
        hit = level.filter(F.col("node") == target).first()
        levels.append(level.select("node", "by.before", "by.edge_id", "by.weight"))
        if hit:
            if max_steps is not None:
                key = F.struct("by.rank", "by.key")
                mine = level.filter(F.col("node") == target).select(key.alias("k"))
                if before + level.join(mine, key < F.col("k")).count() > max_steps:
                    return _none(g)
            return _back(g, levels, target)
        if max_steps is not None and before > max_steps:
            return _none(g)  # all later discoveries come after the budget
        frontier = dense_index(level.select("node", F.struct("by.rank", "by.key").alias("o")), "o", "rank").select("node", "rank")
        seen, before = seen.union(level.select("node")), before + n
    return _none(g)


def _weighted(g: PropertyGraph, start: int, target: int, s: Steps, max_steps: int | None) -> DataFrame:
    """Relaxation to a fixed point in 32-bit sums, with predecessors by (distance, hops, node, step key).

    Where all steps raise the cost, order and ties are those of a priority search. Steps of no cost tie by hops, so the
    path found is a shortest one; another of the same cost may exist.
    """
    cost = F.greatest(F.col("weight"), F.lit(0.0).cast("float"))
    moves = materialize(steps(g, s).withColumn("cost", cost).select("node", "next", "edge_id", "weight", "cost", "key"), "moves")
    settled = materialize(g.spark.createDataFrame([(start, 0.0, 0)], "node bigint, dist float, hops int"), "settled")
    changed = settled
    while True:
        reached = settled.filter(F.col("node") == target).first()
        if reached is not None:  # offers of more than the target's distance can't be on its path
            changed = changed.filter(F.col("dist") <= F.lit(reached.dist).cast("float"))
        offers = changed.join(moves, "node").select(F.col("next").alias("node"), (F.col("dist") + F.col("cost")).cast("float").alias("dist"), (F.col("hops") + 1).alias("hops"))
        if reached is not None:
            offers = offers.filter(F.col("dist") <= F.lit(reached.dist).cast("float"))
        best = settled.unionByName(offers).groupBy("node").agg(F.min(F.struct("dist", "hops")).alias("b")).select("node", "b.dist", "b.hops")
        best = materialize(best, "settled")
        changed = materialize(best.join(settled, ["node", "dist", "hops"], "left_anti"), "changed")
        settled = best
        if changed.isEmpty():
            break
    mine = settled.filter(F.col("node") == target).first()
    if mine is None:
        return _none(g)
    if max_steps is not None:
        d = F.lit(mine.dist).cast("float")
        if settled.filter((F.col("dist") < d) | ((F.col("dist") == d) & (F.col("node") < target))).count() > max_steps:
            return _none(g)
    far = settled.select(F.col("node").alias("next"), F.col("dist").alias("to"), F.col("hops").alias("after"))
    tight = settled.join(moves, "node").join(far, "next").filter(((F.col("dist") + F.col("cost")).cast("float") == F.col("to")) & (F.col("hops") < F.col("after")) & (F.col("next") != start))
    previous = tight.groupBy("next").agg(F.min(F.struct("dist", "node", "key", "edge_id", "weight")).alias("b"))
    return _walk(g, materialize(previous.select(F.col("next").alias("node"), F.col("b.node").alias("before"), "b.edge_id", "b.weight"), "previous"), target, mine.hops)
