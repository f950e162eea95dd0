"""Semantics of the graph operators on small graphs."""

import math
from fractions import Fraction

import numpy as np
import pytest
from graphs import graph, ids
from pyspark.sql import functions as F

from vectrail import errors
from vectrail.config import GraphConfig
from vectrail.functions.indexing import dense_index
from vectrail.functions.scalars import PROPS, literal, matches
from vectrail.graph import PropertyGraph
from vectrail.operators import export, mutations, query, similarity, traverse
from vectrail.operators.mutations import PropertyPatch
from vectrail.operators.query import EdgeFilter, PropertyQuery
from vectrail.operators.similarity import Reach, SimilarityQuery
from vectrail.operators.traverse import BOTH, IN, Steps, Traversal

VALUES = [False, True, 0, -5, 5, 2**53, 2**53 + 1, 2**63 - 1, -(2**63), 0.0, -0.0, 5.0, 5.5, -5.5, 2.0**53, 2.0**63, -(2.0**63), math.inf, -math.inf, math.nan, "", "a", "B", "é", None, b"x", [1, "a"]]


def _key(v):
    """The total order, exactly."""
    if isinstance(v, bool):
        return (0, 0, int(v))
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return (1, 2, 0)
        if isinstance(v, float) and math.isinf(v):
            return (1, 1 if v > 0 else -1, 0)
        return (1, 0, Fraction(v))
    return (2, 0, v.encode()) if isinstance(v, str) else None


def test_total_order_is_exact(spark):
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), literal(v).alias("v")) for i, v in enumerate(VALUES)])).alias("s")).select("s.i", "s.v")
    bounds = [v for v in VALUES if _key(v) is not None]
    tests = {(j, op): matches(F.col("v"), **{op: b}) for j, b in enumerate(bounds) for op in ("eq", "least", "most")}
    got = rows.select("i", *[F.coalesce(c, F.lit(False)).alias(f"{j}_{op}") for (j, op), c in tests.items()]).collect()
    for r in got:
        k = _key(VALUES[r.i])
        for j, b in enumerate(bounds):
            want = {"eq": k is not None and k == _key(b), "least": k is not None and k >= _key(b), "most": k is not None and k <= _key(b)}
            assert {op: r[f"{j}_{op}"] for op in want} == want, (VALUES[r.i], b)


def test_lookup_and_predicates(spark):
    g = graph(spark, [{"age": a} for a in (20, 25, 30, 35, 40)], [(0, 1, "knows", 1)])
    find = lambda **k: ids(query.nodes_by_property(g, PropertyQuery("person", "age", **k)))
    assert find(eq=30) == [2] and find(least=25, most=35) == [1, 2, 3] and find(least=35, most=25) == []
    assert find() == [0, 1, 2, 3, 4] and find(most="x") == [0, 1, 2, 3, 4] and find(least=39.5) == [4]
    assert ids(query.nodes_by_type(g, "person")) == [0, 1, 2, 3, 4] and ids(query.node(g, 3)) == [3] and ids(query.node(g, 9)) == []
    with pytest.raises(errors.InvalidNodeType):
        query.nodes_by_type(g, "none")
    assert g.register_node_type("tag").type_of("tag") == (1, None)
    with pytest.raises(errors.InvalidNodeType):
        g.register_node_type("person", 3)
    assert query.counts(g).first() == (5, 1)
    assert ids(query.nodes_by_type(PropertyGraph.in_memory(spark).register_node_type("x"), "x")) == []


def test_mixed_numbers_and_zero_signs(spark):
    g = graph(spark, [{"s": -5.0}, {"s": 5}, {"s": 5.0}, {"s": 50.0}, {"s": -0.0}, {"s": math.nan}, {"s": None}], [])
    find = lambda **k: ids(query.nodes_by_property(g, PropertyQuery("person", "s", **k)))
    assert find(least=0, most=10.0) == [1, 2, 4] and find(eq=5.0) == [1, 2] and find(eq=0.0) == [4] and find(eq=math.nan) == [5]


def test_neighbors(spark):
    g = graph(spark, 3, [(0, 1, "a", 0.9), (1, 2, "a", 0.2), (0, 0, "b", 1), (0, 1, "b", 0.5)])
    via = lambda *a: [r.via for r in traverse.neighbors(g, *a).orderBy("rank").collect()]
    assert via([0]) == [0, 2, 3] and via([0], Steps(BOTH)) == [0, 2, 3] and via([1], Steps(BOTH)) == [1, 0, 3] and via([1], Steps(IN)) == [0, 3]
    assert via([0], Steps(min_weight=0.6)) == [0, 2] and via([0], Steps(edge_types=("zzz",))) == [] and via([0], Steps(edge_types=("b", "zzz"))) == [2, 3]
    with pytest.raises(errors.NodeNotFound):
        traverse.neighbors(g, [77])
    with pytest.raises(errors.InvalidPropertyValue):
        traverse.neighbors(g, [0], Steps(min_weight=math.nan))
    assert [(r.edge, r.neighbor) for r in traverse.expand(g, 1).collect()] == [(1, 2)]


def _walk(n, edges, kinds, start, direction, hops, limit, revisit):
    """Depth-first pre-order, as a plain recursion."""
    def moves(v):
        out = [(0, kinds.index(t), i, b) for i, (a, b, t, _) in enumerate(edges) if a == v and direction != IN]
        out += [(1, kinds.index(t), i, a) for i, (a, b, t, _) in enumerate(edges) if b == v and direction != "out" and not (direction == BOTH and a == b)]
        return sorted(out)

    found = []

    def go(nodes, taken):
        if len(taken) == hops:
            return
        for _, _, e, b in moves(nodes[-1]):
            if len(found) < limit and (revisit or b not in nodes):
                found.append((nodes + [b], taken + [e]))
                go(nodes + [b], taken + [e])

    go([start], [])
    return found[:limit]


@pytest.mark.parametrize("seed", range(3))
def test_traverse_is_depth_first_preorder(spark, seed):
    r = np.random.default_rng(seed)
    n, kinds = 6, ["a", "b", "c"]
    edges = [(int(r.integers(n)), int(r.integers(n)), kinds[int(r.integers(3))], 1.0) for _ in range(12)]
    kinds = list(dict.fromkeys(e[2] for e in edges))
    direction, revisit = [("out", False), (BOTH, False), (IN, True)][seed]
    g = graph(spark, n, edges)
    got = traverse.traverse(g, 0, Traversal(Steps(direction), 3, 9, revisit)).orderBy("rank").collect()
    assert [(list(x.nodes), list(x.edges)) for x in got] == _walk(n, edges, kinds, 0, direction, 3, 9, revisit)
    assert all(x.cost == len(x.edges) for x in got)


def test_traverse_limits(spark):
    g = graph(spark, 1, [(0, 0, "a", 1)])
    assert traverse.traverse(g, 0, Traversal(max_hops=3, revisit=True)).count() == 3 and traverse.traverse(g, 0, Traversal(max_hops=0)).count() == 0


def test_shortest_paths(spark):
    g = graph(spark, 4, [(0, 2, "t", 5), (0, 1, "t", 1), (1, 2, "t", 1)])
    path = lambda *a, **k: [(list(r.nodes), r.cost) for r in traverse.shortest_path(g, *a, **k).collect()]
    assert path(0, 2) == [([0, 2], 1.0)] and path(0, 2, weighted=True) == [([0, 1, 2], 2.0)]
    assert path(0, 3) == [] and path(0, 3, weighted=True) == [] and path(1, 1) == [([1], 0.0)]
    chain = graph(spark, 4, [(0, 1, "t", 1), (1, 2, "t", 1), (2, 3, "t", 1)])
    for weighted in (False, True):
        assert traverse.shortest_path(chain, 0, 3, weighted=weighted, max_steps=2).count() == 0
        assert traverse.shortest_path(chain, 0, 3, weighted=weighted, max_steps=3).count() == 1
    free = graph(spark, 3, [(0, 1, "t", 0), (1, 2, "t", -4), (0, 2, "t", 0)])
    assert traverse.shortest_path(free, 0, 2, weighted=True).first().cost == 0.0


def test_reachable(spark):
    g = graph(spark, 4, [(0, 1, "t", 1), (1, 2, "t", 1), (2, 0, "t", 1), (2, 3, "t", 1)])
    assert [(r.node_id, r.hops) for r in traverse.reachable(g, 0, 2).orderBy("node_id").collect()] == [(0, 0), (1, 1), (2, 2)]
    both = traverse.reachable(g, spark.createDataFrame([(0,), (3,)], "node_id bigint"), 1, Steps(BOTH)).collect()
    assert sorted((r.anchor, r.node_id) for r in both) == [(0, 0), (0, 1), (0, 2), (3, 2), (3, 3)]


def test_similarity(spark):
    big = float(np.finfo(np.float32).max)
    people = [{"age": 1, "_embedding": [1, 0, 0, 0]}, {"age": 1, "_embedding": [0.9, 0.1, 0, 0]}, {"age": 99, "_embedding": [1, 0, 0, 0]}, {"_embedding": [0, 0, 0, 0]}, {}]
    people = [p | ({"_embedding": [float(x) for x in p["_embedding"]]} if "_embedding" in p else {}) for p in people]
    g = graph(spark, people, [(0, 1, "t", 1)], GraphConfig(scan_ceiling=3))
    v = (1.0, 0.0, 0.0, 0.0)
    top = lambda q: [r.node_id for r in similarity.similar_nodes(g, q).orderBy("rank").collect()]
    assert top(SimilarityQuery(v, property_filter=PropertyQuery("person", "age", eq=1))) == [0, 1]
    with pytest.raises(errors.UnsupportedQuery):
        top(SimilarityQuery(v))
    assert top(SimilarityQuery(v, allow_full_scan=True)) == [0, 2, 1, 3] and top(SimilarityQuery(v, k=0, allow_full_scan=True)) == []
    assert top(SimilarityQuery(v, "euclidean", allow_full_scan=True)) == [0, 2, 1, 3] and top(SimilarityQuery((1.0,), allow_full_scan=True)) == []
    assert top(SimilarityQuery(v, node_types=())) == [] and top(SimilarityQuery(v, within=Reach(0, 1))) == [0, 1]
    for bad in ((math.nan,) * 4, (1e39,) * 4):
        with pytest.raises(errors.InvalidPropertyValue):
            top(SimilarityQuery(bad))
    h = graph(spark, [{"_embedding": [big, 0.0, 0.0, 0.0]}, {"_embedding": [1e-30, 0.0, 0.0, 0.0]}], [])
    assert [r.node_id for r in similarity.similar_nodes(h, SimilarityQuery((big, 0.0, 0.0, 0.0), "dot")).orderBy("rank").collect()] == [1, 0]


def test_batch_scores_have_the_same_bits(spark):
    r = np.random.default_rng(0)
    vectors = r.standard_normal((40, 7)).astype(np.float32)
    g = graph(spark, [{"_embedding": [float(x) for x in v]} for v in vectors], [], dim=7)
    for metric in ("cosine", "dot", "euclidean"):
        one = {(x.node_id, x.score, x.rank) for x in similarity.similar_nodes(g, SimilarityQuery(tuple(map(float, vectors[3])), metric)).collect()}
        many = similarity.similar_batch(g, [(3, tuple(map(float, vectors[3]))), (4, tuple(map(float, vectors[4])))], metric)
        assert one == {(x.node_id, x.score, x.rank) for x in many.filter("query_id = 3").collect()} and many.count() == 20


def test_changes(spark):
    g = graph(spark, 3, [(0, 1, "t", 1), (1, 2, "u", float(np.float32(3e38)))])
    with pytest.raises(errors.DanglingEdge):
        mutations.remove_node(g, 1)
    h = mutations.remove_node(g, 1, cascade=True)
    assert query.counts(h).first() == (2, 0) and h.next_node_id == 3
    h, i = mutations.add_node(h, "person", {"a": 1, "n": None})
    assert i == 3 and ids(query.nodes_by_property(h, PropertyQuery("person", "a", eq=1))) == [3]
    h = mutations.update_node_properties(h, 3, PropertyPatch().set("b", "x").remove("a"))
    p = query.node(h, 3).first().props
    assert set(p) == {"b", "n"} and p["n"].tag == 0 and p["b"].s == "x"
    with pytest.raises(errors.InvalidPropertyValue):
        mutations.decay_edges(g, EdgeFilter(), 10.0)
    d, n = mutations.decay_edges(g, EdgeFilter(("t",)), 0.5)
    assert n == 1 and query.edge(d, 0).first().weight == 0.5
    assert mutations.update_edge_weight(g, 0, "add", 0.25)[1] == 1.25 and mutations.update_edge_weight(g, 0, "multiply", 9, (None, 2.0))[1] == 2.0
    for bad in (lambda: mutations.update_edge_weight(g, 1, "multiply", 10.0, (0.0, 1.0)), lambda: mutations.update_edge_weight(g, 0, "set", 1.0, (2.0, 1.0)), lambda: mutations.add_edge(g, 0, 1, "t", math.inf)):
        with pytest.raises(errors.InvalidPropertyValue):
            bad()
    with pytest.raises(errors.NodeNotFound):
        mutations.add_edge(g, 0, 9, "t", 1.0)
    with pytest.raises(errors.EdgeNotFound):
        mutations.remove_edge(g, 9)
    e, i = mutations.add_edge(g, 2, 2, "new", 0.5)
    assert i == 2 and e.edge_types == {"t": 0, "u": 1, "new": 2} and ids(query.scan_edges(mutations.remove_edge(e, 0)), "edge_id") == [1, 2]
    with pytest.raises(errors.Storage):
        mutations.add_node(graph(spark, 1, [], GraphConfig().as_read_only()), "person")


def test_embeddings_are_checked(spark):
    g = graph(spark, [{}, {"_type": "tag"}], [])
    for node, vector, kind in ((9, [0.0] * 4, errors.NodeNotFound), (0, [math.nan] * 4, errors.InvalidPropertyValue), (1, [0.0] * 4, errors.InvalidNodeType), (0, [0.0], errors.DimensionMismatch)):
        with pytest.raises(kind):
            mutations.set_node_embedding(g, node, vector)
    assert query.node(mutations.set_node_embedding(g, 0, [1.0, 2.0, 3.0, 4.0]), 0).first().embedding == [1, 2, 3, 4]


def test_bulk_ids_follow_the_key(spark):
    g = graph(spark, 2, [])
    rows = spark.createDataFrame([("person", {}, k) for k in (30, 10, 20)], f"node_type string, props {PROPS}, k int")
    h = mutations.add_nodes(g, rows, "k")
    assert ids(h.nodes) == [0, 1, 2, 3, 4] and h.next_node_id == 5
    edges = spark.createDataFrame([(0, 1, t, 1.0, {}, k) for t, k in (("z", 2), ("y", 1), ("z", 3))], f"src bigint, dst bigint, edge_type string, weight float, props {PROPS}, k int")
    h = mutations.add_edges(h, edges, "k")
    assert [(r.edge_id, r.edge_type, r.etype_id) for r in h.edges.orderBy("edge_id").collect()] == [(0, "y", 0), (1, "z", 1), (2, "z", 1)]


def test_export(spark):
    g = graph(spark, [{"age": 3, "_embedding": [1.0, 2.0, 3.0, 4.0]}, {"_type": "tag", "age": "x"}, {"age": True}], [(2, 0, "t", 2), (0, 1, "u", 1)])
    m = export.index_map(g)
    assert [(r.node_id, r.idx) for r in m.orderBy("idx").collect()] == [(0, 0), (1, 1), (2, 2)]
    f = {r.idx: r.features for r in export.node_features(g, m, ("age",)).collect()}
    assert f == {0: [1, 2, 3, 4, 3], 1: [0] * 5, 2: [0, 0, 0, 0, 1]}
    assert {r.idx: r.type_id for r in export.node_type_ids(g, m).collect()} == {0: 0, 1: 1, 2: 0}
    assert [tuple(r) for r in export.edge_index(g, m).orderBy("edge_id").collect()] == [(0, 2, 0, 2.0, 0), (1, 0, 1, 1.0, 1)]
    smaller = mutations.remove_node(g, 2, cascade=True)
    with pytest.raises(errors.IndexCorruption):
        export.node_features(smaller, m)
    with pytest.raises(errors.IndexCorruption):
        export.edge_index(g, m.filter("idx < 2"))


def test_dense_index_over_partitions(spark):
    d = dense_index(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), "k")
    assert d.filter("k <> idx").count() == 0 and d.count() == 1000


def test_lookups_read_only_the_rows_of_their_ids(spark):
    from vectrail.sources.tables import EDGE_BASE, NODE_BASE, load

    g = load(spark, "/root/testdata/sf0.001")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    one = query.node(g, 2 * NODE_BASE + 7)
    assert one.count() == 1 and plan(one).count("FileScan") == 1 and "EqualTo(c_custkey,7)" in plan(one)
    line = g.edges.filter("edge_type = 'supplied_by'").orderBy("edge_id").limit(1).select("edge_id", "src", "dst").first()
    found = query.edge(g, line.edge_id)
    assert found.count() == 1 and plan(found).count("FileScan") == 1 and "PushedFilters: [IsNotNull(l_" in plan(found)
    assert query.node(g, 8 * NODE_BASE).count() == query.edge(g, 9 * EDGE_BASE).count() == 0
    near = traverse.neighbors(g, [line.src], Steps(BOTH))
    whole = traverse.steps(g, Steps(BOTH)).filter(F.col("node") == line.src)
    assert near.count() == whole.count() > 0 and plan(near).count("FileScan") < plan(whole).count("FileScan")
