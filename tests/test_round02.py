"""Cases of the second round's findings."""

import random

import duckdb
import pytest
from graphs import graph
from pyspark.sql import functions as F
from test_catalogue import DATA, TABLES

from vectrail import errors
from vectrail.config import GraphConfig
from vectrail.llm import jaccard
from vectrail.operators import export, mutations, query, similarity, traverse
from vectrail.operators.similarity import SimilarityQuery
from vectrail.plans.catalogue import QUERIES, SQL
from vectrail.sources import storage
from vectrail.sources.tables import load


def test_vector_of_no_types_dimension_needs_no_scan(spark):
    """more nodes than the ceiling, none of which can hold the vector."""
    g = graph(spark, [{"_embedding": [1.0, 0.0, 0.0, 0.0]} for _ in range(5)], [], GraphConfig(scan_ceiling=3))
    assert similarity.similar_nodes(g, SimilarityQuery((1.0, 2.0), node_types=("person",))).collect() == []
    with pytest.raises(errors.UnsupportedQuery):  # those that can are still counted
        similarity.similar_nodes(g, SimilarityQuery((1.0, 0.0, 0.0, 0.0), node_types=("person",)))


def test_fewest_hops_are_bounded(spark, tmp_path):
    """the SQL looks for paths of three hops. A customer of another region reaches region 0 by orders, parts and
    suppliers in five."""
    chain = graph(spark, 5, [(i, i + 1, "t", 1) for i in range(4)])
    assert traverse.shortest_path(chain, 0, 4, max_hops=3).count() == 0
    assert traverse.shortest_path(chain, 0, 4, max_hops=4).first().nodes == [0, 1, 2, 3, 4]
    with pytest.raises(errors.UnsupportedQuery):
        traverse.shortest_path(chain, 0, 4, weighted=True, max_hops=4)
    c = duckdb.connect()
    for t in TABLES[:10]:
        new = "* REPLACE (CASE WHEN c_custkey = 4 THEN (SELECT min(n_nationkey) FROM '%s/nation.parquet' WHERE n_regionkey = 1) ELSE c_nationkey END::INTEGER AS c_nationkey)" % DATA if t == "customer" else "*"
        c.sql(f"COPY (SELECT {new} FROM '{DATA}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    found = [tuple(r) for r in QUERIES["shortest_path_hops"](spark, str(tmp_path)).select("nodes", "edges", "cost").collect()]
    assert found == c.sql(SQL["shortest_path_hops"]).fetchall() == []


def test_edges_look_up_any_index(spark):
    """the index in short is small where ids have no gaps, and exact where they have."""
    n = 1000
    dense = spark.range(n).select((F.col("id") + 70).alias("node_id"), F.col("id").alias("idx"))
    assert export.runs(dense).count() <= n // 64 + 2
    g = graph(spark, n + 70, [(i, (7 * i) % n + 70, "t", i) for i in range(70, n + 70)])
    odd = dense.withColumn("idx", F.when(F.col("node_id") % 3 == 0, 5000 - F.col("idx")).otherwise(F.col("idx") * F.col("idx")))
    for index in (dense, odd):
        at = {r.node_id: r.idx for r in index.collect()}
        assert {(r.edge_id, r.src_idx, r.dst_idx) for r in export.edge_index(g, index).collect()} == {(i - 70, at[i], at[(7 * i) % n + 70]) for i in range(70, n + 70)}
        for gone in (70, 133, 134, 1069):
            with pytest.raises(errors.IndexCorruption):
                export.edge_index(g, index.filter(F.col("node_id") != gone))


def test_features_shuffle_numbers_not_maps(spark):
    """F8: values are picked before the join, and all columns are cast at once."""
    g = load(spark, DATA)
    d = export.node_features(g, export.index_map(g), ("c_acctbal", "p_size", "label"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "map(" not in plan and "c_name" not in plan
    people = graph(spark, [{"age": 3, "_embedding": [1.0, 2.0, 3.0, 4.0]}, {"age": True}, {"age": "x"}], [])
    m = export.index_map(people)
    f = lambda *a: {r.idx: list(r.features) for r in export.node_features(people, m, *a).collect()}
    assert f(("age",)) == {0: [1, 2, 3, 4, 3], 1: [0, 0, 0, 0, 1], 2: [0] * 5} and f() == {0: [1, 2, 3, 4], 1: [0] * 4, 2: [0] * 4}
    assert f(("age",), False) == {0: [3], 1: [1], 2: [0]} and f((), False) == {0: [], 1: [], 2: []}
    with pytest.raises(errors.IndexCorruption):
        export.node_features(people, m.unionByName(spark.createDataFrame([(9, 3)], m.schema)))


def test_snapshot_of_a_base_writes_no_rows(spark, tmp_path):
    """a base without a delta is not written again; with one, or with a property to index, it is."""
    path = f"file://{tmp_path}/g"
    s = storage.create(spark, path)
    s.commit(graph(spark, [{"age": i} for i in range(20)], [(i, i + 1, "t", i) for i in range(19)]))
    data, version = s.parts["data"], s.version
    s.snapshot(free=True)
    assert s.parts["data"] == data and (s.version, s.base) == (version + 1, version + 1)
    s.commit(mutations.update_edge_weight(s.graph, 3, "set", 50.0)[0])
    assert s.parts["delta"]
    s.snapshot(free=True)
    assert s.parts["data"] != data and not s.parts["delta"]
    data = s.parts["data"]
    s = storage.open_(spark, path, GraphConfig().with_indexed_property("person", "age"))
    s.snapshot(free=True)
    assert s.parts["data"] != data and "ix_person_age" in s.graph.nodes.columns
    g = storage.open_(spark, path).graph
    assert tuple(query.counts(g).first()) == (20, 19) and query.edge(g, 3).first().weight == 50.0


def test_results_do_not_hang_on_the_frequent_tokens(spark, monkeypatch):
    """the sample's frequencies order tokens; none, all and wrong ones give the brute-force classes."""
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(60)) for _ in range(12)]
    for t in list(texts):
        for n in (1, 2, 6):
            w = t.split()
            for _ in range(n):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if x == old else x for x in comp]
    assert len(set(comp)) < len(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    every = jaccard.frequent_tokens(d, len(texts), 1.0)
    assert len(every) > 100
    for known in ({}, every, {k: r.randrange(1, 10**6) for k in list(every)[::2]}):
        monkeypatch.setattr(jaccard, "frequent_tokens", lambda *_, known=known: known)
        assert {x.doc_id: x.component_id for x in jaccard.near_duplicates(d).collect()} == dict(enumerate(comp))
