"""Generated graphs and their files, workloads, and streamed updates."""

import inspect

import numpy as np
import pytest
from graphs import graph

from vectrail import errors
from vectrail.operators.query import PropertyQuery
from vectrail.plans import workload
from vectrail.sources import fixture, storage
from vectrail.streaming import ingest

P = fixture.Parameters(nodes=300, dim=8, node_types=3, edge_types=3, max_degree=100)


def test_generated_graph(spark):
    r = fixture.self_check(fixture.generate(spark, P), P).first()
    assert (r.nodes, r.edges, r.self_loops) == (300, 1500, 0) and 0.4 < r.coverage < 0.6 and r.cat_rare == 3 and r.cat_common == 30
    again = fixture.generate(spark, P)
    assert fixture.generate(spark, P).edges.select("src", "dst", "weight").exceptAll(again.edges.select("src", "dst", "weight")).isEmpty()


def test_files(spark, tmp_path):
    g = fixture.generate(spark, P)
    fixture.write(g, tmp_path / "f", P)
    fixture.verify(tmp_path / "f")
    h = fixture.read(spark, f"file://{tmp_path}/f")
    for a, b in ((g.nodes.select("node_id", "node_type", "type_id", "embedding"), h.nodes.select("node_id", "node_type", "type_id", "embedding")), (g.edges.drop("props"), h.edges.drop("props"))):
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    with (tmp_path / "f" / "embeddings.bin").open("ab") as f:
        f.write(b"x")
    with pytest.raises(errors.Codec):
        fixture.verify(tmp_path / "f")


def test_workload(spark):
    g = fixture.generate(spark, P)
    anchors = workload.draw(g, 1)
    assert len(anchors) == 3
    runs = workload.measure(spark, workload.operations(g, anchors[:1], None, PropertyQuery("nt_00", "p_cat", eq="cat_common"), "et_00"), repeats=2, warm_up=0)
    s = {r.bucket: r for r in workload.summary(runs).collect()}
    assert s["neighbors"].n == 2 and all(r.steady and r.p50 <= r.p95 <= r.p99 for r in s.values())
    m = workload.mix("mixed", 100)
    assert m.count("read") == 50 and m.count("similarity") == 25


def test_streamed_updates(spark, tmp_path):
    s = storage.create(spark, f"file://{tmp_path}/g")
    s.commit(graph(spark, 2, [(0, 1, "t", 1), (1, 0, "t", 2)]))
    rows = [(2, 0, "multiply", 3.0), (1, 0, "add", 1.0), (3, 1, "set", 0.5)]
    spark.createDataFrame(rows, ingest.UPDATE).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(ingest.UPDATE).parquet(f"file://{tmp_path}/in")
    q = ingest.ingest(stream, s, f"file://{tmp_path}/check")
    q.awaitTermination()
    got = {r.edge_id: r.weight for r in storage.open_(spark, f"file://{tmp_path}/g").graph.edges.collect()}
    assert got == {0: 6.0, 1: 0.5}
    # after a restart of the process the batch comes again: its number is in the manifest
    again = storage.open_(spark, f"file://{tmp_path}/g")
    version = again.version
    again.commit(ingest.apply_updates(again.graph, spark.createDataFrame(rows, ingest.UPDATE)), mark=(f"file://{tmp_path}/check", 0))
    assert again.version == version and {r.edge_id: r.weight for r in again.graph.edges.collect()} == got
    for bad, kind in (((1, 9, "add", 1.0), errors.EdgeNotFound), ((1, 0, "multiply", float("inf")), errors.InvalidPropertyValue), ((1, 0, "halve", 1.0), errors.InvalidPropertyValue)):
        with pytest.raises(kind):
            ingest.apply_updates(s.graph, spark.createDataFrame([bad], ingest.UPDATE))


def test_updates_of_a_hot_edge_are_not_held_in_one_row(spark, tmp_path):
    s = storage.create(spark, f"file://{tmp_path}/g")
    s.commit(graph(spark, 2, [(0, 1, "t", 1), (1, 0, "t", 2)]))
    rows = spark.range(30_000).selectExpr("id as seq", "cast(0 as bigint) as edge_id", "if(id % 3 = 0, 'multiply', 'add') as op", "cast(0.7 as float) as operand")
    h = ingest.apply_updates(s.graph, rows)
    assert "collect_list" not in inspect.getsource(ingest)
    w = np.float32(1)
    for i in range(30_000):
        w = w * np.float32(0.7) if i % 3 == 0 else w + np.float32(0.7)
    assert {r.edge_id: r.weight for r in h.edges.collect()} == {0: float(w), 1: 2.0}
