"""Stored graphs: round trips, ids, and what damaged or concurrent folders raise."""

import json
import os

import pytest
from graphs import graph, ids
from pyspark.sql import functions as F

from vectrail import errors
from vectrail.config import GraphConfig
from vectrail.operators import mutations, query
from vectrail.operators.query import EdgeFilter, PropertyQuery
from vectrail.sources import storage


def test_round_trip_and_ids(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    config = GraphConfig().with_indexed_property("person", "age")
    with pytest.raises(errors.Storage):
        storage.open_(spark, path)
    s = storage.create(spark, path, config)
    with pytest.raises(errors.Storage):
        storage.create(spark, path)
    g = mutations.remove_node(graph(spark, [{"age": 1}, {"age": 2}, {"age": 3}], [(0, 2, "t", 0.8)], config), 1)
    g, _ = mutations.decay_edges(g, EdgeFilter(), 0.5)
    s.commit(g)
    h = storage.open_(spark, path, config).graph
    assert ids(h.nodes) == [0, 2] and query.edge(h, 0).first().weight == pytest.approx(0.4) and h.next_node_id == 3
    assert ids(query.nodes_by_property(h, PropertyQuery("person", "age", eq=3))) == [2] and "ix_person_age" in h.nodes.columns
    h, i = mutations.add_node(h, "person")
    assert i == 3
    version = s.version
    s.snapshot()
    assert s.version == version + 1 and s.base == s.version
    s.commit(s.graph)
    assert s.version == version + 1  # nothing pending


def test_damage(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    s = storage.create(spark, path)
    s.commit(graph(spark, 2, []))
    last = max(x for x in os.listdir(tmp_path / "g") if x.startswith("manifest-"))
    text = (tmp_path / "g" / last).read_text()
    (tmp_path / "g" / ".manifest-left-over").write_text("x")  # ignored
    assert ids(storage.open_(spark, path).graph.nodes) == [0, 1]
    sealed = json.loads(text)
    def check(change, kind):
        broken = json.loads(text)
        change(broken)
        for x in (f".{last}.crc", last):
            if (tmp_path / "g" / x).exists():
                (tmp_path / "g" / x).unlink()
        (tmp_path / "g" / last).write_text(json.dumps(broken))
        with pytest.raises(kind):
            storage.open_(spark, path)

    check(lambda m: m.update(crc=1), errors.Codec)
    check(lambda m: m["manifest"].update(format=9), errors.VersionMismatch)
    check(lambda m: m.pop("manifest"), errors.Codec)
    def newer(m):
        m["manifest"]["base"] = 99
        m.update(json.loads(storage._seal(m["manifest"])))
    check(newer, errors.GenerationMismatch)
    def wrong(m):
        m["manifest"]["nodes"] = [5, 5]
        m.update(json.loads(storage._seal(m["manifest"])))
    check(wrong, errors.Codec)
    def gone(m):
        m["manifest"]["data"] = "nowhere"
        m.update(json.loads(storage._seal(m["manifest"])))
    check(gone, errors.Storage)
    assert sealed["manifest"]["next_node_id"] == 2


def test_writers(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    config = GraphConfig(file_lock=True)
    s = storage.create(spark, path, config)
    with pytest.raises(errors.LockConflict):
        storage.open_(spark, path, config)
    s.close()
    a, b = storage.open_(spark, path), storage.open_(spark, path)
    a.commit(graph(spark, 1, []))
    with pytest.raises(errors.Storage):
        b.commit(graph(spark, 3, []))
    assert ids(storage.open_(spark, path).graph.nodes) == [0]
    ro = storage.open_(spark, path, GraphConfig().as_read_only())
    with pytest.raises(errors.Storage):
        mutations.add_node(ro.graph, "person")
    with pytest.raises(errors.Storage):
        a.export(f"{path}/inside")
    a.export(f"file://{tmp_path}/copy")
    with pytest.raises(errors.Storage):
        a.export(f"file://{tmp_path}/copy")
    assert ids(storage.import_(spark, f"file://{tmp_path}/copy").nodes) == [0]
    with pytest.raises(errors.InvalidNodeType):
        storage.open_(spark, path, GraphConfig(max_embedding_dim=2))


def test_commits_write_what_changed(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    s = storage.create(spark, path)
    s.commit(graph(spark, [{"age": i} for i in range(40)], [(i, (i + 1) % 40, "t", 1) for i in range(40)]))
    base = s.parts["data"]
    g = mutations.remove_edge(mutations.update_edge_weights(s.graph, F.col("edge_id") == 3, "set", 7.0), 5)
    s.commit(g)
    assert s.parts["data"] == base and set(s.parts["delta"]) == {"edges"} and s.parts["delta"]["edges"][1] == 2  # one changed, one gone
    g, i = mutations.add_node(s.graph, "person", {"age": 99})
    s.commit(mutations.update_node_properties(g, 4, mutations.PropertyPatch().set("age", -1)))
    assert s.parts["delta"]["nodes"][1] == 2 and s.parts["delta"]["edges"][1] == 2
    h = storage.open_(spark, path).graph
    assert ids(h.nodes) == [*range(41)] and query.edge(h, 3).first().weight == 7.0 and query.edge(h, 5).count() == 0 and h.edges.count() == 39
    assert ids(query.nodes_by_property(h, PropertyQuery("person", "age", eq=-1))) == [4] and ids(query.nodes_by_property(h, PropertyQuery("person", "age", eq=4))) == []
    s.commit(mutations.update_edge_weights(s.graph, F.lit(True), "add", 1.0))
    assert s.parts["data"] != base and not s.parts["delta"]  # too large a part: a new base
    s.snapshot(free=True)
    assert [x for x in os.listdir(tmp_path / "g") if x.startswith(("data-", "delta-"))] == [s.parts["data"]]
    again = storage.open_(spark, path).graph
    assert again.edges.count() == 39 and query.edge(again, 3).first().weight == 8.0


def test_changed_columns_are_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    s = storage.create(spark, path)
    s.commit(graph(spark, [{"age": 1}, {"age": 2}], [(0, 1, "t", 1)]))
    nodes = spark.read.parquet(f"{path}/{s.parts['data']}/nodes")
    other = mutations.update_node_properties(s.graph, 1, mutations.PropertyPatch().set("age", 3)).nodes.select(*nodes.columns)
    other.write.parquet(f"file://{tmp_path}/other")
    (tmp_path / "g" / s.parts["data"] / "nodes").rename(tmp_path / "old")
    (tmp_path / "other").rename(tmp_path / "g" / s.parts["data"] / "nodes")
    with pytest.raises(errors.Codec):
        storage.open_(spark, path)


def test_lock_of_an_ended_process_is_stale(spark, tmp_path):
    import socket
    import subprocess
    import sys

    path, config = f"file://{tmp_path}/g", GraphConfig(file_lock=True)
    storage.create(spark, path, config).close()
    ended = subprocess.Popen([sys.executable, "-c", ""])
    ended.wait()
    (tmp_path / "g" / "LOCK").write_text(f"{socket.gethostname()} {ended.pid}")
    storage.open_(spark, path, config).close()
    (tmp_path / "g" / "LOCK").write_text(f"elsewhere {ended.pid}")
    with pytest.raises(errors.LockConflict):
        storage.open_(spark, path, config)
