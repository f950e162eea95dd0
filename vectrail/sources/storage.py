"""Stored graphs: Parquet versions under a folder, published by numbered manifests.

A version is a base, all nodes and edges, and a delta: the rows that are new or changed since, and the ids that are gone.
A commit writes the delta of the tables that changed and then renames its manifest into place, which is the only step that
others see. When the delta reaches a part of the base, the commit writes a new base instead. Readers take the newest
manifest and stay with its files. All access goes through Spark and its Hadoop file systems, so a graph can be in any
store that Spark reads.
"""

from __future__ import annotations

import json
import os
import socket
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import GraphConfig
from ..errors import Codec, GenerationMismatch, InvalidNodeType, LockConflict, Storage, VersionMismatch
from ..graph import EDGES, NODES, PropertyGraph
from ..operators.query import indexed, indexed_column

FORMAT = 2
#: A commit writes a new base when the delta has more than this part of the base's rows.
COMPACT = 0.25
KEYS = {"nodes": "node_id", "edges": "edge_id"}


class Folder:
    """The few file operations needed, on Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(""))) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write text under a name that must be new: to a temporary file, renamed into place."""
        part = f".{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self._path(part), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name) or not self.fs.rename(self._path(part), self._path(name)):
            self.fs.delete(self._path(part), False)
            raise Storage(f"{name} exists: another writer has committed")

    def lock(self) -> None:
        """Create LOCK, which names its holder. A lock whose holder was a process of this machine that has ended is stale and
        taken over; any other stays."""
        self.fs.mkdirs(self._path(""))
        me = f"{socket.gethostname()} {os.getpid()}"
        for _ in range(2):
            try:
                out = self.fs.create(self._path("LOCK"), False)
                out.write(bytearray(me.encode()))
                out.close()
                return
            except Exception as e:
                host, _, pid = self.read("LOCK").partition(" ") if self.exists("LOCK") else ("", "", "")
                if host != socket.gethostname() or not pid.isdigit() or _alive(int(pid)):
                    raise LockConflict(self.path) from e
                self.unlock()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def unlock(self) -> None:
        self.fs.delete(self._path("LOCK"), False)


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps by their sorted entries."""
    plain = lambda f: F.sort_array(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`")
    return F.xxhash64(*[plain(f) for f in df.schema])


def _digest(df: DataFrame) -> list[Column]:
    """Row count, and an order-free digest of all columns."""
    return [F.count("*").alias("n"), F.coalesce(F.bit_xor(row_hash(df)), F.lit(0)).alias("x")]


def checksum(df: DataFrame) -> list[int]:
    r = df.agg(*_digest(df)).first()
    return [r.n, r.x]


def _write(df: DataFrame, path: str) -> list[int]:
    """Write df and return its checksum, observed on the way."""
    seen = Observation()
    df.observe(seen, *_digest(df)).write.parquet(path)
    return [seen.get["n"], seen.get["x"]]


def _manifest_name(version: int) -> str:
    return f"manifest-{version:012d}.json"


@dataclass
class StoredGraph:
    """A handle on a stored graph: ``graph`` is what was committed last."""

    folder: Folder
    version: int
    base: int
    graph: PropertyGraph
    poisoned: bool = False
    parts: dict[str, Any] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def _publish(self, g: PropertyGraph, tables: Callable[[str], dict[str, Any]], base: int, mark: tuple[str, int] | None = None) -> None:
        """Write tables under a new folder, then the manifest that names them."""
        g.writable()
        if self.poisoned:
            raise Storage("an earlier write failed; open the graph again")
        version = self.version + 1
        data = f"data-{version:012d}-{uuid.uuid4().hex[:8]}"
        marks = self.marks | ({mark[0]: mark[1]} if mark else {})
        try:
            manifest = _describe(g) | tables(data) | {"version": version, "base": base, "marks": marks}
            self.folder.publish(_manifest_name(version), _seal(manifest))
        except Storage:
            raise
        except Exception as e:
            self.poisoned = True
            raise Storage(str(e)) from e
        self.version, self.base, self.marks = version, base, marks
        self.parts = {k: manifest[k] for k in ("data", "nodes", "edges", "delta")}
        self.graph = _read_tables(g.spark, self.folder.path, manifest, g.config)

    def _rebase(self, g: PropertyGraph, base: int, mark: tuple[str, int] | None = None) -> None:
        self._publish(g, lambda data: {"data": data, "delta": {}} | _write_tables(g, f"{self.folder.path}/{data}"), base, mark)

    def commit(self, g: PropertyGraph, mark: tuple[str, int] | None = None) -> None:
        """Make g durable: only tables that were changed are looked at, and of these only what differs from the base is
        written. Nothing pending since the last commit: no new version. mark (name, number) is kept in the manifest; a
        number that is not above the name's last one is a repetition and changes nothing."""
        if mark is not None and self.marks.get(mark[0], -1) >= mark[1]:
            return
        if g is not self.graph and g.nodes is self.graph.nodes and g.edges is self.graph.edges and not g.pending or g is self.graph:
            return
        if not self.parts["nodes"][0] + self.parts["edges"][0] or g.config.indexed_properties != self.graph.config.indexed_properties:
            return self._rebase(g, self.base, mark)  # nothing to be a delta of
        g.writable()
        delta = dict(self.parts["delta"])
        folder = f"{self.folder.path}/delta-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
        base = _base_tables(g.spark, self.folder.path, self.parts["data"], g.config)
        for name, key in KEYS.items():
            new = (indexed(g) if name == "nodes" else g.edges) if getattr(g, name) is not getattr(self.graph, name) else None
            if new is None:
                continue
            old = base[name]
            ids = old.select(F.col(key).alias("_id"), row_hash(old).alias("_hash"))
            new = new.select(*old.columns)
            both = new.withColumn("_new", row_hash(new)).join(ids, new[key] == ids["_id"], "full")
            differs = both.filter(F.col("_hash").isNull() | F.col("_new").isNull() | (F.col("_hash") != F.col("_new")))
            changed = differs.select(F.coalesce(key, "_id").alias("_at"), F.col(key).isNull().alias("_gone"), *old.columns)
            delta[name] = [f"{folder.rsplit('/', 1)[1]}/{name}", *_write(changed, f"{folder}/{name}")]
        rows, all_ = sum(x[1] for x in delta.values()), self.parts["nodes"][0] + self.parts["edges"][0]
        if rows > COMPACT * all_:
            return self._rebase(g, self.base, mark)
        self._publish(g, lambda data: {k: self.parts[k] for k in ("data", "nodes", "edges")} | {"delta": delta}, self.base, mark)

    def snapshot(self, free: bool = False) -> None:
        """Make the committed graph a base, sorted by id. A base that no delta has changed since, and that has the columns of all
        indexed properties, is one already: the new version names its files. With free, the folders and manifests of earlier
        versions are deleted; who still reads them has to open the graph again."""
        g = self.graph
        if self.parts["delta"] or any(indexed_column(t, k) not in g.nodes.columns for t, k in g.config.indexed_properties):
            self._rebase(g, self.version + 1)
        else:
            self._publish(g, lambda _: dict(self.parts), self.version + 1)
        if free:
            used = {self.parts["data"], _manifest_name(self.version)}
            for x in self.folder.names():
                if x.startswith(("data-", "delta-", "manifest-")) and x not in used:
                    self.folder.delete(x)

    def export(self, path: str, g: PropertyGraph | None = None) -> None:
        """Write a portable copy of the committed graph; refuses uncommitted changes and its own folder."""
        if self.poisoned or (g is not None and g.pending):
            raise Storage("uncommitted changes")
        if path.rstrip("/").startswith(self.folder.path):
            raise Storage("the destination is inside the graph's folder")
        export(self.graph, path)

    def close(self) -> None:
        if self.graph.config.file_lock:
            self.folder.unlock()


def _seal(manifest: dict[str, Any]) -> str:
    text = json.dumps(manifest, sort_keys=True)
    return json.dumps({"crc": zlib.crc32(text.encode()), "manifest": manifest}, sort_keys=True)


def _unseal(text: str) -> dict[str, Any]:
    try:
        sealed = json.loads(text)
        manifest, crc = sealed["manifest"], sealed["crc"]
    except (ValueError, KeyError, TypeError) as e:
        raise Codec("the manifest can't be read") from e
    if manifest.get("format") != FORMAT:
        raise VersionMismatch(f"found {manifest.get('format')}, supported {FORMAT}")
    if zlib.crc32(json.dumps(manifest, sort_keys=True).encode()) != crc:
        raise Codec("the manifest's checksum is wrong")
    if manifest.get("base", 0) > manifest.get("version", 0):
        raise GenerationMismatch(f"base {manifest['base']} is newer than version {manifest['version']}")
    return manifest


def _describe(g: PropertyGraph) -> dict[str, Any]:
    return {
        "format": FORMAT, "node_types": [[k, i, d] for k, (i, d) in g.node_types.items()], "edge_types": [[k, i] for k, i in g.edge_types.items()],
        "next_node_id": g.next_node_id, "next_edge_id": g.next_edge_id, "indexed": [list(x) for x in g.config.indexed_properties],
    }


def _write_tables(g: PropertyGraph, path: str) -> dict[str, list[int]]:
    """Nodes by type and id with indexed properties as columns, edges by type, source and id: min-max statistics prune."""
    nodes = indexed(g).repartitionByRange("node_type", "node_id").sortWithinPartitions("node_type", "node_id")
    edges = g.edges.repartitionByRange("etype_id", "src").sortWithinPartitions("etype_id", "src", "edge_id")
    return {"nodes": _write(nodes, f"{path}/nodes"), "edges": _write(edges, f"{path}/edges")}


def _base_tables(spark: SparkSession, path: str, data: str, config: GraphConfig) -> dict[str, DataFrame]:
    value = spark.createDataFrame([], NODES).schema["props"].dataType.valueType.simpleString()
    extra = "".join(f", `{indexed_column(t, k)}` {value}" for t, k in config.indexed_properties)
    at = f"{path}/{data}" if data else path
    return {"nodes": spark.read.schema(NODES + extra).parquet(f"{at}/nodes"), "edges": spark.read.schema(EDGES).parquet(f"{at}/edges")}


def _read_tables(spark: SparkSession, path: str, m: dict[str, Any], config: GraphConfig, verify: bool = False) -> PropertyGraph:
    stored = replace(config, indexed_properties=tuple(tuple(x) for x in m["indexed"]))
    try:
        tables = _base_tables(spark, path, m.get("data", ""), stored)
        for name, d in tables.items():
            if verify and checksum(d) != m[name]:
                raise Codec("the tables don't fit their manifest")
            if name in m.get("delta", {}):
                folder, *seen = m["delta"][name]
                delta = spark.read.schema(f"_at bigint, _gone boolean, {_ddl(d)}").parquet(f"{path}/{folder}")
                if verify and checksum(delta) != seen:
                    raise Codec("the delta doesn't fit its manifest")
                kept = d.join(delta.select("_at"), d[KEYS[name]] == delta["_at"], "left_anti")
                tables[name] = kept.unionByName(delta.filter("not _gone").select(*d.columns))
    except Codec:
        raise
    except Exception as e:
        raise Storage(str(e)) from e
    for k, _, d in m["node_types"]:
        if d is not None and config.max_embedding_dim is not None and d > config.max_embedding_dim:
            raise InvalidNodeType(f"{k}: dimension {d} exceeds {config.max_embedding_dim}")
    both = tuple(dict.fromkeys([*(tuple(x) for x in m["indexed"]), *config.indexed_properties]))
    return PropertyGraph(tables["nodes"], tables["edges"], {k: (i, d) for k, i, d in m["node_types"]}, dict(m["edge_types"]), replace(config, indexed_properties=both), m["next_node_id"], m["next_edge_id"])


def _ddl(d: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)


def create(spark: SparkSession, path: str, config: GraphConfig = GraphConfig()) -> StoredGraph:
    """A new, empty stored graph; an error where one is."""
    folder = Folder(spark, path)
    if any(x.startswith("manifest-") for x in folder.names()):
        raise Storage(f"{path} holds a graph; open it")
    if config.file_lock:
        folder.lock()
    s = StoredGraph(folder, -1, 0, PropertyGraph.in_memory(spark, config))
    s._rebase(s.graph, 0)
    return s


def open_(spark: SparkSession, path: str, config: GraphConfig = GraphConfig()) -> StoredGraph:
    """The newest committed version, checked against its manifest. Files that no manifest names are ignored."""
    folder = Folder(spark, path)
    if config.file_lock and not config.read_only:
        folder.lock()
    names = [x for x in folder.names() if x.startswith("manifest-")]
    if not names:
        raise Storage(f"{path} holds no graph; create it")
    m = _unseal(folder.read(names[-1]))
    if not folder.exists(m["data"]):
        raise Storage(f"{m['data']} is missing")
    parts = {k: m[k] for k in ("data", "nodes", "edges", "delta")}
    return StoredGraph(folder, m["version"], m["base"], _read_tables(spark, folder.path, m, config, verify=True), parts=parts, marks=m["marks"])


def export(g: PropertyGraph, path: str) -> None:
    """A portable copy of a graph in a folder of its own."""
    folder = Folder(g.spark, path)
    if folder.exists():
        raise Storage(f"{path} exists")
    m = _describe(g) | _write_tables(g, path)
    folder.publish("export.json", _seal(m | {"version": 0, "base": 0}))


def import_(spark: SparkSession, path: str, config: GraphConfig = GraphConfig()) -> PropertyGraph:
    """An exported graph with the same ids, in memory."""
    folder = Folder(spark, path)
    if not folder.exists("export.json"):
        raise Storage(f"{path} holds no exported graph")
    return _read_tables(spark, folder.path, _unseal(folder.read("export.json")), config, verify=True)
