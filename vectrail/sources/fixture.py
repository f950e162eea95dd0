"""Generated graphs, and their files: nodes.jsonl, edges.jsonl, embeddings.bin, manifest.json.

Generation is a plan over ``spark.range``: every value is a hash of the seed and the row's id, so tables of any size are
made in parallel and rerun equal.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Codec
from ..functions.scalars import DOUBLE, INT, STRING, props, tagged
from ..graph import PropertyGraph

SIZES = {"small": (1_000, 4, 8, 256), "representative": (50_000, 12, 24, 1024), "stress": (500_000, 24, 48, 1024)}
FANOUT = {"low": 2, "medium": 5, "high": 25}


@dataclass(frozen=True)
class Parameters:
    nodes: int = 1_000
    node_types: int = 4
    edge_types: int = 8
    dim: int = 256
    mean_degree: int = 5
    coverage: float = 0.5
    zipf: float = 1.2
    max_degree: int = 1000
    seed: int = 42

    @staticmethod
    def of(size: str, fanout: str = "medium", seed: int = 42) -> Parameters:
        n, t, e, d = SIZES[size]
        return Parameters(n, t, e, d, FANOUT[fanout], seed=seed)


def uniform(seed: int, phase: str, *keys: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(phase), *keys), F.lit(2**53)) / F.lit(float(2**53))


def zipf(u: Column, n: int, s: float) -> Column:
    """A rank from 0 to n - 1 by the inverse of a continuous power law."""
    x = F.pow((F.lit(float(n + 1) ** (1 - s)) - 1) * u + 1, F.lit(1 / (1 - s)))
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(x).cast("long") - 1)).cast("long")


def generate(spark: SparkSession, p: Parameters) -> PropertyGraph:
    """Nodes of round-robin types with p_seq, p_cat (bands of 0.1, 1 and 10 % of a type) and p_score; edges with Zipf
    ends and types, weights in (0, 1]; normalised embeddings, each 100th component a denormal, -0.0 or a tiny one."""
    i = F.col("id")
    within = F.expr(f"id div {p.node_types}")
    size = -(-p.nodes // p.node_types)
    rare, uncommon, common = (int(np.ceil(size * x)) for x in (0.001, 0.01, 0.1))
    cat = F.when(within < rare, "cat_rare").when(within < rare + uncommon, "cat_uncommon").when(within < rare + uncommon + common, "cat_common").otherwise(F.format_string("cat_f%02d", within % 100))
    raw = F.transform(F.sequence(F.lit(0), F.lit(p.dim - 1)), lambda j: (2 * uniform(p.seed, "vector", i, j) - 1).cast("float"))
    covered = uniform(p.seed, "coverage", i) < p.coverage
    nodes = spark.range(p.nodes).withColumn("raw", F.when(covered, raw))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    odd = lambda j: F.when(j % 300 == 0, F.lit(1e-40)).when(j % 300 == 100, F.lit(-0.0)).otherwise(F.lit(float(np.finfo(np.float32).tiny)))
    nodes = nodes.withColumn("norm", norm).select(
        i.alias("node_id"), F.format_string("nt_%02d", i % p.node_types).alias("node_type"), (i % p.node_types).cast("int").alias("type_id"),
        props(p_seq=tagged(INT, i), p_cat=tagged(STRING, cat), p_score=tagged(DOUBLE, uniform(p.seed, "score", i))).alias("props"),
        F.transform("raw", lambda x, j: F.when(j % 100 == 0, odd(j)).otherwise(x / F.col("norm")).cast("float")).alias("embedding"),
    )
    e = spark.range(p.nodes * p.mean_degree)
    src, dst = (zipf(uniform(p.seed, side, i), p.nodes, p.zipf) for side in ("src", "dst"))
    e = e.withColumns({"src": src, "dst": dst})
    for side in ("src", "dst"):  # ends beyond half of the cap move to a uniform node
        over = F.row_number().over(Window.partitionBy(side).orderBy("id")) > p.max_degree // 2 - 1
        e = e.withColumn("over", over).withColumn(side, F.when(F.col("over"), F.floor(uniform(p.seed, f"again-{side}", i) * p.nodes).cast("long")).otherwise(F.col(side)))
    e = e.withColumn("dst", F.when(F.col("src") == F.col("dst"), (F.col("dst") + 1) % p.nodes).otherwise(F.col("dst")))
    kind = zipf(uniform(p.seed, "type", i), p.edge_types, p.zipf)
    edges = e.select(
        i.alias("edge_id"), "src", "dst", F.format_string("et_%02d", kind).alias("edge_type"), kind.cast("int").alias("etype_id"),
        (1 - uniform(p.seed, "weight", i)).cast("float").alias("weight"), props(p_seq=tagged(INT, i)).alias("props"),
    )
    types = {f"nt_{k:02d}": (k, p.dim) for k in range(p.node_types)}
    return PropertyGraph(nodes, edges, types, {f"et_{k:02d}": k for k in range(p.edge_types)}, next_node_id=p.nodes, next_edge_id=p.nodes * p.mean_degree)


def self_check(g: PropertyGraph, p: Parameters) -> DataFrame:
    """One row: counts, the largest degree, self-loops, coverage, and sizes of the category bands."""
    d = g.edges.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").count().agg(F.max("count").alias("max_degree"))
    e = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    cat = F.col("props")["p_cat"]["s"]
    n = g.nodes.agg(F.count("*").alias("nodes"), F.round(F.count("embedding") / F.count("*"), 2).alias("coverage"), *[F.count_if(cat == x).alias(x) for x in ("cat_rare", "cat_uncommon", "cat_common")])
    return n.join(e).join(d)  # one row each


def nodes_json(g: PropertyGraph) -> DataFrame:
    value = lambda k, f: F.col("props")[k][f].alias(k)
    row = F.struct(F.col("node_id").alias("id"), F.col("node_type").alias("type"), F.struct(value("p_seq", "i"), value("p_cat", "s"), value("p_score", "d")).alias("props"))
    return g.nodes.select(F.to_json(row).alias("value"))


def edges_json(g: PropertyGraph) -> DataFrame:
    row = F.struct(F.col("edge_id").alias("id"), F.col("src").alias("from"), F.col("dst").alias("to"), F.col("edge_type").alias("type"), "weight", F.struct(F.col("props")["p_seq"]["i"].alias("p_seq")).alias("props"))
    return g.edges.select(F.to_json(row).alias("value"))


def write(g: PropertyGraph, folder: Path, p: Parameters) -> None:
    """Write a fixture to a local folder, rows by id; a tool for test data, streamed row by row through the driver."""
    folder.mkdir(parents=True, exist_ok=False)
    sums, counts = {}, {}
    for name, lines in (("nodes", nodes_json(PropertyGraph(g.nodes.orderBy("node_id"), g.edges))), ("edges", edges_json(PropertyGraph(g.nodes, g.edges.orderBy("edge_id"))))):
        digest, counts[name] = hashlib.sha256(), 0
        with (folder / f"{name}.jsonl").open("wb") as f:
            for r in lines.toLocalIterator():
                f.write(line := r.value.encode() + b"\n")
                digest.update(line)
                counts[name] += 1
        sums[f"{name}.jsonl"] = f"sha256:{digest.hexdigest()}"
    digest, counts["embeddings"] = hashlib.sha256(), 0
    with (folder / "embeddings.bin").open("wb") as f:
        for r in g.nodes.filter("embedding is not null").orderBy("node_id").select("node_id", "embedding").toLocalIterator():
            f.write(one := encode_embedding(r.node_id, r.embedding))
            digest.update(one)
            counts["embeddings"] += 1
    sums["embeddings.bin"] = f"sha256:{digest.hexdigest()}"
    (folder / "manifest.json").write_text(json.dumps({"parameters": asdict(p), "counts": counts, "checksums": sums}, sort_keys=True))


def encode_embedding(node_id: int, vector: list[float]) -> bytes:
    return np.uint64(node_id).astype("<u8").tobytes() + np.uint32(len(vector)).astype("<u4").tobytes() + np.asarray(vector, "<f4").tobytes()


def decode_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """node_id, embedding of the records (id u64, dimension u32, that many f32; little endian) of binary files."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                b, at, ids, vectors = content.as_py(), 0, [], []
                while at < len(b):
                    if at + 12 > len(b) or at + 12 + 4 * (n := int.from_bytes(b[at + 8 : at + 12], "little")) > len(b):
                        raise Codec("embeddings end inside a record")
                    ids.append(int.from_bytes(b[at : at + 8], "little"))
                    vectors.append(np.frombuffer(b, "<f4", n, at + 12))
                    at += 12 + 4 * n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], ["node_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "node_id bigint, embedding array<float>")


def read(spark: SparkSession, folder: str) -> PropertyGraph:
    """A fixture's graph, by Spark's readers with given schemas."""
    n = spark.read.schema("id bigint, type string, props struct<p_seq:bigint,p_cat:string,p_score:double>").json(f"{folder}/nodes.jsonl")
    e = spark.read.schema("id bigint, `from` bigint, `to` bigint, type string, weight float, props struct<p_seq:bigint>").json(f"{folder}/edges.jsonl")
    v = decode_embeddings(spark, f"{folder}/embeddings.bin")
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("int")
    nodes = n.join(v.withColumnRenamed("node_id", "id"), "id", "left").select(
        F.col("id").alias("node_id"), F.col("type").alias("node_type"), number("type").alias("type_id"),
        props(p_seq=tagged(INT, F.col("props.p_seq")), p_cat=tagged(STRING, F.col("props.p_cat")), p_score=tagged(DOUBLE, F.col("props.p_score"))).alias("props"), "embedding",
    )
    edges = e.select(F.col("id").alias("edge_id"), F.col("from").alias("src"), F.col("to").alias("dst"), F.col("type").alias("edge_type"), number("type").alias("etype_id"), "weight", props(p_seq=tagged(INT, F.col("props.p_seq"))).alias("props"))
    return PropertyGraph(nodes, edges)


def verify(folder: Path) -> None:
    """Raise Codec if a file of a local fixture differs from its checksum."""
    manifest = json.loads((folder / "manifest.json").read_text())
    for name, want in manifest["checksums"].items():
        with (folder / name).open("rb") as f:
            if f"sha256:{hashlib.file_digest(f, 'sha256').hexdigest()}" != want:
                raise Codec(f"{name} differs from its checksum")
