"""The star-schema tables as a property graph.

Node ids are type id * 10 ** 9 + key; edge ids are edge type id * 10 ** 16 + a key computed from key columns, so
no row has to know about others. All columns stay lazy: a property predicate on one type reads one table's column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GraphConfig
from ..functions.scalars import DOUBLE, INT, STRING, props, tagged
from ..graph import EDGES, NODES, Lookup, PropertyGraph

NODE_BASE, EDGE_BASE = 10**9, 10**16
VECTOR_DIM = 64
#: Given, so that opening a table needs no job for its footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
#: label -> (table, key, {property: tag})
NODE_TABLES = {
    "region": ("region", "r_regionkey", {"r_name": STRING}),
    "nation": ("nation", "n_nationkey", {"n_name": STRING}),
    "customer": ("customer", "c_custkey", {"c_name": STRING, "c_acctbal": DOUBLE, "c_mktsegment": STRING}),
    "supplier": ("supplier", "s_suppkey", {"s_name": STRING, "s_acctbal": DOUBLE}),
    "part": ("part", "p_partkey", {"p_name": STRING, "p_brand": STRING, "p_type": STRING, "p_size": INT, "p_retailprice": DOUBLE}),
    "orders": ("orders", "o_orderkey", {"o_orderstatus": STRING, "o_totalprice": DOUBLE, "o_orderpriority": STRING}),
    "vec": ("embeddings", "vec_id", {"label": INT}),
}
#: label -> (table, source label, source column, target label, target column, weight, key)
LINE_KEY = "((l_orderkey * 8 + l_linenumber) * 131072 + l_partkey) * 1024 + l_suppkey"
EDGE_TABLES = {
    "in_region": ("nation", "nation", "n_nationkey", "region", "n_regionkey", "1.0", "n_nationkey"),
    "cust_nation": ("customer", "customer", "c_custkey", "nation", "c_nationkey", "1.0", "c_custkey"),
    "supp_nation": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "1.0", "s_suppkey"),
    "placed": ("orders", "customer", "o_custkey", "orders", "o_orderkey", "o_totalprice", "o_orderkey"),
    "contains": ("lineitem", "orders", "l_orderkey", "part", "l_partkey", "l_discount", LINE_KEY),
    "supplied_by": ("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "l_quantity", LINE_KEY),
}


def _id(label: str, key: str) -> Column:
    return F.col(key).cast("long") + list(NODE_TABLES).index(label) * NODE_BASE


def _line_keys(keys: list[int]) -> Column:
    """The condition for LINE_KEY values, on the columns that they are made of."""
    out = F.lit(False)
    for k in keys:
        rest, supplier = divmod(k, 1024)
        rest, part = divmod(rest, 131072)
        order, line = divmod(rest, 8)
        out = out | ((F.col("l_orderkey") == order) & (F.col("l_linenumber") == line) & (F.col("l_partkey") == part) & (F.col("l_suppkey") == supplier))
    return out


def load(spark: SparkSession, sf_dir: str, config: GraphConfig = GraphConfig()) -> PropertyGraph:
    """The graph of the tables under sf_dir. Lookups by id turn into comparisons of key columns, on the tables that can
    hold the ids."""
    read = lambda t: spark.read.schema(SCHEMAS[t]).parquet(f"{sf_dir}/{t}.parquet")
    labels, kinds = list(NODE_TABLES), list(EDGE_TABLES)

    def nodes_of(label: str, d: DataFrame) -> DataFrame:
        _, key, columns = NODE_TABLES[label]
        vector = F.col("embedding").cast("array<float>") if label == "vec" else F.lit(None).cast("array<float>")
        return d.select(
            _id(label, key).alias("node_id"), F.lit(label).alias("node_type"), F.lit(labels.index(label)).alias("type_id"),
            props(**{c: tagged(tag, F.col(c)) for c, tag in columns.items()}).alias("props"), vector.alias("embedding"),
        )

    def edges_of(label: str, d: DataFrame) -> DataFrame:
        _, a, src, b, dst, weight, key = EDGE_TABLES[label]
        return d.select(
            (F.expr(key).cast("long") + kinds.index(label) * EDGE_BASE).alias("edge_id"), _id(a, src).alias("src"), _id(b, dst).alias("dst"), F.lit(label).alias("edge_type"),
            F.lit(kinds.index(label)).alias("etype_id"), F.expr(weight).cast("float").alias("weight"), props().alias("props"),
        )

    def union(parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)

    def own(ids: Sequence[int], i: int, base: int) -> list[int]:
        return [x - i * base for x in ids if x // base == i]

    def nodes_with(ids: Sequence[int]) -> DataFrame:
        return union([nodes_of(x, read(NODE_TABLES[x][0]).filter(F.col(NODE_TABLES[x][1]).isin(*keys))) for i, x in enumerate(labels) if (keys := own(ids, i, NODE_BASE))], NODES)

    def edges_with(ids: Sequence[int]) -> DataFrame:
        parts = []
        for i, x in enumerate(kinds):
            if keys := own(ids, i, EDGE_BASE):
                key = EDGE_TABLES[x][6]
                parts.append(edges_of(x, read(EDGE_TABLES[x][0]).filter(_line_keys(keys) if key == LINE_KEY else F.col(key).isin(*keys))))
        return union(parts, EDGES)

    def edges_at(ids: Sequence[int], end: str) -> DataFrame:
        parts = []
        for x in kinds:
            label, column = EDGE_TABLES[x][1:3] if end == "src" else EDGE_TABLES[x][3:5]
            if keys := own(ids, labels.index(label), NODE_BASE):
                parts.append(edges_of(x, read(EDGE_TABLES[x][0]).filter(F.col(column).isin(*keys))))
        return union(parts, EDGES)

    nodes = union([nodes_of(x, read(NODE_TABLES[x][0])) for x in labels], NODES)
    edges = union([edges_of(x, read(EDGE_TABLES[x][0])) for x in kinds], EDGES)
    types = {label: (i, VECTOR_DIM if label == "vec" else None) for i, label in enumerate(labels)}
    lookup = Lookup(nodes, edges, nodes_with, edges_with, edges_at)
    return PropertyGraph(nodes, edges, types, {label: i for i, label in enumerate(kinds)}, config, len(labels) * NODE_BASE, len(kinds) * EDGE_BASE, lookup=lookup)
