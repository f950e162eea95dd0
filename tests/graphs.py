"""Small graphs for tests."""

from pyspark.sql import functions as F

from vectrail.config import GraphConfig
from vectrail.functions.scalars import PROPS, merge
from vectrail.graph import EDGES, NODES, PropertyGraph


def graph(spark, n_or_nodes, edges, config=GraphConfig(), dim=4):
    """Nodes: a count, or dicts of properties (with "_embedding" and "_type"); edges: (src, dst, type, weight)."""
    nodes = [{} for _ in range(n_or_nodes)] if isinstance(n_or_nodes, int) else n_or_nodes
    types = list(dict.fromkeys(["person", *(x.get("_type", "person") for x in nodes)]))
    kinds = list(dict.fromkeys(e[2] for e in edges))
    n = spark.createDataFrame([(i, x.get("_type", "person"), types.index(x.get("_type", "person")), None, x.get("_embedding")) for i, x in enumerate(nodes)], NODES)
    value = F.create_map().cast(PROPS)
    for i, x in enumerate(nodes):
        own = {k: v for k, v in x.items() if k[0] != "_"}
        if own:
            value = F.when(F.col("node_id") == i, merge(F.create_map().cast(PROPS), own, set())).otherwise(value)
    n = n.withColumn("props", value)
    e = spark.createDataFrame([(i, a, b, t, kinds.index(t), float(w), {}) for i, (a, b, t, w) in enumerate(edges)], EDGES)
    return PropertyGraph(n, e, {t: (i, dim if t == "person" else None) for i, t in enumerate(types)}, {t: i for i, t in enumerate(kinds)}, config, len(nodes), len(edges))


def ids(df, column="node_id"):
    return sorted(r[column] for r in df.collect())
