"""Weight updates as a stream: each micro-batch is folded per edge in order and committed as one version."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import EdgeNotFound, InvalidPropertyValue
from ..functions.scratch import materialize
from ..graph import PropertyGraph
from ..sources.storage import StoredGraph

UPDATE = "seq bigint, edge_id bigint, op string, operand float"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """edge_id, lost, __weight, ok of each edge, from rows in the order of edge and update. Sums and products are of 32 bits
    and so depend on the order; an edge's updates pass one by one, and only its weight is held."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.float32(), pa.bool_()))], ["edge_id", "lost", "__weight", "ok"])

    began, edge, lost, w, ok = False, None, False, np.float32(0), True
    with np.errstate(all="ignore"):
        for batch in batches:
            done = []
            operands = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float32)
            has = batch.column(3).is_valid().to_pylist()
            for e, start, op, x, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), operands, has, strict=True):
                if not began or e != edge:
                    if began:
                        done.append((edge, lost, w, ok))
                    began, edge, lost, w, ok = True, e, start is None, np.float32(start or 0.0), True
                w = x if op == "set" else w + x if op == "add" else w * x if op == "multiply" else np.float32("nan")
                ok = ok and known and bool(np.isfinite(w))
            yield out(done)
    if began:
        yield out([(edge, lost, w, ok)])


def apply_updates(g: PropertyGraph, updates: DataFrame) -> PropertyGraph:
    """Apply (seq, edge_id, op, operand) rows, op being set, add or multiply, to each edge in the order of seq.

    All or nothing: an unknown edge, an unknown op or a weight that is not finite on the way is an error.
    """
    g.writable()
    rows = updates.select("edge_id", "seq", "op", F.col("operand").cast("float").alias("operand"))
    rows = rows.join(g.edges.select("edge_id", "weight"), "edge_id", "left").repartition("edge_id").sortWithinPartitions("edge_id", "seq", "op", "operand")
    folded = rows.select("edge_id", "weight", "op", "operand").mapInArrow(_fold, "edge_id bigint, lost boolean, __weight float, ok boolean")
    folded = materialize(folded, "updates")
    bad = folded.filter("lost or not ok").orderBy("edge_id").first()
    if bad is not None:
        raise EdgeNotFound(str(bad.edge_id)) if bad.lost else InvalidPropertyValue(f"the weight of edge {bad.edge_id} would not be finite")
    edges = g.edges.join(folded.select("edge_id", "__weight"), "edge_id", "left").withColumn("weight", F.coalesce("__weight", "weight")).select(*g.edges.columns)
    return replace(g, edges=edges, pending=(*g.pending, ("apply_updates",)))


def ingest(stream: DataFrame, stored: StoredGraph, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Commit every micro-batch of a stream of updates to a stored graph. A batch's number is kept in the graph's manifest
    under the checkpoint's path, so a batch that is delivered again, also after a restart, changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        if stored.marks.get(checkpoint, -1) >= number or rows.isEmpty():
            return
        stored.commit(apply_updates(stored.graph, rows), mark=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
