"""Vector scores in 32-bit arithmetic, folded in order, so that results are the same bits everywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean")

def fold(vector: np.ndarray) -> np.float32:
    total = np.float32(0)
    for x in vector:
        total = np.float32(total + x)
    return total


def _float(x) -> Column:
    return F.lit(float(x)).cast("float")


def score(embedding: Column, query: list[float], metric: str) -> Column:
    """Score of an embedding of the query's dimension. Not finite scores become the worst of the metric."""
    q = np.asarray(query, np.float32)
    other = F.array(*[_float(x) for x in q])
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(embedding, other, lambda a, b: a * b), _float(0), add)
    own = F.aggregate(F.transform(embedding, lambda a: a * a), _float(0), add)
    far = F.aggregate(F.zip_with(embedding, other, lambda a, b: (a - b) * (a - b)), _float(0), add)
    if metric == "dot":
        s = dot
    elif metric == "euclidean":
        s = F.sqrt(far).cast("float")
    else:
        mine, norm = F.sqrt(own).cast("float"), np.float32(np.sqrt(fold(q * q)))
        s = _float(0) if norm == 0 else F.when(mine == 0, _float(0)).otherwise((dot / (mine * _float(norm))).cast("float"))
    worst = float("inf") if metric == "euclidean" else float("-inf")
    return F.when(F.isnan(s) | (F.abs(s) == float("inf")), _float(worst)).otherwise(s)


def score_rows(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores (rows, queries) of 32-bit vectors: the same fold as ``score``, one dimension at a time for all rows."""
    out = np.zeros((len(rows), len(queries)), np.float32)
    with np.errstate(all="ignore"):
        for j in range(rows.shape[1]):
            a, b = rows[:, j : j + 1], queries[None, :, j]
            out += (a - b) * (a - b) if metric == "euclidean" else a * b
        if metric == "euclidean":
            out = np.sqrt(out)
        elif metric == "cosine":
            norms = [np.zeros(len(x), np.float32) for x in (rows, queries)]
            for j in range(rows.shape[1]):
                norms[0] += rows[:, j] * rows[:, j]
                norms[1] += queries[:, j] * queries[:, j]
            both = np.sqrt(norms[0])[:, None] * np.sqrt(norms[1])[None, :]
            out = np.where((norms[0] == 0)[:, None] | (norms[1] == 0)[None, :], np.float32(0), out / both)
    return np.where(np.isfinite(out), out, np.float32(np.inf if metric == "euclidean" else -np.inf)).astype(np.float32)
