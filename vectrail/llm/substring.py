"""Removal of long repeated word spans by compaction of a de Bruijn graph of word k-mers.

The graph's edges are windows of WINDOW words; its paths are texts.

1. Runs: consecutive windows with one minimizer (their K-word part of smallest hash) travel together to its node, with a
   hash of each. There, windows that also start earlier are found, and runs of them that follow each other in both places
   are the repeated edges' occurrences: (doc, pos, n windows, first_doc, first_pos). A run's name is its first coordinates
   and n; equal names are one stretch of the graph. A node that a bounded sample shows to be frequent is split: its windows
   travel one by one, by their own hash.
2. Degrees: how often each stretch occurs, and how often it is followed by which. Where a stretch is always followed by the
   same one, which always follows it, and both go on in the first place too, the path between them does not branch.
3. Nonbranching stretches compact into paths by joins: every stretch points to the one before it, and pointers are
   followed twice as far in each round, until all point to the head of their path.
4. Every occurrence of a head is a span of its whole path. Spans that follow each other are joined, and each is verified by
   joining both source coordinates to the texts and comparing digests of the words themselves, before words are removed.

Hot passages shrink before the shuffle: windows that repeat inside one chunk of texts are linked there, and only a
chunk's first occurrence goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, temporary
from .shingles import Words, chunks, mix

WINDOW, K = 20, 5
#: Nodes of at least this many of about SAMPLE_DOCS documents are split; it tunes the work, not the result.
SAMPLE_DOCS, FREQUENT = 2000, 20
_PIECE = "key bigint, doc bigint, pos int, n int, first_doc bigint, first_pos int, hashes binary"
_LINK = "doc bigint, pos int, n int, first_doc bigint, first_pos int"


def _spans(doc, pos, fdoc, fpos) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of windows that follow each other in both places."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (fdoc[1:] != fdoc[:-1]) | (fpos[1:] != fpos[:-1] + 1)
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return starts, np.diff(np.append(starts, len(doc)))


def _nodes(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word that starts each window's minimizer, and the hashes of the K words from each word on."""
    k_at, k_hash = w.windows(K)
    kmers = np.full(len(w.hash), np.iinfo(np.uint64).max, np.uint64)
    kmers[k_at] = k_hash
    return at + np.lib.stride_tricks.sliding_window_view(kmers, WINDOW - K + 1)[at].argmin(axis=1), kmers


def frequent_nodes(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Hashes of the nodes of at least FREQUENT documents of a sample of about SAMPLE_DOCS."""
    sample = docs.filter(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in chunks(batches):
            w = Words(texts)
            at, _ = w.windows(WINDOW)
            if len(at):
                node, kmers = _nodes(w, at)
                once = np.unique(np.stack([w.doc[at].astype(np.uint64), kmers[node]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(once[1].view(np.int64))], ["node"])

    counts = sample.mapInArrow(run, "node bigint").groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(np.array([r.node for r in counts.orderBy(F.desc("n"), "node").limit(100_000).collect()], np.int64).view(np.uint64))


def pieces(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Runs of windows, keyed by their node, or single windows of frequent nodes, keyed by their hash; and links of windows
    repeated within a chunk.

    A run has the 8-byte hashes of its windows; a link has none, but the coordinates of its chunk's first occurrence, and a
    key that spreads it.
    """
    often = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, texts in chunks(batches):
            ids = np.array(batch.column(0)[rows].to_pylist(), np.int64)
            order = np.argsort(ids, kind="stable")
            ids, w = ids[order], Words([texts[i] for i in order])
            at, whole = w.windows(WINDOW)
            if not len(at):
                continue
            node, kmers = _nodes(w, at)
            hot = np.isin(kmers[node], often.value)
            doc, pos = ids[w.doc[at]], w.pos[at]
            # windows that the chunk holds before, in coordinate order
            by = np.argsort(whole, kind="stable")
            same = np.concatenate([[False], whole[by][1:] == whole[by][:-1]])
            first = np.empty(len(by), np.int64)
            first[by] = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
            again = (doc != doc[first]) | (pos != pos[first])
            s = np.flatnonzero(again)
            a, n = _spans(doc[s], pos[s], doc[first[s]], pos[first[s]])
            a = s[a] if len(a) else a
            links = [mix(a.astype(np.uint64) + whole[a]).view(np.int64), doc[a], pos[a], n, doc[first[a]], pos[first[a]]]
            u = np.flatnonzero(first == np.arange(len(by)))
            cut = np.concatenate([[True], (node[u][1:] != node[u][:-1]) | (u[1:] != u[:-1] + 1) | (doc[u][1:] != doc[u][:-1]) | hot[u][1:]]) if len(u) else np.zeros(0, bool)
            b = np.flatnonzero(cut)
            size = np.diff(np.append(b, len(u)))
            h = whole[u]
            p = u[b]
            m, zero = len(p), np.zeros(len(p), np.int64)
            data = [np.concatenate([x, y]) for x, y in zip([np.where(hot[p], whole[p], kmers[node[p]]).view(np.int64), doc[p], pos[p], size, zero, zero], links, strict=True)]
            offsets = np.concatenate([[0], np.cumsum(size) * 8, np.full(len(a), len(h) * 8)]).astype(np.int32)
            valid = np.packbits(np.arange(m + len(a)) < m, bitorder="little")
            blobs = pa.Array.from_buffers(pa.binary(), m + len(a), [pa.py_buffer(valid.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(h.tobytes())])
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(data, types, strict=True)], blobs], ["key", "doc", "pos", "n", "first_doc", "first_pos", "hashes"])

    return docs.mapInArrow(run, _PIECE)


def meet(parts: DataFrame) -> DataFrame:
    """Links (doc, pos, n windows, first_doc, first_pos) of the pieces that meet at their nodes, and the given ones.

    Batches stream in order of node and coordinates; of earlier batches only the windows of the current node are kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, {}  # of the node that may go on in the next batch: window -> first coordinates
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, pos, n, fdoc, fpos = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            known = batch.column(6).is_null().to_numpy(zero_copy_only=False)
            out = [[x[known]] for x in (doc, pos, n, fdoc, fpos)]
            r = np.flatnonzero(~known)
            if len(r):
                h = np.frombuffer(b"".join(batch.column(6).take(pa.array(r)).to_pylist()), np.uint64)
                row = np.repeat(r, n[r])
                d, p = doc[row], pos[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[r]) - n[r], n[r])
                whole = mix(key[row].view(np.uint64)) ^ h  # equal windows have equal nodes
                by = np.argsort(whole, kind="stable")
                same = np.concatenate([[False], whole[by][1:] == whole[by][:-1]])
                first = np.empty(len(by), np.int64)
                first[by] = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
                fd, fp = d[first], p[first]
                if seen and key[r[0]] == last:
                    for i in np.flatnonzero(key[row] == last):
                        if (was := seen.get(int(h[i]))) is not None:
                            fd[i], fp[i] = was
                if key[r[-1]] != last:
                    last, seen = key[r[-1]], {}
                for i in np.flatnonzero(key[row] == last):
                    seen.setdefault(int(h[i]), (d[i], p[i]))
                s = np.flatnonzero((d != fd) | (p != fp))
                a, size = _spans(d[s], p[s], fd[s], fp[s])
                a = s[a] if len(a) else a
                for x, y in zip(out, (d[a], p[a], size, fd[a], fp[a]), strict=True):
                    x.append(y)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t.to_pandas_dtype())) for x, t in zip(out, types, strict=True)], ["doc", "pos", "n", "first_doc", "first_pos"])

    return parts.repartition("key").sortWithinPartitions("key", "doc", "pos").mapInArrow(run, _LINK)


_NAME = ("first_doc", "first_pos", "n")


def paths(links: DataFrame) -> DataFrame:
    """(first_doc, first_pos, n, windows) of the stretches on paths of several that don't branch: for a path's head the
    windows of the whole path, for the others null."""
    occurs = materialize(links.groupBy(*_NAME).agg(F.count("*").alias("times")), "stretches")
    ends = ["doc", "pos", "first_doc", "first_pos"]
    this = links.select("doc", F.col("pos") + F.col("n"), "first_doc", F.col("first_pos") + F.col("n"), "first_pos", "n").toDF(*ends, "from", "size")
    follows = this.join(links, ends).groupBy("first_doc", "from", "size", "first_pos", "n").agg(F.count("*").alias("times"))
    before = occurs.select("first_doc", F.col("first_pos").alias("from"), F.col("n").alias("size"), "times")
    only = follows.join(before, ["first_doc", "from", "size", "times"]).join(occurs, [*_NAME, "times"])  # all of both
    chain = only.select(F.struct(*_NAME).alias("node"), F.struct("first_doc", F.col("from").alias("first_pos"), F.col("size").alias("n")).alias("head"), F.lit(True).alias("moved"))
    chain = materialize(chain, "chain")
    while not chain.filter("moved").isEmpty():  # head: the stretch 1, 2, 4 ... before this one, as far as there is one
        further = chain.select(F.col("node").alias("head"), F.col("head").alias("further"))
        chain = materialize(chain.join(further, "head", "left").select("node", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("moved")), "chain")
    heads = chain.groupBy("head").agg(F.sum("node.n").alias("rest")).select("head.*", (F.col("head.n") + F.col("rest")).cast("int").alias("windows"))
    return materialize(heads.unionByName(chain.select("node.*", F.lit(None).cast("int").alias("windows"))), "paths")


def compact(links: DataFrame) -> DataFrame:
    """Spans (doc, pos, len, first_doc, first_pos): every occurrence of a path that doesn't branch as a whole, and spans
    that follow each other in both places joined."""
    on_path = paths(links).withColumn("on_path", F.lit(True))
    x = links.join(on_path, list(_NAME), "left").filter("on_path is null or windows is not null")  # others are in their head's span
    return joined(x.select("doc", "pos", F.coalesce("windows", "n").alias("n"), "first_doc", "first_pos"))


def joined(x: DataFrame) -> DataFrame:
    """Spans of a document that follow each other in both places, as one."""
    w = Window.partitionBy("doc", "first_doc", "shift").orderBy("pos")
    end = F.max(F.col("pos") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("shift", F.col("first_pos") - F.col("pos")).withColumn("new", (F.coalesce(end, F.lit(-1)) < F.col("pos")).cast("int"))
    x = x.withColumn("span", F.sum("new").over(w))
    g = x.groupBy("doc", "first_doc", "shift", "span").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("n")).alias("end"))
    words_ = (F.col("end") - F.col("pos") + WINDOW - 1).cast("int")
    return g.select("doc", F.col("pos").cast("int").alias("pos"), words_.alias("len"), "first_doc", (F.col("pos") + F.col("shift")).cast("int").alias("first_pos"))


def verify(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words are the same at both source coordinates: (doc, pos, len)."""
    ends = spans.select("doc", "pos", "len").union(spans.select("first_doc", "first_pos", "len")).distinct()
    asked = ends.groupBy("doc").agg(F.collect_list(F.struct("pos", "len")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, asks in zip(*(batch.column(c) for c in range(3)), strict=True):
                words, asks = (text.as_py() or b"").split(), asks.as_py()
                digests = [hashlib.blake2b(b" ".join(words[x["pos"] : x["pos"] + x["len"]]), digest_size=16).digest() for x in asks]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc.as_py()] * len(asks), pa.int64()), pa.array([x["pos"] for x in asks], pa.int32()), pa.array([x["len"] for x in asks], pa.int32()), pa.array(digests, pa.binary()),
                ], ["doc", "pos", "len", "digest"])

    read = materialize(docs.join(asked, "doc").mapInArrow(run, "doc bigint, pos int, len int, digest binary").dropDuplicates(["doc", "pos", "len"]), "digests")
    other = read.select(F.col("doc").alias("first_doc"), F.col("pos").alias("first_pos"), "len", F.col("digest").alias("first_digest"))
    return spans.join(read, ["doc", "pos", "len"]).join(other, ["first_doc", "first_pos", "len"]).filter("digest = first_digest").select("doc", "pos", "len")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of docs (doc_id, text): without each word that a repeated
    window of WINDOW words covers, unless the window is its sequence's first (smallest doc_id, then position).

    doc_id names one text: repeated rows have equal results. Rows with null doc_id have no coordinates and keep all
    their words. Null texts have no words; kept_text is then empty. Very long texts are read whole, a chunk each; other columns
    are ignored. An empty table gives an empty result.
    """
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("text"))
    frequent = frequent_nodes(texts, docs.count())
    with temporary(docs.sparkSession):
        spans = materialize(compact(materialize(meet(pieces(texts, frequent)), "links")), "spans", keep=True)
    cuts = verify(texts, spans).groupBy(F.col("doc").alias("cut_doc")).agg(F.collect_list(F.struct("pos", "len")).alias("cuts"))
    all_ = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cuts_ in zip(batch.column(1), batch.column(2), strict=True):
                words, kept = (text.as_py() or b"").split(), None
                if cuts_.is_valid:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for x in cuts_.as_py():
                        drop[x["pos"]] += 1
                        drop[x["pos"] + x["len"]] -= 1
                    kept = [x for x, d in zip(words, np.cumsum(drop)[:-1] > 0, strict=True) if not d]
                kept = words if kept is None else kept
                rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n, gone, out = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    kept = all_.join(cuts, all_.doc_id == cuts.cut_doc, "left").select("doc_id", "text", "cuts").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
    return kept.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def op8_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS h FROM w WHERE len(w) >= 20),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM r) GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
  FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
