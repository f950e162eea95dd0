"""N-gram Jaccard join with prefix filters under several global token orders, and the classes it links.

A document's tokens are its distinct 5-word shingles. Documents with equal sets form a class at once. For sets x and y
with Jaccard similarity of at least t, the prefixes of x and y under ANY global order of tokens share a token, if the
prefix of a set of n tokens holds its n - ceil(t n) + 1 first. So a candidate has to share a prefix token under each
of several orders, and the filters are intersected before the exact check:

* order A: tokens by (frequency, hash), the SHARE of smallest hashes before all others, so that frequencies are needed
  (and shuffled) for these only,
* order B: by (frequency, hash) of all tokens, counted among the documents that order A leaves,
* order C: by hash alone.

A token that occurs once takes a place in the prefix and yields no candidate, which clears most documents; and since
it can't be shared, the other tokens of both documents must be enough for the similarity. Tokens that are frequent in
a bounded sample of documents rank last and skip the count's shuffle.

Links are found in rounds: in each, every class is checked against one pivot of its token groups (the most shared), so
the work is linear in a group of near copies; pairs inside one component need no further check. The first pivots have
the fewest tokens of their own, as the source of a group of copies has. A last round checks all remaining pairs that
share prefixes across components, so no link between components is lost. There, a group of texts that are nearly but not
quite near enough would give all its pairs; a parity bitmap of each set (every shared token flips one of 256 bits) bounds
the distance of two sets from below, and pairs that it shows to be too far are never made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, table, temporary
from .shingles import chunks, shingle_sets

K, PERCENT = 5, 80
#: Part of all tokens that the orders rank first.
SHARE = 0.28
#: Frequent tokens are looked for in at most about so many documents; it tunes the order, not the result.
SAMPLE_DOCS, FREQUENT = 4000, 40
ROUNDS = 2
#: Classes of a token's group that meet in one block of the last round.
GROUP = 2000
#: Longs of a parity bitmap, a power of two.
PARITY = 4


def _competing(tokens: np.ndarray, share: float) -> int:
    """How many of the sorted tokens compete for the prefix: those ranked first, and at least the prefix's number."""
    return max(int(np.searchsorted(tokens, np.uint64(int(share * 2**64)))) if share < 1 else len(tokens), prefix_size(len(tokens)))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _class_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (of equal sets; null if empty) and emitted (tokens that compete for the prefix)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, texts in chunks(batches):
            sets = shingle_sets(texts, K)
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[rows], pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([_competing(s, SHARE) if len(s) else 0 for s in sets], pa.int64()),
            ], ["doc_id", "n_shingles", "cls", "emitted"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, cls bigint, emitted bigint")


def frequent_tokens(docs: DataFrame, n_docs: int, share: float) -> dict[int, int]:
    """Tokens of at least FREQUENT documents of a sample of about SAMPLE_DOCS, with their counts; at most
    SAMPLE_DOCS * tokens / FREQUENT entries whatever the size of docs."""
    step = max(1, n_docs // SAMPLE_DOCS)
    sample = _texts(docs).filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(step)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in chunks(batches):
            tokens, counts = np.unique(np.concatenate([s[: _competing(s, share)] for s in shingle_sets(texts, K)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], ["tok", "n"])

    counts = sample.mapInArrow(run, "tok bigint, n bigint").groupBy("tok").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    return {r.tok: r.n for r in counts.orderBy(F.desc("n"), "tok").limit(100_000).collect()}


def competing(docs: DataFrame, frequent: dict[int, int], share: float) -> DataFrame:
    """(cls, tok, place, known): the tokens of each class that compete for its prefix, with their place by hash
    and, for frequent ones, a known frequency. Equal sets in one chunk are emitted once."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((np.array(sorted(np.uint64(k % 2**64) for k in frequent), np.uint64), frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = known.value
        for _, _, texts in chunks(batches):
            classes, tokens, places = [], [], []
            for c, s in {_class_id(s): s for s in shingle_sets(texts, K) if len(s)}.items():
                s = s[: _competing(s, share)]
                classes.append(np.full(len(s), c, np.int64))
                tokens.append(s)
                places.append(np.arange(len(s), dtype=np.int32))
            if classes:
                t = np.concatenate(tokens)
                at = np.zeros(len(t), np.int64)
                if len(common):
                    hit = np.flatnonzero(common[np.minimum(np.searchsorted(common, t), len(common) - 1)] == t)
                    at[hit] = [counts[x] for x in t[hit].view(np.int64).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(classes)), pa.array(t.view(np.int64)), pa.array(np.concatenate(places)), pa.array(at.astype(np.int32))], ["cls", "tok", "place", "known"])

    return _texts(docs).mapInArrow(run, "cls bigint, tok bigint, place int, known int")


def shared_tokens(docs: DataFrame, n_docs: int, share: float) -> DataFrame:
    """cls, t: its competing tokens that another class has too, as structs (freq, tok, place)."""
    rows = competing(docs, frequent_tokens(docs, n_docs, share), share)
    rows = rows.withColumn("key", F.when(F.col("known") > 0, F.xxhash64("cls")).otherwise(F.col("tok"))).repartition("key")
    rows = rows.groupBy("key", "tok", "cls").agg(F.min("place").alias("place"), F.max("known").alias("known"))
    count = F.count("*").over(Window.partitionBy("key"))
    rows = rows.withColumn("freq", F.when(F.col("known") > 0, F.col("known").cast("long") + 2**40).otherwise(count)).filter("freq >= 2")
    return rows.groupBy("cls").agg(F.collect_list(F.struct("freq", "tok", "place")).alias("t"))


#: prefix_size in SQL.
_SIZE = f"n_shingles - (({PERCENT} * n_shingles + 99) div 100) + 1"


def _rarest(t: str, need: str) -> Column:
    return F.transform(F.slice(F.array_sort(F.transform(t, lambda x: F.struct(x["freq"], x["tok"].alias("tok")))), F.lit(1), F.col(need).cast("int")), lambda y: y["tok"])


def parity(t: str) -> Column:
    """struct of PARITY longs, in which each token of t flips the bit that its low bits name."""
    flip = "shiftleft(1L, cast(x.tok & 63 AS int))"
    return F.struct(*[F.expr(f"aggregate({t}, 0L, (a, x) -> a ^ if(shiftright(x.tok, 6) & {PARITY - 1} = {i}, {flip}, 0L))").alias(f"p{i}") for i in range(PARITY)])


def apart(one: str, two: str) -> Column:
    """At least so many tokens are in one of two sets only, by their parity bitmaps."""
    return sum((F.bit_count(F.col(f"{one}.p{i}").bitwiseXOR(F.col(f"{two}.p{i}"))) for i in range(PARITY)), F.lit(0))


def class_texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(cls, doc_id, text): one text of each class of named (cls, doc_id), found by its doc_id and then by its set, since
    rows may share a doc_id or have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column(0).to_pylist()
            for at in range(0, len(cls), 256):
                part = batch.slice(at, 256)
                own = [_class_id(s) if len(s) else None for s in shingle_sets([t or b"" for t in part.column(2).to_pylist()], K)]
                yield part.filter(pa.array([c is None or c == o for c, o in zip(cls[at : at + 256], own, strict=True)])).set_column(0, "cls", pa.array([o for c, o in zip(cls[at : at + 256], own, strict=True) if c is None or c == o], pa.int64()))

    schema, t = "cls bigint, doc_id bigint, text binary", _texts(docs)
    by_id = t.join(named.filter("doc_id is not null"), "doc_id").select("cls", "doc_id", "text").mapInArrow(run, schema)
    nameless = t.filter("doc_id is null").select(F.lit(None).cast("bigint").alias("cls"), F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
    nameless = nameless.dropDuplicates(["cls"]).join(named.filter("doc_id is null").select("cls"), "cls", "left_semi")
    return by_id.dropDuplicates(["cls"]).unionByName(nameless)


def prefixes(docs: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, sets) of the classes that can have partners: cls, n_shingles, own (tokens of no other class), parity
    (bitmap of the other tokens) and the prefixes a, b, c under the three orders, without tokens of one class only; and
    cls, doc_id, text."""
    classes = info.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("emitted").alias("emitted"))
    p = shared_tokens(docs, info.count(), SHARE).join(classes, "cls").withColumn("size", F.expr(_SIZE))
    p = p.withColumn("need", F.col("size") - (F.col("emitted") - F.size("t"))).filter("need > 0")
    c = F.transform(F.filter("t", lambda x: x["place"] < F.col("size")), lambda x: x["tok"])
    p = materialize(p.select("cls", "doc_id", "n_shingles", _rarest("t", "need").alias("a"), c.alias("c")), "prefixes")
    sets = materialize(class_texts(docs, p.select("cls", "doc_id")), "sets")
    q = shared_tokens(sets, p.count(), 1.0).join(p, "cls").withColumn("own", F.col("n_shingles") - F.size("t"))
    q = q.withColumn("need", F.expr(_SIZE) - F.col("own")).filter("need > 0")
    return materialize(q.select("cls", "n_shingles", "own", parity("t").alias("parity"), "a", _rarest("t", "need").alias("b"), "c"), "prefixes"), sets


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) of classes with 100 * intersection >= PERCENT * union, from sets (cls, text)."""
    one = sets.select(F.col("cls").alias("x"), F.col("text").alias("tx"))
    two = sets.select(F.col("cls").alias("y"), F.col("text").alias("ty"))
    both = pairs.join(one, "x").join(two, "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            keep = []
            for at in range(0, batch.num_rows, 256):
                a, b = (shingle_sets([t or b"" for t in batch.column(c)[at : at + 256].to_pylist()], K) for c in (2, 3))
                for i, (p, q) in enumerate(zip(a, b, strict=True)):
                    shared = len(p) + len(q) - len(np.union1d(p, q))
                    if 100 * shared >= PERCENT * (len(p) + len(q) - shared):
                        keep.append(at + i)
            yield pa.RecordBatch.from_arrays([x.take(pa.array(keep, pa.int64())), y.take(pa.array(keep, pa.int64()))], ["x", "y"])

    return both.mapInArrow(run, "x bigint, y bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in links (x, y), comp the smallest id that it reaches: components take the label of
    their smallest neighbour, labels of labels are followed once, until no link joins two labels."""
    both = links.select("x", "y").union(links.select("y", "x"))
    labels = materialize(both.select(F.col("x").alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while True:
        at = lambda side: labels.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
        across = both.join(at("x"), "x").join(at("y"), "y").filter("cx <> cy").groupBy("cx").agg(F.min("cy").alias("near"))
        step = materialize(across.select(F.col("cx").alias("comp"), F.least("cx", "near").alias("up")), "labels")
        if step.isEmpty():
            return labels
        above = step.select(F.col("comp").alias("up"), F.col("up").alias("top"))
        step = step.join(above, "up", "left").select("comp", F.coalesce("top", "up").alias("up"))
        labels = materialize(labels.join(step, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), "labels")


def linked_classes(docs: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, links): the components of classes that links join, and the verified links (x, y)."""
    p, sets = prefixes(docs, info)
    filters = p.select("cls", "a", "c")
    x = filters.select(F.col("cls").alias("x"), F.col("a").alias("ax"), F.col("c").alias("cx"))
    y = filters.select(F.col("cls").alias("y"), F.col("a").alias("ay"), F.col("c").alias("cy"))

    def intersected(pairs: DataFrame) -> DataFrame:
        """Pairs that also share prefix tokens under the orders A and C."""
        q = pairs.join(x, "x").join(y, "y")
        return q.filter(F.arrays_overlap("ax", "ay") & F.arrays_overlap("cx", "cy")).drop("ax", "ay", "cx", "cy")

    def possible(n: str, own: str, m: str, other: str) -> Column:
        """Whether the tokens that two classes may share are enough for the similarity."""
        most = F.least(F.col(n) - F.col(own), F.col(m) - F.col(other))
        return (100 + PERCENT) * most >= PERCENT * (F.col(n) + F.col(m))

    # the tokens that are not in both: those of one class only, and those that the bitmaps tell apart
    total = F.col("n_shingles") + F.col("kn")
    near = (100 + PERCENT) * (total - F.col("own") - F.col("ko") - apart("parity", "kp")) >= 2 * PERCENT * total
    spark = docs.sparkSession
    links = spark.createDataFrame([], "x bigint, y bigint")
    labels = spark.createDataFrame([], "id bigint, comp bigint")
    tested = links
    for r in [*range(ROUNDS), None]:
        known = ["cls", "n_shingles", "own", *["parity"] * (r is None)]
        named = p.join(labels, p.cls == labels.id, "left").select(*known, F.coalesce("comp", "cls").alias("comp"), F.explode("b").alias("tok"))
        first = F.struct(F.col("own") / F.col("n_shingles") if r == 0 else F.lit(0.0), F.xxhash64("cls", F.lit(r or 0)))
        groups = named.groupBy("tok").agg(F.min_by(F.struct("cls", "comp", "n_shingles", "own"), first).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
        # written, so that the join is of plain shuffles (or a broadcast), whose hot tokens are split at run time
        groups = materialize(groups.filter("lo <> hi").select("tok", "p", F.expr(f"cast((n + {GROUP - 1}) div {GROUP} as int)").alias("blocks")), "groups")
        outside = named.join(groups, "tok").filter(F.col("comp") != F.col("p.comp"))
        if r is None:  # all pairs of a token's group across components, one side outside the pivot's
            # a large group is cut into blocks of about GROUP classes, each of which meets all classes outside
            one = outside.select("tok", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("cls").alias("k"), F.col("comp").alias("kc"), F.col("n_shingles").alias("kn"), F.col("own").alias("ko"), F.col("parity").alias("kp"))
            dealt = named.join(groups.select("tok", "blocks"), "tok").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(9)), F.col("blocks")).cast("int"))
            pairs = one.join(dealt, ["tok", "block"]).filter((F.col("comp") != F.col("kc")) & possible("n_shingles", "own", "kn", "ko") & near)
            pairs = pairs.select(F.least("k", "cls").alias("x"), F.greatest("k", "cls").alias("y")).distinct()
            pairs = intersected(pairs.join(tested, ["x", "y"], "left_anti"))
        else:
            votes = outside.filter(possible("n_shingles", "own", "p.n_shingles", "p.own")).groupBy("cls", F.col("p.cls").alias("p")).agg(F.count("*").alias("votes"))
            pairs = intersected(votes.select(F.least("cls", "p").alias("x"), F.greatest("cls", "p").alias("y"), "cls", "votes"))
            if r:
                pairs = pairs.join(tested, ["x", "y"], "left_anti")
            pairs = pairs.groupBy("cls").agg(F.max(F.struct("votes", "x", "y")).alias("best")).select("best.x", "best.y").distinct()
        pairs = materialize(pairs, "pairs")
        found = materialize(verify(pairs, sets), "links")
        links, tested = links.union(found), tested.union(pairs)
        labels = components(links)
    return labels, links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Null and blank texts have no shingles and form their own components. component_id is the smallest doc_id that
    links reach. Rows with null doc_id are linked like others and take the smallest doc_id of their class, or null. Repeated
    rows are each returned, and rows that share a doc_id or have none are compared by their own texts. Documents that tie are
    named by the smallest doc_id. Very long texts are one set each; other columns are ignored. An empty table gives an empty result.
    """
    with temporary(docs.sparkSession):
        info = materialize(describe(docs), "info")
        labels, _ = linked_classes(docs, info)
        c = info.join(labels, info.cls == labels.id, "left").select("doc_id", "n_shingles", F.coalesce("comp", "cls").alias("comp"))
        c = materialize(c, "classes", keep=True)
    # a document alone in its component names it; the others' names are written, so that a component with very many
    # documents is split where they are joined, or the names are sent to all tasks if few
    least = c.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return c.join(materialize(least, "names", keep=True), "comp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each component: of the smallest doc_id, rows without one last, then by row.

    Rows are told apart by a number of their own, so null and repeated doc_ids lose nothing and keep no copies. Rows
    without shingles are components of their own and all stay. All columns pass through; an empty table stays empty.
    """
    rows = numbered(docs, "rows")
    near = materialize(near_duplicates(rows.select(F.col("row_id").alias("doc_id"), F.col("row.text").alias("text"))), "near")
    groups = near.filter("doc_id <> component_id").select("component_id").distinct()
    ids = rows.select("row_id", F.col("row.doc_id").alias("name"))
    some = near.join(materialize(groups, "groups"), "component_id", "left_semi").join(ids, F.col("doc_id") == F.col("row_id"))
    first = some.groupBy("component_id").agg(F.min(F.struct(F.col("name").isNull(), F.col("name"), F.col("row_id"))).alias("m")).select(F.col("m.row_id").alias("kept"))
    gone = materialize(some.select("row_id").join(materialize(first, "kept"), F.col("row_id") == F.col("kept"), "left_anti"), "gone")
    out = rows.join(gone, "row_id", "left_anti").select("row.*")
    return out


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: CTE ``near`` over a relation ``docs`` (doc_id, text) with distinct doc_ids.
NEAR_SQL = """
n0 AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM docs),
n1 AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM n0),
n2 AS (SELECT doc_id, count(*) AS n FROM n1 GROUP BY doc_id),
n3 AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM n1 a JOIN n1 b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
n4 AS (SELECT x, y FROM n3 JOIN n2 p ON p.doc_id = x JOIN n2 q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
n5(doc_id, reach) AS (SELECT doc_id, doc_id FROM docs UNION SELECT n5.doc_id, n4.y FROM n5 JOIN n4 ON n5.reach = n4.x),
near AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM docs d LEFT JOIN n2 USING (doc_id)
  JOIN (SELECT doc_id, min(reach) AS component_id FROM n5 GROUP BY 1) USING (doc_id))"""

OP10_SQL = f"WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {NEAR_SQL} SELECT * FROM near"
