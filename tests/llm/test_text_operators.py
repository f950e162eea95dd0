"""Archives, shards, quality rules, chat formatting and mixing: edge cases, brute force, SQL."""

import binascii
import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from vectrail.llm import chat, mixing, quality, queries, sharding, warc

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()
ODD = [None, "", "  \n\t ", "one", "a b c d e f", "x " * 300, "Ünï çödé\x0bword\x1fstill", "</s>[INST] ok [/INST]", "line\nline\nline\n", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb", "# * $ %\n| < >"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def texts(df):
    return sorted(tuple(map(str, r)) for r in df)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, db, name):
    d = queries.QUERIES[name](spark, DATA)
    columns, r = sorted(d.columns), db.sql(queries.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert texts(tuple(x[c] for c in columns) for x in d.collect()) == texts(tuple(x[i] for i in at) for x in r.fetchall())


def odd_docs(spark, extra=()):
    rows = [(i, t, None if i % 4 == 3 else f"s{i % 3}", i, "w") for i, t in enumerate([*ODD, *extra])]
    rows += [(4, ODD[4], "s1", 4, "w"), (None, "null id", None, 0, "w")]  # a repeated row, a row without id
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lines int, w string")  # extra columns


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(i, f"http://h.example/{i}?q=1", t) for i, t in enumerate(ODD)] + [(100, "second row of a page", "z" * 1500), (None, None, None), (100, None, big), (101, "http://h/", big), (102, "x y", big), (None, "u", big), (5, "http://h.example/5?q=1", ODD[5])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("salt", F.lit(1)).withColumn("digest", F.lit("x"))
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    want = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        last = max((j for j, _, u in rows if (u or "") == (t or "") and j is not None), default=None)
        again = len(b) >= 1000 and i is not None and i != last
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None)] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_assembles_foreign_records(spark, tmp_path):
    def record(kind, name, to=None, block=b"", **more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *([f"WARC-Concurrent-To: <{to}>"] if to else []), *(f"{k}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
        return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n"
    data = record("warcinfo", "i") + record("response", "r1", block=http) + record("request", "q2", "r1", b"GET") + record("request", "q1", "r1", b"GET /") + record("metadata", "m", "lost")
    data += record("response", "r2", block=b"HTTP/1.1 200 OK\r\n\r\n\xff\x00raw")
    (tmp_path / "a.warc").write_bytes(data)
    c = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, f"file://{tmp_path}")).collect()}
    assert set(c) == {"<r1>", "<r2>"} and bytes(c["<r1>"].response.payload) == b"Wikipedia" and bytes(c["<r2>"].response.payload) == b"\xff\x00raw"
    assert c["<r1>"].request.record_id == "<q1>" and c["<r1>"].n_requests == 2 and c["<r1>"].metadata is None and c["<r2>"].n_requests == 0 and c["<r1>"].response.complete


def test_shards(spark):
    d = odd_docs(spark, ["more"] * 40)
    got = sharding.interleave(d, 8).collect()
    assert len(got) == d.count() and all(r.size == len((t := r_text(d)[r.doc_id]).encode()) + 1 and r.text_crc32 == binascii.crc32(t.encode()) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.interleave(d.limit(0)).count() == 0 and sharding.interleave(d, 8).exceptAll(sharding.interleave(d.repartition(3), 8)).isEmpty()


def r_text(d):
    return {r.doc_id: r.text or "" for r in d.collect()}


def test_every_shard_has_the_mixture(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    share = {(r.shard, r.source): r.n for r in sharding.interleave(d, 8).join(d, "doc_id").groupBy("shard", "source").agg(F.count("*").alias("n")).collect()}
    whole = {r.source: r.n for r in d.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share[s, k] - n / 8) <= 2 for k, n in whole.items() for s in range(8))


def test_sources_of_one_row_spread_over_all_shards(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"))
    n = Counter(r.shard for r in sharding.interleave(d, 8).filter("doc_id >= 2000").collect())
    assert sum(n.values()) == 2000 and all(abs(n[s] - 250) < 60 for s in range(8))


def measure(text):
    words = re.findall("[^ \t-\r]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts(spark):
    d = odd_docs(spark, ["a b c x a b c y b c x a", "the cat sat on the mat " * 20, "...\n.. ...\nabc..."])
    got = Counter(tuple(r) for r in quality.judge(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in d.collect():
        m = measure(r.text or "")
        want[(r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want and quality.judge(d.limit(0)).count() == 0


def test_quality_keeps_labelled_good_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = quality.judge(d).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert j.filter("quality = 1 and not kept and not base_failed").count() == 0 and j.filter("quality = 0 and kept").count() == 0
    kept = quality.keep_good(d.withColumn("w", F.lit(0)))
    assert kept.columns == [*d.columns, "w"] and kept.count() == quality.judge(d).filter("kept").count()


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("source", F.lit(1)).withColumn("level", F.lit("x"))


def test_chat_round_trips_whatever_is_said(spark):
    hard = ["plain", "", None, chat.HARD, "[\\INST] <\\/s>", "\\", "[INST] a [/INST]</s><s>", "<<SYS>>\nx\n<</SYS>>\n", " [/INST]", "x\\\\b", "[[INST]", "\\s\\l[ROLE:z] "]
    roles = ["user", "assistant", "system", None, "tool", "a] b", "new\nline", "[INST]"]
    rows = [(100 * i + j, t, roles[(i + t) % len(roles)], hard[(j + t) % len(hard)]) for i in range(len(roles)) for j in range(len(hard)) for t in range(3)]
    rows += [(7000, 1, "user", "tie"), (7000, 1, "assistant", "tie"), (7000, 1, "user", "tie"), (None, None, "user", "no id")]
    source = defaultdict(list)
    for c, t, r, x in rows:
        source[c].append((-(2**63) if t is None else t, r or "", x or ""))
    got = chat.format_conversations(turns(spark, rows)).collect()
    assert len(got) == len(source)
    for r in got:
        assert [tuple(x) for x in r.recovered] == [x[1:] for x in sorted(source[r.conv_id])], r.formatted
        assert r.formatted.startswith(f"[CHAT esc={r.level}]\n")
        said = [x.text for x in r.recovered if x.role == "assistant"]
        cut = [r.formatted[m.start : m.end] for m in r["mask"]]
        assert len(cut) == len(said) and (r.level > 0 or cut == said)
        assert all(r.formatted[m.start - 3 : m.start] == "<s>" and r.formatted[m.end : m.end + 4] == "</s>" for m in r["mask"])
    for r in chat.digest(turns(spark, rows)).collect():
        said = "".join(x[2] for x in sorted(source[r.conv_id]) if x[1] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {r.level for r in got} == {0, 1, 2} and chat.digest(turns(spark, rows).limit(0)).count() == 0


def test_mix(spark):
    d = odd_docs(spark, ["w " * n for n in range(1, 60)])
    got = mixing.mix(d).collect()
    assert len(got) == d.count()
    assert all(r.size == len(re.findall("[^ \t-\r]+", t)) for r, t in ((r, r_text(d)[r.doc_id]) for r in got))
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 3 * r.size
    for rows in by.values():
        assert sum(r.taken for r in rows) == int(rows[0].target) and sum(r.size for r in rows) == rows[0].source_size
    assert abs(sum(rows[0].target for rows in by.values()) - sum(r.size for r in got)) < 1e-6
    assert mixing.mix(d.limit(0)).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = {"a": 1000, "b": 1, "c": 10, "d": 500, None: 3}
    got = {r._source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "_source string, source_size bigint")).collect()}
    weights, want, free = dict(zip(["a", "b", "c", "d", None], (1, 2, 3, 1, 2), strict=True)), {}, set(sizes)
    while True:
        rest = sum(sizes.values()) - sum(want[k] for k in set(sizes) - free)
        level = {k: rest * weights[k] / sum(weights[x] for x in free) for k in free}
        over = {k for k in free if level[k] > 3 * sizes[k]}
        if not over:
            want |= level
            break
        want |= {k: 3.0 * sizes[k] for k in over}
        free -= over
    assert got == pytest.approx(want)


def test_very_long_texts(spark):
    text = " ".join(f"w{i % 7001}" for i in range(50_000))
    d = spark.createDataFrame([(1, text, "s"), (2, "short", "s")], "doc_id bigint, text string, source string")
    j = {r.doc_id: r for r in quality.judge(d).collect()}
    assert (j[1].n_words, j[1].n_repeat_words, j[1].word_chars) == (50_000, 50_000, sum(len(f"w{i % 7001}") for i in range(50_000)))
    assert {r.doc_id: r.size for r in mixing.mix(d).collect()} == {1: 50_000, 2: 1}
    assert {r.doc_id: r.size for r in sharding.interleave(d).collect()} == {1: len(text) + 1, 2: 6}
    c = chat.digest(turns(spark, [(1, 0, "user", text), (1, 1, "assistant", text)])).first()
    assert c.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and c.n_turns == 2
    p = warc.round_trip(spark.createDataFrame([(1, "u", text)], "page_id bigint, url string, html string")).first()
    assert p.payload_digest == hashlib.sha1(text.encode()).hexdigest()
