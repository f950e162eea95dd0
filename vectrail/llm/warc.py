"""WARC archives: writing captures, reading records back, assembling transactions.

Every capture is three records: the request, the response (or a revisit of an equal payload) and a metadata
record. Request and metadata name the response in WARC-Concurrent-To; ``assemble`` joins them through these
identifiers and emits one nested row per capture.

Archives are read with Spark's text source, split at the version line that opens each record, so a task streams
records and a large uncompressed archive is split between tasks. A payload that itself holds that version line is
written with HTTP chunked coding, a chunk border inside each occurrence, so splitting is exact for what
``write_warc`` wrote; for foreign archives ``complete`` tells whether a record has its declared length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table

VERSION = "WARC/1.1"
EOL = "\r\n"
DELIMITER = f"{EOL}{VERSION}{EOL}"
#: Payloads of at least so many bytes are stored once; later copies become revisits.
MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _urn(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), name.cast("string"), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record up to its last line end; the text writer's line separator adds the closing one."""
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit(EOL)) for k, v in [("WARC-Type", kind), ("WARC-Date", F.lit(DATE)), *headers]]
    lines = [F.coalesce(x, F.lit("")) for x in lines]  # a header without a value is left out
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL))
    return F.concat(F.lit(VERSION + EOL), *lines, length, F.lit(EOL), block, F.lit(EOL))


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the payloads that another page with a larger page_id stores.

    Digests are pre-aggregated and only repeated ones are kept. They are written before the join, so the planner sends
    them to all tasks only below its threshold; beyond, both sides are plain shuffles, and the rows of a payload that
    fills a third of the table are split at run time. Rows without page_id never refer to others.
    """
    keys = (
        pages.select("page_id", F.coalesce("html", F.lit("")).alias("p")).filter((F.octet_length("p") >= min_bytes) & F.col("page_id").isNotNull())
        .select("page_id", F.sha1(F.col("p").cast("binary")).alias("digest"))
    )
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keys.join(materialize(groups, "payloads"), "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _body(payload: Column, chunked: Column) -> Column:
    parts = F.split(payload, "(?<=WARC)(?=/1\\.1)")
    coded = F.array_join(F.transform(parts, lambda p: F.concat(F.hex(F.octet_length(p)), F.lit(EOL), p, F.lit(EOL))), "")
    return F.when(chunked, F.concat(coded, F.lit("0" + EOL + EOL))).otherwise(payload)


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, compression: str = "gzip") -> None:
    """Write the captures of pages (page_id, url, html) as archives under path, one per task.

    Null html is an empty payload, a null url an empty target; repeated rows give repeated captures with equal
    record ids; rows of one page_id with several payloads are each judged by their own payload, and rows without page_id
    have an id of their own; other columns are ignored. The (small) list of revisits is written first, so the planner
    sends it to all tasks only when its size is under the broadcast threshold and shuffles the pages otherwise.
    """
    refs = materialize(revisits(pages, min_bytes), "revisits").select(F.col("page_id").alias("ref_page"), F.col("digest").alias("ref_digest"), "refers_to")
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    p = p.join(refs, (F.col("page_id") == F.col("ref_page")) & (F.col("digest") == F.col("ref_digest")), "left")
    p = p.withColumn("row", F.monotonically_increasing_id())
    payload, page, name = F.col("html"), F.col("page_id"), F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("row-"), F.col("row").cast("string")))
    uri = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    host, target = F.regexp_extract(uri, "^[a-z]+://([^/?#]*)", 1), F.regexp_extract(uri, "^[a-z]+://[^/?#]*([^#]*)", 1)
    response, revisit = _urn("response", name), F.col("refers_to").isNotNull()
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    chunked = F.concat(F.lit(EOL), payload, F.lit(EOL)).contains(DELIMITER)
    size = F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"),
        F.when(~revisit & chunked, F.lit("Transfer-Encoding: chunked")).otherwise(size), F.lit(EOL + EOL),
        F.when(revisit, F.lit("")).otherwise(_body(payload, chunked)),
    )
    get = F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL))
    fields = F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(EOL))
    common = [("WARC-Target-URI", uri)]
    records = F.array(
        _record(F.lit("request"), [("WARC-Record-ID", _urn("request", name)), ("WARC-Concurrent-To", response), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], get),
        _record(
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            [("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
             ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("refers_to")))), ("Content-Type", F.lit("application/http; msgtype=response"))],
            http,
        ),
        _record(F.lit("metadata"), [("WARC-Record-ID", _urn("metadata", name)), ("WARC-Concurrent-To", response), *common, ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    p.select(F.explode(records).alias("value")).write.option("lineSep", EOL).option("compression", compression).text(path)


def _header(head: Column, name: str) -> Column:
    x = F.regexp_extract(head, f"(?i)(?:^|\\r\\n){name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(x != "", x)


def _dechunk(body: Column) -> Column:
    """Decode HTTP chunked coding of a binary column, chunk by chunk."""
    def step(a, _):
        size = F.conv(F.regexp_extract(F.substring_index(a["rest"].cast("string"), EOL, 1), "^([0-9A-Fa-f]+)", 1), 16, 10).cast("int")
        at = F.octet_length(F.substring_index(a["rest"].cast("string"), EOL, 1)) + 3
        more = a["rest"].isNotNull() & (size > 0)
        return F.struct(
            F.when(more, F.substr(a["rest"], at + size + F.lit(2))).alias("rest"),
            F.when(more, F.concat(a["out"], F.substr(a["rest"], at, size))).otherwise(a["out"]).alias("out"),
        )

    steps = F.sequence(F.lit(1), F.size(F.split(body.cast("string"), EOL)))
    return F.aggregate(steps, F.struct(body.alias("rest"), F.lit("").cast("binary").alias("out")), step, lambda a: a["out"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under path: record_id, record_type, concurrent_to, target_uri, refers_to_id,
    declared_digest, http_head, declared_bytes, payload (binary, of responses and revisits decoded from HTTP),
    complete. Both plain and gzip archives. Only the columns that are used are computed."""
    raw = spark.read.option("lineSep", DELIMITER).text(path)
    value = F.col("value").cast("binary")  # cut as bytes: a payload need not be UTF-8
    r = raw.select(F.when(F.col("value").startswith(VERSION + EOL), F.substr(value, F.lit(len(VERSION + EOL) + 1))).otherwise(value).cast("string").alias("record"))
    r = r.select("record", F.substring_index("record", EOL + EOL, 1).alias("head")).filter(F.col("head").rlike("(?i)(?:^|\\r\\n)WARC-Type:"))
    length = _header(F.col("head"), "Content-Length").cast("int")
    r = r.select("head", F.expr("substring(cast(record as binary), octet_length(head) + 5)").alias("rest"), length.alias("length"))
    r = r.select("head", "length", (F.octet_length("rest") >= F.col("length")).alias("complete"), F.expr("substring(rest, 1, length)").alias("block"))
    head = F.col("head")
    is_http = _header(head, "WARC-Type").isin("response", "revisit")
    http_head = F.when(is_http, F.substring_index(F.col("block").cast("string"), EOL + EOL, 1))
    r = r.select(
        _header(head, "WARC-Record-ID").alias("record_id"), _header(head, "WARC-Type").alias("record_type"),
        _header(head, "WARC-Concurrent-To").alias("concurrent_to"), _header(head, "WARC-Target-URI").alias("target_uri"),
        _header(head, "WARC-Refers-To").alias("refers_to_id"), _header(head, "WARC-Payload-Digest").alias("declared_digest"),
        http_head.alias("http_head"), "block", "complete",
    )
    body = F.expr("substring(block, octet_length(http_head) + 5)")
    coded = F.lower(_header(F.col("http_head"), "Transfer-Encoding")) == "chunked"
    payload = F.when(F.col("http_head").isNull(), F.col("block")).when(coded, _dechunk(body)).otherwise(body)
    return r.select(
        "record_id", "record_type", "concurrent_to", "target_uri", "refers_to_id", "declared_digest", "http_head",
        _header(F.col("http_head"), "Content-Length").cast("long").alias("declared_bytes"), payload.alias("payload"), "complete",
    )


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata record.

    Request and metadata records are joined through concurrent_to; of several, the one with the smallest
    record_id is taken and ``n_requests``/``n_metadata`` count them, so a capture with very many of them stays one
    bounded row (pre-aggregated before the shuffle). Captures without request or metadata have null there;
    requests that name no known capture are left out. Repeated response records give one row each.
    """
    def side(kind: str):
        s = F.struct("record_id", "target_uri", "payload")
        return (
            records.filter((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
            .groupBy(F.col("concurrent_to").alias(f"{kind}_of")).agg(F.min(s).alias(kind), F.count("*").alias(f"n_{kind}"))
        )

    captures = records.filter(F.col("record_type").isin("response", "revisit"))
    out = captures.join(side("request"), F.col("record_id") == F.col("request_of"), "left").join(side("metadata"), F.col("record_id") == F.col("metadata_of"), "left")
    response = F.struct("record_id", "record_type", "target_uri", "refers_to_id", "declared_digest", "http_head", "declared_bytes", "payload", "complete")
    return out.select(
        F.col("record_id").alias("capture_id"), response.alias("response"), "request", F.coalesce("n_request", F.lit(0)).alias("n_requests"),
        "metadata", F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, read back and assembled: one row per page with the digest of its payload."""
    return round_trip(table(spark, sf_dir, "pages"))


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    c = assemble(read_warc(spark, path))
    r = F.col("response")
    revisit = r["record_type"] == "revisit"
    page_id = F.regexp_extract(F.col("metadata.payload").cast("string"), "page-id: ([-0-9]+)", 1)
    return c.select(
        F.when(page_id != "", page_id.cast("long")).alias("page_id"),
        F.when(revisit, r["declared_bytes"]).otherwise(F.octet_length(r["payload"]).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(r["declared_digest"], "^sha1:", "")).otherwise(F.sha1(r["payload"])).alias("payload_digest"),
        r["record_type"].alias("record_type"),
        F.when(revisit, F.regexp_extract(r["refers_to_id"], ":([-0-9]+)>$", 1).cast("long")).alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM g
"""
