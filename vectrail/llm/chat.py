"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation renders as a header ``[CHAT esc=L]\\n`` and one bracketed piece per turn. A deterministic parser, one
regular grammar, reads the rendered text back; the recovered turns are compared to the source. If they differ, texts
are escaped one level further and rendered again:

* level 0 leaves texts as they are,
* level 1 puts a backslash behind the first character of control strings,
* level 2 replaces every backslash, bracket and angle bracket by a two-character code, which cannot conflict.

Unescaping by level restores the source exactly. A conversation is one row, since its digest needs the whole of it; its
turns are collected per conversation, never across conversations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Opening and closing marks by role; any other role uses the named bracket.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
NAMED = ("[ROLE:", "] ", " [/ROLE]")
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]")
HEADER = "[CHAT esc={}]\n"
#: Codes of level 2; the backslash's own is applied first and undone last.
CODES = (("\\", "\\b"), ("[", "\\s"), ("]", "\\e"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n"))
LEVELS = 3

_CONTROL = "|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in CONTROL)
_OPEN = "\\[INST\\] |<s>|<<SYS>>\\n|\\[ROLE:[^\\]]*\\] "
_CLOSE = " \\[/INST\\]|</s>|\\n<</SYS>>\\n| \\[/ROLE\\]"
TURN = f"(?s)({_OPEN})(.*?)({_CLOSE})"


def escape(x: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(x, f"(?={_CONTROL})", "\\\\")
    if level == 2:
        for plain, code in CODES:
            x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(x, f"(?<=[\\[<])\\\\(?={'|'.join(sorted({re.escape(c[1:]) for c in CONTROL}))})", "")
    if level == 2:
        for plain, code in reversed(CODES):
            x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def render(turns: Column, level: int) -> Column:
    """The formatted text of an array of (role, text) structs."""
    def one(t):
        text, role = escape(t["text"], level), t["role"]
        out = F.concat(F.lit(NAMED[0]), escape(role, level), F.lit(NAMED[1]), text, F.lit(NAMED[2]))
        for name, (a, b) in MARKS.items():
            out = F.when(role == name, F.concat(F.lit(a), text, F.lit(b))).otherwise(out)
        return out

    return F.concat(F.lit(HEADER.format(level)), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column, level: int) -> Column:
    """What the grammar reads from a formatted text, null if it doesn't read all of it: ``turns`` of (role, text), and
    ``mask``, the loss mask, (start, end) in code points of each assistant turn's escaped text."""
    head = len(HEADER.format(level))
    body = F.substr(formatted, F.lit(head + 1))
    opens, texts, closes = (F.regexp_extract_all(body, F.lit(TURN), F.lit(i)) for i in (1, 2, 3))

    def one(z):
        role = unescape(F.regexp_extract(z["o"], "(?s)^\\[ROLE:([^\\]]*)\\] $", 1), level)
        right = z["c"] == NAMED[2]
        for name, (a, b) in MARKS.items():
            role = F.when(z["o"] == a, F.lit(name)).otherwise(role)
            right = F.when(z["o"] == a, z["c"] == b).otherwise(right)
        return F.struct(F.when(right, role).alias("role"), unescape(z["t"], level).alias("text"))

    def further(a, z):
        at = a["at"] + F.length(z["o"])
        end = (at + F.length(z["t"])).cast("int")
        span = F.array(F.struct(at.cast("int").alias("start"), end.alias("end")))
        return F.struct((end + F.length(z["c"])).cast("int").alias("at"), F.when(z["o"] == MARKS["assistant"][0], F.concat(a["mask"], span)).otherwise(a["mask"]).alias("mask"))

    pieces = F.arrays_zip(opens.alias("o"), texts.alias("t"), closes.alias("c"))
    none = F.struct(F.lit(head).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def judged(p):
        read = F.aggregate(p, none, further)
        return F.get(F.transform(F.array(read), lambda r: F.when(r["at"] == F.length(formatted), F.struct(F.transform(p, one).alias("turns"), r["mask"].alias("mask")))), F.lit(0))

    return F.get(F.transform(F.array(pieces), judged), F.lit(0))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, level, formatted, recovered (role, text) turns and the loss mask (start, end in code points of
    ``formatted``) of each conversation (conv_id, turn, role, text).

    Rows are ordered by turn (null first), then role and text, so ties have one order; null role and text are empty;
    rows with null conv_id form one conversation; repeated rows are repeated turns. ``recovered`` is read back from
    ``formatted`` and equals the source at the level that was kept. Very long texts and conversations are one row each;
    an empty table gives an empty result, and other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("t"))
    c = c.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))

    def attempt(level: int) -> Column:
        """struct(level, formatted, recovered) of the first level from here on that reads back identically."""
        def judge(f):
            def kept(r):
                this = F.struct(F.lit(level).alias("level"), f.alias("formatted"), r["turns"].alias("recovered"), r["mask"].alias("mask"))
                return this if level == LEVELS - 1 else F.when(r["turns"] == F.col("source"), this).otherwise(attempt(level + 1))

            return F.get(F.transform(F.array(parse(f, level)), kept), F.lit(0))

        return F.get(F.transform(F.array(render(F.col("source"), level)), judge), F.lit(0))

    return c.withColumn("best", attempt(0)).select("conv_id", "best.level", "best.formatted", "best.recovered", "best.mask")


def under_mask(formatted: Column, mask: Column, level: Column) -> Column:
    """The text under a loss mask: its spans cut out of the formatted text, each unescaped by its level."""
    cut = F.transform(mask, lambda m: F.substr(formatted, m["start"] + 1, m["end"] - m["start"]))
    plain = lambda k: F.transform(cut, lambda x: unescape(x, k))
    said = plain(LEVELS - 1)
    for k in range(LEVELS - 1):
        said = F.when(level == k, plain(k)).otherwise(said)
    return F.array_join(said, "")


def digest(conversations: DataFrame) -> DataFrame:
    """Per conversation the digests of what its formatted text reads back as, and of what its loss mask covers."""
    f = format_conversations(conversations)
    f = f.withColumns({"_said": under_mask(F.col("formatted"), F.col("mask"), F.col("level")), "_all": F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")})
    return f.select(
        "conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2("_all", 256).alias("turns_sha256"),
        F.length("_said").cast("long").alias("loss_chars"), F.sha2("_said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


HARD = "</s>[INST] ok [/INST]"


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text")
    )
    return digest(c.unionByName(hard))


_ANY = "|".join(re.escape(c).replace("/", "/") for c in CONTROL)
OP4_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HARD}' UNION ALL SELECT -1, 1, 'assistant', '{HARD}'),
m AS (SELECT *, max(CASE WHEN regexp_matches(x, '{_ANY}') OR r NOT IN ('user', 'assistant', 'system') AND regexp_matches(r, '\\]|{_ANY}') THEN 1 ELSE 0 END) OVER w AS one,
  max(CASE WHEN regexp_matches(x || ' ' || r, '[\\[<]\\\\') OR regexp_matches(r, '\\]') THEN 1 ELSE 0 END) OVER w AS two
  FROM c WINDOW w AS (PARTITION BY conv_id)),
e AS (SELECT *, CASE WHEN one = 0 THEN 0 WHEN two = 0 THEN 1 ELSE 2 END AS lv FROM m),
l AS (SELECT *, CASE lv WHEN 0 THEN length(x) WHEN 1 THEN length(x) + len(regexp_extract_all(x, '{_ANY}')) ELSE length(x) + len(regexp_extract_all(x, '[\\[\\]<>\\\\\\n]')) END AS xl,
  CASE WHEN r = 'user' THEN 15 WHEN r = 'assistant' THEN 7 WHEN r = 'system' THEN 18 ELSE 16 + CASE lv WHEN 2 THEN length(r) + len(regexp_extract_all(r, '[\\[\\]<>\\\\\\n]')) WHEN 1 THEN length(r) + len(regexp_extract_all(r, '{_ANY}')) ELSE length(r) END END AS rl FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  (13 + sum(xl + rl))::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
