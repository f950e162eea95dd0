"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` computes all counts of a text in one pass over its row; ``RULES`` states the bounds; ``verdict`` turns the
table into one boolean expression. No shuffle, no join: a plan of a scan and projections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "ist",
    "que", "el", "los", "se", "del", "las", "por", "con", "no", "para",
)


@dataclass(frozen=True)
class Rule:
    """Reject a text whose numerator * scale > bound * denominator (or < where least)."""

    name: str
    numerator: str
    denominator: str
    bound: int
    per: int = 100
    least: bool = False

    def broken(self, column) -> Column:
        a, b = F.lit(self.per) * column(self.numerator), F.lit(self.bound) * column(self.denominator)
        return (a < b) if self.least else (a > b)

    def sql(self) -> str:
        return f"{self.per} * {self.numerator} {'<' if self.least else '>'} {self.bound} * {self.denominator}"


#: Ratios in hundredths: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean word too short", "word_chars", "n_words", 200, least=True),
    Rule("mean word too long", "word_chars", "n_words", 2000),
    Rule("symbols", "n_symbols", "n_words", 20),
    Rule("exclamations", "n_exclaims", "n_words", 30),
    Rule("stop words", "n_stop_words", "n_words", 1, least=True),
    Rule("repeated lines", "n_dup_lines", "n_lines", 60),
    Rule("unfinished lines", "n_ellipsis_lines", "n_lines", 50),
)
MIN_WORDS, MAX_REPEATED = 50, 50


def measures(docs: DataFrame, text: str = "text", p: str = "") -> DataFrame:
    """docs with the counts that the rules use, as columns named p + measure.

    Null and blank texts have zero counts. Words in repeated 3-word windows are found within the row: windows are
    hashed and sorted, positions of hashes that occur twice are merged; the cost of a text of n words is n log n.
    """
    c = lambda name: F.col(f"{p}{name}")
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn(f"{p}w", words(F.col(text)))
    w = c("w")
    blank_free = "[^\\x20\\x09-\\x0D]"
    d = d.withColumns({
        f"{p}n_words": F.size(w).cast("long"),
        f"{p}word_chars": F.length(F.array_join(w, "")).cast("long"),
        f"{p}n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        f"{p}n_exclaims": F.regexp_count(t, F.lit("!")).cast("long"),
        f"{p}n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long"),
        f"{p}lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(blank_free)),
        f"{p}g": F.transform(w, lambda x: F.xxhash64(x)),
    })
    # hashes of all windows of three words, by pairing the words' hashes with themselves shifted by one and by two
    pair = lambda x, y: F.xxhash64(x, y)
    g = c("g")
    windows = F.zip_with(F.zip_with(g, F.slice(g, 2, F.greatest(F.size(g), F.lit(1))), pair), F.slice(g, 3, F.greatest(F.size(g), F.lit(1))), pair)
    d = d.withColumn(f"{p}h", F.slice(windows, 1, F.greatest(F.size(g) - 2, F.lit(0))))
    h, lines = c("h"), c("lines")
    paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s):
        twice = F.filter(s, lambda e, k: F.coalesce((F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), F.get(s, k - 1)["h"] == e["h"], F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    repeats = F.get(F.transform(F.array(paired), covered), F.lit(0))
    return d.withColumns({
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{p}n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).cast("long"),
        f"{p}n_repeat_words": F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats).cast("long"),
    })


def verdict(p: str = "", rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """base_failed and kept, from the columns of ``measures``; a rule without denominator (0 words or lines) holds."""
    c = lambda name: F.col(f"{p}{name}")
    base = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEATED * c("n_words"))
    broken = F.lit(False)
    for rule in rules:
        broken = broken | rule.broken(c)
    return base, ~(base | broken)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept of every row of docs (doc_id, text). Null and blank texts have no words and fail;
    repeated rows and rows without doc_id are judged each; very long texts are judged whole, in their row; other columns are
    ignored, and an empty table gives an empty result."""
    d = measures(docs.select("doc_id", "text"), p="_")
    base, kept = verdict("_")
    counts = [F.col(f"_{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return d.select("doc_id", *counts, base.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns unchanged.

    The filter also names a non-deterministic column, so that Catalyst evaluates it on the measures' columns
    and does not push it below them, where each reference would compute a measure anew.
    """
    base, kept = verdict("__quality_")
    m = measures(docs, p="__quality_").withColumn("__quality_row", F.monotonically_increasing_id())
    return m.filter(kept & (F.col("__quality_row") >= 0)).select(*[F.col(f"`{x}`") for x in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{x}'" for x in STOP_WORDS)
#: CTE ``judged`` over a relation ``docs`` (doc_id, text), for op3 and the pipeline.
JUDGED_SQL = f"""
q0 AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
q1 AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM q0),
q2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q1),
q3 AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM q2 WHERE c > 1) GROUP BY doc_id),
q4 AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims,
  len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ellipsis_lines FROM q0),
judged AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, r AS n_repeat_words, bf AS base_failed,
  NOT (bf OR {" OR ".join(f"({r.sql()})" for r in RULES)}) AS kept
  FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * r > {MAX_REPEATED} * n_words AS bf FROM (
    SELECT q4.*, coalesce(n_repeat_words, 0)::BIGINT AS r FROM q4 LEFT JOIN q3 USING (doc_id))))"""

OP3_SQL = f"WITH docs AS (SELECT doc_id, text FROM documents), {JUDGED_SQL} SELECT * FROM judged"
