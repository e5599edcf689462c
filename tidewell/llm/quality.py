"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every measure is a Catalyst expression over the row itself, so the plan is one scan and one projection, with no
shuffle and no user functions. A null text has no words; it and every text under the least length fail the base rule.
Rows are judged one by one: repeated rows get equal verdicts and columns besides the key and the text pass through
untouched in `quality_filter` whatever their names, while `judge` refuses to replace one. Windows of three words are compared by 64-bit hashes
within one text. No text is too long: the work is linear in its words, and rules bound ratios, not lengths from above. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, free_name, let, table, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was with as be by on are this at from "
    "de la le les et des un une du que qui en est pour dans par sur au "
    "el los las y del se con su para al como "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject if `measure` lies outside [low, high]."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios of a text without words count as zero.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("symbols_per_word", high=0.10),
    Rule("stop_word_ratio", low=0.05),
    Rule("upper_ratio", high=0.40),
    Rule("dup_line_ratio", high=0.50),
    Rule("ellipsis_line_ratio", high=0.30),
    Rule("bullet_line_ratio", high=0.90),
)


def _repeat_words(w: Column) -> Column:
    """Number of words inside a three-word window that the text holds at least twice."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        at = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    return F.when(F.size(w) >= 3, let(F.array_sort(windows), covered)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """All measures of a text as one struct column."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")

    def of_words(w: Column) -> Column:
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(joined) - F.length(F.translate(joined, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            (F.length(joined) - F.length(F.regexp_replace(joined, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(ls, lambda x: F.ltrim(x).rlike("^[-*•]" + WS_CLASS))).cast("long").alias("n_bullet_lines"),
        )

    return F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, column: str = "quality") -> DataFrame:
    """docs with a struct of all measures, ratios and verdicts in `column`."""
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {column} already")
    m = docs.withColumn(column, measures(F.col(f"`{text}`")))
    get = {k: F.col(f"`{column}`.w.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words", "n_upper")}
    get |= {k: F.col(f"`{column}`.l.{k}") for k in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")}
    ratios = {
        "mean_word_chars": _ratio(get["word_chars"], get["n_words"]),
        "symbols_per_word": _ratio(get["n_symbols"], get["n_words"]),
        "stop_word_ratio": _ratio(get["n_stop_words"], get["n_words"]),
        "upper_ratio": _ratio(get["n_upper"], get["word_chars"]),
        "dup_line_ratio": _ratio(get["n_dup_lines"], get["n_lines"]),
        "ellipsis_line_ratio": _ratio(get["n_ellipsis_lines"], get["n_lines"]),
        "bullet_line_ratio": _ratio(get["n_bullet_lines"], get["n_lines"]),
    }
    base = (get["n_words"] < 50) | (100 * get["n_repeat_words"] > 50 * get["n_words"])
    kept = ~base
    for rule in rules:
        value = (get | ratios)[rule.measure]
        if rule.low is not None:
            kept = kept & (value >= rule.low)
        if rule.high is not None:
            kept = kept & (value <= rule.high)
    return m.withColumn(column, F.struct(*(v.alias(k) for k, v in (get | ratios).items()), base.alias("base_failed"), kept.alias("kept")))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with docs' own columns."""
    column = free_name(docs.columns, "quality")
    return judge(docs, text, rules, column).filter(F.col(f"`{column}`.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", *(F.col(f"quality.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: list_contains(string_split('{stop}', ' '), lower(x))))::BIGINT AS n_stop,
         length(regexp_replace(array_to_string(ws, ''), '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
         len(list_filter(ls, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::BIGINT AS n_ell,
         len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•][\x20\x09-\x0D]')))::BIGINT AS n_bul
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars::DOUBLE / n_words >= 2 AND word_chars::DOUBLE / n_words <= 12 AND n_symbols::DOUBLE / n_words <= 0.1
         AND n_stop::DOUBLE / n_words >= 0.05 AND n_upper::DOUBLE / word_chars <= 0.4 AND n_dup_lines::DOUBLE / n_lines <= 0.5
         AND n_ell::DOUBLE / n_lines <= 0.3 AND n_bul::DOUBLE / n_lines <= 0.9 AS kept
FROM m
""".replace("{stop}", " ".join(STOP_WORDS))
