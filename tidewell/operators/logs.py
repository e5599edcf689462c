"""Reports over a development log and over text and commit collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import running_sums

TOKENS_PER_LINE = 5


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long")


def summary(log: DataFrame) -> DataFrame:
    """One row: entries, lines, tokens known, entries with tokens, and the estimate of five tokens a line."""
    lines = _sum("lines_added") + _sum("lines_removed")
    return log.agg(
        F.count(F.lit(1)).alias("entries"), _sum("lines_added").alias("lines_added"), _sum("lines_removed").alias("lines_removed"),
        _sum("input_tokens_actual").alias("input_tokens"), _sum("output_tokens_actual").alias("output_tokens"),
        F.count("input_tokens_actual").alias("annotated"), (lines * TOKENS_PER_LINE).alias("estimated_tokens"),
    )


def by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("type").agg(F.count(F.lit(1)).alias("entries"))


def by_key(log: DataFrame, key: str) -> DataFrame:
    """Entries that have the key (round or feature), with dashes for nulls."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c)
    return log.filter(F.col(key).isNotNull()).select(F.col(key), *(dash(c) for c in log.columns if c != key)).orderBy(key)


def trend(log: DataFrame, order: str, value: str) -> DataFrame:
    """log's sums by `order`, with running sums of them and of the estimate. No task has the whole order."""
    sums = log.groupBy(order).agg(_sum(value).alias("total"))
    return running_sums(sums, {"running": F.col("total")}, order).withColumn("running_estimate", F.col("running") * TOKENS_PER_LINE)


def top_n(log: DataFrame, value: str, n: int = 5, tie: str = "commit") -> DataFrame:
    return log.orderBy(F.desc(value), tie).limit(n)


def append_new(log: DataFrame, new: DataFrame, key: str = "commit") -> DataFrame:
    """log with the rows of new whose key it does not have."""
    return log.unionByName(new.join(log.select(key), key, "left_anti").select(*new.columns))


def annotate(log: DataFrame, notes: DataFrame, key: str = "commit") -> DataFrame:
    """log with the non-null values of notes (key and some of log's columns) in place of its own."""
    columns = [c for c in notes.columns if c != key]
    new = notes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return log.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in log.columns))


def classify_path(path: Column, meta: tuple[str, ...], business: tuple[str, ...]) -> Column:
    any_of = lambda prefixes: F.lit(False) if not prefixes else F.greatest(*(F.coalesce(path.startswith(p), F.lit(False)) for p in prefixes), F.lit(False))
    return F.when(any_of(meta), "meta").when(any_of(business), "business").otherwise("unknown")


def classify_change(changes: DataFrame, group: str, kind: str = "kind") -> DataFrame:
    """mixed, meta, business or unknown for each change."""
    has = changes.groupBy(group).agg(F.bool_or(F.col(kind) == "meta").alias("m"), F.bool_or(F.col(kind) == "business").alias("b"))
    return has.select(group, F.when(F.col("m") & F.col("b"), "mixed").when(F.col("m"), "meta").when(F.col("b"), "business").otherwise("unknown").alias("change"))


def pending(docs: DataFrame, id_col: str, text: str, pattern: str = r"^- \[ \]") -> DataFrame:
    """Number of lines that match, for each document that has any."""
    n = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)))
    return docs.select(id_col, n.cast("long").alias("n_pending")).filter("n_pending > 0")


def override_reason(message: Column, marker: str = r"override:\s*(.+)") -> Column:
    """The reason given after the marker, or null."""
    found = F.regexp_extract(message, marker, 1)
    return F.when(found == "", F.lit(None).cast("string")).otherwise(F.trim(found))
