"""Parent expansion and citation of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RetrievalError


def expand_to_parent(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with parent_content, parent_heading_path and parent_found. hits need chunk_id and parent_id.

    The parent is null where parent_id is null, unknown or the hit itself. chunk_id is unique in chunks, so each hit stays one row.
    """
    parents = chunks.select(F.col("chunk_id").alias("_parent"), F.col("content").alias("parent_content"), F.col("heading_path").alias("parent_heading_path"))
    on = (hits["parent_id"] == parents["_parent"]) & (hits["parent_id"] != hits["chunk_id"])
    return hits.join(parents, on, "left").withColumn("parent_found", F.col("_parent").isNotNull()).drop("_parent")


def flatten_with_parent_content(expanded: DataFrame) -> DataFrame:
    """The parent's content in place of the hit's where there is one; id and metadata stay the hit's."""
    return expanded.withColumn("content", F.coalesce("parent_content", "content")).drop("parent_content", "parent_heading_path", "parent_found")


def parent_audit(expanded: DataFrame) -> DataFrame:
    """n_hits and n_missing as one row."""
    return expanded.agg(F.count(F.lit(1)).alias("n_hits"), F.count_if(~F.col("parent_found")).alias("n_missing"))


def expand_strict(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """As expand_to_parent, but an error if any hit has no parent."""
    expanded = expand_to_parent(hits, chunks)
    n, missing = parent_audit(expanded).first()
    if missing:
        raise RetrievalError(f"{missing} of {n} hits have no parent")
    return expanded


def parents_of(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """child_id and the parent's columns, for each of ids (chunk_id) whose chunk has a parent that is there. A chunk is no parent of itself."""
    own = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select(F.col("chunk_id").alias("child_id"), F.col("parent_id").alias("_p")).filter(F.col("_p") != F.col("child_id"))
    return own.join(chunks, own["_p"] == chunks["chunk_id"]).drop("_p")


def parent_of(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The parent of one chunk, if it has one."""
    return parents_of(chunks, chunks.filter(F.col("chunk_id") == chunk_id).select("chunk_id")).drop("child_id")


def heading_display(path: Column) -> Column:
    return F.when(F.coalesce(F.size(path), F.lit(0)) <= 0, F.lit("(root)")).otherwise(F.array_join(path, " > "))


def lines_display(line_range: Column) -> Column:
    return F.when(line_range.isNull(), F.lit("L?")).otherwise(F.concat(F.lit("L"), line_range["start"].cast("string"), F.lit("-"), line_range["end"].cast("string")))


def preview(content: Column, chars: int = 200) -> Column:
    return F.substring(content, 1, chars)


def console_preview(content: Column, chars: int = 200) -> Column:
    """One line; an ellipsis follows where the content has more than `chars` bytes."""
    return F.concat(F.replace(preview(content, chars), F.lit("\n"), F.lit(" ")), F.when(F.octet_length(content) > chars, F.lit("…")).otherwise(F.lit("")))


def cite(hits: DataFrame) -> DataFrame:
    """The citation of each hit. hits need source, heading_path and line_range of their chunks."""
    return hits.select("query_id", "rank", "chunk_id", F.col("source").alias("source"), "heading_path", "line_range", "score", heading_display(F.col("heading_path")).alias("heading"), lines_display(F.col("line_range")).alias("lines"))
