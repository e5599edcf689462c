"""Metadata predicates. The two branches of a hybrid search differ on purpose: see vector_filter and fulltext_filter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    platforms: tuple[str, ...] = ()
    api_version: str | None = None
    source_framework: str | None = None  # accepted and not applied by either branch
    include_deprecated: bool = False
    tags: tuple[str, ...] = field(default=())


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def vector_filter(f: Filters) -> Column:
    """Any platform in common, or none stated; api version equal or unknown; any tag in common."""
    keep = F.lit(True) if f.include_deprecated else ~F.coalesce(F.col("deprecated"), F.lit(False))
    if f.platforms:
        keep = keep & ((F.coalesce(F.size("platforms"), F.lit(0)) <= 0) | F.arrays_overlap("platforms", _strings(f.platforms)))
    if f.api_version is not None:
        keep = keep & (F.col("api_version").isNull() | (F.col("api_version") == f.api_version))
    if f.tags:
        keep = keep & F.coalesce(F.arrays_overlap("tags", _strings(f.tags)), F.lit(False))
    return keep


def fulltext_filter(f: Filters) -> Column:
    """All platforms and all tags; api version equal and known. Filters never add to a score."""
    keep = F.lit(True) if f.include_deprecated else ~F.coalesce(F.col("deprecated"), F.lit(False))
    for name, values in (("platforms", f.platforms), ("tags", f.tags)):
        for v in values:
            keep = keep & F.coalesce(F.array_contains(name, v), F.lit(False))
    if f.api_version is not None:
        keep = keep & F.coalesce(F.col("api_version") == f.api_version, F.lit(False))
    return keep


def score_threshold(hits: DataFrame, least: float) -> DataFrame:
    """Hits whose vector score reaches `least`; hits without a vector score go."""
    return hits.filter(F.coalesce(F.col("vector_score") >= least, F.lit(False)))


def get_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id).limit(1)
