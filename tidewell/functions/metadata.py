"""Metadata as VARIANT: nested values keep their shape, paths are read with a type, and JSON is the boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a chunk's metadata has, apart from its text.
FIELDS = ("source", "heading_path", "line_range", "platforms", "api_version", "deprecated", "type", "source_framework", "complexity", "tags", "parent_id", "extra")


def from_json(text: Column) -> Column:
    """VARIANT of a JSON text; null for null and for what is no JSON."""
    return F.try_parse_json(text)


def to_json(value: Column) -> Column:
    """JSON text of a VARIANT, keys in order."""
    return F.to_json(value)


def read_path(value: Column, path: str, kind: str = "string") -> Column:
    """The value at a path ($.a.b[0]) as a type; null where there is none, or none of that type."""
    return F.try_variant_get(value, path, kind)


def metadata(columns: list[str]) -> Column:
    """One VARIANT of the metadata columns that there are."""
    return F.to_variant_object(F.struct(*(F.col(c) for c in FIELDS if c in columns)))
