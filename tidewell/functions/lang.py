"""Language detection by file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"markdown": ("md", "markdown"), "arkts": ("ets", "ts", "tsx"), "kotlin": ("kt", "kts"), "swift": ("swift",), "json": ("json",)}


def extension(path: Column) -> Column:
    """What follows the last dot of the last segment, in lower case; empty without one or for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def detect_lang(path: Column) -> Column:
    ext, out = extension(path), F.lit("auto")
    for lang, names in EXTENSIONS.items():
        out = F.when(ext.isin(*names), lang).otherwise(out)
    return out
