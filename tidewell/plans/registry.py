"""All queries over the tables of a folder, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunking, corpus, evaluation, search

_MODULES = (search, chunking, evaluation, corpus)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
