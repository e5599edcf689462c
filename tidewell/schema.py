"""Schemas of the engine's tables: the single source of truth."""

from __future__ import annotations

from pyspark.sql import types as T

PLATFORMS = ("harmonyos", "android", "ios")
CHUNK_TYPES = ("api_doc", "code_example", "migration_rule", "error_fix", "generic")
LANGUAGES = ("markdown", "arkts", "kotlin", "swift", "json", "auto")
INTENTS = ("api_lookup", "error_fix", "migration", "adaptive", "new_component", "generic", "chitchat")
SOURCES = ("vector", "bm25", "hybrid", "reranked")

LINE_RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("lang", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
        T.StructField("line_range", LINE_RANGE),
        T.StructField("platforms", T.ArrayType(T.StringType())),
        T.StructField("api_version", T.StringType()),
        T.StructField("deprecated", T.BooleanType()),
        T.StructField("type", T.StringType()),
        T.StructField("source_framework", T.StringType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("parent_id", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

HIT = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("vector_score", T.DoubleType()),
        T.StructField("bm25_score", T.DoubleType()),
    ]
)

EVAL_QUERY = T.StructType(
    [
        T.StructField("query_id", T.StringType(), False),
        T.StructField("query", T.StringType(), False),
        T.StructField("relevant", T.ArrayType(T.StringType())),
        T.StructField("notes", T.StringType()),
    ]
)

SMOKE_QUERY = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("expect", T.StringType())])

TELEMETRY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("iteration", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("files_changed", T.IntegerType()),
        T.StructField("lines_added", T.IntegerType()),
        T.StructField("lines_removed", T.IntegerType()),
        T.StructField("input_tokens_actual", T.LongType()),
        T.StructField("output_tokens_actual", T.LongType()),
        T.StructField("duration_sec", T.IntegerType()),
        T.StructField("notes", T.StringType()),
    ]
)
