"""Query sets and logs from files."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError
from ..schema import EVAL_QUERY, SMOKE_QUERY, TELEMETRY


def _read(spark: SparkSession, path: str) -> object:
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """EVAL_QUERY rows of a YAML list of id, query, relevant and notes."""
    found = _read(spark, path)
    try:
        rows = [(str(q["id"]), str(q["query"]), [str(r) for r in q.get("relevant") or []], q.get("notes")) for q in found or []]
    except (TypeError, KeyError, AttributeError) as e:
        raise ConfigError(f"{path}: not a list of queries") from e
    return spark.createDataFrame(rows, EVAL_QUERY)


def load_smoke(spark: SparkSession, path: str) -> DataFrame:
    """SMOKE_QUERY rows of a YAML mapping with a list under `queries`."""
    found = _read(spark, path)
    try:
        rows = [(str(q["id"]), str(q["query"]), q.get("expect")) for q in (found or {}).get("queries") or []]
    except (TypeError, KeyError, AttributeError) as e:
        raise ConfigError(f"{path}: not a smoke set") from e
    return spark.createDataFrame(rows, SMOKE_QUERY)


def load_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).json(path)
