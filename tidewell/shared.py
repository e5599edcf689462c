"""Folders and checkpoints that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session or of spark.checkpoint.dir. Without one, a temporary folder in local mode; an error on a cluster, whose machines would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidewell-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name there."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder, and read from there."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def local(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table that is part of the plan."""
    return spark.createDataFrame(pa.table(columns))


def running_sums(df: DataFrame, sums: dict[str, Column], *order: str) -> DataFrame:
    """df with sums over all rows up to each, in the order of columns that no two rows share.

    Rows are range-partitioned and summed within partitions; what the partitions before each have in all is one small row for each. No task has all rows.
    """
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("*", *(v.alias(f"_{k}") for k, v in sums.items())).repartitionByRange(n, *order)
    rows = settled(rows.withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy("_part").agg(*(F.sum(f"_{k}").alias(k) for k in sums)).collect()  # a row for each partition
    totals, ahead = dict.fromkeys(sums, 0), []
    for p in sorted(parts, key=lambda p: p["_part"]):
        ahead.append((p["_part"], *totals.values()))
        totals = {k: t + (p[k] or 0) for k, t in totals.items()}
    if not ahead:
        return rows.select(*df.columns, *(F.col(f"_{k}").alias(k) for k in sums))
    names = ["_at", *(f"_{k}_ahead" for k in sums)]
    before = spark.createDataFrame(ahead, ", ".join(f"{c} {'int' if c == '_at' else rows.schema[c.removesuffix('_ahead')].dataType.simpleString()}" for c in names))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.join(F.broadcast(before), F.col("_part") == F.col("_at"))
    return own.select(*df.columns, *((F.coalesce(F.sum(f"_{k}").over(w), F.lit(0)) + F.col(f"_{k}_ahead")).alias(k) for k in sums))
