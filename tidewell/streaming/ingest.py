"""Incremental ingestion and windowed event counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lang import detect_lang
from ..shared import settled
from ..sources.corpus import read_text, visible
from ..sources.index import Dispatcher, Store, embed_once, noted_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A stream of the files below root: source, modificationTime, length, content and lang, each path once for a checkpoint."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    plain = F.regexp_replace("path", r"^file:/+", "/")
    rel = F.substring(plain, F.length(F.lit(base)) + 1, F.length(plain))
    return files.select(rel.alias("source"), "modificationTime", "length", "content").filter(visible(F.col("source"))).withColumn("lang", detect_lang(F.col("source")))


def ingest(spark: SparkSession, root: str, store: Store, checkpoint: str, embed: Callable[[Column], Column], model_id: str, dim: int, dispatcher: Dispatcher | None = None) -> StreamingQuery:
    """Indexes what is new below root and stops. A restart with the same checkpoint goes on where the last run ended.

    A batch replaces whatever the store has of its files, so batches that run again change nothing, and texts known to the store are not embedded again. A stream takes each path once; `sync_folder` is for
    folders whose files change or go.
    """
    d = dispatcher or Dispatcher.default()

    def write(batch: DataFrame, _: int) -> None:
        store.open_or_create(model_id, dim)
        files = settled(batch)
        chunks = embed_once(d.chunk(read_text(files.drop("modificationTime", "length"))), store, embed)
        store.replace(store.ids_of(files.select("source")), chunks, files=noted_files(files))

    return watch_folder(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values by type and tumbling window, for batch and streaming alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
