"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so, in any case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Without one, a temporary folder in local mode; an error on a cluster, whose machines would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Removes the files of a shared_checkpoint that nothing is computed from any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove_folder(df.sparkSession, file.get())


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot if one row in so many has it, so there are fewer hot keys than that.
HOT = 1000


def join_hot(rows: DataFrame, labels: DataFrame, key: str, label_key: str) -> DataFrame:
    """rows with the label of their key, for each row that has one; labels has a row for each key at most.

    Fewer than HOT keys have more than 1 / HOT of the rows each. Their labels are broadcast; the rows of the others are shuffled to theirs, in which no key is large.
    """
    rows = rows.select("*")
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    counts = shared_checkpoint(counts)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") > max(1, total // HOT)).select("_key")
    few = F.broadcast(shared_checkpoint(labels.join(F.broadcast(hot), F.col(label_key) == F.col("_key")).drop("_key")))
    cold = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left_anti")
    return rows.join(few, F.col(key) == F.col(label_key)).unionByName(cold.join(labels, F.col(key) == F.col(label_key)))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key for a row: equal for rows with equal id and text (null differs from empty), else different."""
    blank = F.coalesce(text, F.lit(""))
    return F.struct(F.coalesce(doc_id.cast("long"), F.lit(0)).alias("i"), F.xxhash64(doc_id.isNull(), text.isNull(), blank).alias("a"), F.xxhash64(F.lit(7), blank).alias("b"))


def batches(table_iter: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose text stays near max_bytes, however long single texts are."""
    for batch in table_iter:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def words8(t: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, packed, the first lowest; zeros follow the end."""
    padded = np.zeros(len(t) + 8, dtype=np.uint8)
    padded[: len(t)] = t
    return np.lib.stride_tricks.as_strided(padded, (len(t), 8), (1, 1)).copy().view("<u8").ravel()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
