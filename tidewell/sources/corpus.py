"""Corpus folders: scanning, decoding, listing and auditing files, and unpacking archives."""

from __future__ import annotations

import codecs
import re
import tarfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, NotFoundError
from ..functions.lang import detect_lang

TOP_FOLDERS = ("official", "samples", "migration", "errors", "custom")


def visible(relative: Column) -> Column:
    """Whether neither the file nor a folder above it is hidden, and no folder is named _index."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.exists(folders, lambda p: p.startswith(".") | (p == "_index")) & ~F.element_at(parts, -1).startswith(".")


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/").removeprefix("file://") + "/"
    plain = F.regexp_replace(path, r"^file:/+", "/")
    return F.substring(plain, F.length(F.lit(base)) + 1, F.length(plain))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, source (relative), modificationTime and length of each visible file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    return files.select("path", _relative(F.col("path"), root).alias("source"), "modificationTime", "length").filter(visible(F.col("source")))


def scan_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, source, modificationTime, length, content and lang of the files at these paths below root."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    # a path is read as a pattern, so its special characters are marked
    files = spark.read.format("binaryFile").load([re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths]) if paths else spark.createDataFrame([], shape)
    return files.select("path", _relative(F.col("path"), root).alias("source"), "modificationTime", "length", "content").withColumn("lang", detect_lang(F.col("source")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, source (relative), lang and content of each visible file, in order of path within a read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", _relative(F.col("path"), root).alias("source"), "content").filter(visible(F.col("source"))).withColumn("lang", detect_lang(F.col("source")))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("had_bad_bytes", T.BooleanType())]))
def _decode(content: pd.Series) -> pd.DataFrame:
    rows = []
    for b in content:
        try:
            rows.append((bytes(b).decode("utf-8"), False))
        except UnicodeDecodeError:
            rows.append((bytes(b).decode("utf-8", "replace"), True))
    return pd.DataFrame(rows, columns=["text", "had_bad_bytes"])


def read_text(files: DataFrame) -> DataFrame:
    """files with text and had_bad_bytes in place of content; malformed bytes become U+FFFD."""
    return files.withColumn("_d", _decode("content")).select(*(c for c in files.columns if c != "content"), "_d.text", "_d.had_bad_bytes")


_BAD = "source string, position long, bytes_hex string, context string, guess string"


def malformed(data: bytes) -> list[tuple[int, int]]:
    """Begin and end of each malformed byte sequence, in one pass."""
    found: list[tuple[int, int]] = []

    def note(e: UnicodeDecodeError) -> tuple[str, int]:
        found.append((e.start, e.end))
        return "", e.end

    codecs.register_error("tidewell.note", note)
    codecs.decode(data, "utf-8", "tidewell.note")
    return found


def _bad_bytes(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in stream:
        rows = []
        for source, content in zip(pdf["source"], pdf["content"], strict=True):
            data = bytes(content)
            for pos, end in malformed(data):
                around = data[max(0, pos - 16) : end + 16]
                try:
                    guess = around.decode("gb18030")
                except UnicodeDecodeError:
                    guess = None
                rows.append((source, pos, data[pos:end].hex(), around.decode("utf-8", "replace"), guess))
        yield pd.DataFrame(rows, columns=["source", "position", "bytes_hex", "context", "guess"])


def audit_utf8(files: DataFrame) -> DataFrame:
    """Each malformed byte sequence: file, place, bytes, surroundings, and what GB18030 would read there."""
    return files.select("source", "content").mapInPandas(_bad_bytes, _BAD)


def transcode(files: DataFrame, encoding: str = "gb18030") -> DataFrame:
    """source and text with files that are not UTF-8 read in another encoding."""

    @F.pandas_udf(T.StringType())
    def read(content: pd.Series) -> pd.Series:
        def one(b) -> str:
            try:
                return bytes(b).decode("utf-8")
            except UnicodeDecodeError:
                return bytes(b).decode(encoding, "replace")

        return content.map(one)

    return files.select("source", read("content").alias("text"))


def folder_counts(files: DataFrame, folders: tuple[str, ...] = TOP_FOLDERS) -> DataFrame:
    """folder and n for each of the fixed folders, also those without files: entries directly inside."""
    entries = files.select(F.split("source", "/").alias("p")).filter(F.size("p") >= 2).select(F.get("p", F.lit(0)).alias("folder"), F.get("p", F.lit(1)).alias("entry")).filter(~F.col("entry").startswith("."))
    known = files.sparkSession.createDataFrame([(f,) for f in folders], "folder string")
    counts = entries.groupBy("folder").agg(F.countDistinct("entry").alias("n"))
    return known.join(counts, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def checksums(files: DataFrame) -> DataFrame:
    return files.select("source", F.sha2("content", 256).alias("sha256"))


def unpack(archive: str, target: str, force: bool = False, strip_components: int = 0) -> int:
    """The number of files unpacked from a local tar archive. Driver-side; for corpora shipped as one file."""
    if not Path(archive).is_file():
        raise NotFoundError(archive)
    out = Path(target)
    if out.is_dir() and any(out.iterdir()) and not force:
        raise ConfigError(f"{target} is not empty")
    n = 0
    with tarfile.open(archive) as tar:
        for member in tar:
            parts = [p for p in PurePosixPath(member.name).parts if p not in (".", "/")][strip_components:]
            if not parts or not member.isfile():
                continue
            if ".." in parts:
                raise ConfigError(f"{member.name} leaves the target")
            place = out.joinpath(*parts)
            place.parent.mkdir(parents=True, exist_ok=True)
            data = tar.extractfile(member)
            place.write_bytes(data.read() if data else b"")
            n += 1
    return n
