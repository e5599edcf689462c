"""Corpus folders and tar archives as a data source: `spark.read.format("corpus").option("path", root)`.

The planner walks folders from the root and never enters a hidden one or one named _index. A tar archive among the files (or as the root) is listed by its headers, without its contents, and cut
into ranges of members of about `rangeBytes` each, so several tasks read one archive, each only its bytes of it; nothing is unpacked. Compressed archives cannot be cut and are read by one
task as a stream. Files are grouped in the same way. Any file system that pyarrow knows will do.
"""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
SCHEMA = "source string, length long, content binary"
_PACKED = (".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


def hidden(name: str, folder: bool) -> bool:
    return name.startswith(".") or folder and name == "_index"


def shown(relative: str) -> bool:
    """Whether no part of a path is hidden, and none leaves the root."""
    *folders, name = relative.split("/")
    return bool(name) and not hidden(name, False) and not any(hidden(f, True) or f == ".." for f in folders)


class Piece(InputPartition):
    """What one task reads: (file, source, offset, length) each. Offset -1: the whole of a compressed archive."""

    def __init__(self, parts: list[tuple[str, str, int, int]]):
        self.parts = parts


class _Reader(DataSourceReader):
    def __init__(self, root: str, range_bytes: int):
        self.root, self.range_bytes = root, range_bytes

    def _at(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.root if "://" in self.root else posixpath.abspath(self.root))

    def _files(self) -> Iterator[tuple[str, str, int]]:
        """(path, source, length) of each visible file, folder by folder."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = self._at()
        info = fs.get_file_info(root)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(self.root)
        if info.type == FileType.File:
            yield root, info.base_name, info.size
            return
        open_ = [(root, "")]
        while open_:
            folder, at = open_.pop()
            for f in sorted(fs.get_file_info(FileSelector(folder)), key=lambda f: f.base_name):
                if not hidden(f.base_name, f.type == FileType.Directory):
                    if f.type == FileType.Directory:
                        open_.append((f.path, f"{at}{f.base_name}/"))
                    elif f.type == FileType.File:
                        yield f.path, at + f.base_name, f.size

    def _members(self, path: str) -> Iterator[tuple[str, int, int]]:
        """(name, offset, length) of an archive's visible files; contents are passed over."""
        fs, _ = self._at()
        with fs.open_input_file(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
            for m in tar:
                name = posixpath.normpath(m.name).lstrip("/")
                if m.isfile() and shown(name):
                    yield name, m.offset_data, m.size

    def partitions(self) -> list[Piece]:
        pieces: list[Piece] = []
        parts: list[tuple[str, str, int, int]] = []
        size = 0
        for path, source, length in self._files():
            low = source.lower()
            if low.endswith(".tar"):
                found = [(path, f"{source}/{name}", offset, n) for name, offset, n in self._members(path)]
            else:
                found = [(path, source, -1 if low.endswith(_PACKED) else 0, length)]
            for part in found:
                if parts and size + part[3] > self.range_bytes:
                    pieces.append(Piece(parts))
                    parts, size = [], 0
                parts.append(part)
                size += part[3]
        return [*pieces, Piece(parts)] if parts or not pieces else pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        fs, _ = self._at()
        for path, source, offset, length in partition.parts:
            with fs.open_input_file(path) as f:
                if offset >= 0:
                    f.seek(offset)
                    yield source, length, f.read(length)
                    continue
                with tarfile.open(fileobj=io.BufferedReader(f), mode="r|*") as tar:
                    for m in tar:
                        name = posixpath.normpath(m.name).lstrip("/")
                        if m.isfile() and shown(name):
                            yield f"{source}/{name}", m.size, tar.extractfile(m).read()


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def read_corpus(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES):
    """source, lang, length and content of the visible files below root, and of those in archives there."""
    from pyspark.sql import functions as F

    from ..functions.lang import detect_lang

    spark.dataSource.register(CorpusSource)
    files = spark.read.format("corpus").option("path", root).option("rangeBytes", range_bytes).load()
    return files.withColumn("lang", detect_lang(F.col("source")))
