"""Indexing: chunking by language, embedding, versioned snapshots, upserts and deletes by bitmaps."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionError, NotFoundError, ReadOnlyError, StorageError, UnsupportedLanguageError
from ..operators.blocks import DOCS, SHIFT, WINDOW, TextIndex, build_blocks, decode_postings, term_counts
from ..operators.clusters import VectorIndex, heads_of, with_clusters
from ..operators.retrieve import FIELDS, with_fields
from ..schema import CHUNK
from ..shared import local, settled
from . import corpus
from .code import chunk_typescript
from .markdown import chunk_markdown

FORMAT_VERSION = 2
#: Rows of a bitmap, as Spark's bitmap functions count them.
BUCKET_BITS = 15
BUCKET = 1 << BUCKET_BITS
Chunker = Callable[[DataFrame], DataFrame]


class Dispatcher:
    """Chunkers by language; registering replaces."""

    def __init__(self, chunkers: dict[str, Chunker] | None = None):
        self.chunkers = dict(chunkers or {})

    @classmethod
    def default(cls) -> Dispatcher:
        return cls({"markdown": chunk_markdown, "arkts": chunk_typescript})

    def register(self, lang: str, chunker: Chunker) -> None:
        self.chunkers[lang] = chunker

    def has(self, lang: str) -> bool:
        return lang in self.chunkers

    def supported(self) -> list[str]:
        return sorted(self.chunkers)

    def chunk_as(self, files: DataFrame, lang: str) -> DataFrame:
        if lang not in self.chunkers:
            raise UnsupportedLanguageError(lang)
        return self.chunkers[lang](files.filter(F.col("lang") == lang))

    def chunk(self, files: DataFrame) -> DataFrame:
        """Chunks of all files (source, lang, text) whose language has a chunker."""
        if not self.chunkers:
            raise UnsupportedLanguageError("no chunker is registered")
        return reduce(DataFrame.unionByName, (self.chunk_as(files, lang) for lang in self.supported()))


def index_stats(files: DataFrame, chunks: DataFrame, supported: list[str]) -> DataFrame:
    """files (that gave chunks), chunks and skipped, as one row."""
    skipped = files.agg(F.count_if(~F.col("lang").isin(supported)).alias("skipped"))
    made = chunks.agg(F.count_distinct("source").alias("files"), F.count(F.lit(1)).alias("chunks"))
    return made.crossJoin(F.broadcast(skipped))  # one row each


def last_write(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key: the last by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """base with the rows of new in place of those with equal keys; of equal keys within new, one row stays."""
    once = new.dropDuplicates([key])
    return base.join(once.select(key), key, "left_anti").unionByName(once, allowMissingColumns=True)


def delete(base: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


class Store:
    """Chunks, postings and vectors in segments under one folder, and numbered manifests that list the segments of a version.

    A write adds one segment, in proportion to what it writes, and then a manifest; the highest number is the current version, so readers see a whole version or
    the one before, also if a writer dies half-way, and of two writers of one version the later fails. A segment holds chunks by length, with row numbers; their ids in order; blocks of
    postings by term; vectors by cluster; document frequencies, less those of what the write replaced; and bitmaps of the rows that it replaced or deleted in segments before it.

    The rows that a write replaces are looked up by id, and only their texts are read again, for what they take from the statistics. Readers test the bitmaps at the scan, in no join;
    they hold a bit for each row of a touched stretch, compressed. `compact` writes one segment of all that lives, by itself after MAX_SEGMENTS writes or when the bitmaps pass DEAD_BYTES, so what
    a reader ships to its tasks is bounded; `vacuum` removes what no current manifest lists. A read-only store cannot write.
    """

    MAX_SEGMENTS = 32
    DEAD_BYTES = 16 << 20
    #: Most ids that become a filter on a lookup.
    LOOKUP = 4096

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self._dead: tuple[int, Dead] | None = None
        self._schemas: dict[tuple[str, str], str] = {}

    # ---- manifests

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def manifest(self) -> dict | None:
        numbers = sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())
        if not numbers:
            return None
        path, fs = self._path(f"manifests/{numbers[-1]:012}.json")
        stream = fs.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found.get("format_version") != FORMAT_VERSION:
            raise StorageError(f"format {found.get('format_version')}, expected {FORMAT_VERSION}")
        self._schemas |= {(s, t): schema for s, own in found["tables"].items() for t, schema in own.items()}
        return found

    def _commit(self, manifest: dict) -> dict:
        """Writes the manifest beside its place and moves it there; nothing that exists is touched."""
        new, fs = self._path(f"manifests/.{uuid.uuid4()}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        path, _ = self._path(f"manifests/{manifest['version']:012}.json")
        if fs.exists(path) or not fs.rename(new, path):
            fs.delete(new, False)
            raise StorageError(f"version {manifest['version']} was written by another writer")
        return manifest

    def _current(self) -> dict:
        found = self.manifest()
        if found is None:
            raise NotFoundError(self.root)
        return found

    # ---- reading

    def _read(self, segment: str, table: str) -> DataFrame:
        """A table of a segment; its schema, where the manifest has it, is not read from the files again."""
        known = self._schemas.get((segment, table))
        reader = self.spark.read.schema(T.StructType.fromJson(json.loads(known))) if known else self.spark.read
        return reader.parquet(f"{self.root}/segments/{segment}/{table}")

    def dead(self, m: dict) -> Dead:
        """The bitmaps of a version. They are kept for the next read of it."""
        if self._dead is None or self._dead[0] != m["version"]:
            maps: dict[tuple[int, int], np.ndarray] = {}
            places = {s: i for i, s in enumerate(m["segments"])}
            for s in m["segments"]:
                if "dead" in m["tables"][s]:
                    for r in self._read(s, "dead").filter(F.col("segment").isin(list(places))).collect():  # bounded by DEAD_BYTES
                        key = places[r["segment"]], r["bucket"]
                        bits = np.frombuffer(r["bits"], dtype=np.uint8)
                        maps[key] = maps[key] | bits if key in maps else bits
            self._dead = m["version"], Dead({k: zlib.compress(v.tobytes()) for k, v in maps.items()})
        return self._dead[1]

    def _segments(self, m: dict, table: str, live: bool = True) -> DataFrame | None:
        """Rows of a table of all segments, with the place of their segment; without dead rows, where the table has row numbers."""
        dead, parts = self.dead(m) if live else None, []
        for i, s in enumerate(m["segments"]):
            if table in m["tables"][s]:
                rows = self._read(s, table)
                if live and dead.touches(i):
                    rows = rows.filter(dead.alive_in(i)(F.col("_row")))
                parts.append(rows.withColumn("_segment", F.lit(i)))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _rows(self, m: dict) -> DataFrame:
        rows = self._segments(m, "chunks")
        if rows is None:
            raise NotFoundError("the store has no chunks")
        return rows

    def chunks(self, model_id: str | None = None, dim: int = 0) -> DataFrame:
        """The current chunks; model and width, where given, must be those of the store. Width 0 takes what the store has."""
        m = self._current()
        if model_id is not None and model_id != m["embedder_model_id"]:
            raise StorageError(f"indexed with {m['embedder_model_id']}, asked with {model_id}")
        if dim and dim != m["embedder_dim"]:
            raise DimensionError(f"width {m['embedder_dim']} in the store, {dim} asked")
        return self._rows(m).drop("_row", "_segment")

    def _blocks(self, m: dict) -> DataFrame:
        if not m["fulltext"]:
            raise NotFoundError("the store has no full text")
        return self._segments(m, "postings", live=False)

    def postings(self) -> DataFrame:
        """field, term, id, tf and dl of the current chunks."""
        m = self._current()
        return decode_postings(self._blocks(m), self.dead(m).alive)

    def text_index(self) -> TextIndex | None:
        """What a full-text search reads: blocks of postings, and statistics that each write has kept up to date. None without full text."""
        m = self._current()
        if not m["fulltext"]:
            return None
        n = m["lengths"]["n"]
        return TextIndex(self._blocks(m), self._segments(m, "terms", live=False), n, {f: m["lengths"][f] / n if n else 0.0 for f in FIELDS}, self._rows(m), self.dead(m).alive)

    def vector_index(self) -> VectorIndex | None:
        """What a vector search reads: vectors by cluster, with centres and radii. None without vectors."""
        m = self._current()
        vectors, heads = self._segments(m, "vectors"), self._segments(m, "clusters", live=False)
        return None if vectors is None or heads is None else VectorIndex(vectors, heads)

    def count(self) -> int:
        return self._current()["lengths"]["n"]

    def is_empty(self) -> bool:
        return self.count() == 0

    # ---- writing

    def _found(self, m: dict, ids: DataFrame) -> DataFrame | None:
        """_segment, _row and chunk_id of the live rows with these ids."""
        rows = self._segments(m, "ids")
        if rows is None:
            return None
        few = [r[0] for r in ids.limit(self.LOOKUP + 1).collect()]
        if len(few) <= self.LOOKUP:
            return rows.filter(F.col("chunk_id").isin(few))  # read from the row groups that may hold them
        return rows.join(ids, "chunk_id", "left_semi")

    def _write(self, m: dict, chunks: DataFrame | None, gone: DataFrame | None = None, fresh: bool = False, files: DataFrame | None = None) -> dict:
        """A new version: the segments of m, none of them if fresh, and one more with chunks, in place of those with their ids and of the ids in gone. files: what is known of files from now on."""
        name = uuid.uuid4().hex
        base, counts = f"{self.root}/segments/{name}", []
        tables: dict[str, str] = {}
        total = dict.fromkeys(("n", *FIELDS), 0) if fresh else dict(m["lengths"])

        def write(table: str, rows: DataFrame, **options: str) -> None:
            rows.write.options(**{"compression": "zstd", **options}).parquet(f"{base}/{table}")
            tables[table] = self._schemas[name, table] = rows.schema.json()

        small = {"parquet.block.size": str(8 << 20)}  # row groups that lookups can skip
        if chunks is not None:
            by_length = chunks.sortWithinPartitions(F.length("content")) if "content" in chunks.columns else chunks
            write("chunks", by_length.withColumn("_row", F.monotonically_increasing_id()), **{"parquet.bloom.filter.enabled#chunk_id": "true", **small})
            stored = self._read(name, "chunks")
            if "embedding" in stored.columns:
                if m["embedder_dim"] and not stored.filter(F.size("embedding") != m["embedder_dim"]).isEmpty():
                    raise DimensionError(f"an embedding is not of width {m['embedder_dim']}")
                digest = content_digest(F.col("content")) if "content" in stored.columns else F.lit(None).cast("string")
                write("vectors", with_clusters(stored.withColumn("_digest", digest).drop(*FIELDS)), **small)
                write("clusters", heads_of(self._read(name, "vectors")))
            write("ids", stored.select("chunk_id", "_row").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id"), **small)
            if "source" in stored.columns:
                write("sources", stored.select("source", "chunk_id", "_row").repartitionByRange("source").sortWithinPartitions("source"), **small)
            own = self._read(name, "ids").select("chunk_id")
            gone = own if gone is None else own.unionByName(gone.select("chunk_id")).distinct()
            if m["fulltext"]:
                write("postings", self._built(stored).sortWithinPartitions("term", "field", "win"), **small)
                blocks = self._read(name, "postings")
                counts.append(term_counts(blocks))
                added = self._totals(blocks)
            else:
                added = {"n": stored.count(), **dict.fromkeys(FIELDS, 0)}
            total = {k: total[k] + added[k] for k in total}
        hits = None if fresh or gone is None else self._found(m, gone)
        if hits is not None:
            # the rows themselves are few; what follows reads them from here
            hits = settled(hits.select("_segment", "_row", "chunk_id"))
            n = hits.count()
            if n:
                places = local(self.spark, _segment=pa.array(range(len(m["segments"])), pa.int32()), segment=pa.array(m["segments"]))
                bits = F.bitmap_construct_agg(F.col("_row").bitwiseAND(BUCKET - 1)).alias("bits")
                write("dead", hits.join(F.broadcast(places), "_segment").groupBy("segment", F.shiftright("_row", BUCKET_BITS).alias("bucket")).agg(bits))  # a row for each segment of places
                taken = {"n": n, **dict.fromkeys(FIELDS, 0)}
                if m["fulltext"]:
                    rows = self._segments(m, "chunks")
                    if n <= self.LOOKUP:
                        rows = rows.filter(F.col("chunk_id").isin([r[0] for r in hits.select("chunk_id").distinct().collect()]))
                    killed = rows.join(hits.select("_segment", "_row"), ["_segment", "_row"], "left_semi")
                    blocks = settled(self._built(killed))
                    taken |= {f: v for f, v in self._totals(blocks).items() if f in FIELDS}
                    counts.append(term_counts(blocks).withColumn("df", -F.col("df")))
                total = {k: total[k] - taken[k] for k in total}
        if counts:
            write("terms", reduce(DataFrame.unionByName, counts).groupBy("field", "term").agg(F.sum("df").alias("df")).repartitionByRange("term").sortWithinPartitions("term"), **small)
        if files is not None:
            write("files", files.select("source", "modified", "length", "digest", "removed").repartitionByRange("source").sortWithinPartitions("source"), **small)
        segments = [*([] if fresh else m["segments"]), name]
        listed = {s: w for s, w in (m["tables"] | {name: tables}).items() if s in segments}
        return self._commit(m | {"version": m["version"] + 1, "segments": segments, "tables": listed, "lengths": total})

    @staticmethod
    def _built(rows: DataFrame) -> DataFrame:
        """Blocks of rows with row numbers."""
        rows, _ = with_fields(rows)
        for f in FIELDS:
            rows = rows if f in rows.columns else rows.withColumn(f, F.lit(""))
        return build_blocks(rows, FIELDS)

    @staticmethod
    def _totals(blocks: DataFrame) -> dict:
        """Rows, and grams of each field, from the rows of documents that windows have."""
        found = {r["field"]: r for r in blocks.filter(F.col("term") == DOCS).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
        return {"n": int(max((r["n"] for r in found.values()), default=0)), **{f: int(found[f]["total"]) if f in found else 0 for f in FIELDS}}

    def _writable(self) -> None:
        if self.read_only:
            raise ReadOnlyError(self.root)

    def open_or_create(self, model_id: str, dim: int, fulltext: bool = True) -> dict:
        """The current manifest, or that of an empty store. An existing store must have this model and width; width 0 takes what the store has, which must exist then."""
        found = self.manifest()
        if found is not None:
            if model_id != found["embedder_model_id"]:
                raise StorageError(f"indexed with {found['embedder_model_id']}, asked with {model_id}")
            if dim and dim != found["embedder_dim"]:
                raise DimensionError(f"width {found['embedder_dim']} in the store, {dim} asked")
            return found
        if not dim:
            raise NotFoundError(f"{self.root}: a new store needs a width")
        self._writable()
        return self.save(self.spark.createDataFrame([], CHUNK).withColumn("embedding", F.lit(None).cast("array<float>")), model_id, dim, fulltext)

    def save(self, chunks: DataFrame, model_id: str, dim: int, fulltext: bool = True) -> dict:
        """Writes chunks (with embeddings) in place of all that the store has."""
        self._writable()
        version = (self.manifest() or {"version": 0})["version"]
        m = {"format_version": FORMAT_VERSION, "embedder_model_id": model_id, "embedder_dim": dim, "version": version, "segments": [], "tables": {}, "fulltext": fulltext}
        return self._write(m, chunks, fresh=True)

    def _added(self, m: dict) -> dict:
        return self.compact() if len(m["segments"]) > self.MAX_SEGMENTS or self.dead(m).size > self.DEAD_BYTES else m

    def upsert(self, new: DataFrame) -> dict:
        """Adds chunks, in place of those with equal ids; of equal ids within new, one row stays."""
        self._writable()
        return self._added(self._write(self._current(), new.dropDuplicates(["chunk_id"])))

    def replace(self, gone: DataFrame, new: DataFrame, files: DataFrame | None = None) -> dict:
        """Adds chunks, in place of those with equal ids and of the ids in gone, as one version; files (source, modified, length, digest, removed) are noted with it."""
        self._writable()
        once = new.dropDuplicates(["chunk_id"])
        return self._added(self._write(self._current(), once, gone.select("chunk_id").distinct(), files=files))

    def files(self) -> DataFrame:
        """source, modified, length and digest of the files that the current chunks come from, as last noted."""
        return self._files(self._current())

    def _files(self, m: dict) -> DataFrame:
        noted = self._segments(m, "files", live=False)
        if noted is None:
            return self.spark.createDataFrame([], "source string, modified timestamp, length long, digest string")
        last = noted.groupBy("source").agg(F.max_by(F.struct("modified", "length", "digest", "removed"), "_segment").alias("f"))
        return last.select("source", "f.*").filter("NOT removed").drop("removed")

    def ids_of(self, sources: DataFrame) -> DataFrame:
        """chunk_id of the current chunks of these sources."""
        rows = self._segments(self._current(), "sources")
        if rows is None:
            raise NotFoundError("the store's chunks have no source")
        few = [r[0] for r in sources.select("source").limit(self.LOOKUP + 1).collect()]
        found = rows.filter(F.col("source").isin(few)) if len(few) <= self.LOOKUP else rows.join(sources.select("source"), "source", "left_semi")
        return found.select("chunk_id")

    def known_vectors(self, digests: DataFrame) -> DataFrame | None:
        """digest and embedding of texts (by content_digest) that any segment has embedded, one row for each. None if nothing is embedded."""
        m = self.manifest()
        rows = None if m is None else self._segments(m, "vectors", live=False)
        if rows is None:
            return None
        few = [r[0] for r in digests.select("digest").limit(self.LOOKUP + 1).collect()]
        rows = rows.select(F.col("_digest").alias("digest"), "embedding")
        rows = rows.filter(F.col("digest").isin(few)) if len(few) <= self.LOOKUP else rows.join(digests.select("digest"), "digest", "left_semi")
        return rows.dropDuplicates(["digest"])

    def delete(self, ids: DataFrame) -> dict:
        self._writable()
        return self._added(self._write(self._current(), None, ids.select("chunk_id").distinct()))

    def compact(self) -> dict:
        """A version of one segment with all live chunks."""
        self._writable()
        m = self._current()
        noted = any("files" in own for own in m["tables"].values())
        files = self._files(m).withColumn("removed", F.lit(False)) if noted else None
        return self._write(m, self._rows(m).drop("_row", "_segment"), fresh=True, files=files)

    def vacuum(self) -> list[str]:
        """Removes manifests before the current one and segments that it does not list; returns the segments removed. For when no reader is at an older version."""
        self._writable()
        m = self._current()
        dead = [s for s in self._names("segments") if s not in m["segments"]]
        for name in [f"segments/{s}" for s in dead] + [f"manifests/{n}" for n in self._names("manifests") if n != f"{m['version']:012}.json"]:
            path, fs = self._path(name)
            fs.delete(path, True)
        return dead


class Dead:
    """Compressed bitmaps of dead rows by place of segment and bucket of BUCKET rows; tasks look rows up in them."""

    def __init__(self, maps: dict[tuple[int, int], bytes]):
        self.maps = maps
        self.size = sum(map(len, maps.values()))
        self.places = {s for s, _ in maps}

    def touches(self, segment: int) -> bool:
        return segment in self.places

    def alive_in(self, segment: int):
        """alive(column of row numbers) -> column of booleans. Only the numbers go to Python."""
        maps = {b: z for (s, b), z in self.maps.items() if s == segment}

        @F.pandas_udf("boolean")
        def alive(rows: pd.Series) -> pd.Series:
            r = rows.to_numpy()
            out = np.ones(len(r), dtype=bool)
            for b in np.unique(r >> BUCKET_BITS).tolist():
                if b in maps:
                    own = (r >> BUCKET_BITS) == b
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(maps[b]), dtype=np.uint8), bitorder="little")
                    out[own] = bits[r[own] & (BUCKET - 1)] == 0
            return pd.Series(out)

        return alive

    def alive(self, segment: int, win: int) -> np.ndarray:
        """The live rows of a window of postings."""
        found = self.maps.get((segment, win >> (BUCKET_BITS - SHIFT)))
        if found is None:
            return np.ones(WINDOW, dtype=bool)
        at = (win << SHIFT & (BUCKET - 1)) // 8
        return np.unpackbits(np.frombuffer(zlib.decompress(found)[at : at + WINDOW // 8], dtype=np.uint8), bitorder="little") == 0


def content_digest(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def embed_once(chunks: DataFrame, store: Store, embed: Callable[[Column], Column]) -> DataFrame:
    """chunks with embeddings: of texts that the store has embedded, from there; of the others each different text goes to the model once."""
    rows = settled(chunks.withColumn("_digest", content_digest(F.col("content"))))
    texts = rows.groupBy(F.col("_digest").alias("digest")).agg(F.any_value("content").alias("content"))
    known = store.known_vectors(texts)
    new = texts if known is None else texts.join(known, "digest", "left_anti")
    # apart from the join: the model's column must not be computed for rows that have a vector
    made = settled(new.select("digest", embed(F.col("content")).alias("embedding")))
    vectors = made if known is None else made.unionByName(known.withColumn("embedding", F.col("embedding").cast(made.schema["embedding"].dataType)))
    return rows.join(vectors, F.col("_digest") == F.col("digest"), "left").drop("_digest", "digest")


def noted_files(files: DataFrame) -> DataFrame:
    """source, modified, length, digest and removed of files with content."""
    return files.select("source", F.col("modificationTime").alias("modified"), F.col("length").cast("long").alias("length"), F.sha2("content", 256).alias("digest"), F.lit(False).alias("removed"))


def index_folder(spark: SparkSession, root: str, store: Store, embed: Callable[[Column], Column], model_id: str, dim: int, dispatcher: Dispatcher | None = None, fulltext: bool = True) -> dict:
    """Chunks, embeds and stores a folder; returns files, chunks and skipped. Texts that the store has embedded with this model before are not embedded again."""
    d = dispatcher or Dispatcher.default()
    files = corpus.read_text(corpus.scan(spark, root))
    chunks = d.chunk(files)
    before = store.manifest()
    same = before is not None and (before["embedder_model_id"], before["embedder_dim"]) == (model_id, dim)
    store.save(embed_once(chunks, store, embed) if same else chunks.withColumn("embedding", embed(F.col("content"))), model_id, dim, fulltext)
    return index_stats(files, store.chunks(), d.supported()).first().asDict()


#: Most paths of one read.
PATHS = 10_000


def sync_folder(spark: SparkSession, root: str, store: Store, embed: Callable[[Column], Column], model_id: str, dim: int, dispatcher: Dispatcher | None = None) -> dict:
    """Brings the store up to what the folder has now; returns the numbers of files added, changed, removed and touched (new time, same bytes).

    The store knows each file's time, length and digest. Files with the time and length noted are not opened. All chunks of a changed file go, also those whose place in the file has moved, those of a removed file go,
    and both with the new ones in one version: a run that stops half-way leaves the version before, and the next one does it all. Texts known to the store are not embedded again.
    """
    d = dispatcher or Dispatcher.default()
    store.open_or_create(model_id, dim)
    there = corpus.listing(spark, root).select("path", "source", "modificationTime", "length")
    known = store.files().select(F.col("source").alias("_source"), "modified", F.col("length").alias("_length"), F.col("digest").alias("_digest"))
    met = there.join(known, F.col("source") == F.col("_source"), "full")
    same = F.coalesce((F.col("modificationTime") == F.col("modified")) & (F.col("length") == F.col("_length")), F.lit(False))
    open_ = settled(met.filter(~same))
    paths = [r[0] for r in open_.filter("path IS NOT NULL").select("path").collect()]  # names of what has changed
    removed = open_.filter("path IS NULL").select(F.col("_source").alias("source"))
    reads = [corpus.scan_paths(spark, root, paths[at : at + PATHS]) for at in range(0, len(paths), PATHS)]
    files = settled(reduce(DataFrame.unionByName, reads) if reads else corpus.scan_paths(spark, root, []))
    noted = noted_files(files).join(open_.select(F.col("_source"), "_digest"), F.col("source") == F.col("_source"), "left")
    noted = settled(noted.select("source", "modified", "length", "digest", "removed", F.when(F.col("_source").isNull(), "added").when(F.col("digest") == F.col("_digest"), "touched").otherwise("changed").alias("kind")))
    counts = {r["kind"]: r["n"] for r in noted.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {k: counts.get(k, 0) for k in ("added", "changed", "touched")} | {"removed": removed.count()}
    if any(out.values()):
        new = noted.filter("kind <> 'touched'")
        chunks = embed_once(d.chunk(corpus.read_text(files.join(new.select("source"), "source", "left_semi"))), store, embed)
        left = removed.select("source", F.lit(None).cast("timestamp").alias("modified"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("digest"), F.lit(True).alias("removed"))
        old = noted.filter("kind = 'changed'").select("source").unionByName(removed)
        store.replace(store.ids_of(old), chunks, files=noted.drop("kind").unionByName(left))
    return out
