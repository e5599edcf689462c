"""Line dedup: hashes in range partitions, first occurrences streamed, bitmaps returned.

Each line becomes a row of two 64-bit hashes of its key, its document and its position. The rows are range-partitioned
by all of these and sorted within partitions, so a line that a third of all documents hold spreads over many
partitions. One pass streams through each partition with constant memory; where a key goes on in the next partition, the
first and last runs of all partitions (two small rows for each) settle its count. What comes back is a compressed bitmap
for each document that loses lines; texts meet it in one join. Very long texts are lists of lines like others; their bitmaps have a bit for each line.

Ids are numbers, or text that reads as one. Extra columns pass through whatever their names; a count of lost lines may not take one. A null or empty text is one empty line. Keys shorter than `min_chars` are never dropped. Rows that share a document id, null
included, count as one document. Equal rows get equal bitmaps. With keep_first the first place of a common line stays, and with
keep_first="document" all its places in the first document (the least id) that holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, forget, free_name, shared_checkpoint, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SORT = ("h1", "h2", "nil", "id", "a", "pos")


def _keys(doc_id: Column, text: Column) -> dict[str, Column]:
    return {"nil": doc_id.isNull(), "id": F.coalesce(doc_id.cast("long"), F.lit(0)), "a": F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")))}


def line_rows(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    lines = docs.select(*(v.alias(k) for k, v in _keys(d, t).items()), F.posexplode(F.split(F.coalesce(t, F.lit("")), "\n")).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(WS)), UPPER, LOWER)
    return lines.withColumn("key", key).filter(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "nil", "id", "a", "pos")


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: batch.column(k).to_numpy(zero_copy_only=False) for k in _SORT}


_KEY, _DOC = ("h1", "h2"), ("h1", "h2", "nil", "id")


def _runs(batch: pa.RecordBatch, last: tuple | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, bool]:
    """Columns, bounds of the runs of equal keys, documents that begin in each run, and whether the first run began before this batch.

    last: key and document of the row before the batch.
    """
    c = _columns(batch)
    new_key, new_doc = np.zeros(batch.num_rows, dtype=bool), np.zeros(batch.num_rows, dtype=bool)
    for new, names in ((new_key, _KEY), (new_doc, _DOC)):
        new[0] = last is None or tuple(c[n][0].item() for n in names) != last[: len(names)]
        for n in names:
            new[1:] |= c[n][1:] != c[n][:-1]
    bounds = np.flatnonzero(new_key)
    goes_on = not new_key[0]
    if goes_on:
        bounds = np.r_[0, bounds]
    return c, np.r_[bounds, batch.num_rows], np.add.reduceat(new_doc.astype(np.int64), bounds), goes_on


_EDGE = "part int, h1 long, h2 long, docs long, first_nil boolean, first_id long, first_a long, last_nil boolean, last_id long"


def _edges(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a partition: key, documents, first and last document."""
    first, current, last = None, None, None
    for batch in stream:
        if not batch.num_rows:
            continue
        c, bounds, docs, goes_on = _runs(batch, last)
        for j in dict.fromkeys((0, len(docs) - 1)):
            lo, hi = bounds[j], bounds[j + 1] - 1
            end = [c["nil"][hi].item(), c["id"][hi].item()]
            if j == 0 and goes_on:
                current[2] += int(docs[0])
                current[6:] = end
            else:
                current = [c["h1"][lo].item(), c["h2"][lo].item(), int(docs[j]), c["nil"][lo].item(), c["id"][lo].item(), c["a"][lo].item(), *end]
            first = current if first is None else first
        last = tuple(c[n][-1].item() for n in _DOC)
    if first is not None:
        found = [first] if current is first else [first, current]
        part = TaskContext.get().partitionId()
        columns = zip(*([part, *r] for r in found), strict=True)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _EDGE.split(", ")])


def _settle(edges: list) -> tuple[dict, set, dict]:
    """Documents of each key at a partition's edge, the (partition, key) runs that an earlier partition began, and the key's first document."""
    total: dict[tuple[int, int], int] = {}
    later: set[tuple[int, int, int]] = set()
    firsts: dict[tuple[int, int], tuple] = {}
    last: dict[tuple[int, int], tuple] = {}
    for e in edges:  # in order of partition and key
        key = (e["h1"], e["h2"])
        if key in total:
            later.add((e["part"], *key))
        firsts.setdefault(key, (e["first_nil"], e["first_id"], e["first_a"]))
        total[key] = total.get(key, 0) + e["docs"] - (last.get(key) == (e["first_nil"], e["first_id"]))
        last[key] = (e["last_nil"], e["last_id"])
    return total, later, firsts


def _dropper(total: dict, later: set, firsts: dict, min_docs: int, keep_first: bool | str):
    """Streams the rows of lines to drop; at most the rows of min_docs - 1 documents of one run wait."""
    names = ("nil", "id", "a", "pos")
    whole = keep_first == "document"
    same = names[:3] if whole else names  # what the rows that stay share with the first

    def leading(c: dict, lo: int, hi: int, first: tuple) -> int:
        """Rows of lo to hi that stay: those like the first of the key, which come first."""
        alike = np.ones(hi - lo, dtype=bool)
        for n, x in zip(same, first, strict=True):
            alike &= c[n][lo:hi] == x
        return int(alike.sum())

    def drop(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, docs, gone, wait, last, first = None, 0, None, [], None, None
        for batch in stream:
            if not batch.num_rows:
                continue
            rows = batch.select(names)
            c, bounds, n_docs, goes_on = _runs(batch, last)
            inner = n_docs >= min_docs
            inner[[0, -1]] = False  # they may go on in another batch or partition
            mask = np.repeat(inner, np.diff(bounds))
            if keep_first:
                began = np.repeat(bounds[:-1], np.diff(bounds))
                mask &= np.logical_or.reduce([c[n] != c[n][began] for n in same])
            for j in dict.fromkeys((0, len(n_docs) - 1)):
                lo, hi = bounds[j], bounds[j + 1]
                if not (j == 0 and goes_on):
                    key, docs, wait = (c["h1"][lo].item(), c["h2"][lo].item()), 0, []
                    gone = total[key] >= min_docs if key in total else None
                    if whole:
                        first = firsts.get(key) or tuple(c[n][lo].item() for n in same)
                    elif keep_first:  # equal rows are in one partition
                        first = None if (part, *key) in later else tuple(c[n][lo].item() for n in same)
                head = leading(c, lo, hi, first) if first is not None else 0
                docs += int(n_docs[j])
                if gone is None and docs >= min_docs:
                    gone = True
                    yield from wait
                    wait = []
                if gone:
                    mask[lo + head : hi] = True
                elif gone is None:
                    wait.append(rows.slice(lo + head, hi - lo - head))
            picked = np.flatnonzero(mask)
            if len(picked):
                yield rows.take(pa.array(picked))
            last = tuple(c[n][-1].item() for n in _DOC)

    return drop


@F.pandas_udf(T.BinaryType())
def _bitmap(n_bits: pd.Series, gone: pd.Series) -> pd.Series:
    """Compressed bits, one for each line up to the last that goes: 1 keeps it. Later lines stay."""
    out = []
    for n, at in zip(n_bits, gone, strict=True):
        keep = np.ones(n, dtype=bool)
        keep[np.asarray(at, dtype=np.int64)] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def _keep(text: pd.Series, n_bits: pd.Series, bits: pd.Series) -> pd.Series:
    out = []
    for t, n, b in zip(text, n_bits, bits, strict=True):
        if b is not None and t is not None:
            keep = np.unpackbits(np.frombuffer(zlib.decompress(b), dtype=np.uint8), count=int(n)).tolist()
            lines = t.split("\n")
            t = "\n".join([x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :])
        out.append(t)
    return pd.Series(out, dtype=object)


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool | str = False) -> DataFrame:
    """nil, id, a (the document's key) and pos of each line to drop."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = shared_checkpoint(line_rows(docs, doc_id, text, min_chars))  # texts are cut and hashed once; the sample for the ranges reads hashes
    rows = shared_checkpoint(cut.repartitionByRange(n, *_SORT).sortWithinPartitions(*_SORT))
    forget(cut)
    # two rows for each partition; only of keys that go on in another one, which are few, they come to the driver
    edge = shared_checkpoint(rows.mapInArrow(_edges, _EDGE))
    wide = edge.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = edge.join(wide, ["h1", "h2"], "left_semi").collect()
    edges.sort(key=lambda e: (e["part"], e["h1"], e["h2"]))
    total, later, firsts = _settle(edges)
    return rows.mapInArrow(_dropper(total, later, firsts, min_docs, keep_first), "nil boolean, id long, a long, pos int")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool | str = False) -> DataFrame:
    """nil, id, a, bits, n_bits and n_dropped for each document that loses lines."""
    found = dropped_lines(docs, doc_id, text, min_docs, min_chars, keep_first)
    at = found.groupBy("nil", "id", "a").agg(F.array_sort(F.collect_set("pos")).alias("gone")).withColumn("n_bits", F.element_at("gone", -1) + 1)
    return at.select("nil", "id", "a", "n_bits", _bitmap("n_bits", "gone").alias("bits"), F.size("gone").cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool | str = False, dropped: str | None = None) -> DataFrame:
    """docs with `text` reduced to its kept lines; the number of lines lost in a column named by `dropped`.

    A null text stays null. Texts move once, to meet their bitmaps.
    """
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    if dropped and dropped.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {dropped} already")
    keys = _keys(d, t)
    own = {k: free_name(docs.columns, f"{k}_of_row") for k in keys}
    bitmaps = keep_bitmaps(docs, doc_id, text, min_docs, min_chars, keep_first)
    found = {k: free_name(docs.columns, f"{k}_of_bitmap") for k in bitmaps.columns}
    bitmaps = bitmaps.select(*(F.col(k).alias(v) for k, v in found.items())).hint("shuffle_hash")
    on = [F.col(own[k]) == F.col(found[k]) for k in keys]
    joined = docs.select("*", *(v.alias(own[k]) for k, v in keys.items())).join(bitmaps, on, "left")
    out = [_keep(t, F.col(found["n_bits"]), F.col(found["bits"])).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if dropped:
        out.append(F.coalesce(F.col(found["n_dropped"]), F.lit(0).cast("long")).alias(dropped))
    return joined.select(*out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    out = dedup_lines(docs, dropped="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(g.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g USING (key) GROUP BY doc_id
"""
