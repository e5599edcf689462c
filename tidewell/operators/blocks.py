"""Full-text search on stored blocks of postings with positions.

Rows are numbered, and WINDOW neighbours form a window. A block holds all postings of one gram of one field in one window: which rows, how often, and for grams of two characters at which
places, as deltas. Its header says how good its best posting can be, whatever the lengths of other documents are: BM25 of a posting grows with
1 / (0.3 / tf + 0.9 / avg * dl / tf), so the most occurrences and the least ratio of length to occurrences bound it.

A search reads the headers of the grams asked for first. They give each query a bound for each window, none where a word cannot be there. The windows with the best bounds are read
and scored; the k-th score that they give rules out all windows whose bound is lower, and only blocks of what is left are read and move. So the hits are
those of a scan, ties included, and of a frequent gram only the blocks of promising windows are read. Rows are stored by length, so that windows differ in what they promise.

A word stands in a field if it is a part of it: for two or three characters its own postings say so, for more the places of its grams meet. A quoted phrase is a word with
spaces. Rows that are dead, or that `keep` leaves out, are not scored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import local, settled
from .fulltext import K1, SIZES, Word, B, _plans, bm25, gram_count, grams_of, idf_of
from .fusion import rank_hits

WINDOW = 256
SHIFT = 8
#: Windows that a query reads before it knows its k-th score.
FIRST = 8
#: The term of a window's row of documents, and of its rows that a filter keeps.
DOCS, KEPT = "", "\x00"
_CODE = 21


# ---- numbers as bytes ------------------------------------------------------------------------------------------------


def pack_deltas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, the lowest first, a high bit where more follow; and how many bytes each number takes."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), dtype=np.int64)
    for bits in range(7, 64, 7):
        size += x >> np.uint64(bits) > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[(ends - size)[on] + k] = (x[on] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | np.where(size[on] > k + 1, 0x80, 0).astype(np.uint8)
    return out, size


def unpack_deltas(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    last = b < 0x80
    number = np.cumsum(np.r_[0, last[:-1]]) if len(b) else np.zeros(0, dtype=np.int64)
    first = np.r_[0, np.flatnonzero(last)[:-1] + 1] if len(b) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(b)) - first[number]
    out = np.zeros(int(last.sum()), dtype=np.int64)
    np.add.at(out, number, (b & 0x7F).astype(np.int64) << (7 * place))
    return out


# ---- building --------------------------------------------------------------------------------------------------------


def _slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """data's bytes cut at bounds (in items)."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype("<i4").tobytes()), pa.py_buffer(raw.tobytes())])


def _grams(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and places of the grams of n characters, in order of key, document and place; and the n codes of each."""
    m = len(codes) - n + 1
    if m <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros((0, n), dtype=np.int64),)
    inside = np.flatnonzero(doc[:m] == doc[n - 1 :])
    key = np.zeros(len(inside), dtype=np.int64)
    for k in range(n):
        key = key << _CODE | codes[inside + k]
    order = np.argsort(key, kind="stable")
    return key[order], doc[inside[order]], inside[order], codes[inside[order][:, None] + np.arange(n)]


def encode_field(name: str, texts: list[str], offsets: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array] | None:
    """Blocks of one field of a window: texts in lower case, the row's offset and length in grams of each. Columns are those of BLOCKS from `field` on."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    doc, began = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    parts = []
    for n in SIZES:
        key, d, at, chars = _grams(codes, doc, n)
        if not len(key):
            continue
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_doc = new_key | np.r_[True, d[1:] != d[:-1]]
        first = np.flatnonzero(new_doc)  # a posting each
        tf, who = np.diff(np.r_[first, len(key)]), d[first]
        blocks = np.flatnonzero(new_key[first])
        bounds = np.r_[blocks, len(first)]
        ratio = lengths[who] / tf
        terms = chars[np.flatnonzero(new_key)].astype("<u4").tobytes().decode("utf-32-le")
        if n == 2:
            place = at - began[d]
            raw, size = pack_deltas(np.where(new_doc, place, place - np.r_[0, place[:-1]]))
            ends = np.r_[0, np.cumsum(size)][np.r_[np.flatnonzero(new_key), len(key)]]
            places = _slices(raw, ends)
        else:
            places = pa.nulls(len(blocks), pa.binary())
        parts.append(
            {
                "field": pa.array([name] * len(blocks)), "term": pa.array([terms[i : i + n] for i in range(0, len(terms), n)]), "n": pa.array(np.diff(bounds), pa.int32()),
                "max_tf": pa.array(np.maximum.reduceat(tf, blocks), pa.int32()), "min_ratio": pa.array(np.minimum.reduceat(ratio, blocks), pa.float64()),
                "offsets": _slices(offsets[who].astype(np.uint8), bounds), "tf": _slices(tf.astype("<u4"), bounds), "places": places,
            }
        )
    return {k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]} if parts else None


BLOCKS = "win long, field string, term string, n int, max_tf int, min_ratio double, offsets binary, tf binary, places binary, total long, ids array<{id}>"
_NAMES = ("win", "field", "term", "n", "max_tf", "min_ratio", "offsets", "tf", "places", "total", "ids")


def _builder(fields: tuple[str, ...]):
    """Blocks of a task's rows (row, id, texts); rows of a window follow each other."""

    def window(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        row, id_type = rows.column(0).to_numpy(), rows.schema.field(1).type
        ids = rows.column(1).combine_chunks()
        win, offsets, n = int(row[0]) >> SHIFT, (row & (WINDOW - 1)).astype(np.int64), len(row)
        for f, name in enumerate(fields):
            texts = [(t or "").lower() for t in rows.column(2 + f).to_pylist()]
            lengths = np.array([gram_count(len(t)) for t in texts], dtype=np.int64)
            one = lambda x: pa.array([x], pa.binary())
            bounds = pa.array([0, n if f == 0 else 0], pa.int32())
            docs = [pa.array([win]), pa.array([name]), pa.array([DOCS]), pa.array([n], pa.int32()), pa.array([0], pa.int32()), pa.array([0.0]), one(offsets.astype(np.uint8).tobytes()), one(lengths.astype("<u4").tobytes()), one(None), pa.array([int(lengths.sum())]), pa.ListArray.from_arrays(bounds, ids if f == 0 else ids.slice(0, 0))]
            yield pa.RecordBatch.from_arrays(docs, names=list(_NAMES))
            made = encode_field(name, texts, offsets, lengths)
            if made:
                m = len(made["n"])
                nothing = pa.nulls(m, pa.list_(id_type))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, win)), *made.values(), pa.array(np.zeros(m, dtype=np.int64)), nothing], names=list(_NAMES))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        at = None
        for batch in stream:
            if not batch.num_rows:
                continue
            wins = batch.column(0).to_numpy() >> SHIFT
            cuts = [0, *(np.flatnonzero(np.diff(wins)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if waiting and wins[a] != at:
                    yield from window(pa.Table.from_batches(waiting))
                    waiting = []
                at = wins[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from window(pa.Table.from_batches(waiting))

    return run


def build_blocks(rows: DataFrame, fields: tuple[str, ...], id_col: str = "chunk_id", row: str = "_row") -> DataFrame:
    """Blocks of rows, whose numbers are neighbours in each partition. One pass, nothing is shuffled; sort by term before storing."""
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(row), F.col(id_col), *(F.col(f) for f in fields)).mapInArrow(_builder(fields), BLOCKS.replace("{id}", kind))


def term_counts(blocks: DataFrame) -> DataFrame:
    """field, term and df, from headers."""
    return blocks.filter(F.col("term") != DOCS).groupBy("field", "term").agg(F.sum(F.col("n").cast("long")).alias("df"))


def _stats(fields: int):
    """(term, df, cf) of a task's texts: a row for each gram of a window, not of a document."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, WINDOW):
                texts = [(t or "").lower() for t in batch.column(0).slice(at, WINDOW).to_pylist()]
                sizes = np.array([len(t) for t in texts])
                codes, doc = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64), np.repeat(np.arange(len(texts)), sizes)
                for n in SIZES:
                    key, d, _, chars = _grams(codes, doc, n)
                    if len(key):
                        new_key = np.r_[True, key[1:] != key[:-1]]
                        first = np.flatnonzero(new_key)
                        new_doc = new_key | np.r_[True, d[1:] != d[:-1]]
                        terms = chars[first].astype("<u4").tobytes().decode("utf-32-le")
                        yield pa.RecordBatch.from_arrays([pa.array([terms[i : i + n] for i in range(0, len(terms), n)]), pa.array(np.add.reduceat(new_doc.astype(np.int64), first)), pa.array(np.diff(np.r_[first, len(key)]))], names=["term", "df", "cf"])

    return run


def gram_stats(docs: DataFrame, text: str = "content") -> DataFrame:
    """term, df and cf of a column of texts, counted within each task's windows before they meet."""
    made = docs.select(text).mapInArrow(_stats(1), "term string, df long, cf long")
    return made.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


# ---- windows ---------------------------------------------------------------------------------------------------------


def _by_window(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """((segment, win), rows) of a sorted stream."""
    key, rows = None, []
    for batch in stream:
        for r in batch.to_pylist():
            own = (r["_segment"], r["win"])
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append(r)
    if rows:
        yield key, rows


@dataclass(frozen=True)
class Plan:
    """What tasks know of a block of queries: words, idf by (field, gram), mean lengths."""

    queries: list[tuple]
    fields: tuple[str, ...]
    idf: dict[tuple[str, str], float]
    avg: dict[str, float]

    def allowed(self, w: Word) -> tuple[str, ...]:
        return self.fields if w.field is None else (w.field,)

    def bound(self, words: list[Word], heads: dict[tuple[str, str], tuple[int, float]]) -> float | None:
        """The most that a row of a window can score, or None if none can match."""
        total = 0.0
        for w in words:
            if w.wanted:
                found = None
                for f in self.allowed(w):
                    own = [heads.get((f, g)) for g in w.grams]
                    if None not in own:
                        found = (found or 0.0) + sum(self.idf.get((f, g), 0.0) * (K1 + 1) / (1 + K1 * ((1 - B) / tf + B * ratio / self.avg[f])) for g, (tf, ratio) in zip(w.grams, own, strict=True))
                if found is None:
                    return None
                total += found
        return total


def _bounder(plan: Plan):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (segment, win), rows in _by_window(stream):
            heads: dict[tuple[str, str], tuple[int, float]] = {}
            for r in rows:  # a window may have been built in two parts
                tf, ratio = heads.get((r["field"], r["term"]), (0, float("inf")))
                heads[r["field"], r["term"]] = max(tf, r["max_tf"]), min(ratio, r["min_ratio"])
            for q, (_, words) in enumerate(plan.queries):
                b = plan.bound(words, heads)
                if b is not None:
                    out.append((q, segment, win, b))
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["q", "_segment", "win", "bound"])

    return run


class Window:
    """The blocks of one window, decoded as they are asked for."""

    def __init__(self, rows: list[dict], alive: np.ndarray):
        self.blocks: dict[tuple[str, str], list[dict]] = {}
        self.dl: dict[str, np.ndarray] = {}
        self.ids: list = [None] * WINDOW
        there, kept, filtered = np.zeros(WINDOW, dtype=bool), np.zeros(WINDOW, dtype=bool), False
        for r in rows:
            at = np.frombuffer(r["offsets"], dtype=np.uint8)
            if r["term"] == KEPT:
                filtered = True
                kept[at] = True
            elif r["term"] == DOCS:
                self.dl.setdefault(r["field"], np.zeros(WINDOW, dtype=np.int64))[at] = np.frombuffer(r["tf"], dtype="<u4")
                there[at] = True
                for i, own in zip(at.tolist(), r["ids"] or (), strict=False):
                    self.ids[i] = own
            else:
                self.blocks.setdefault((r["field"], r["term"]), []).append(r)
        self.open = there & alive & (kept if filtered else True)
        self.known: dict = {}

    def tf(self, f: str, gram: str) -> np.ndarray:
        """Occurrences by row."""
        if ("tf", f, gram) not in self.known:
            out = np.zeros(WINDOW, dtype=np.int64)
            for r in self.blocks.get((f, gram), ()):
                out[np.frombuffer(r["offsets"], dtype=np.uint8)] = np.frombuffer(r["tf"], dtype="<u4")
            self.known["tf", f, gram] = out
        return self.known["tf", f, gram]

    def places(self, f: str, gram: str) -> np.ndarray:
        """row << 32 | place of each occurrence of a gram of two characters, ascending."""
        if ("at", f, gram) not in self.known:
            parts = [np.zeros(0, dtype=np.int64)]
            for r in self.blocks.get((f, gram), ()):
                at, tf = np.frombuffer(r["offsets"], dtype=np.uint8).astype(np.int64), np.frombuffer(r["tf"], dtype="<u4").astype(np.int64)
                run = np.cumsum(unpack_deltas(r["places"]))
                before = np.r_[0, run][np.cumsum(tf) - tf]
                parts.append((np.repeat(at, tf) << 32) | (run - np.repeat(before, tf)))
            self.known["at", f, gram] = np.sort(np.concatenate(parts))
        return self.known["at", f, gram]

    def holds(self, f: str, word: str, grams: tuple[str, ...]) -> np.ndarray:
        """Rows in whose field the word stands."""
        if ("in", f, word) not in self.known:
            if len(word) <= 3:
                out = self.tf(f, word) > 0
            else:
                out = self.open.copy()
                for g in grams:
                    out &= self.tf(f, g) > 0
                if out.any():
                    # grams at every second place cover the word; the last may overlap the one before
                    steps = [*range(0, len(word) - 2, 2), len(word) - 2]
                    found = None
                    for s in sorted(steps, key=lambda s: len(self.places(f, word[s : s + 2]))):
                        own = self.places(f, word[s : s + 2])
                        own = own[out[own >> 32]] - s
                        found = own if found is None else np.intersect1d(found, own, assume_unique=True)
                        if not len(found):
                            break
                    out = np.zeros(WINDOW, dtype=bool)
                    out[found[found >= 0] >> 32] = True
            self.known["in", f, word] = out
        return self.known["in", f, word]


def _scorer(plan: Plan, k: int, digits: int, alive: Callable[[int, int], np.ndarray]):
    """The best k of a task for each query."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in plan.queries]
        id_type = None
        for (segment, win), rows in _by_window(map(_noted := _Noted(), stream)):
            id_type = _noted.id_type
            w = Window(rows, alive(segment, win))
            for q, (_, words) in enumerate(plan.queries):
                match, score = w.open.copy(), np.zeros(WINDOW)
                for word in words:
                    own = {f: w.holds(f, word.text, word.grams) for f in plan.allowed(word)}
                    some = np.logical_or.reduce(list(own.values()))
                    match &= some if word.wanted else ~some
                    if not match.any():
                        break
                    for f, mask in own.items() if word.wanted else ():
                        if mask.any():
                            dl = w.dl[f]
                            for g in word.grams:
                                tf = w.tf(f, g)
                                score += np.where(mask, bm25(plan.idf.get((f, g), 0.0), tf, dl, plan.avg[f]), 0.0)
                found = np.flatnonzero(match)
                best[q] += [(-s, w.ids[i]) for i, s in zip(found.tolist(), np.round(score[found], digits).tolist(), strict=True)]
                if len(best[q]) > 4 * k + 256:
                    best[q] = heapq.nsmallest(k, best[q])
        for q, found in enumerate(best):
            if found:
                top = heapq.nsmallest(k, found)
                yield pa.RecordBatch.from_arrays([pa.array([plan.queries[q][0]] * len(top)), pa.array([i for _, i in top], id_type), pa.array([-s for s, _ in top], pa.float64())], names=["query_id", "id", "score"])

    return run


class _Noted:
    """Passes batches on, and keeps the type of their ids."""

    id_type: pa.DataType | None = None

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        self.id_type = batch.schema.field("ids").type.value_type
        return batch


# ---- search ----------------------------------------------------------------------------------------------------------


def _all_alive(segment: int, win: int) -> np.ndarray:
    return np.ones(WINDOW, dtype=bool)


@dataclass(frozen=True)
class TextIndex:
    """Blocks (with _segment), document frequencies, the statistics of live rows, and what says which rows live. rows: live rows with _segment, _row and the columns that filters ask for."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    avg_dl: dict[str, float]
    rows: DataFrame | None = None
    alive: Callable[[int, int], np.ndarray] = field(default=_all_alive)


def index_of(docs: DataFrame, fields: tuple[str, ...], id_col: str = "chunk_id") -> TextIndex:
    """An index of docs, in the shared folder. The store keeps one that follows its writes."""
    rows = settled(docs.withColumn("_row", F.monotonically_increasing_id()))
    blocks = settled(build_blocks(rows, fields, id_col)).withColumn("_segment", F.lit(0))
    found = {r["field"]: r for r in blocks.filter(F.col("term") == DOCS).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n = max((r["n"] for r in found.values()), default=0)
    return TextIndex(blocks, term_counts(blocks), n, {f: found[f]["total"] / n if f in found else 0.0 for f in fields}, rows.withColumn("_segment", F.lit(0)))


def search_blocks(index: TextIndex, queries: DataFrame, k: int, id_col: str = "chunk_id", keep: Column | None = None, digits: int = 6, text: str = "query", syntax: bool = False, counter: dict | None = None) -> DataFrame:
    """query_id, rank, id and score: the hits of `bm25_topk` over the indexed rows. keep: a predicate on index.rows that hits must meet.

    counter gets the numbers of windows and blocks that the grams asked for have, and of those that were read.
    """
    fields, spark = tuple(index.avg_dl), index.blocks.sparkSession
    kinds = index.blocks.schema["ids"].dataType.elementType.simpleString(), dict(queries.dtypes)["query_id"]
    out = None
    for block in _plans(queries, text, fields, syntax):
        asked = sorted({g for _, words in block for w in words for g in w.grams})
        df = {(r["field"], r["term"]): r["df"] for r in index.terms.filter(F.col("term").isin(asked)).groupBy("field", "term").agg(F.sum("df").alias("df")).collect()}  # a row for each gram asked for
        plan = Plan(block, fields, {key: idf_of(index.n_docs, n) for key, n in df.items()}, {f: max(1e-9, a) for f, a in index.avg_dl.items()})
        heads = index.blocks.filter(F.col("term").isin(asked)).select("_segment", "win", "field", "term", "n", "max_tf", "min_ratio")
        bounds = settled(heads.repartition("_segment", "win").sortWithinPartitions("_segment", "win").mapInArrow(_bounder(plan), "q int, _segment int, win long, bound double"))
        best = bounds.withColumn("place", F.row_number().over(_window_order())).filter(F.col("place") <= FIRST).select("_segment", "win").distinct().toArrow()  # FIRST for each query at most
        first = F.broadcast(local(spark, _segment=best["_segment"].combine_chunks(), win=best["win"].combine_chunks()))

        def read(chosen: DataFrame, asked: list = asked, plan: Plan = plan) -> DataFrame:
            rows = index.blocks.filter(F.col("term").isin([DOCS, *asked])).select("_segment", *_NAMES)
            if keep is not None:
                at = index.rows.filter(keep).select("_segment", F.shiftright("_row", SHIFT).alias("win"), F.hex(F.col("_row").bitwiseAND(WINDOW - 1)).alias("o"))
                kept = at.groupBy("_segment", "win").agg(F.unhex(F.array_join(F.transform(F.collect_list("o"), lambda o: F.lpad(o, 2, "0")), "")).alias("offsets"))  # of a window
                # windows without any kept row need a row that says so
                kept = chosen.join(kept, ["_segment", "win"], "left").select("_segment", "win", F.lit("").alias("field"), F.lit(KEPT).alias("term"), F.coalesce("offsets", F.lit(b"")).alias("offsets"))
                rows = rows.join(chosen, ["_segment", "win"], "left_semi").unionByName(kept, allowMissingColumns=True)
            else:
                rows = rows.join(chosen, ["_segment", "win"], "left_semi")
            return rows.repartition("_segment", "win").sortWithinPartitions("_segment", "win").mapInArrow(_scorer(plan, k, digits, index.alive), f"query_id {kinds[1]}, id {kinds[0]}, score double")

        found = settled(read(first))
        ranked = rank_hits(found, "id").groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
        scores = {r["query_id"]: r["least"] for r in ranked.collect()}  # a row for each query
        least = [scores.get(q[0]) for q in block]
        rest = bounds.join(first, ["_segment", "win"], "left_anti")
        known = local(spark, q=pa.array(range(len(block)), pa.int32()), least=pa.array([None if x is None else x - 10.0**-digits for x in least], pa.float64()))
        rest = rest.join(F.broadcast(known), "q").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        second = rest.select("_segment", "win").distinct()
        if counter is not None:
            second = settled(second)
            both = first.unionByName(second)
            counted = heads.join(both.withColumn("read", F.lit(True)), ["_segment", "win"], "left").agg(F.count(F.lit(1)), F.count("read")).first()
            total = bounds.select("_segment", "win").distinct().count()
            for name, n in (("windows", total), ("windows_read", both.count()), ("blocks", counted[0]), ("blocks_read", counted[1])):
                counter[name] = counter.get(name, 0) + n
        hits = found.unionByName(read(second)).withColumnRenamed("id", id_col)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], f"query_id {kinds[1]}, {id_col} {kinds[0]}, score double")
    return rank_hits(out, id_col).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _window_order():
    from pyspark.sql import Window as W

    return W.partitionBy("q").orderBy(F.desc("bound"), "_segment", "win")


def decode_postings(blocks: DataFrame, alive: Callable[[int, int], np.ndarray] = _all_alive) -> DataFrame:
    """field, term, id, tf and dl: one row for each posting of a live row. Blocks of a window meet; no join."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noted = _Noted()
        for (segment, win), rows in _by_window(map(noted, stream)):
            w = Window(rows, alive(segment, win))
            columns: tuple[list, ...] = ([], [], [], [], [])
            for f, gram in w.blocks:
                tf = np.where(w.open, w.tf(f, gram), 0)
                at = np.flatnonzero(tf).tolist()
                for c, new in zip(columns, ([f] * len(at), [gram] * len(at), [w.ids[i] for i in at], tf[at].tolist(), w.dl[f][at].tolist()), strict=True):
                    c.extend(new)
            types = (pa.string(), pa.string(), noted.id_type, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["field", "term", "id", "tf", "dl"])

    rows = blocks.select("_segment", *_NAMES).repartition("_segment", "win").sortWithinPartitions("_segment", "win")
    return rows.mapInArrow(run, f"field string, term string, id {kind}, tf long, dl long")


__all__ = ["TextIndex", "build_blocks", "decode_postings", "gram_stats", "grams_of", "index_of", "search_blocks", "term_counts"]
