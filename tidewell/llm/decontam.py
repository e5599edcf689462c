"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in lower case with each run of white space as one space. An item of m characters occurs in a
document if some part of the document lies within k = floor(`budget` * m) edits of the whole item; a part of an item by itself is no occurrence. By the q-gram lemma such
a part shares at least m - q + 1 - k * q of the item's q-grams on k + 1 neighbouring diagonals, so one of the overlapping bands of 2 (k + 1)
diagonals holds that many hits. q is Q, or as much less as short items need for the bound to be positive, so no
item's budget is cut. A sliding count over all hits rules most of a text out first, by the same bound; hits are counted per band only where that passes, and
bands that reach the bound are verified by alignment within the band and k diagonals on either side: O(m k) cells, however repetitive the text. No step loses an
occurrence.

The benchmark is the stated query set. It is taken in blocks of at most BLOCK_CHARS characters, each broadcast for one scan of the documents, which
move nowhere; a benchmark of n blocks costs n scans, and the broadcasts of a query stay until it is done. Null and blank texts and items match
nothing. Ids are numbers, or text that reads as one; other text as an id is an error of the cast. Items shorter than 1 / budget have no edits and are matched exactly. Repeated rows are judged alike. Long texts are scanned in overlapping pieces. Extra columns pass through
whatever their names. An empty table or benchmark gives no occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

Q = 8
BUDGET = 0.1
BLOCK_CHARS = 2_000_000
PIECE = 1_000_000
AT_ONCE = 1 << 19
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each position on."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    one = c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0x2545F4914F6CDD1D)
    total, have, done, base, power = None, one, 0, int(_BASE), 1
    while done < q:  # by the binary digits of q, from the lowest
        if q & power:
            piece = have[done : done + n]
            total = piece.copy() if total is None else total * np.uint64(base) + piece
            done += power
        if done < q:
            have = have[:-power] * np.uint64(base) + have[power:]
            base, power = base * base % (1 << 64), power * 2
    return total * np.uint64(0xBF58476D1CE4E5B9)


class Benchmark:
    """A block of items: those matched exactly, and an index of the others for each q."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET):
        known = [(i, n) for i, t in items if (n := normal(t))]
        edits = lambda n: int(len(n) * budget)
        self.short = [(i, n) for i, n in known if not edits(n) and len(n) < Q]
        groups: dict[int, list] = {}
        for i, n in known:
            if edits(n) or len(n) >= Q:
                groups.setdefault(min(Q, len(n) // (edits(n) + 1)), []).append((i, n, edits(n)))
        self.indexes = [Index(group, q) for q, group in sorted(groups.items(), reverse=True)]


class Index:
    """The q-grams of items (id, normal form, edits)."""

    def __init__(self, items: list[tuple[int, str, int]], q: int):
        known = sorted(items, key=lambda x: (len(x[1]), x[0] is None, x[0] or 0))
        self.q, self.ids, self.texts = q, [i for i, _, _ in known], [n for _, n, _ in known]
        self.m, self.k = np.array([len(n) for n in self.texts], dtype=np.int64), np.array([k for *_, k in known], dtype=np.int64)
        self.need = self.m - q + 1 - self.k * q
        all_grams = [grams(codes(n), q) for n in self.texts]
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *all_grams])
        item = np.repeat(np.arange(len(all_grams)), [len(g) for g in all_grams]).astype(np.int64)
        at = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(len(g)) for g in all_grams)])
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first, self.item, self.at = np.r_[first, len(flat)].astype(np.int64), item[order], at[order]
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[(flat >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.classes = []  # (hits needed, characters in reach) for items of similar length
        lo = 0
        while lo < len(self.m):
            hi = int(np.searchsorted(self.m, self.m[lo] * 1.3, side="right"))
            self.classes.append((int(self.need[lo:hi].min()), int((self.m[lo:hi] + self.k[lo:hi]).max())))
            lo = hi
        self.reach = int((self.m + 2 * self.k).max()) if len(self.m) else 0


def _near(hit: np.ndarray, index: Index) -> np.ndarray:
    """Hits inside some stretch that has enough of them for some item."""
    at = np.flatnonzero(hit)
    near = np.zeros(len(at), dtype=bool)
    for need, reach in index.classes:
        if len(at) < need:
            continue
        full = at[need - 1 :] - at[: len(at) - need + 1] < reach  # from the i-th hit on, need hits within reach
        cover = np.zeros(len(at) + 1, dtype=np.int64)
        starts = np.flatnonzero(full)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + need, -1)
        near |= np.cumsum(cover[:-1]) > 0
    return at[near]


def align(items: list[np.ndarray], texts: list[np.ndarray], low: list[int], width: int) -> list[tuple[int, int]]:
    """For each item and its text: least edits between the item and any stretch of the text, and where the first such stretch ends, over the paths on `width` diagonals
    from low on.

    A path is on diagonal d where it has d more characters of the text than of the item behind it. Beyond its ends a text is taken to go on with characters that
    no item has, which costs what leaving out the item's would. All pairs advance together, one character of each item at a time, in groups of AT_ONCE cells.
    """
    out: list[tuple[int, int]] = []
    longest = max(map(len, items), default=0)
    step = max(1, AT_ONCE // (longest + width))
    for at in range(0, len(items), step):
        some, parts, lows = items[at : at + step], texts[at : at + step], low[at : at + step]
        m = np.array([len(x) for x in some])
        padded = np.full((len(some), int(m.max()) + width), 0xFFFFFFFF, dtype=np.uint32)  # text[low : low + m + width]
        letters = np.zeros((len(some), int(m.max())), dtype=np.uint32)
        for r, (x, part, d) in enumerate(zip(some, parts, lows, strict=True)):
            letters[r, : len(x)] = x
            a, b = max(d, 0), min(d + padded.shape[1], len(part))
            if a < b:
                padded[r, a - d : b - d] = part[a:b]
        t = np.arange(width, dtype=np.int32)
        row = np.zeros((len(some), width), dtype=np.int32)
        best = np.zeros((len(some), 2), dtype=np.int64)
        for i in range(letters.shape[1]):
            new = row + (padded[:, i : i + width] != letters[:, i : i + 1])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            new -= t
            row = np.minimum.accumulate(new, axis=1)
            row += t
            done = np.flatnonzero(m == i + 1)
            if len(done):
                best[done, 1] = row[done].argmin(axis=1)
                best[done, 0] = row[done, best[done, 1]]
        out += [(e, min(max(n + d + k, 0), len(part))) for (e, k), n, d, part in zip(best.tolist(), m.tolist(), lows, parts, strict=True)]
    return out


def verify(index: Index, bands: list[tuple[int, int, int, int]], texts: list[str]) -> list[tuple[int, int, tuple[int, int, int]]]:
    """(text, item, (start, end, edits)) of the best occurrence in each band (text, item, first and last diagonal of its hits) that has one."""
    found, groups = [], {}
    for i, item, first, last in bands:
        m, k = int(index.m[item]), int(index.k[item])
        lo, hi = max(0, first - k), min(len(texts[i]), last + m + 2 * k)
        exact = texts[i].find(index.texts[item], lo, hi)
        if exact >= 0:
            found.append((i, item, (exact, exact + m, 0)))
        elif k and lo < hi:
            groups.setdefault(k, []).append((i, item, lo, codes(index.texts[item]), codes(texts[i][lo:hi]), first - k - lo))
    for k, group in groups.items():  # bands of one width
        near = align([g[3] for g in group], [g[4] for g in group], [g[5] for g in group], 4 * k + 2)
        group = [(i, item, lo, want, part[:end]) for (i, item, lo, want, part, _), (edits, end) in zip(group, near, strict=True) if edits <= k]
        back = align([g[3][::-1] for g in group], [g[4][::-1] for g in group], [-2 * k] * len(group), 4 * k + 1)  # from the end back, by the same edits
        found += [(i, item, (lo + len(part) - length, lo + len(part), edits)) for (i, item, lo, _, part), (edits, length) in zip(group, back, strict=True)]
    return found


def scan(texts: list[str], benchmark: Benchmark) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the best occurrence of each item in each text (normal forms)."""
    out = [found for index in benchmark.indexes for found in _scan(texts, index)]
    for i, t in enumerate(texts):
        out += [(i, item, at, at + len(n), 0) for item, n in benchmark.short if (at := t.find(n)) >= 0]
    return out


def _scan(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    pieces = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - index.reach), PIECE)]
    group: list[tuple[int, int]] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if not group:
            return
        parts = [texts[i][at : at + PIECE + index.reach] for i, at in group]
        starts = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]
        c = codes("\0".join(parts))
        g = grams(c, index.q)
        at = _near(index.filter[(g >> np.uint64(64 - _BITS)).astype(np.int64)], index)
        place = np.searchsorted(index.grams, g[at])
        real = index.grams[np.minimum(place, len(index.grams) - 1)] == g[at]
        at, place = at[real], place[real]
        n = index.first[place + 1] - index.first[place]
        total = np.cumsum(n)
        cut = np.searchsorted(total, np.arange(0, (total[-1] if len(total) else 0) + 4_000_000, 4_000_000))
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        span = np.int64(len(c) + 2 * index.reach + 4)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            k = np.repeat(index.first[place[lo:hi]], n[lo:hi]) + np.arange(n[lo:hi].sum()) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
            pos, item = np.repeat(at[lo:hi], n[lo:hi]), index.item[k]
            band = (pos - index.at[k] + index.reach) // (index.k[item] + 1)
            own = (np.searchsorted(starts, pos, side="right") - 1) * len(index.m) + item
            new, many = np.unique(np.r_[own * span + band, own * span + band + 1], return_counts=True)  # band b takes in diagonals of b - 1 and b
            keys, back = np.unique(np.r_[keys, new], return_inverse=True)
            counts = np.bincount(back, weights=np.r_[counts, many]).astype(np.int64)
        own, band = keys // span, keys % span
        full = counts >= index.need[own % len(index.m)]
        bands = []
        for o, b in zip(own[full].tolist(), band[full].tolist(), strict=True):
            (i, base), item = group[o // len(index.m)], o % len(index.m)
            w = int(index.k[item]) + 1
            off = index.reach + int(starts[o // len(index.m)]) - base
            bands.append((i, item, (b - 1) * w - off, (b + 1) * w - 1 - off))
        for i, item, occurrence in verify(index, bands, texts):
            if (i, item) not in best or (occurrence[2], occurrence[0]) < (best[i, item][2], best[i, item][0]):
                best[i, item] = occurrence
        group, size = [], 0

    for i, at in pieces:
        group.append((i, at))
        size += min(len(texts[i]) - at, PIECE + index.reach)
        if size >= PIECE:
            flush()
    flush()
    return [(i, index.ids[item], *x) for (i, item), x in best.items()]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item, t in benchmark.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`")).toLocalIterator():
        block.append((item, t))
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_FOUND = "doc_id long, item_id long, start long, end long, edits long"


def occurrences(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, start, end and edits: the best occurrence of each item in each document that has it.

    start and end count characters of the document in lower case with single spaces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = spark.createDataFrame([], _FOUND)
    for block in _blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(Benchmark(block, budget))

        def find(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(stream, 4 << 20):
                ids = batch.column(0).to_pylist()
                found = scan([normal(t) for t in batch.column(1).to_pylist()], shared.value)
                columns = list(zip(*((ids[i], *x) for i, *x in found), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "item_id", "start", "end", "edits"])

        out = out.unionByName(rows.mapInArrow(find, _FOUND))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """The rows of docs in which no item occurs."""
    out = docs
    place = docs.columns.index(text)
    for block in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block, budget))

        def clean(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches(stream, 4 << 20):
                found = scan([normal(t) for t in batch.column(place).to_pylist()], shared.value)
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[i for i, *_ in found]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
