"""SimHash near-dedup: tiled exact comparison of fingerprints with numpy exclusive-or and bit counts.

Fingerprints of 64 bits or a multiple come from one Arrow pass over the texts. Distinct fingerprints are sorted by population count and cut
into packed tiles. Two tiles, and two stretches of them, are compared only if their population counts can lie within the radius; this
loses no pair, for two fingerprints differ in at least as many bits as their counts do. A tile reports a spanning forest of
its links, as trees of few branches, and a pair of tiles what joins their components, never the links themselves. Components follow by minimum labels
with pointer jumping over what tasks have contracted, each round in the shared checkpoint and the one before it removed. Keys that many rows share (a component, a text that has a million copies) meet
their labels in a broadcast of these few labels.

Two texts whose shingle counts have cosine c differ in a share of about acos(c) / pi of the bits. `dedup` takes the distinct shingles of five words, 256
bits and a radius of 88, and verifies each link within the radius, unless verified links join its ends already: two texts are near copies if of the words of each
SIMILAR lie in shingles that the other has too. So single changed words cost what they are, wherever they stand, while a third of own text is always too much. All
pairs with a Jaccard similarity of 0.8 are far within (they differ in 39 bits on average); by normal estimate the radius misses
one in ten at a similarity of 0.4, and two texts without a shingle in common come within it three times in 10^7 pairs.
Such near copies share shingles, so `dedup` compares only what does (see shingles): a group of texts that may be near copies, in blocks of one group or of many small groups. A group of
more than BLOCK_TEXTS is cut by the links of its fingerprints first, by tiles. Of a large group's blocks the heads of their components meet, and then only what is not in
the largest component meets the other blocks. The comparison of all pairs is quadratic in the number of distinct fingerprints for `near_duplicates`, and in the size of a group for `dedup`.

Ids are numbers, or text that reads as one; other text as an id is an error of the cast. A null text, an empty text and a text of white space have no words and fingerprint zero. Documents with equal fingerprints form one
class whatever their number; rows with a null id take part but name no component (a component of such rows alone has
a null id). Long texts are counted piece by piece. Extra columns pass through `dedup` whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import batches, forget, free_name, join_hot, mix64, shared_checkpoint, table

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_CHUNK = 1 << 15


def _bit_sums(hashes: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """How often each of the 64 * words bits is set among the hashes of each text. Later words are scramblings of the hash."""
    sums = []
    for k in range(words):
        h = hashes if k == 0 else mix64(hashes ^ np.uint64(k * 0xD1B54A32D192ED03 % (1 << 64)))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums.append(np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
    return np.stack(sums, axis=1)


def fingerprints_of(texts: list[bytes | None], size: int = 4, words: int = 1, repeats: bool = True, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text, as `words` unsigned 64-bit numbers. repeats: a shingle counts as often as it occurs, else once."""
    sums = np.zeros((len(texts), words, 64), dtype=np.int64)
    totals = np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    owner: list[int] = []
    counts: list[int] = []

    def fold() -> None:
        nonlocal hashes, owner, counts
        if hashes:
            sums[owner] += _bit_sums(np.array(hashes, dtype=np.uint64), np.r_[0, np.cumsum(counts)[:-1]], words)
        hashes, owner, counts = [], [], []

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        parts = text.translate(_FOLD).split() if text else []
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= size:
            spans = [(0, len(joined))]
        else:
            ends = np.cumsum([len(w) + 1 for w in parts])
            spans = list(zip([0, *ends[: len(parts) - size].tolist()], (ends[size - 1 :] - 1).tolist(), strict=True))
        if not repeats:
            spans = list({digest(joined[a:b], seed): (a, b) for a, b in spans}.values())
        totals[i] = len(spans)
        for at in range(0, len(spans), _CHUNK):  # a very long text is counted piece by piece
            found = [digest(joined[a:b], seed) for a, b in spans[at : at + _CHUNK]]
            if at:
                fold()
            hashes += found
            owner.append(i)
            counts.append(len(found))
            if len(hashes) >= _CHUNK:
                fold()
    fold()
    bits = (2 * sums > totals[:, None, None]).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64).reshape(len(texts), words)


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows of unsigned numbers as big-endian bytes, which sort like the rows."""
    raw, width = x.astype(">u8").tobytes(), 8 * x.shape[1]
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _unpacked(raw: bytes, words: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, words)


def _signer(size: int, words: int, repeats: bool):
    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            prints = fingerprints_of(batch.columns[-1].cast(pa.large_binary()).to_pylist(), size, words, repeats)
            ones = np.bitwise_count(prints).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_packed(prints), pa.binary()), pa.array(ones)], names=[*batch.schema.names[:-1], "fp", "ones"])

    return sign


def _row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.isNull(), text.isNull(), F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, words: int = 1, repeats: bool = True, body: bool = False) -> DataFrame:
    """doc_id, a (a hash of id and text), fp and ones (its bits set), one row for each row of docs. body: also b (a hash of the text) and chars."""
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    of_text = [F.xxhash64(F.lit(2), F.coalesce(t, F.lit(""))).alias("b"), F.coalesce(F.length(t), F.lit(0)).cast("long").alias("chars")] if body else []
    rows = docs.select(d.cast("long").alias("doc_id"), _row_hash(d, t).alias("a"), *of_text, t.alias("_text"))
    return rows.mapInArrow(_signer(size, words, repeats), f"doc_id long, a long, {'b long, chars long, ' if body else ''}fp binary, ones int")


_TILE = "tile long, low int, high int, fps binary, roots binary"


def _tiles(tile_rows: int, radius: int, words: int):
    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        fps: list[bytes] = []
        ones: list[int] = []

        def tile() -> pa.RecordBatch:
            nonlocal k, fps, ones
            k += 1
            raw = b"".join(fps)
            roots = forest(_unpacked(raw, words), None, radius).astype(np.int32).tobytes()
            row = [pa.array([(part << 32) + k]), pa.array([min(ones)], pa.int32()), pa.array([max(ones)], pa.int32()), pa.array([raw], pa.binary()), pa.array([roots], pa.binary())]
            fps, ones = [], []
            return pa.RecordBatch.from_arrays(row, names=["tile", "low", "high", "fps", "roots"])

        for batch in stream:
            for f, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fps.append(f)
                ones.append(n)
                if len(fps) == tile_rows:
                    yield tile()
        if fps:
            yield tile()

    return cut


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent with the links a-b added; parents are the least of their component."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)


def _near(rows: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, other) places of the pairs within the radius. others: one contiguous line for each 64 bits."""
    apart = np.bitwise_count(rows[:, 0, None] ^ others[0])
    for k in range(1, rows.shape[1]):
        more = np.bitwise_count(rows[:, k, None] ^ others[k])
        np.minimum(apart, 255 - 64, out=apart)  # far beyond any radius in use, and no overflow
        apart += more
    return np.nonzero(apart <= radius)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, roots: np.ndarray | None = None) -> np.ndarray:
    """The root of each row of a, then of b, over the links between a and b (or within a): the place of its component's least fingerprint.

    roots: those of links that are known already.
    """
    if not radius < 255 - 64:
        raise ValueError("the radius is too large")
    sides = []
    for x in (a, b) if b is not None else (a,):
        ones = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        place = np.argsort(ones, kind="stable")
        sides.append((x[place], ones[place], place))
    (xa, ones_a, place_a), (xb, ones_b, place_b) = sides[0], sides[-1]
    lines = np.ascontiguousarray(xb.T)
    every = np.concatenate([a, b]) if b is not None else a
    order = np.lexsort(every.T[::-1])
    rank = np.empty(len(every), dtype=np.int64)
    rank[order] = np.arange(len(every))
    parent = np.arange(len(every))
    if roots is not None:
        parent[rank] = rank[roots]
    rank_a, rank_b = rank[place_a], rank[place_b + (len(a) if b is not None else 0)]
    for r in range(0, len(xa), 16):
        lo, hi = ones_a[r] - radius, ones_a[min(r + 16, len(xa)) - 1] + radius
        f, t = int(np.searchsorted(ones_b, lo)), int(np.searchsorted(ones_b, hi, side="right"))
        if b is None:
            f = max(f, r)
        for c in range(f, t, 1 << 13):
            i, j = _near(xa[r : r + 16], lines[:, c : min(t, c + (1 << 13))], radius)
            if len(i):
                parent = _join(parent, rank_a[i + r], rank_b[j + c])
    return order[parent[rank]]


def linked(a: np.ndarray, b: np.ndarray | None, radius: int, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, their roots): what the links between a and b (or within a) join that roots do not."""
    every = np.concatenate([a, b]) if b is not None else a
    own = np.arange(len(every))
    found = forest(a, b, radius, roots)
    new = (found != own) & (True if roots is None else roots == own)
    return every[new], every[found[new]]


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_packed(u), pa.binary()), pa.array(_packed(v), pa.binary())], names=["u", "v"])


BRANCHES = 16


def _inner(words: int):
    """The links inside tiles: an edge for each fingerprint that is not a root, as trees in which none has more than BRANCHES + 1."""

    def inner(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for fps, roots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, r = _unpacked(fps, words), np.frombuffer(roots, dtype=np.int32)
                order = np.lexsort((np.arange(len(r)) != r, r))  # each root before its members
                first = np.flatnonzero(np.r_[True, r[order][1:] != r[order][:-1]][: len(r)])
                start = np.repeat(first, np.diff(np.r_[first, len(r)]))
                rank = np.arange(len(r)) - start
                child = np.flatnonzero(rank)
                yield _edges(x[order[child]], x[order[(start + (rank - 1) // BRANCHES)[child]]])

    return inner


def _compare(radius: int, words: int):
    """The links between the tiles of a cell: edges between components of two tiles, not between their members."""

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        tiles = group.sort_by("tile")
        bands, lows, highs = (tiles.column(c).to_pylist() for c in ("band", "low", "high"))
        fps = [_unpacked(x, words) for x in tiles.column("fps").to_pylist()]
        roots = [np.frombuffer(x, dtype=np.int32) for x in tiles.column("roots").to_pylist()]
        made = [_edges(fps[0][:0], fps[0][:0])]
        for a in range(len(fps)):
            for b in range(a + 1, len(fps)):
                if (bands[a], bands[b]) == (i, j) and lows[b] <= highs[a] + radius:
                    u, v = linked(fps[a], fps[b], radius, np.r_[roots[a], roots[b] + len(fps[a])])
                    if len(u):
                        made.append(_edges(u, v))
        return pa.Table.from_batches(made)

    return compare


#: Most tiles of a band.
BAND = 32


def links(prints: DataFrame, radius: int = 4, words: int = 1) -> DataFrame:
    """u, v: edges between distinct fingerprints whose components are those of all links within the radius.

    A fingerprint has one edge at most from its own tile; two tiles add edges between their components only. A group of near copies in
    t tiles so costs its size and a few edges for each two tiles, not one for each member and tile. Neighbouring tiles form bands, and a task compares the tiles of two bands, so a tile
    is sent once for each band within the radius, not for each tile.
    """
    spark = prints.sparkSession
    distinct = shared_checkpoint(prints.select("fp", "ones").distinct())
    n, parts = distinct.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tile_rows = max(1024, min(65536, -(-n // 24)))
    ordered = distinct.repartitionByRange(max(1, min(parts, -(-n // tile_rows))), "ones", "fp").sortWithinPartitions("ones", "fp")
    tiles = shared_checkpoint(ordered.mapInArrow(_tiles(tile_rows, radius, words), _TILE))
    about = sorted(tiles.select("tile", "low", "high").collect())  # three numbers for each tile
    count = max(1, -(-len(about) // BAND), min(len(about), int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))))
    size = max(1, -(-len(about) // count))
    bands = [about[k : k + size] for k in range(0, len(about), size)]
    reach = [(min(t["low"] for t in b), max(t["high"] for t in b)) for b in bands]
    cells = [[(min(i, j), max(i, j)) for j in range(len(bands)) if reach[max(i, j)][0] <= reach[min(i, j)][1] + radius] for i in range(len(bands))]
    known = spark.createDataFrame([(t["tile"], i, [list(c) for c in cells[i]]) for i, b in enumerate(bands) for t in b], "of long, band int, cells array<array<int>>")
    dealt = tiles.join(F.broadcast(known), F.col("tile") == F.col("of")).select("tile", "low", "high", "fps", "roots", "band", F.explode("cells").alias("c"))  # a row for each tile of at least 1024
    dealt = dealt.select(F.get("c", F.lit(0)).alias("i"), F.get("c", F.lit(1)).alias("j"), "tile", "low", "high", "fps", "roots", "band")
    between = dealt.groupBy("i", "j").applyInArrow(_compare(radius, words), "u binary, v binary")
    return tiles.select("fps", "roots").mapInArrow(_inner(words), "u binary, v binary").unionByName(between)


#: Edges of a forest that one task contracts.
CONTRACT = 1 << 18


def _contract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's edges: an edge for each node but the least of its component, as trees of few branches, and that least node."""
    up: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in stream:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    members: dict[bytes, list[bytes]] = {}
    for x in up:
        members.setdefault(find(x), []).append(x)
    rows: list[tuple[bytes, bytes, bytes]] = []
    for root, own in members.items():
        own.sort()  # the root first
        rows += [(x, own[(k - 1) // BRANCHES], root) for k, x in enumerate(own) if k]
    for at in range(0, len(rows), 1 << 16):
        columns = zip(*rows[at : at + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["u", "v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable over the edges, for each node that has one.

    Tasks contract CONTRACT edges each, so that one edge a node is left of whatever links a task has, and each node starts at the least of its component there; rounds of minimum labels
    with pointer jumping join what the tasks have apart. Edges in one task need no more than the round that finds nothing to do.
    """
    once = shared_checkpoint(edges)
    n = once.count()
    trees = shared_checkpoint(once.repartition(max(1, -(-n // CONTRACT))).mapInArrow(_contract, "u binary, v binary, root binary"))
    forget(once)
    starts = trees.select(F.col("u").alias("node"), "root").unionByName(trees.select(F.col("v").alias("node"), "root"))
    labels = kept = shared_checkpoint(starts.groupBy("node").agg(F.min("root").alias("root")))
    both = shared_checkpoint(trees.select("u", "v").unionByName(trees.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    forget(trees)
    while True:
        heard = both.join(labels, both["u"] == labels["node"]).groupBy("v").agg(F.min("root").alias("heard"))
        told = labels.join(heard, labels["node"] == heard["v"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("heard", "root")).alias("root"))
        told = shared_checkpoint(told)
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("above"))
        new = shared_checkpoint(join_hot(told, up, "root", "up").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        changed = not new.filter("root < old").isEmpty()
        forget(kept)
        forget(told)
        kept, labels = new, new.select("node", "root")
        if not changed:
            forget(both)
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, size: int = 4, words: int = 1, repeats: bool = True) -> DataFrame:
    """doc_id, a, fp and component_id for each row of docs."""
    prints = shared_checkpoint(fingerprints(docs, doc_id, text, size, words, repeats))
    roots = components(links(prints, radius, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = shared_checkpoint(classes)
    named = shared_checkpoint(classes.groupBy("root").agg(F.min("least").alias("component_id")))  # apart from the join, so that a large component's classes spread
    named = shared_checkpoint(join_hot(classes, named.withColumnRenamed("root", "root_"), "root", "root_").select("fp", "component_id"))
    return join_hot(prints, named.withColumnRenamed("fp", "fp_"), "fp", "fp_").select("doc_id", "a", "fp", "component_id")


#: The least share of each text's words that lie in common shingles, for near copies, as a fraction.
SIMILAR = (4, 5)
#: A block of texts to verify holds about so many, or so many characters.
BLOCK_TEXTS, BLOCK_CHARS = 256, 16_000_000


def shingle_hashes(text: bytes | None, size: int, seed: int = 42) -> np.ndarray:
    """The hashes of the shingles from each word on; that of the whole text if it has no more than `size` words, none without words."""
    parts = text.translate(_FOLD).split() if text else []
    digest = xxhash.xxh64_intdigest
    found = [digest(b" ".join(parts[i : i + size]), seed) for i in range(max(1, len(parts) - size + 1))] if parts else []
    return np.array(found, dtype=np.uint64)


def _covered(a: np.ndarray, others: np.ndarray, size: int) -> bool:
    """Whether SIMILAR of the words lie in shingles that are among others (in order). a: the shingle from each word on."""
    place = np.searchsorted(others, a)
    common = others[np.minimum(place, len(others) - 1)] == a
    words = len(a) + size - 1
    cover = np.zeros(words + 1, dtype=np.int32)
    cover[: len(a)] += common
    cover[size:] -= common
    return SIMILAR[1] * int(np.count_nonzero(np.cumsum(cover))) >= SIMILAR[0] * words


def similar(a: np.ndarray, b: np.ndarray, size: int) -> bool:
    """Whether two texts, as shingle_hashes, are near copies; two texts without words are."""
    if len(a) < 2 or len(b) < 2:
        return np.array_equal(a, b)
    return _covered(a, np.unique(b), size) and _covered(b, np.unique(a), size)


def verified(fps: np.ndarray, sets: list[np.ndarray], radius: int, size: int, first: int | None = None, roots: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, roots): stars over the places of fps, from each former root to its new one, with the components of all verified links within the radius.

    first: only links between the first so many and the others count. roots: what is known already.
    """
    parent = list(range(len(fps))) if roots is None else roots.tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    former = [x for x, up in enumerate(parent) if x == up]
    lines, start = np.ascontiguousarray(fps[first or 0 :].T), first or 0
    for r in range(0, len(fps) if first is None else first, 16):
        i, j = _near(fps[r : r + 16 if first is None else min(r + 16, first)], lines, radius)
        i, j = i + r, j + start
        after = i < j
        for x, y in zip(i[after].tolist(), j[after].tolist(), strict=True):
            u, v = find(x), find(y)
            if u != v and similar(sets[x], sets[y], size):
                parent[max(u, v)] = min(u, v)
    return [(x, find(x)) for x in former if find(x) != x], np.array([find(x) for x in range(len(fps))], dtype=np.int32)


def _shingler(size: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            sets = [shingle_hashes(t, size).tobytes() for t in batch.column(3).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["own", "block", "node", "hashes"])

    return run


def _sets(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in raw]


def _prints(nodes: list[bytes], words: int) -> np.ndarray:
    return _unpacked(b"".join(x[: 8 * words] for x in nodes), words)


_NODE_EDGES = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _node_edges(found: list[tuple[int, int]], nodes: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.binary()) for k in (0, 1)], schema=_NODE_EDGES)


def _within_blocks(radius: int, size: int, words: int):
    """Each block with the links inside it; of a large group's block also the heads of its components."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                own, block, rows = (batch.column(c)[k].as_py() for c in range(3))
                nodes, hashes = [x["node"] for x in rows], [x["hashes"] for x in rows]
                found, roots = verified(_prints(nodes, words), _sets(hashes), radius, size)
                u, v = ([nodes[p[c]] for p in found] for c in (0, 1))
                heads = [i for i, r in enumerate(roots.tolist()) if i == r]
                # a group in one block has met itself; only a large one's texts go on
                row = (own, block, nodes if own else [], hashes if own else [], [nodes[i] for i in heads] if own else [], [hashes[i] for i in heads] if own else [], u, v)
                lists = pa.list_(pa.binary())
                types = (pa.binary(), pa.int32(), lists, lists, lists, lists, lists, lists)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _MET.split(", ")])

    return run


_MET = "own binary, block int, nodes array<binary>, hashes array<binary>, head_nodes array<binary>, head_hashes array<binary>, u array<binary>, v array<binary>"


def _between_blocks(radius: int, size: int, words: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                rows, n2, h2 = (batch.column(c)[k].as_py() for c in range(3))
                n1, h1 = [x["node"] for x in rows], [x["hashes"] for x in rows]
                found, _ = verified(_prints(n1 + n2, words), _sets(h1 + h2), radius, size, len(n1))
                yield _node_edges(found, n1 + n2)

    return run


def _blocked(rows: DataFrame) -> DataFrame:
    """own, block and rows (node and hashes) of rows (own, node, hashes), in blocks of about BLOCK_TEXTS of one group."""
    sizes = rows.groupBy("own").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias("k"))
    dealt = rows.join(sizes, "own").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("k")).cast("int"))
    return dealt.groupBy("own", "block").agg(F.collect_list(F.struct("node", "hashes")).alias("rows"))


def _across_blocks(blocks: DataFrame, radius: int, size: int, words: int) -> DataFrame | None:
    """u, v: the links that large groups have between their blocks, up to components. blocks: _MET rows of large groups.

    First the heads of the blocks' components meet, which joins what a group of near copies has in all its blocks. What is then in a group's largest component need not meet itself
    again: only the rest, if any, meets all blocks of its group.
    """
    heads = blocks.select("own", F.explode(F.arrays_zip("head_nodes", "head_hashes")).alias("e")).select("own", F.col("e.head_nodes").alias("node"), F.col("e.head_hashes").alias("hashes"))
    met = shared_checkpoint(_blocked(heads).mapInArrow(_within_blocks(radius, size, words), _MET).select("own", F.explode(F.arrays_zip("u", "v")).alias("e")).select("own", "e.u", "e.v"))
    inside = blocks.select(F.explode(F.arrays_zip("u", "v")).alias("e")).select("e.u", "e.v")
    labels = components(inside.unionByName(met.select("u", "v")))
    members = blocks.select("own", F.explode(F.arrays_zip("nodes", "hashes")).alias("e")).select("own", F.col("e.nodes").alias("node"), F.col("e.hashes").alias("hashes"))
    members = members.join(labels.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left").select("own", "node", "hashes", F.coalesce("root", "node").alias("head"))
    largest = members.groupBy("own", "head").agg(F.count(F.lit(1)).alias("n")).groupBy("own").agg(F.max_by("head", F.struct("n", "head")).alias("largest"))
    rest = shared_checkpoint(members.join(largest, "own").filter("head <> largest").select("own", "node", "hashes"))
    if rest.isEmpty():
        return met.select("u", "v")
    pairs = _blocked(rest).select("own", "rows").join(blocks.select("own", "nodes", "hashes"), "own").select("rows", "nodes", "hashes")
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * blocks.sparkSession.sparkContext.defaultParallelism)
    return met.select("u", "v").unionByName(pairs.repartition(parts).mapInArrow(_between_blocks(radius, size, words), "u binary, v binary"))


def verified_links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, radius: int, size: int, words: int) -> DataFrame:
    """u, v: edges between nodes (fp and b) whose components are those of all links that are within the radius and similar.

    classes: root (of the links within the radius), fp, b, chars, and the id and hash `a` of one row, for each distinct text.
    """
    spark = docs.sparkSession
    weight = F.count(F.lit(1)) / BLOCK_TEXTS + F.sum("chars") / BLOCK_CHARS
    groups = classes.groupBy("root").agg(F.count(F.lit(1)).alias("n"), weight.alias("weight")).filter("n > 1").withColumn("k", F.ceil("weight").cast("int"))
    groups = shared_checkpoint(groups)
    m = max(1, int(np.ceil(groups.filter("k = 1").agg(F.sum("weight")).first()[0] or 0)))
    own = F.when(F.col("k") > 1, F.col("root")).otherwise(F.lit(b""))
    block = F.when(F.col("k") > 1, F.pmod(F.xxhash64("fp", "b"), F.col("k"))).otherwise(F.pmod(F.xxhash64("root"), F.lit(m))).cast("int")
    node = F.concat("fp", F.unhex(F.lpad(F.hex("b"), 16, "0")))
    asked = classes.join(groups, "root").select(F.coalesce("id", F.lit(0)).alias("_asked_id"), F.col("a").alias("_asked_a"), own.alias("own"), block.alias("block"), node.alias("node"))
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    rows = docs.select(F.coalesce(d.cast("long"), F.lit(0)).alias("_id"), _row_hash(d, t).alias("_a"), t.alias("_text"))
    met = rows.join(asked.hint("shuffle_hash"), (F.col("_id") == F.col("_asked_id")) & (F.col("_a") == F.col("_asked_a"))).dropDuplicates(["_id", "_a"])
    sets = met.select("own", "block", "node", "_text").mapInArrow(_shingler(size), "own binary, block int, node binary, hashes binary")
    packed = sets.groupBy("own", "block").agg(F.collect_list(F.struct("node", "hashes")).alias("rows"))
    blocks = shared_checkpoint(packed.mapInArrow(_within_blocks(radius, size, words), _MET))
    inside = blocks.select(F.explode(F.arrays_zip("u", "v")).alias("e")).select("e.u", "e.v")
    large = blocks.filter("own <> X''")
    if large.isEmpty():
        return inside
    return inside.unionByName(_across_blocks(large, radius, size, words))


def _grouped(texts: DataFrame, edges: DataFrame, radius: int, words: int) -> DataFrame:
    """b, c, fp and root of the texts whose group has others: all links that are within the radius and similar lie inside groups.

    Groups of more than BLOCK_TEXTS are cut by the links of their fingerprints within the radius.
    """
    roots = components(edges)
    group = shared_checkpoint(texts.join(roots, F.col("u") == F.col("node")).groupBy("b", "c", "fp").agg(F.min("root").alias("root")))
    large = shared_checkpoint(group.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_TEXTS).select(F.col("root").alias("large")))
    if large.isEmpty():
        return group
    marked = group.join(large, F.col("root") == F.col("large"), "left")
    ones = F.udf(lambda x: int.from_bytes(x, "big").bit_count(), "int")
    near = components(links(marked.filter("large IS NOT NULL").select("fp").distinct().withColumn("ones", ones("fp")), radius, words)).select("node", F.col("root").alias("near"))
    cut = F.when(F.col("large").isNull(), F.col("root")).otherwise(F.concat("root", F.coalesce("near", "fp")))
    return shared_checkpoint(marked.join(near, F.col("large").isNotNull() & (F.col("fp") == F.col("node")), "left").select("b", "c", "fp", cut.alias("root")))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 88, size: int = 5, words: int = 4) -> DataFrame:
    """doc_id, a and component_id for each row of docs: components of the links within the radius that are similar."""
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    b, c = (F.xxhash64(F.lit(k), F.coalesce(t, F.lit(""))).alias(name) for k, name in ((2, "b"), (3, "c")))
    rows = shared_checkpoint(docs.select(d.cast("long").alias("doc_id"), _row_hash(d, t).alias("a"), b, c, F.coalesce(F.length(t), F.lit(0)).cast("long").alias("chars")))
    sign = lambda found: _packed(fingerprints_of(found, size, words, repeats=False))
    texts, edges = shingles.candidates(docs, doc_id, text, (b, c), size, SIMILAR, sign)
    classes = shared_checkpoint(rows.groupBy("b", "c").agg(F.min("doc_id").alias("least"), F.max("chars").alias("chars"), F.min(F.struct("doc_id", "a")).alias("one")))
    near = classes.join(_grouped(texts, edges, radius, words), ["b", "c"]).select("fp", "b", "c", "least", "chars", F.col("one.doc_id").alias("id"), F.col("one.a").alias("a"), "root")
    near = shared_checkpoint(near)
    own = F.concat("fp", F.unhex(F.lpad(F.hex("b"), 16, "0")))
    roots = components(verified_links(docs, near, doc_id, text, radius, size, words)).withColumnRenamed("root", "head")
    named = shared_checkpoint(near.join(roots, own == F.col("node")).select("b", "c", "least", "head"))
    heads = shared_checkpoint(named.groupBy("head").agg(F.min("least").alias("component_id")))
    named = shared_checkpoint(join_hot(named, heads.withColumnRenamed("head", "head_"), "head", "head_").select("b", "c", "component_id", F.lit(True).alias("linked")))
    key = F.concat(F.lpad(F.hex("b"), 16, "0"), F.lpad(F.hex("c"), 16, "0"))
    labels = shared_checkpoint(classes.join(named, ["b", "c"], "left").select(key.alias("key_"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
    return join_hot(rows.withColumn("key", key), labels, "key", "key_").select("doc_id", "a", "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 88, size: int = 5, words: int = 4) -> DataFrame:
    """The rows of docs that represent their group: those of its least document id.

    Rows that repeat an id and a text are the same document and stay together. Of the rows without an id none stands for
    others, so all of them stay.
    """
    found = similar_documents(docs, doc_id, text, radius, size, words)
    gone_id, gone_a = free_name(docs.columns, "gone_id"), free_name(docs.columns, "gone_a")
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone_id), F.col("a").alias(gone_a)).distinct().hint("shuffle_hash")
    d, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    return docs.join(gone, (d.cast("long") == F.col(gone_id)) & (_row_hash(d, t) == F.col(gone_a)), "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
