"""Hierarchical packing into several context sizes: documents go to tiers, long windows fill their gaps from shorter tiers, step groups are balanced.

A task reads its documents once. Whole windows of the longest tier are cut off long documents as they come; what is left of each goes to the least tier that holds it. When
enough has gathered (`POOL_TOKENS`), tiers are packed from the longest down: each piece opens a window of its tier, the gap takes the longest shorter pieces that fit, and
the last bit of it is cut off a piece whose rest goes back to the tier of its new length. So a window is full, and documents are cut about once a window. A window that nothing can
fill is halved: its first half is a full window of the next tier. What is left below the shortest tier waits for the next documents, and at the end of a task goes up a
tree in which `FAN` tasks' rests meet and are packed the same way: a few hundred tokens a task, with their ids. At the root one sequence remains short, the only padding.

Sequences are then dealt to step groups. Within a tier they are ranked by cost (the sum of squared lengths of their pieces, what attention inside documents costs) over
range partitions, and dealt in alternating directions, so the groups of a tier have equal tokens and nearly equal cost. Nothing is dealt by document or source, so hot ones do not matter.

Ids are those of a public tokenizer, whose path is a parameter; words between ASCII white space, across which its rules never reach, are encoded once for each task's memory and
looked up after. A null or empty text is the end token alone. Very long texts are cut like others, repeated rows and ids are packed one by one, null ids are kept, other columns are
not read, whatever their names. An empty table gives no rows. Reruns over the same files agree.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, shared_checkpoint, table

TIERS = (256, 512, 1024, 2048)
FAN = 64
#: Tokens that wait in a task before they are packed.
POOL_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 1 << 17
#: Words that a task remembers, and the longest of these in bytes.
WORDS, WORD_BYTES = 800_000, 64
#: A part of a word, as the tokenizer's rule cuts words of ASCII and Latin letters without an apostrophe: a run of letters, a digit, a run of signs.
_PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


# ---- tokens ----------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts, by a tokenizer that never joins what ASCII white space parts, folds case, and ends each of the parts it cuts a word into with a token of its own kind.

    Words of plain letters, digits and signs are cut into these parts here; new parts go to the tokenizer many at a time, as one text in which the ends say which ids are whose. If
    they do not add up, and for all other words, each is a text of its own.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            return self._one_by_one(parts)
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return list(map(raw.__getitem__, map(slice, cuts, cuts[1:])))

    def _learn(self, words: list[bytes]) -> None:
        plain, others = [], []
        for w in words:
            t = w.decode("utf-8", "replace")
            cut = _PART.findall(t)
            if sum(map(len, cut)) == len(t) and "<|" not in t:
                plain.append((w, cut))
            else:
                others.append((w, t))
        new = list({c for _, cut in plain for c in cut if c not in self.parts})
        for at in range(0, len(new), 4096):
            self.parts.update(zip(new[at : at + 4096], self._together(new[at : at + 4096]), strict=True))
        self.known.update((w, self.parts[cut[0]] if len(cut) == 1 else b"".join(map(self.parts.__getitem__, cut))) for w, cut in plain)
        for at in range(0, len(others), 4096):
            self.known.update(zip((w for w, _ in others[at : at + 4096]), self._one_by_one([t for _, t in others[at : at + 4096]]), strict=True))

    def __call__(self, text: bytes, end_id: int) -> np.ndarray:
        if b"<|" not in text:
            text = text.lower()  # ASCII letters; fewer words to know
        words = text.split()  # of bytes: at ASCII white space only
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            self.parts.clear()
            new = list(set(words))
        self._learn(new)
        ids = np.frombuffer(b"".join([*map(self.known.__getitem__, words), np.array([end_id], dtype="<u4").tobytes()]), dtype="<u4")
        for w in new:
            if len(w) > WORD_BYTES:
                del self.known[w]
                self.parts.pop(w.decode("utf-8", "replace"), None)
        return ids


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer on this machine; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- windows ---------------------------------------------------------------------------------------------------------


class Packer:
    """Gathers pieces (length, number, document, start, ids of the document or of this piece, first id's place there) and gives full windows.

    A window is (tier, [(document, start, ids)]); a document is (id, tokens).
    """

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.pool, self.tokens, self.count = tiers, [], 0, 0

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        """Takes a piece of a document; its whole windows of the longest tier come back at once."""
        most, at = self.tiers[-1], 0
        while len(ids) - at >= most:
            yield most, [(doc, start + at, ids[at : at + most])]
            at += most
        if at < len(ids):
            self._put(doc, start + at, ids[at:].copy())  # a copy, so that a long text's ids can go

    def _put(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        insort(self.pool, (len(ids), self.count, doc, start, ids), key=lambda p: p[:2])
        self.count += 1
        self.tokens += len(ids)

    def _take(self, at: int) -> tuple:
        piece = self.pool.pop(at)
        self.tokens -= piece[0]
        return piece

    def pack(self) -> Iterator[tuple[int, list]]:
        """Full windows, from the longest tier down. Less than the shortest tier stays."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.pool and (self.pool[-1][0] > below) and (k or self.tokens >= tier):
                first = self._take(-1)
                window, gap = [first[2:]], tier - first[0]
                while gap and self.pool:
                    fits = bisect_right(self.pool, gap, key=lambda p: p[0])
                    if fits:
                        piece = self._take(fits - 1)
                        window.append(piece[2:])
                        gap -= piece[0]
                    else:
                        _, _, doc, start, ids = self._take(0)  # the shortest left is too long
                        window.append((doc, start, ids[:gap]))
                        self._put(doc, start + gap, ids[gap:])
                        gap = 0
                if not gap:
                    yield tier, window
                else:  # nothing else is left, and the pieces are longer than the tier below
                    for doc, start, ids in self._cut(window, below):
                        self._put(doc, start, ids)
                    yield below, self.head

    def _cut(self, window: list, at: int) -> list:
        """Leaves the window's first `at` tokens in head, and returns the rest."""
        self.head, rest = [], []
        for doc, start, ids in window:
            n = min(at, len(ids))
            if n:
                self.head.append((doc, start, ids[:n]))
            if n < len(ids):
                rest.append((doc, start + n, ids[n:]))
            at -= n
        return rest

    def rest(self) -> list:
        """What is left, less than the shortest tier."""
        found = [p[2:] for p in self.pool]
        self.pool, self.tokens = [], 0
        return found


def _piece_type(id_type: pa.DataType) -> pa.StructType:
    return pa.struct([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _schema(id_kind: str) -> str:
    """tier 0: what goes up the tree, with its ids."""
    return f"tier int, level int, part long, number long, cost long, pieces array<struct<doc_id:{id_kind},start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,offset:bigint,ids:binary>>"


def _rows(windows: list[tuple[int, list]], level: int, part: int, first: int, id_type: pa.DataType) -> pa.RecordBatch:
    tiers, costs, bounds, flat = [], [], [0], []
    for tier, window in windows:
        offset = 0
        for (doc_id, n), start, ids in window:
            raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
            flat.append((doc_id, start, len(ids), zlib.crc32(raw), n, offset, None if tier else raw))
            offset += len(ids)
        tiers.append(tier)
        costs.append(sum(len(ids) ** 2 for _, _, ids in window))
        bounds.append(len(flat))
    kind = _piece_type(id_type)
    columns = [pa.array([f[i] for f in flat], kind.field(i).type) for i in range(kind.num_fields)]
    pieces = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))
    n = len(windows)
    return pa.RecordBatch.from_arrays(
        [pa.array(tiers, pa.int32()), pa.array([level] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(costs, pa.int64()), pieces],
        names=["tier", "level", "part", "number", "cost", "pieces"],
    )


def _task_packer(tokenizer: str, end_id: int, tiers: tuple[int, ...]):
    """Windows of a task's documents (id, text), and what is left."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, made, n, part, id_type = encoder(tokenizer_path(tokenizer)), Packer(tiers), [], 0, TaskContext.get().partitionId(), None
        for batch in batches(stream):
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids = encode(text or b"", end_id)
                made.extend(packer.add((doc_id, len(ids)), 0, ids))
                if packer.tokens >= POOL_TOKENS:
                    made.extend(packer.pack())
                if len(made) >= 512:
                    yield _rows(made, 0, part, n, id_type)
                    made, n = [], n + len(made)
        made.extend(packer.pack())
        if rest := packer.rest():
            made.append((0, rest))
        if made:
            yield _rows(made, 0, part, n, id_type)

    return run


def _tree_packer(level: int, tiers: tuple[int, ...], root: bool):
    """Windows of the rests of a group of tasks, and what is left; at the root that is one short sequence."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        packer, made = Packer(tiers), []
        pieces = group.sort_by("part").column("pieces").combine_chunks()
        for window in pieces.to_pylist():
            for p in window:
                made.extend(packer.add((p["doc_id"], p["doc_tokens"]), p["start"], np.frombuffer(p["ids"], dtype="<u4")))
        made.extend(packer.pack())
        if rest := packer.rest():
            made.append((tiers[-1] if root else 0, rest))
        return pa.Table.from_batches([_rows(made, level, key[0].as_py(), 0, pieces.type.value_type.field("doc_id").type)])

    return run


def windows(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """tier, level, part, number, cost and pieces, one row for each sequence. (level, part, number) is its key. Tiers double, from the shortest to the longest."""
    if any(b != 2 * a for a, b in zip(tiers, tiers[1:], strict=False)):
        raise ValueError("each tier must be twice the one before")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = _schema(rows.schema["doc_id"].dataType.simpleString())
    level, found = 0, shared_checkpoint(rows.mapInArrow(_task_packer(tokenizer, end_id, tiers), schema))
    done = found.filter("tier > 0")
    most = found.filter("tier = 0").agg(F.max("part")).first()[0]
    while most is not None:
        level, most = level + 1, most // FAN
        rests = found.filter("tier = 0").groupBy(F.floor(F.col("part") / FAN).alias("part_"))
        found = shared_checkpoint(rests.applyInArrow(_tree_packer(level, tiers, most == 0), schema))
        done = done.unionByName(found.filter("tier > 0"))
        most = None if most == 0 else most
    return done


# ---- step groups -----------------------------------------------------------------------------------------------------


def _dealer(firsts: dict[tuple[int, int], int], totals: dict[int, int], step_tokens: int):
    """Adds sequence_id (rank by tier and cost) and step_group to the sorted sequences of each partition."""
    base, groups, ids, at = {}, {}, 0, 0
    for tier, n in sorted(totals.items()):
        groups[tier] = -(-n * tier // step_tokens)
        base[tier] = ids, at
        ids, at = ids + n, at + groups[tier]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in stream:
            tiers = batch.column("tier").to_numpy()
            rank, group = np.empty(len(tiers), dtype=np.int64), np.empty(len(tiers), dtype=np.int64)
            for tier in np.unique(tiers).tolist():
                own = tiers == tier
                j = firsts[part, tier] + seen.get(tier, 0) + np.arange(own.sum())
                seen[tier] = seen.get(tier, 0) + int(own.sum())
                turn, place = j // groups[tier], j % groups[tier]
                rank[own] = base[tier][0] + j
                group[own] = base[tier][1] + np.where(turn % 2 == 0, place, groups[tier] - 1 - place)
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(group), batch.column("tier"), batch.column("cost"), batch.column("pieces")], names=["sequence_id", "step_group", "tier", "cost", "pieces"])

    return run


def deal(sequences: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """sequence_id, step_group, tier, cost and pieces. The groups of a tier have step_tokens each (the last has less) and costs that differ by little."""
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("tier", "cost", "level", "part", "number")
    rows = shared_checkpoint(sequences.repartitionByRange(n, *order).sortWithinPartitions(*order))
    firsts, totals = {}, {}
    counts = rows.groupBy(F.spark_partition_id().alias("p"), "tier").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition and tier
    for c in sorted(counts, key=lambda c: (c["tier"], c["p"])):
        firsts[c["p"], c["tier"]] = totals.get(c["tier"], 0)
        totals[c["tier"]] = totals.get(c["tier"], 0) + c["n"]
    kind = rows.schema["pieces"].dataType.simpleString()
    return rows.mapInArrow(_dealer(firsts, totals, step_tokens), f"sequence_id long, step_group long, tier int, cost long, pieces {kind}")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", doc_id: str = "doc_id", text: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """sequence_id, step_group, tier, cost and pieces (doc_id, start, length, ids_crc32, doc_tokens, offset) of all documents; one row for each sequence."""
    return deal(windows(docs, tokenizer, doc_id, text, end_id, tiers), step_tokens)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    pieces = packed.select("sequence_id", "step_group", "tier", F.inline("pieces"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
