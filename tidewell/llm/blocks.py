"""Packed blocks of documents, and questions that blocks put to hash partitions.

Both substring operators work in rounds: every block of documents sends packed arrays of names to the partitions that own
them, a partition answers each block with some bits or a number for each name, and the block goes on with the answers. Names travel as
binary arrays and what many documents share is merged within the block before it is sent. A block writes to the partitions that own
one of its names and to no others, so a round has as many messages as there are names at most, whatever the number of partitions.
Partitions are dealt out as the input needs them, each to a task of its own size. Blocks lie in the shared checkpoint, so every round
sees the same blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, forget, shared_checkpoint

BLOCK_BYTES = 2 << 20
#: A block of an operator whose blocks grow with the input; in between there are BLOCKS_PER_CORE.
MOST_BLOCK_BYTES, BLOCKS_PER_CORE = 8 << 20, 16
#: Bytes of text for each partition that answers questions for copies, and for names.
RAW_COPIES, RAW_NAMES = 64 << 20, 16 << 20
#: A shuffle's own number of partitions counts for these up to here, for beyond it only makes messages smaller.
MOST_USUAL = 256
#: Blocks that lie in one task.
BLOCKS_PER_TASK = 32
#: A name that more blocks than this have is hot: what it stands for is dealt out by more than the name.
HOT_BLOCKS = 512
#: Stands for a null id: greater than all others.
NO_ID = np.iinfo(np.int64).max

BLOCK = "block long, ids binary, lengths binary, digests binary, data binary, raw long, keys binary"
QUESTION = "part int, block long, payload binary"
ANSWER = "block long, part int, payload binary"


def _packer(block_bytes: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches(stream, block_bytes):
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            ids = np.array(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), dtype=np.int64)
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            digests = b"".join(blake2b(t, digest_size=16).digest() for t in texts)
            keys = b"".join(np.asarray(c, dtype=np.int64).tobytes() for c in batch.columns[2:])
            binary = [pa.array([x], pa.binary()) for x in (ids.tobytes(), lengths.tobytes(), digests, data)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + k]), *binary, pa.array([int(lengths.sum())]), pa.array([keys], pa.binary())],
                names=[x.split()[0] for x in BLOCK.split(", ")],
            )
            k += 1

    return run


def growing(docs: DataFrame, text: str) -> int:
    """Bytes of a block: the more text the larger, so that blocks and partitions do not both grow in number from the start."""
    raw = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(BLOCK_BYTES, min(MOST_BLOCK_BYTES, raw // (BLOCKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)))


def pack(docs: DataFrame, doc_id: str, text: str, keys: tuple[Column, ...] = (), block_bytes: int | None = None) -> DataFrame:
    """The documents in blocks of about block_bytes (BLOCK_BYTES); a longer text is a block by itself. keys: numbers that go with each text.

    Blocks are dealt out by their number, BLOCKS_PER_TASK to a task, and stay there: answers come to them, they do not move again. The plan of that one step
    is not adaptive, for an adaptive one forgets how its rows are dealt out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *keys)
    packed = shared_checkpoint(rows.mapInArrow(_packer(block_bytes or BLOCK_BYTES), BLOCK))
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-packed.count() // BLOCKS_PER_TASK))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = shared_checkpoint(packed.repartition(n_tasks, "block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    forget(packed)
    return dealt


class Block:
    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        #: 128 bits of a cryptographic hash of each text, as two unsigned columns.
        self.digests = np.frombuffer(row["digests"], dtype=np.uint64).reshape(-1, 2)
        self.data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["raw"])) if row["raw"] else b""
        #: A line for each of the keys.
        self.keys = np.frombuffer(row.get("keys") or b"", dtype=np.int64).reshape(-1, len(self.ids)) if len(self.ids) else None
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def partitions(blocks: DataFrame, raw_per_partition: int, most: int | None = None) -> int:
    """How many partitions answer: one for so many bytes of text, at least as many as a shuffle has. most: of that last number."""
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    usual = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual if most is None else min(usual, most), -(-raw // raw_per_partition))


def ask(blocks: DataFrame, question: Callable[[Block], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """The first questions of each block: (partition, payload) pairs."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                yield _rows(Block(row), question)

    def _rows(block: Block, question) -> pa.RecordBatch:
        found = list(question(block))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([block.block] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["part", "block", "payload"])

    return blocks.mapInArrow(run, QUESTION)


Reply = Callable[[int, list[bytes]], list[bytes]]


def answer(questions: DataFrame, reply: Reply, n_parts: int) -> DataFrame:
    """One answer for each question, given a partition's number and all questions that it got. Negative partitions hand questions back as they are."""

    def run(group: pa.Table) -> pa.Table:
        parts, blocks, payloads = (group.column(c).to_pylist() for c in ("part", "block", "payload"))
        if parts[0] >= 0:
            order = sorted(range(len(blocks)), key=lambda i: blocks[i])
            replies = reply(parts[0], [payloads[i] for i in order])
            for i, x in zip(order, replies, strict=True):
                payloads[i] = x
        return pa.table([pa.array(blocks, pa.int64()), pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "part", "payload"])

    return questions.repartition(n_parts, "part").groupBy("part").applyInArrow(run, ANSWER)


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True))


def proceed(blocks: DataFrame, answers: DataFrame, step: Callable[[Block, dict[int, bytes]], pa.Table], schema: str, types: pa.Schema) -> DataFrame:
    """step(block, answers by partition) for each block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = _answers(right)
        out = [step(Block(row), got) for row in left.to_pylist()]
        return pa.concat_tables(out) if out else types.empty_table()

    dealt = answers.repartition(blocks.rdd.getNumPartitions(), "block")
    return blocks.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(run, schema)


def dump(value: object) -> bytes:
    """Arrays, packed."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def load(payload: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))  # noqa: S301 - written by dump in the same job


QUESTION_TYPES = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def questions_table(block: int, state: object, found: list[tuple[int, bytes]]) -> pa.Table:
    """The questions of a block, and what it keeps for the next step: see kept."""
    found = [*found, (-1 - (block * 0x9E3779B97F4A7C15 % (1 << 64) >> 34), dump(state))]  # each block's in a group of its own, nearly
    return pa.table([pa.array([p for p, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], schema=QUESTION_TYPES)


def kept(answers: dict[int, bytes]) -> object:
    """What a block kept from the step before; the rest of answers are answers."""
    return load(answers.pop(next(part for part in answers if part < 0)))


# ---- names shared by different texts -------------------------------------------------------------------------------


class Names:
    """The different names of a block, split by owning partition.

    A partition gets each name once, 40 bits of it, and a bit that tells whether several texts of the block have it; the owner is taken from other bits.
    """

    def __init__(self, owner: np.ndarray, name: np.ndarray, n_parts: int):
        part = (name >> np.uint64(40)) % np.uint64(n_parts)
        order = np.argsort(name)
        order = order[np.argsort(part[order].astype(np.uint16 if n_parts < 1 << 16 else np.int64), kind="stable")]
        p, x, own = part[order], name[order], owner[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1])
        self.of = np.empty(len(x), dtype=np.int64)  # of each given pair, the place of its name
        self.of[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.name = x[first]
        self.several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first) if len(x) else np.zeros(0, dtype=bool)
        parts, cuts = np.unique(p[first], return_index=True)
        ends = np.r_[cuts, len(first)][1:]
        self.cuts = {p: slice(lo, hi) for p, lo, hi in zip(parts.tolist(), cuts.tolist(), ends.tolist(), strict=False)}

    def questions(self) -> list[tuple[int, bytes]]:
        out = []
        for part, at in self.cuts.items():
            low = np.ascontiguousarray(self.name[at]).view(np.uint8).reshape(-1, 8)[:, :5]
            out.append((part, np.uint32(len(low)).tobytes() + np.packbits(self.several[at]).tobytes() + low.tobytes()))
        return out

    def verdicts(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each pair given: whether different texts have the name, and whether it is hot."""
        out = np.zeros((2, len(self.name)), dtype=bool)
        for part, at in self.cuts.items():
            out[:, at] = np.unpackbits(np.frombuffer(answers[part], dtype=np.uint8).reshape(2, -1), axis=1, count=at.stop - at.start)
        return out[0, self.of], out[1, self.of]


def _read_names(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, dtype=np.uint32, count=1)[0])
    bits = -(-n // 8)
    several = np.unpackbits(np.frombuffer(payload, dtype=np.uint8, count=bits, offset=4), count=n).astype(bool)
    names = np.zeros((n, 8), dtype=np.uint8)
    names[:, :5] = np.frombuffer(payload, dtype=np.uint8, count=5 * n, offset=4 + bits).reshape(-1, 5)
    return names.view(np.uint64).ravel(), several


def reply_names(hot_blocks: int) -> Reply:
    """For each name: whether different texts have it, and whether more than hot_blocks blocks do. A block asks for a name once."""

    def reply(part: int, payloads: list[bytes]) -> list[bytes]:
        asked = [_read_names(p) for p in payloads]
        name, several = np.concatenate([n for n, _ in asked]), np.concatenate([s for _, s in asked])
        order = np.argsort(name, kind="stable")
        x = name[order]
        at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
        blocks = np.diff(np.r_[at, len(x)])
        out = np.empty((2, len(x)), dtype=bool)
        if len(x):
            out[0, order] = np.repeat(np.logical_or.reduceat(several[order], at) | (blocks > 1), blocks)
            out[1, order] = np.repeat(blocks > hot_blocks, blocks)
        return [np.packbits(v, axis=1).tobytes() for v in np.split(out, np.cumsum([len(n) for n, _ in asked])[:-1], axis=1)]

    return reply


# ---- equal texts ---------------------------------------------------------------------------------------------------


class Copies:
    """The different texts of a block, each with the least id that has it."""

    def __init__(self, ids: np.ndarray, digests: np.ndarray):
        order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
        d, self.ids = digests[order], ids
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (d[1:] != d[:-1]).any(axis=1)
        self.of = np.empty(len(ids), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.digest, self.least = d[new], ids[order][new]

    def by_part(self, n_parts: int) -> dict[int, np.ndarray]:
        """The places of the texts that each partition owns."""
        part = (self.digest[:, 1] % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        return dict(zip(parts.tolist(), np.split(order, first[1:]), strict=True)) if len(part) else {}

    def payload(self, at: np.ndarray) -> bytes:
        return np.uint32(len(at)).tobytes() + self.digest[at].tobytes() + self.least[at].tobytes()

    def copied(self, later: np.ndarray) -> np.ndarray:
        """For each text of the block, whether a smaller id has it. later: whether a smaller id than the block's least has each different text."""
        return (self.ids > self.least[self.of]) | later[self.of]


def _ask_copies(n_parts: int):
    def ask(block: Block) -> Iterator[tuple[int, bytes]]:
        copies = Copies(block.ids, block.digests)
        for part, at in copies.by_part(n_parts).items():
            yield part, copies.payload(at)

    return ask


def _reply_copies(part: int, payloads: list[bytes]) -> list[bytes]:
    """For each different text of each block, whether another block has it with a smaller id."""
    sizes = [int(np.frombuffer(p, dtype=np.uint32, count=1)[0]) for p in payloads]
    digest = np.concatenate([np.frombuffer(p, dtype=np.uint64, count=2 * n, offset=4).reshape(-1, 2) for p, n in zip(payloads, sizes, strict=True)])
    ids = np.concatenate([np.frombuffer(p, dtype=np.int64, count=n, offset=4 + 16 * n) for p, n in zip(payloads, sizes, strict=True)])
    order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
    d, i = digest[order], ids[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (d[1:] != d[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    out = np.empty(len(i), dtype=bool)
    out[order] = i > np.repeat(i[at], np.diff(np.r_[at, len(i)])) if len(i) else False
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def copies(blocks: DataFrame, n_parts: int) -> DataFrame:
    """Answers that read_copies understands. No text is read for them."""
    light = blocks.select("block", "ids", "lengths", "digests", F.lit(b"").alias("data"), F.lit(0).cast("long").alias("raw"), F.lit(b"").alias("keys"))
    return answer(ask(light, _ask_copies(n_parts)), _reply_copies, n_parts)


def read_copies(block: Block, answers: dict[int, bytes], n_parts: int) -> np.ndarray:
    """For each text, whether a smaller id has it."""
    own = Copies(block.ids, block.digests)
    later = np.zeros(len(own.least), dtype=bool)
    for part, at in own.by_part(n_parts).items():
        later[at] = np.unpackbits(np.frombuffer(answers[part], dtype=np.uint8), count=len(at))
    return own.copied(later)
