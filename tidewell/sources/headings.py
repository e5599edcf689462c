"""Sections of Markdown files of any size: heading stacks as a monoid, combined over pieces of a file.

Lines are range-partitioned by file and place, so one file of many lines spreads over many tasks. What a piece of a file does to the stack of open headings is
small: it closes all headings of its least level and deeper, and leaves those that it has opened and not closed. Two such effects, one after the other, are one effect, so a scan over
the pieces at the edges of partitions (one or two for each partition) says with which stack, and how many headings, each piece begins. Each task then reads its lines once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settled

HEADING = re.compile(r"^\s*(#{1,6})(?: (.*))?$", re.DOTALL)
FENCE = re.compile(r"^\s*(```|~~~)")


@dataclass
class Effect:
    """Of a stretch of lines: number of headings, least level that it closes down to, headings left open (level, number, title), and fence lines."""

    count: int = 0
    closes: int = 7
    stack: list[tuple[int, int, str]] = field(default_factory=list)
    fences: int = 0

    def heading(self, level: int, title: str) -> None:
        self.count += 1
        self.closes = min(self.closes, level)
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        self.stack.append((level, self.count, title))

    def then(self, other: Effect) -> Effect:
        """Both, one after the other. Associative; an effect of no lines changes nothing."""
        kept = [h for h in self.stack if h[0] < other.closes]
        return Effect(self.count + other.count, min(self.closes, other.closes), kept + [(lv, n + self.count, t) for lv, n, t in other.stack], self.fences + other.fences)


def read_line(line: str, open_: Effect, fence_aware: bool) -> bool:
    """Whether the line is a heading; open_ takes it."""
    if fence_aware and FENCE.match(line):
        open_.fences += 1
        return False
    m = None if fence_aware and open_.fences % 2 else HEADING.match(line)
    if m:
        open_.heading(len(m[1]), (m[2] or "").strip(" "))
    return m is not None


def _effects(fence_aware: bool):
    """(part, edge, key, effects) of the first and the last file of a partition. In a file that may begin in an open fence both cases are followed: two effects."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, first, rows, seen = None, [], None, [], False
        for batch in stream:
            for k, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not seen or k != key:
                    if seen and first is None:
                        first = (key, now)
                    key, now, seen = k, [Effect(), Effect(fences=1)], True
                for e in now:
                    read_line(line, e, fence_aware)
        if seen:
            now[1].fences -= 1
            if first is not None:
                first[1][1].fences -= 1
            rows = [first, (key, now)] if first else [(key, now)]
            part = TaskContext.get().partitionId()
            effects = [[{"count": e.count, "closes": e.closes, "fences": e.fences, "stack": [{"level": a, "number": b, "title": c} for a, b, c in e.stack]} for e in es] for _, es in rows]
            stack = pa.list_(pa.struct([("level", pa.int32()), ("number", pa.int64()), ("title", pa.string())]))
            kind = pa.list_(pa.struct([("count", pa.int64()), ("closes", pa.int32()), ("fences", pa.int64()), ("stack", stack)]))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.string()), pa.array(effects, kind)], names=["part", "key", "effects"])

    return run


_EFFECT = "part int, key string, effects array<struct<count:bigint,closes:int,fences:bigint,stack:array<struct<level:int,number:bigint,title:string>>>>"


def _starts(rows: list) -> dict[tuple[int, str], Effect]:
    """With what each partition begins its first file, if an earlier one has lines of it."""
    out: dict[tuple[int, str], Effect] = {}
    before: dict[str, Effect] = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        start = before.get(r["key"], Effect())
        out.setdefault((r["part"], r["key"]), start)
        e = r["effects"][start.fences % 2]
        before = {r["key"]: start.then(Effect(e["count"], e["closes"], [(s["level"], s["number"], s["title"]) for s in e["stack"]], e["fences"]))}
    return out


def _sections(starts: dict[tuple[int, str], Effect], fence_aware: bool):
    """key, section, pos, line of text lines; and of heading lines also the stack, in a row without line."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, now, seen = TaskContext.get().partitionId(), None, Effect(), False
        for batch in stream:
            out: list[tuple] = []
            for k, pos, line in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if not seen or k != key:
                    start = starts.get((part, k), Effect()) if not seen else Effect()
                    key, seen, now = k, True, Effect(start.count, start.closes, list(start.stack), start.fences)
                if read_line(line, now, fence_aware):
                    out.append((k, now.count, pos, None, [t for _, _, t in now.stack], now.stack[-2][1] if len(now.stack) > 1 else None))
                elif now.count:
                    out.append((k, now.count, pos, line, None, None))
            if out:
                types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "section", "pos", "line", "heading_path", "up"])

    return run


def wide_sections(docs: DataFrame, key: str, body: str, fence_aware: bool = False) -> DataFrame:
    """What `markdown.sections` gives: key, section, heading_path, parent_section, start, end and content. The lines of one file may be in many tasks."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = docs.select(F.col(key).cast("string").alias("key"), F.posexplode(F.split(F.col(body), "\n")).alias("pos", "line"))
    lines = settled(lines.repartitionByRange(n, "key", "pos").sortWithinPartitions("key", "pos"))
    starts = _starts(lines.mapInArrow(_effects(fence_aware), _EFFECT).collect())  # two rows for each partition
    placed = settled(lines.mapInArrow(_sections(starts, fence_aware), "key string, section long, pos int, line string, heading_path array<string>, up long"))
    heads = placed.filter("line IS NULL").select("key", "section", F.col("pos").alias("head"), "heading_path", "up")
    text = placed.filter("line IS NOT NULL").groupBy("key", "section").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))  # one section is one chunk
    text = text.select("key", "section", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"), F.size("ls").alias("n")).filter(F.length(F.trim(F.regexp_replace("content", r"\s", ""))) > 0)
    chunks = heads.join(text, ["key", "section"]).select("key", "section", "heading_path", "up", (F.col("head") + 2).alias("start"), (F.col("head") + 1 + F.col("n")).alias("end"), "content")
    has = chunks.select("key", F.col("section").alias("up"), F.col("section").alias("parent_section"))
    return chunks.join(has, ["key", "up"], "left").select(F.col("key").alias(key), "section", "heading_path", "parent_section", "start", "end", "content")
