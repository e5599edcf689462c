"""Full-text search over character 2- and 3-grams of one or more fields, by scan; `blocks` has the same from stored postings.

Grams cross spaces and punctuation; query text is cut into words. A word matches a field that has its grams at following places, which is to say that has the word; a document
matches if each word matches some field, and words of one character ask for nothing. Scores are BM25 with k1 = 1.2 and b = 0.75 for each field, summed over the
distinct words of the query, the fields each matches and its distinct grams.

Query syntax, by `parse_query`: "several words" in quotes stand together in the text, spaces included; `field:word` looks in one field only; -word must not match and +word must,
as words do anyway. What cannot be read so is taken as plain words.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import rank_hits

K1, B = 1.2, 0.75
SIZES = (2, 3)
MAX_TERM_BYTES = 40
#: Most different grams that one scan looks for.
BLOCK_TERMS = 4096


# ---- queries ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Word:
    """What some field (or the named one) must hold as it is, or must not; a quoted phrase is a word with spaces."""

    text: str
    grams: tuple[str, ...]
    field: str | None = None
    wanted: bool = True


def grams_of(text: str, sizes: tuple[int, ...] = SIZES) -> tuple[str, ...]:
    return tuple(dict.fromkeys(text[i : i + n] for n in sizes for i in range(len(text) - n + 1)))


_PIECE = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]+)"|([^\s"]+))')


def parse_query(text: str | None, fields: tuple[str, ...], syntax: bool = True) -> list[Word]:
    """The different words of a query; none for a blank one."""
    low, found = (text or "").lower(), []
    if syntax and (low.count('"') % 2 == 0):
        for sign, field, quoted, plain in _PIECE.findall(low):
            if field and field not in fields:
                field, plain, quoted = "", f"{field}:{plain or quoted}", ""
            word = quoted or plain
            if not word.strip("+-"):
                continue
            found.append(Word(word, grams_of(word), field or None, sign != "-"))
    else:
        found = [Word(w, grams_of(w)) for w in low.split()]
    return [w for w in dict.fromkeys(found) if w.grams]


def _plans(queries: DataFrame, text: str, fields: tuple[str, ...], syntax: bool) -> Iterator[list[tuple]]:
    """(query_id, words) of the queries that ask for something, in blocks of at most BLOCK_TERMS grams."""
    block, terms = [], set()
    for q in queries.select("query_id", text).repartition(1).toLocalIterator():  # one job, whatever the partitions
        words = parse_query(q[1], fields, syntax)
        if any(w.wanted for w in words):
            block.append((q[0], words))
            terms.update(g for w in words for g in w.grams)
            if len(terms) >= BLOCK_TERMS:
                yield block
                block, terms = [], set()
    if block:
        yield block


# ---- scoring ---------------------------------------------------------------------------------------------------------


def gram_count(n_chars: int) -> int:
    return max(0, n_chars - 1) + max(0, n_chars - 2)


def occurrences(text: str, gram: str) -> int:
    """How often gram stands in text, overlaps included."""
    if gram[0] != gram[-1]:  # of two or three characters, such a gram cannot overlap itself
        return text.count(gram)
    n, at = 0, text.find(gram)
    while at >= 0:
        n, at = n + 1, text.find(gram, at + 1)
    return n


def _matches(words: list[Word], texts: list[str], fields: tuple[str, ...]) -> list[tuple[Word, int]] | None:
    """The (word, field) pairs that match, or None if the document does not."""
    pairs = []
    for w in words:
        own = [f for f in range(len(texts)) if w.field in (None, fields[f]) and w.text in texts[f]]
        if bool(own) != w.wanted:
            return None
        if w.wanted:
            pairs += [(w, f) for f in own]
    return pairs


def bm25(idf: float, tf: int, dl: int, avg_dl: float) -> float:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def idf_of(n_docs: int, df: int) -> float:
    return math.log1p((n_docs - df + 0.5) / (df + 0.5))


def _lower(batch: pa.RecordBatch, first: int, n: int) -> list[list[str]]:
    columns = [[(t or "").lower() for t in batch.column(first + f).to_pylist()] for f in range(n)]
    return list(map(list, zip(*columns, strict=True)))


def _counter(terms: list[str], n_fields: int):
    """For each task: (number, n): documents and grams by field, and documents that have each gram, by field."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, lengths, df = 0, [0] * n_fields, np.zeros((n_fields, len(terms)), dtype=np.int64)
        for batch in stream:
            for texts in _lower(batch, 0, n_fields):
                n_docs += 1
                for f, t in enumerate(texts):
                    lengths[f] += gram_count(len(t))
                    if t:
                        df[f, [i for i, g in enumerate(terms) if g in t]] += 1
        counts = [n_docs, *lengths, *df.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.int64())], names=["number", "n"])

    return run


def _searcher(block: list[tuple], fields: tuple[str, ...], n_docs: int, avg: list[float], df: dict[tuple[int, str], int], k: int, digits: int):
    """The best k of each task for each query."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = {key: idf_of(n_docs, n) for key, n in df.items()}
        best: list[list] = [[] for _ in block]
        id_type = None
        for batch in stream:
            id_type = batch.column(0).type
            ids = batch.column(0).to_pylist()
            for i, texts in zip(ids, _lower(batch, 1, len(fields)), strict=True):
                dl = [gram_count(len(t)) for t in texts]
                for q, (_, words) in enumerate(block):
                    pairs = _matches(words, texts, fields)
                    if pairs:
                        score = sum(bm25(idf[f, g], occurrences(texts[f], g), dl[f], avg[f]) for w, f in pairs for g in w.grams)
                        best[q].append((-round(score, digits), i))
            for q, found in enumerate(best):
                if len(found) > 4 * k:
                    best[q] = heapq.nsmallest(k, found)
        for q, found in enumerate(best):
            if found:
                top = heapq.nsmallest(k, found)
                yield pa.RecordBatch.from_arrays([pa.array([block[q][0]] * len(top)), pa.array([i for _, i in top], id_type), pa.array([-s for s, _ in top])], names=["query_id", "id", "score"])

    return run


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", field: str | tuple[str, ...] = "content", keep: Column | None = None, digits: int = 6, text: str = "query", syntax: bool = False) -> DataFrame:
    """query_id, rank, id and score. keep: a predicate on docs that hits must meet; statistics cover all docs.

    Two scans of the fields for each block of queries, one for the counts of the grams asked for and one for the hits; a task hands on its best k for each query only. Null texts count as
    empty documents. Ties go to the lesser id.
    """
    fields = (field,) if isinstance(field, str) else field
    texts = [F.col(f) for f in fields]
    hits = docs if keep is None else docs.filter(keep)
    kinds = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"], dict(queries.dtypes)["query_id"]
    out = None
    for block in _plans(queries, text, fields, syntax):
        terms = sorted({g for _, words in block for w in words for g in w.grams})
        counted = docs.select(*(t.alias(f"t{i}") for i, t in enumerate(texts))).mapInArrow(_counter(terms, len(fields)), "number int, n long")
        counts = {r[0]: r[1] for r in counted.groupBy("number").agg(F.sum("n").alias("n")).collect()}  # a row for each gram asked for
        n_docs = counts.get(0, 0)
        avg = [max(1e-9, counts.get(1 + f, 0) / max(1, n_docs)) for f in range(len(fields))]
        df = {(f, g): counts.get(1 + len(fields) + f * len(terms) + i, 0) for f in range(len(fields)) for i, g in enumerate(terms)}
        found = hits.select(F.col(id_col).alias("id"), *(t.alias(f"t{i}") for i, t in enumerate(texts))).mapInArrow(_searcher(block, fields, n_docs, avg, df, k, digits), f"query_id {kinds[1]}, id {kinds[0]}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"query_id {kinds[1]}, id {kinds[0]}, score double")
    return rank_hits(out.withColumnRenamed("id", id_col), id_col).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


# ---- stored postings -------------------------------------------------------------------------------------------------


def gram_counts(text: str | None, sizes: tuple[int, ...] = SIZES) -> Counter:
    t = (text or "").lower()
    found: Counter = Counter()
    for n in sizes:
        found.update(t[i : i + n] for i in range(len(t) - n + 1))
    return found


def postings(docs: DataFrame, id_col: str = "chunk_id", field: str | tuple[str, ...] = "content", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """field, term, id, tf and dl (grams of the document's field): one row for each term of each field of each document. One scan, no shuffle."""
    fields = (field,) if isinstance(field, str) else field
    rows = docs.select(F.col(id_col).alias("id"), *(F.col(f).alias(f"t{i}") for i, f in enumerate(fields)))
    kind = dict(rows.dtypes)["id"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns: tuple[list, list, list, list, list] = ([], [], [], [], [])

            def rows(batch=batch, columns=columns) -> pa.RecordBatch:
                types = (pa.string(), pa.string(), batch.column(0).type, pa.int64(), pa.int64())
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["field", "term", "id", "tf", "dl"])
                for c in columns:
                    c.clear()
                return made

            for f, name in enumerate(fields):
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1 + f).to_pylist(), strict=True):
                    counts = gram_counts(text, sizes)
                    n = len(counts)
                    for c, new in zip(columns, ([name] * n, counts, [i] * n, counts.values(), [counts.total()] * n), strict=True):
                        c.extend(new)
                    if len(columns[0]) >= 100_000:
                        yield rows()
            if columns[0]:
                yield rows()

    return rows.mapInArrow(run, f"field string, term string, id {kind}, tf long, dl long").filter(F.octet_length("term") <= MAX_TERM_BYTES)


def null_search(queries: DataFrame, id_type: str = "string", id_col: str = "chunk_id") -> DataFrame:
    """No hits: what a store without full text answers."""
    return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, rank long, {id_col} {id_type}, score double")
