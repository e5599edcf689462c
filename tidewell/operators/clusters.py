"""Exact vector search that skips clusters.

Vectors are stored by cluster, with a centre and a radius for each cluster. No vector of a ball scores more against q than q . centre + |q| * radius, so a search reads the clusters with the
best bounds first, and the k-th score found there rules out the clusters whose bound is lower. What is left is compared exactly; the hits are those of a scan. How much is
skipped depends on the vectors: nothing of independent ones in many dimensions, most of what lies in groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import local, settled
from .fusion import rank_hits
from .vector import BLOCK_VALUES, _matrix, _partial

#: Vectors that are clustered together, in bytes, and of a cluster on average.
ROOM, SIZE = 32 << 20, 96
#: Clusters that a query reads before it knows its k-th score.
FIRST = 8
#: Most cluster numbers that become a filter on the scan, and that a search names at all.
ASKED, MOST = 2048, 1 << 18


@dataclass(frozen=True)
class VectorIndex:
    """vectors: id, vector, _segment, _cluster and what filters ask for. heads: _segment, _cluster, centre, radius and n."""

    vectors: DataFrame
    heads: DataFrame


def assign(x: np.ndarray, size: int = SIZE, rounds: int = 3) -> np.ndarray:
    """A cluster for each row: evenly spaced rows as first centres, then means."""
    k = max(1, len(x) // size)
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    found = np.zeros(len(x), dtype=np.int64)
    for r in range(rounds):
        half = (centres * centres).sum(1) / 2
        for at in range(0, len(x), 4096):
            found[at : at + 4096] = (x[at : at + 4096] @ centres.T - half).argmax(1)
        if r + 1 < rounds:
            n = np.bincount(found, minlength=k)
            order = np.argsort(found, kind="stable")
            there = np.flatnonzero(n)
            centres = centres.copy()
            centres[there] = np.add.reduceat(x[order], (np.cumsum(n) - n)[there], axis=0) / n[there, None]
    return found


def with_clusters(rows: DataFrame, vector: str = "embedding", size: int = SIZE) -> DataFrame:
    """rows whose vector is not null, with _cluster, sorted by it in each partition. Nothing is shuffled."""
    place = rows.columns.index(vector)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held, base = 0, TaskContext.get().partitionId() << 32

        def clustered(batches: list[pa.RecordBatch], base: int) -> tuple[pa.RecordBatch, int]:
            table = pa.Table.from_batches(batches).combine_chunks()
            found = assign(_matrix(table.column(place).combine_chunks()), size)
            return table.append_column("_cluster", pa.array(found + base)).combine_chunks(), int(found.max()) + 1

        for batch in stream:
            batch = batch.filter(batch.column(place).is_valid())
            if batch.num_rows:
                waiting.append(batch)
                held += 8 * len(batch.column(place).flatten())
            if held >= ROOM:
                table, n = clustered(waiting, base)
                yield from table.to_batches()
                waiting, held, base = [], 0, base + n
        if waiting:
            yield from clustered(waiting, base)[0].to_batches()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_cluster", T.LongType())])).sortWithinPartitions("_cluster")


def heads_of(stored: DataFrame, vector: str = "embedding") -> DataFrame:
    """_cluster, centre, radius and n of stored vectors, which lie by cluster. A cluster that two tasks read has two heads."""

    def head(c: int, parts: list[np.ndarray]) -> tuple:
        x = np.vstack(parts)
        centre = x.mean(0)
        off = x - centre
        return c, centre.tolist(), float(np.sqrt((off * off).sum(1).max())) * (1 + 1e-9), len(x)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, parts = [], None, []
        for batch in stream:
            if not batch.num_rows:
                continue
            c, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if parts and c[a] != now:
                    out.append(head(now, parts))
                    parts = []
                now = int(c[a])
                parts.append(x[a:b])
        if parts:
            out.append(head(now, parts))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.float64())), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())], names=["_cluster", "centre", "radius", "n"])

    return stored.select("_cluster", vector).mapInArrow(run, "_cluster long, centre array<double>, radius double, n long")


def index_of(rows: DataFrame, vector: str = "embedding", size: int = SIZE) -> VectorIndex:
    """An index of rows, in the shared folder."""
    stored = settled(with_clusters(rows, vector, size))
    return VectorIndex(stored.withColumn("_segment", F.lit(0)), settled(heads_of(stored, vector)).withColumn("_segment", F.lit(0)))


def _bounder(queries: np.ndarray, least: np.ndarray | None):
    """(q, _segment, _cluster, bound) of a task's heads: the best few for each query, or those that may hold a score of at least `least`."""
    norms = np.sqrt((queries * queries).sum(1))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            centre, radius = _matrix(batch.column(2)), batch.column(3).to_numpy()
            bound = queries @ centre.T + norms[:, None] * radius * (1 + 1e-9)
            bound += 1e-9 * (1 + np.abs(bound))
            if least is None:
                n = min(FIRST, bound.shape[1])
                at = np.argpartition(-bound, n - 1, axis=1)[:, :n]
                q, c = np.repeat(np.arange(len(queries)), n), at.ravel()
            else:
                c = np.flatnonzero((bound >= least[:, None]).any(0))
                q = np.zeros(len(c), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), batch.column(0).take(pa.array(c)), batch.column(1).take(pa.array(c)), pa.array(bound[q, c])], names=["q", "_segment", "_cluster", "bound"])

    return run


def clustered_topk(index: VectorIndex, queries: DataFrame, k: int, id_col: str = "chunk_id", vector: str = "embedding", keep: Column | None = None, digits: int = 6, counter: dict | None = None) -> DataFrame:
    """query_id, rank, id and score: the hits of `vector_topk` over the indexed vectors. keep: a predicate that hits must meet. counter gets the numbers of clusters and of those read."""
    spark = index.vectors.sparkSession
    rows = index.vectors if keep is None else index.vectors.filter(keep)
    kinds = rows.schema[id_col].dataType.simpleString(), dict(queries.dtypes)["query_id"]
    out = None
    block: list[tuple] = []

    def search() -> None:
        nonlocal out, block
        ids, matrix = [b[0] for b in block], np.array([b[1] for b in block], dtype=np.float64)
        block = []
        heads = index.heads.select("_segment", "_cluster", "centre", "radius")
        shape = "q int, _segment int, _cluster long, bound double"

        def read(chosen: pa.Table) -> DataFrame:
            n = chosen["_cluster"].unique().to_pylist()
            near = rows.filter(F.col("_cluster").isin(n)) if len(n) <= ASKED else rows
            few = local(spark, _segment=chosen["_segment"].combine_chunks(), _cluster=chosen["_cluster"].combine_chunks())
            return near.join(F.broadcast(few) if len(chosen) <= ASKED else few, ["_segment", "_cluster"], "left_semi").select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(_partial(ids, matrix, k, digits), f"query_id {kinds[1]}, id {kinds[0]}, score double")

        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "_segment", "_cluster"))
        first = heads.mapInArrow(_bounder(matrix, None), shape).withColumn("place", best).filter(F.col("place") <= FIRST).select("_segment", "_cluster").distinct().toArrow()  # FIRST for each query at most
        found = settled(read(first))
        ranked = rank_hits(found, "id").groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
        scores = {r["query_id"]: r["least"] for r in ranked.collect()}  # a row for each query
        least = np.array([-np.inf if scores.get(i) is None else scores[i] - 10.0**-digits for i in ids])
        # a number for each cluster of 96 vectors at most; beyond what a driver holds, the scan of all vectors is as good
        second = heads.mapInArrow(_bounder(matrix, least), shape).select("_segment", "_cluster").distinct().limit(MOST + 1).toArrow()
        if len(second) > MOST:
            hits = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(_partial(ids, matrix, k, digits), f"query_id {kinds[1]}, id {kinds[0]}, score double")
        else:
            done = set(zip(first["_segment"].to_pylist(), first["_cluster"].to_pylist(), strict=True))
            second = second.filter(pa.array([p not in done for p in zip(second["_segment"].to_pylist(), second["_cluster"].to_pylist(), strict=True)], pa.bool_()))
            hits = found.unionByName(read(second)) if len(second) else found
        if counter is not None:
            for name, n in (("clusters", heads.select("_segment", "_cluster").distinct().count()), ("clusters_read", len(first) + len(second))):
                counter[name] = counter.get(name, 0) + n
        out = hits if out is None else out.unionByName(hits)

    for q in queries.select("query_id", vector).filter(F.col(vector).isNotNull()).repartition(1).toLocalIterator():  # one job, whatever the partitions
        block.append((q[0], q[1]))
        if len(block) * max(1, len(q[1])) >= BLOCK_VALUES:
            search()
    if block:
        search()
    if out is None:
        out = spark.createDataFrame([], f"query_id {kinds[1]}, id {kinds[0]}, score double")
    return rank_hits(out.withColumnRenamed("id", id_col), id_col).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
