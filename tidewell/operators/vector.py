"""Exact vector search for a whole set of queries.

Queries come in blocks of a bounded number of values; each block is shipped once, every task of the corpus scan multiplies it with batches of
vectors and keeps its own best k for each query, and only those meet in a shuffle. The corpus moves nowhere, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionError

#: Most numbers in a block of query vectors.
BLOCK_VALUES = 1 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; the longer array's tail is ignored. Cosine for unit vectors."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda x: F.slice(x, F.lit(1), n)
    return F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distance_score(distance: Column) -> Column:
    """A score from a distance: 1 for none, 0 for 1 and more; null for null and for what is no number."""
    d = distance.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))


def check_dim(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """df, failing at run time on a vector of another width."""
    found = F.size(vector)
    return df.withColumn(vector, F.when(F.assert_true(found == dim, F.concat(F.lit(f"vector width is not {dim}: "), found.cast("string"))).isNull(), F.col(vector)))


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sizes = np.diff(column.offsets.to_numpy())
        if len(sizes) and (sizes != sizes[0]).any():
            raise DimensionError("vectors of different width")
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1)
    raise DimensionError("not a vector column")


def _partial(ids: list, queries: np.ndarray, k: int, digits: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(ids)
        for batch in stream:
            batch = batch.filter(batch.column(1).is_valid())  # here, since a filter in the plan would compute the vectors twice
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1))
            if vectors.shape[1] != queries.shape[1]:
                raise DimensionError(f"vectors of width {vectors.shape[1]}, queries of width {queries.shape[1]}")
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), 256):
                scores = np.round(queries[at : at + 256] @ vectors.T, digits)
                for i, row in enumerate(scores, at):
                    old_keys, old = best[i]
                    if len(row) > 4 * k:
                        cut = np.partition(row, len(row) - k)[len(row) - k]
                        near = np.flatnonzero(row >= cut)
                    else:
                        near = np.arange(len(row))
                    all_keys, all_scores = np.r_[old_keys, keys[near]], np.r_[old, row[near]]
                    order = np.lexsort((all_keys, -all_scores))[:k]
                    best[i] = all_keys[order], all_scores[order]
        for i, (key, score) in enumerate(best):
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(key)), pa.array(key), pa.array(score)], names=["query_id", "id", "score"])

    return run


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, rank, id and score: the k best of corpus (numeric or string id, vector) for each of queries (query_id, vector).

    Scores are rounded to `digits`; ties go to the lesser id. A null vector is never found, and a null query finds nothing. A query set of b blocks costs b scans.
    """
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    kinds = dict(rows.dtypes)["id"], dict(queries.dtypes)["query_id"]
    out = None
    block: list[tuple] = []

    def search() -> None:
        nonlocal out, block
        ids, matrix = [b[0] for b in block], np.array([b[1] for b in block], dtype=np.float64)
        found = rows.mapInArrow(_partial(ids, matrix, k, digits), f"query_id {kinds[1]}, id {kinds[0]}, score double")
        out, block = found if out is None else out.unionByName(found), []

    for q in queries.select("query_id", vector).filter(F.col(vector).isNotNull()).repartition(1).toLocalIterator():  # one job, whatever the partitions
        block.append((q[0], q[1]))
        if len(block) * max(1, len(q[1])) >= BLOCK_VALUES:
            search()
    if block:
        search()
    if out is None:
        out = rows.sparkSession.createDataFrame([], f"query_id {kinds[1]}, id {kinds[0]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
