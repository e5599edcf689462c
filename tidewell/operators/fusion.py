"""Reciprocal rank fusion of any number of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0


def rank_hits(scored: DataFrame, id_col: str = "chunk_id", score: str = "score") -> DataFrame:
    """scored with its rank within the query: score down, id up."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), id_col)).cast("long"))


def rrf_fuse(rankings: list[DataFrame], k: float = RRF_K, top_k: int | None = None, id_col: str = "chunk_id", digits: int = 9) -> DataFrame:
    """query_id, rank, id, score, source, vector_score and bm25_score. rankings: query_id, rank, id and any raw scores."""
    if not rankings:
        raise ValueError("no rankings")

    def shaped(r: DataFrame) -> DataFrame:
        raw = [F.col(c) if c in r.columns else F.lit(None).cast("double").alias(c) for c in ("vector_score", "bm25_score")]
        return r.select("query_id", id_col, "rank", *raw)

    union = reduce(DataFrame.unionByName, map(shaped, rankings))
    # ranks are summed in order, so that the sum does not depend on how tasks finish
    summed = F.aggregate(F.array_sort(F.collect_list(1.0 / (F.lit(k) + F.col("rank")))), F.lit(0.0), lambda s, x: s + x)
    fused = union.groupBy("query_id", id_col).agg(F.round(summed, digits).alias("score"), F.max("vector_score").alias("vector_score"), F.max("bm25_score").alias("bm25_score"))
    ranked = rank_hits(fused, id_col)
    if top_k is not None:
        ranked = ranked.filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", id_col, "score", F.lit("hybrid").alias("source"), "vector_score", "bm25_score")
