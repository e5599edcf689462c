"""Hybrid retrieval of a query set: two searches, fusion, threshold, rerank, expansion and citation as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context
from .blocks import TextIndex, search_blocks
from .clusters import VectorIndex, clustered_topk
from .filters import Filters, fulltext_filter, score_threshold, vector_filter
from .fulltext import bm25_topk
from .fusion import RRF_K, rank_hits, rrf_fuse
from .vector import vector_topk

#: embed(column of texts) -> column of vectors
Embed = Callable[[Column], Column]
#: rerank(candidates with query and content, top_n) -> hits
Rerank = Callable[[DataFrame, int], DataFrame]


#: So many hits of a query set may be broadcast.
SMALL_HITS = 100_000

#: What full text looks in: the content, and the headings above it joined by " / ".
FIELDS = ("content", "heading_path")


def with_fields(chunks: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """chunks with searchable strings, and their names."""
    kinds = dict(chunks.dtypes)
    if kinds.get("heading_path", "").startswith("array"):
        chunks = chunks.withColumn("heading_path", F.array_join("heading_path", " / "))
    return chunks, tuple(f for f in FIELDS if f in kinds)


@dataclass(frozen=True)
class Options:
    top_k: int = 5
    per_branch: int = 50
    pre_rerank_k: int = 50
    rrf_k: float = RRF_K
    threshold: float | None = None
    expand_parent: bool = False
    fulltext: bool = True
    filters: Filters = field(default_factory=Filters)


def passthrough(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("query").alias("raw"), F.col("query").alias("rewritten"), F.lit(None).cast("string").alias("hyde_doc"))


def stub_rerank(candidates: DataFrame, top_n: int) -> DataFrame:
    """Identity and cut; nothing in, nothing out."""
    return candidates.filter(F.col("rank") <= top_n)


def rerank_by(score: Callable[[Column, Column], Column]) -> Rerank:
    """A reranker from a column function of query and content."""

    def run(candidates: DataFrame, top_n: int) -> DataFrame:
        again = candidates.withColumn("score", score(F.col("raw"), F.col("content"))).drop("rank").withColumn("source", F.lit("reranked"))
        return rank_hits(again).filter(F.col("rank") <= top_n)

    return run


def text_branch(words: DataFrame, chunks: DataFrame, o: Options, k: int, index: TextIndex | None) -> DataFrame:
    """Full-text hits from the index, or from a scan without one. Only the index's postings of the words asked for are read."""
    keep = fulltext_filter(o.filters)
    if index is not None:
        return search_blocks(index, words, k, keep=keep)
    texts, fields = with_fields(chunks)
    return bm25_topk(texts, words, k, field=fields, keep=keep)


def fuse_branches(queries: DataFrame, chunks: DataFrame, embed: Embed, o: Options, k: int, index: TextIndex | None = None, vectors_of: VectorIndex | None = None) -> DataFrame:
    """The fused hits of enhanced queries (raw, rewritten, hyde_doc) over chunks with embeddings."""
    per_branch = max(1, o.per_branch)
    asked = queries.filter(F.trim("raw") != "")
    vectors = asked.select("query_id", embed(F.coalesce("hyde_doc", "rewritten")).alias("embedding"))
    keep = vector_filter(o.filters)
    branch = vector_topk(chunks.filter(keep), vectors, per_branch) if vectors_of is None else clustered_topk(vectors_of, vectors, per_branch, keep=keep)
    rankings = [branch.withColumn("vector_score", F.col("score"))]
    if o.fulltext:
        words = asked.select("query_id", F.col("rewritten").alias("query"))
        rankings.append(text_branch(words, chunks, o, per_branch, index).withColumn("bm25_score", F.col("score")))
    return rrf_fuse(rankings, o.rrf_k, top_k=k)


def retrieve(queries: DataFrame, chunks: DataFrame, embed: Embed, options: Options = Options(), enhance: Callable[[DataFrame], DataFrame] = passthrough, rerank: Rerank | None = None, index: TextIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """Hits of queries (query_id, query) with content and metadata. Content is joined for the winners only. index, vectors: each branch is answered from its index, not from the chunks."""
    o = options
    enhanced = enhance(queries)
    k = max(o.pre_rerank_k, o.top_k) if rerank else o.top_k
    hits = fuse_branches(enhanced, chunks, embed, o, k, index, vectors)
    if o.threshold is not None:
        hits = score_threshold(hits, o.threshold)
    hits = hits.withColumnRenamed("source", "found_by")
    if queries.count() * k <= SMALL_HITS:  # k rows for each query at most: the winners go to the content, not the content to them
        hits = F.broadcast(hits)
    full = hits.join(chunks.drop("embedding"), "chunk_id").join(enhanced.select("query_id", "raw"), "query_id")
    if rerank:
        full = rerank(full.withColumnRenamed("source", "file").withColumnRenamed("found_by", "source"), o.top_k).withColumnRenamed("source", "found_by").withColumnRenamed("file", "source")
    if o.expand_parent:
        full = context.flatten_with_parent_content(context.expand_to_parent(full, chunks))
    return full


def migration_query(from_platform: Column, code: Column, target: str) -> Column:
    """The query text of a migration search."""
    return F.concat(from_platform, F.lit(f" migration to {target}: "), code)


def migration_text(from_platform: str, code: str, target: str) -> str:
    """migration_query of one request."""
    return f"{from_platform} migration to {target}: {code}"


#: The named form of `retrieve`, as other retrievers are called: (queries, k) -> hits.
@dataclass(frozen=True)
class HybridRetriever:
    chunks: DataFrame
    embed: Embed
    options: Options = field(default_factory=Options)
    index: TextIndex | None = None
    vectors: VectorIndex | None = None
    name: str = "hybrid"

    def __call__(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieve(queries, self.chunks, self.embed, replace(self.options, top_k=k), index=self.index, vectors=self.vectors)
