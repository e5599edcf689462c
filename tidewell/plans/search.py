"""Search queries over `embeddings`, `documents` and `labels`. Query sets: vectors whose id 50 divides, and the texts of QUERIES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DimensionError, StorageError
from ..functions.embed import hash_embed, letter_frequencies
from ..operators.blocks import gram_stats, search_blocks
from ..operators.clusters import clustered_topk
from ..operators.filters import Filters, fulltext_filter, score_threshold, vector_filter
from ..operators.fulltext import bm25_topk
from ..operators.fusion import rrf_fuse
from ..operators.retrieve import Options, retrieve, with_fields
from ..operators.vector import check_dim, distance_score, vector_topk
from ..shared import scratch
from ..sources.index import Store

TEXTS = (("q1", "that with"), ("q2", "licensed under license"), ("q3", "Token"), ("q4", "und die"), ("q5", "par la"), ("q6", "a"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS), "query_id string, query string")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    return e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_SCORES = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, q.q_label, c.vec_id, c.label, round(list_inner_product(q.e, c.embedding::DOUBLE[]), 6) AS score FROM q, embeddings c{where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def q_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    return vector_topk(corpus, queries, 10, "vec_id")


VECTOR_TOPK = f"WITH {_SCORES.format(where='')} SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"


def q_vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    tagged = corpus.select("vec_id", "embedding", F.array(F.concat(F.lit("t"), F.col("label").cast("string"))).alias("tags"), (F.col("label") == 2).alias("deprecated"))
    return vector_topk(tagged.filter(vector_filter(Filters(tags=("t1", "t2", "t3")))), queries, 10, "vec_id")


VECTOR_TOPK_FILTERED = f"WITH {_SCORES.format(where=' WHERE c.label IN (1, 3)')} SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"


def q_vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    hits = score_threshold(vector_topk(corpus, queries, 50, "vec_id").withColumn("vector_score", F.col("score")), 0.25)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))


VECTOR_THRESHOLD = f"WITH {_SCORES.format(where='')} SELECT query_id, count(*) AS n, min(score) AS least FROM r WHERE rank <= 50 AND score >= 0.25 GROUP BY query_id"


def q_vector_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = check_dim(read(spark, sf_dir, "embeddings"), "embedding", 64)
    return e.groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


VECTOR_DIM_CHECK = "SELECT len(embedding)::BIGINT AS dim, count(*) AS n FROM embeddings GROUP BY 1"


def q_distance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from distances along the first axis, some of them below 0 and above 1."""
    e = read(spark, sf_dir, "embeddings")
    distance = 1.0 - 3.0 * F.get("embedding", F.lit(0)).cast("double")
    return e.select("vec_id", F.round(distance_score(distance), 9).alias("score"))


DISTANCE_SCORE = "SELECT vec_id, round(1.0e0 - greatest(0.0e0, least(1.0e0, 1.0e0 - 3.0e0 * embedding[1]::DOUBLE)), 9) AS score FROM embeddings"


def q_store_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty store of a width, filled, opened again without naming the width, and refused with another."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("e"), F.col("label").cast("string")).alias("source"), F.lit("arkts").alias("lang"), F.lit("").alias("content"), "embedding")
    store = Store(spark, scratch(spark, "store"))
    empty = store.open_or_create("m", 64, fulltext=False)["lengths"]["n"]
    store.upsert(e)
    again = Store(spark, store.root, read_only=True)
    dim = again.open_or_create("m", 0)["embedder_dim"]
    refused = 0
    for model, width in (("m", 65), ("other", 64)):
        try:
            again.open_or_create(model, width)
        except (DimensionError, StorageError):
            refused += 1
    counts = again.chunks("m", dim).groupBy(F.size("embedding").cast("long").alias("dim"), "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", F.lit(empty).cast("long").alias("n_before"), F.lit(refused).cast("long").alias("refused"))


STORE_OPEN = "SELECT len(embedding)::BIGINT AS dim, 'e' || label AS source, count(*) AS n, 0::BIGINT AS n_before, 2::BIGINT AS refused FROM embeddings GROUP BY 1, 2"


def q_rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    a = vector_topk(corpus, queries, 50, "vec_id").withColumn("vector_score", F.col("score"))
    b = vector_topk(half(corpus), half(queries), 50, "vec_id").withColumn("bm25_score", F.col("score"))
    return rrf_fuse([a, b], top_k=10, id_col="vec_id").drop("source")


RRF_FUSE = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, c.vec_id, round(list_inner_product(q.e, c.embedding::DOUBLE[]), 6) AS a,
             round(list_inner_product(q.e[1:32], (c.embedding::DOUBLE[])[1:32]), 6) AS b FROM q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, vec_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, vec_id) AS rb FROM s),
u AS (SELECT query_id, vec_id, ra AS rank, a AS vector_score, NULL::DOUBLE AS bm25_score FROM r WHERE ra <= 50
      UNION ALL SELECT query_id, vec_id, rb, NULL, b FROM r WHERE rb <= 50),
f AS (SELECT query_id, vec_id, round(list_sum(list_sort(list(1.0e0 / (60.0e0 + rank)))), 9) AS score, max(vector_score) AS vector_score, max(bm25_score) AS bm25_score FROM u GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f)
SELECT query_id, rank, vec_id, score, vector_score, bm25_score FROM o WHERE rank <= 10
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.array("lang").alias("platforms"), F.array("source").alias("tags"), F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("api_version"))


_GRAMS = """t AS (SELECT doc_id, lang, source, string_split(lower(coalesce(text, '')), '') AS c FROM documents),
g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS term FROM t),
p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM g GROUP BY 1, 2)"""


def q_ngram_postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_stats(_chunks(spark, sf_dir))


NGRAM_POSTINGS_STATS = f"WITH {_GRAMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term"

_BM25 = (
    "WITH "
    + _GRAMS
    + """,
dl AS (SELECT doc_id, (greatest(0, len(c) - 1) + greatest(0, len(c) - 2))::DOUBLE AS dl FROM (SELECT doc_id, list_filter(c, lambda x: x <> '') AS c FROM t)),
st AS (SELECT count(*)::DOUBLE AS n_docs, avg(dl) AS avg_dl FROM dl),
q AS (SELECT * FROM (VALUES {values}) AS v(query_id, query)),
w AS (SELECT DISTINCT query_id, unnest(string_split(lower(query), ' ')) AS word FROM q),
k AS (SELECT DISTINCT query_id, word, unnest(list_concat(list_transform(range(1, length(word)), lambda i: substr(word, i, 2)), list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3)))) AS term FROM w WHERE length(word) >= 2),
n AS (SELECT query_id, count(*) AS n_terms FROM k GROUP BY 1),
df AS (SELECT term, count(*)::DOUBLE AS df FROM p WHERE term IN (SELECT term FROM k) GROUP BY 1),
m AS (SELECT k.query_id, p.doc_id, sum(ln(1.0e0 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avg_dl))) AS score, count(*) AS n
      FROM p JOIN k USING (term) JOIN df USING (term) JOIN dl USING (doc_id) JOIN documents d USING (doc_id), st WHERE {where} GROUP BY 1, 2),
wl AS (SELECT query_id, list(word) AS words FROM w WHERE length(word) >= 2 GROUP BY 1),
bm AS (SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM m JOIN n USING (query_id) JOIN wl USING (query_id) JOIN documents USING (doc_id)
       WHERE m.n = n.n_terms AND len(list_filter(words, lambda x: NOT contains(lower(text), x))) = 0)
"""
)
_VALUES = ", ".join(f"('{i}', '{t}')" for i, t in TEXTS)


def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(_chunks(spark, sf_dir), text_queries(spark), 10)


BM25_TOPK = _BM25.format(values=_VALUES, where="TRUE") + "SELECT query_id, rank, chunk_id, score FROM bm WHERE rank <= 10"


def q_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(_chunks(spark, sf_dir), text_queries(spark), 10, keep=fulltext_filter(Filters(platforms=("en",), tags=("src0",))))


BM25_FILTERED = _BM25.format(values=_VALUES, where="d.lang = 'en' AND d.source = 'src0'") + "SELECT query_id, rank, chunk_id, score FROM bm WHERE rank <= 10"


#: Some words of these stand in headings only.
FIELD_TEXTS = (*TEXTS, ("q7", "src0 that"), ("q8", "src1 de und"), ("q9", "src2"))


def _with_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).withColumn("heading_path", F.col("tags")).withColumn("heading_path", F.concat("heading_path", "platforms"))


def field_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIELD_TEXTS), "query_id string, query string")


def q_bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content and headings: each word in either."""
    docs, fields = with_fields(_with_headings(spark, sf_dir))
    return bm25_topk(docs, field_queries(spark), 10, field=fields)


def q_bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store that got its documents in three writes and lost some in between."""
    store = Store(spark, scratch(spark, "store"))
    chunks = _with_headings(spark, sf_dir)
    store.save(chunks.filter("chunk_id % 3 < 2").withColumn("content", F.when(F.col("chunk_id") % 7 == 0, "replaced that").otherwise(F.col("content"))), "none", 0)
    store.delete(chunks.filter("chunk_id % 5 = 0").select("chunk_id"))
    store.upsert(chunks.filter("chunk_id % 3 = 2 OR chunk_id % 7 = 0 OR chunk_id % 5 = 0"))
    return search_blocks(store.text_index(), field_queries(spark), 10)


_FIELDS_BM25 = """
WITH d AS (SELECT doc_id, unnest([{'field': 'content', 'x': coalesce(text, '')}, {'field': 'heading_path', 'x': source || ' / ' || lang}], recursive := true) FROM documents),
t AS (SELECT doc_id, field, list_filter(string_split(lower(x), ''), lambda y: y <> '') AS c FROM d),
g AS (SELECT doc_id, field, unnest(list_concat(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS term FROM t),
dl AS (SELECT doc_id, field, (greatest(0, len(c) - 1) + greatest(0, len(c) - 2))::DOUBLE AS dl FROM t),
st AS (SELECT field, count(*)::DOUBLE AS n_docs, avg(dl) AS avg_dl FROM dl GROUP BY field),
q AS (SELECT * FROM (VALUES {values}) AS v(query_id, query)),
w AS (SELECT DISTINCT query_id, unnest(string_split(lower(query), ' ')) AS word FROM q),
k AS (SELECT DISTINCT query_id, word, unnest(list_concat(list_transform(range(1, length(word)), lambda i: substr(word, i, 2)), list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3)))) AS term FROM w WHERE length(word) >= 2),
p AS (SELECT doc_id, field, term, count(*)::DOUBLE AS tf FROM g WHERE term IN (SELECT term FROM k) GROUP BY 1, 2, 3),
kw AS (SELECT query_id, word, count(*) AS n_terms FROM k GROUP BY 1, 2),
nw AS (SELECT query_id, count(*) AS n_words FROM kw GROUP BY 1),
df AS (SELECT field, term, count(*)::DOUBLE AS df FROM p GROUP BY 1, 2),
bw AS (SELECT k.query_id, k.word, p.field, p.doc_id, count(*) AS n, sum(ln(1.0e0 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avg_dl))) AS s
       FROM p JOIN k USING (term) JOIN df USING (field, term) JOIN dl USING (doc_id, field) JOIN st USING (field) JOIN d USING (doc_id, field) WHERE contains(lower(x), word) GROUP BY 1, 2, 3, 4),
bd AS (SELECT query_id, doc_id, sum(s) AS score, count(DISTINCT word) AS n FROM bw JOIN kw USING (query_id, word) WHERE n = n_terms GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bd JOIN nw USING (query_id) WHERE n = n_words)
""".replace("{values}", ", ".join(f"('{i}', '{t}')" for i, t in FIELD_TEXTS))
BM25_FIELDS = _FIELDS_BM25 + "SELECT query_id, rank, chunk_id, score FROM bm WHERE rank <= 10"


#: Quoted phrases, words in one field, words that must or must not stand in a document.
PHRASE_TEXTS = (("p1", '"of the"'), ("p2", 'licensed -"apache license"'), ("p3", "heading_path:src1 +und -die"), ("p4", "content:src0"), ("p5", '"und die" -heading_path:src2'), ("p6", 'heading_path:"src0 / en" the'), ("p7", '-that'), ("p8", '"that with" that'))


def q_bm25_phrases_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and the rest of the query syntax, from a store that got its documents in two writes."""
    store = Store(spark, scratch(spark, "store"))
    chunks = _with_headings(spark, sf_dir)
    store.save(chunks.filter("chunk_id % 2 = 0"), "none", 0)
    store.upsert(chunks.filter("chunk_id % 2 = 1 OR chunk_id % 10 = 0"))
    return search_blocks(store.text_index(), spark.createDataFrame(list(PHRASE_TEXTS), "query_id string, query string"), 10, syntax=True)


BM25_PHRASES = """
WITH d AS (SELECT doc_id, unnest([{'field': 'content', 'x': coalesce(text, '')}, {'field': 'heading_path', 'x': source || ' / ' || lang}], recursive := true) FROM documents),
t AS (SELECT doc_id, field, list_filter(string_split(lower(x), ''), lambda y: y <> '') AS c FROM d),
g AS (SELECT doc_id, field, unnest(list_concat(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS term FROM t),
dl AS (SELECT doc_id, field, (greatest(0, len(c) - 1) + greatest(0, len(c) - 2))::DOUBLE AS dl FROM t),
st AS (SELECT field, count(*)::DOUBLE AS n_docs, avg(dl) AS avg_dl FROM dl GROUP BY field),
w(query_id, word, in_field, wanted) AS (VALUES ('p1', 'of the', NULL, TRUE), ('p2', 'licensed', NULL, TRUE), ('p2', 'apache license', NULL, FALSE), ('p3', 'src1', 'heading_path', TRUE), ('p3', 'und', NULL, TRUE), ('p3', 'die', NULL, FALSE),
  ('p4', 'src0', 'content', TRUE), ('p5', 'und die', NULL, TRUE), ('p5', 'src2', 'heading_path', FALSE), ('p6', 'src0 / en', 'heading_path', TRUE), ('p6', 'the', NULL, TRUE), ('p8', 'that with', NULL, TRUE), ('p8', 'that', NULL, TRUE)),
k AS (SELECT DISTINCT query_id, word, unnest(list_concat(list_transform(range(1, length(word)), lambda i: substr(word, i, 2)), list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3)))) AS term FROM w WHERE wanted),
p AS (SELECT doc_id, field, term, count(*)::DOUBLE AS tf FROM g WHERE term IN (SELECT term FROM k) GROUP BY 1, 2, 3),
df AS (SELECT field, term, count(*)::DOUBLE AS df FROM p GROUP BY 1, 2),
mw AS (SELECT query_id, word, wanted, doc_id, field FROM w JOIN d ON (in_field IS NULL OR in_field = field) AND contains(lower(x), word)),
ok AS (SELECT query_id, doc_id FROM mw GROUP BY 1, 2 HAVING count(DISTINCT word) FILTER (wanted) = (SELECT count(*) FROM w WHERE w.query_id = mw.query_id AND wanted) AND count(*) FILTER (NOT wanted) = 0),
s AS (SELECT query_id, doc_id, sum(ln(1.0e0 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avg_dl))) AS score
      FROM mw JOIN ok USING (query_id, doc_id) JOIN k USING (query_id, word) JOIN p USING (doc_id, field, term) JOIN df USING (field, term) JOIN dl USING (doc_id, field) JOIN st USING (field) WHERE wanted GROUP BY 1, 2),
o AS (SELECT query_id, doc_id AS chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, chunk_id, score FROM o WHERE rank <= 10
"""


def q_vector_topk_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered search from a store of clusters that lost some vectors and got others again."""
    corpus, queries = _vectors(spark, sf_dir)
    tagged = corpus.select(F.col("vec_id").alias("chunk_id"), F.lit("").alias("content"), "embedding", F.array(F.concat(F.lit("t"), F.col("label").cast("string"))).alias("tags"), (F.col("label") == 2).alias("deprecated"))
    store = Store(spark, scratch(spark, "store"))
    store.save(tagged.filter("chunk_id % 4 < 3"), "none", 0, fulltext=False)
    store.delete(tagged.filter("chunk_id % 3 = 0").select("chunk_id"))
    store.upsert(tagged.filter("chunk_id % 4 = 3 OR chunk_id % 3 = 0"))
    hits = clustered_topk(store.vector_index(), queries, 10, keep=vector_filter(Filters(tags=("t1", "t2", "t3"))))
    return hits.withColumnRenamed("chunk_id", "vec_id")


def q_hybrid_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter frequencies and stored postings of both fields, fused."""
    store = Store(spark, scratch(spark, "store"))
    store.save(_with_headings(spark, sf_dir).withColumn("embedding", letter_frequencies(F.col("content"))), "letters", 26)
    hits = retrieve(field_queries(spark), store.chunks("letters", 26), letter_frequencies, Options(top_k=10), index=store.text_index(), vectors=store.vector_index())
    return hits.select("query_id", "rank", "chunk_id", "score", "vector_score", "bm25_score")


def q_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text and hash embeddings; hash vectors are Spark's own, so there is no SQL for it."""
    embed = lambda c: hash_embed(c, 64)
    chunks = _chunks(spark, sf_dir).withColumn("embedding", embed(F.col("content")))
    return retrieve(text_queries(spark), chunks, embed, Options(top_k=10)).select("query_id", "rank", "chunk_id", "score", "vector_score", "bm25_score")


def q_hybrid_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumn("embedding", letter_frequencies(F.col("content")))
    return retrieve(text_queries(spark), chunks, letter_frequencies, Options(top_k=10)).select("query_id", "rank", "chunk_id", "score", "vector_score", "bm25_score")


_LETTERS = "list_transform(range(97, 123), lambda c: (length(lower({0})) - length(replace(lower({0}), chr(c::INT), '')))::DOUBLE)"
_FUSED = f""",
lv AS (SELECT doc_id, {_LETTERS.format("coalesce(text, '')")} AS v FROM documents),
du AS (SELECT doc_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS v FROM lv),
qv AS (SELECT query_id, {_LETTERS.format("query")} AS v FROM q),
qu AS (SELECT query_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS v FROM qv),
vs AS (SELECT query_id, doc_id AS chunk_id, round(list_inner_product(qu.v, du.v), 6) AS score FROM qu, du),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs),
u AS (SELECT query_id, chunk_id, rank, score AS vector_score, NULL::DOUBLE AS bm25_score FROM vr WHERE rank <= 50
      UNION ALL SELECT query_id, chunk_id, rank, NULL, score FROM bm WHERE rank <= 50),
f AS (SELECT query_id, chunk_id, round(list_sum(list_sort(list(1.0e0 / (60.0e0 + rank)))), 9) AS score, max(vector_score) AS vector_score, max(bm25_score) AS bm25_score FROM u GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f)
SELECT query_id, rank, chunk_id, score, vector_score, bm25_score FROM o WHERE rank <= 10
"""
HYBRID_SQL = _BM25.format(values=_VALUES, where="TRUE") + _FUSED
HYBRID_STORED = _FIELDS_BM25 + _FUSED


def q_deprecated_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("quality").eqNullSafe(0).alias("deprecated"))
    count = lambda f: F.count_if(f)
    return marked.agg(
        count(vector_filter(Filters())).alias("vector_default"), count(vector_filter(Filters(include_deprecated=True))).alias("vector_all"),
        count(fulltext_filter(Filters())).alias("fulltext_default"), count(fulltext_filter(Filters(include_deprecated=True))).alias("fulltext_all"),
    )


DEPRECATED_EXCLUDED = """
WITH m AS (SELECT coalesce(quality = 0, FALSE) AS d FROM documents LEFT JOIN labels USING (doc_id))
SELECT count(*) FILTER (NOT d) AS vector_default, count(*) AS vector_all, count(*) FILTER (NOT d) AS fulltext_default, count(*) AS fulltext_all FROM m
"""


def q_api_version_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown version passes the vector branch and fails the full-text branch; so do missing platforms."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select(
        "source", F.lit(False).alias("deprecated"), F.col("quality").cast("string").alias("api_version"),
        F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("platforms"),
    )
    f, g = Filters(api_version="1"), Filters(platforms=("de", "src1"))
    return d.groupBy("source").agg(F.count_if(vector_filter(f)).alias("vector_version"), F.count_if(fulltext_filter(f)).alias("fulltext_version"), F.count_if(vector_filter(g)).alias("vector_platforms"), F.count_if(fulltext_filter(g)).alias("fulltext_platforms"))


API_VERSION_SEMANTICS = """
SELECT source, count(*) FILTER (quality IS NULL OR quality = 1) AS vector_version, count(*) FILTER (quality = 1) AS fulltext_version,
       count(*) FILTER (lang = 'en' OR lang = 'de' OR source = 'src1') AS vector_platforms, count(*) FILTER (lang = 'de' AND source = 'src1') AS fulltext_platforms
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
"""


def q_best_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within a group: the three longest documents of each source."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return d.withColumn("rank", rank.cast("long")).filter("rank <= 3")


BEST_OF_SOURCE = "SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3"

QUERIES = {
    "vector_topk": q_vector_topk, "vector_topk_filtered": q_vector_topk_filtered, "vector_threshold": q_vector_threshold, "vector_dim_check": q_vector_dim_check,
    "distance_score": q_distance_score, "store_open": q_store_open, "rrf_fuse": q_rrf_fuse, "ngram_postings_stats": q_ngram_postings_stats, "bm25_topk": q_bm25_topk, "bm25_filtered": q_bm25_filtered,
    "bm25_phrases_stored": q_bm25_phrases_stored, "vector_topk_stored": q_vector_topk_stored,
    "bm25_fields": q_bm25_fields, "bm25_stored": q_bm25_stored, "hybrid_stored": q_hybrid_stored, "hybrid_topk": q_hybrid_topk, "hybrid_sql": q_hybrid_sql, "deprecated_excluded": q_deprecated_excluded, "api_version_semantics": q_api_version_semantics,
    "best_of_source": q_best_of_source,
}
SQL = {
    "vector_topk": VECTOR_TOPK, "vector_topk_filtered": VECTOR_TOPK_FILTERED, "vector_threshold": VECTOR_THRESHOLD, "vector_dim_check": VECTOR_DIM_CHECK,
    "distance_score": DISTANCE_SCORE, "store_open": STORE_OPEN, "rrf_fuse": RRF_FUSE, "ngram_postings_stats": NGRAM_POSTINGS_STATS, "bm25_topk": BM25_TOPK, "bm25_filtered": BM25_FILTERED,
    "bm25_phrases_stored": BM25_PHRASES, "vector_topk_stored": VECTOR_TOPK_FILTERED,
    "bm25_fields": BM25_FIELDS, "bm25_stored": BM25_FIELDS, "hybrid_stored": HYBRID_STORED, "hybrid_sql": HYBRID_SQL, "deprecated_excluded": DEPRECATED_EXCLUDED, "api_version_semantics": API_VERSION_SEMANTICS, "best_of_source": BEST_OF_SOURCE,
}
