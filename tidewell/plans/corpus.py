"""Queries on files, chunkers, stores and request parts. Files and logs are built from the tables by the same expressions in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import hash_embed, letter_frequencies
from ..functions.enhance import rule_enhance
from ..functions.lang import detect_lang
from ..functions.metadata import from_json, read_path, to_json
from ..operators.blocks import search_blocks
from ..operators.context import cite
from ..operators.evaluate import per_query, smoke_totals, summarize
from ..operators.filters import get_by_id
from ..operators.fulltext import bm25_topk, null_search
from ..operators.logs import by_key, by_type
from ..operators.retrieve import Options, migration_query, rerank_by, retrieve, stub_rerank
from ..shared import scratch
from ..sources.corpus import audit_utf8, checksums, read_text, visible
from ..sources.headings import wide_sections
from ..sources.index import Dispatcher, Store
from ..sources.markdown import chunk_markdown, front_matter
from ..sources.querysets import load_telemetry
from ..streaming.ingest import sessions
from .evaluation import _ASKED, _OTHERS, _asked, _ranked, _sql_template
from .search import _BM25, _FUSED, _VALUES, _chunks, read, text_queries

# ---- files -----------------------------------------------------------------------------------------------------------


def q_corpus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a corpus folder, some hidden: which of them a scan takes, and their languages."""
    n = F.col("page_id")
    folder = F.when(n % 7 == 0, ".git/").when(n % 7 == 1, "_index/").when(n % 7 == 2, "official/.cache/").otherwise("official/")
    name = F.when(n % 5 == 0, ".hidden.md").otherwise(F.concat(F.lit("f"), n.cast("string"), F.element_at(F.array(*map(F.lit, (".md", ".ETS", ".kt", ".json"))), (n % 4 + 1).cast("int"))))
    paths = read(spark, sf_dir, "pages").select("page_id", F.concat(folder, name).alias("source"))
    return paths.filter(visible(F.col("source"))).select("page_id", "source", detect_lang(F.col("source")).alias("lang"))


CORPUS_PATHS = """
SELECT page_id, 'official/f' || page_id || ['.md', '.ETS', '.kt', '.json'][page_id % 4 + 1] AS source, ['markdown', 'arkts', 'kotlin', 'json'][page_id % 4 + 1] AS lang
FROM pages WHERE page_id % 7 > 2 AND page_id % 5 <> 0
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file; every third has a byte that is not UTF-8 before its text, one behind it, and a cut character at the end."""
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    bad = lambda raw: F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit(raw))).otherwise(F.unhex(F.lit("")))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), F.concat(bad("FF"), whole, bad("C0"), F.encode(F.lit(" end"), "UTF-8"), bad("E4BD")).alias("content"))


def q_utf8_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_text(_files(spark, sf_dir)).select("source", F.md5("text").alias("text_md5"), "had_bad_bytes")


UTF8_DECODE = """
SELECT 'd' || doc_id AS source, md5(CASE WHEN doc_id % 3 = 0 THEN chr(65533) || coalesce(text, '') || chr(65533) || ' end' || chr(65533) ELSE coalesce(text, '') || ' end' END) AS text_md5, doc_id % 3 = 0 AS had_bad_bytes
FROM documents
"""


def q_utf8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_utf8(_files(spark, sf_dir)).select("source", "position", "bytes_hex")


UTF8_AUDIT = """
WITH f AS (SELECT 'd' || doc_id AS source, strlen(coalesce(text, ''))::BIGINT AS n FROM documents WHERE doc_id % 3 = 0)
SELECT source, 0::BIGINT AS position, 'ff' AS bytes_hex FROM f UNION ALL SELECT source, n + 1, 'c0' FROM f UNION ALL SELECT source, n + 6, 'e4bd' FROM f
"""


def q_file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.encode("text", "UTF-8").alias("content"))
    return checksums(d)


FILE_CHECKSUMS = "SELECT doc_id::VARCHAR AS source, sha256(text) AS sha256 FROM documents"


# ---- chunkers --------------------------------------------------------------------------------------------------------


def _fronted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files with front matter: two or three lines of it, a section with the document's text, and one with its source."""
    n = F.col("doc_id")
    front = F.concat(F.lit("---\napi_version: "), (n % 20).cast("string"), F.lit("\ntags: ["), "source", F.lit(", "), "lang", F.lit("]\n"), F.when(n % 2 == 0, "deprecated: true\n").otherwise(""), F.lit("---\n"))
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\n| "))  # no line of it is a heading
    body = F.concat(F.lit("# Document "), n.cast("string"), F.lit("\n| "), text, F.lit("\n## Source\n"), "source", F.lit("\n"))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), n.cast("string"), F.lit(".md")).alias("source"), F.lit("markdown").alias("lang"), F.concat(front, body).alias("text"))


def _flat(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.array_join("heading_path", " / ").alias("heading"), F.col("line_range.start").cast("long").alias("start"), F.col("line_range.end").cast("long").alias("end"), "parent_id", "content")


def q_frontmatter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_markdown(_fronted(spark, sf_dir))
    return c.select("chunk_id", "api_version", F.array_join("tags", ",").alias("tags"), "deprecated", "type", F.col("line_range.start").cast("long").alias("start"))


_FRONTED = """f AS (SELECT doc_id, lang, source, 'd' || doc_id || '.md' AS file, 'Document ' || doc_id AS h, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 4 END AS front,
                 '| ' || replace(replace(coalesce(text, ''), chr(13), ''), chr(10), chr(10) || '| ') AS body FROM documents),
m AS (SELECT *, len(string_split(body, chr(10))) AS n FROM f),
c AS (SELECT doc_id, lang, source, file || '#' || h || '@' || (front + 2) AS chunk_id, h AS heading, front + 2 AS start, front + 1 + n AS "end", NULL AS parent_id, body AS content FROM m
      UNION ALL SELECT doc_id, lang, source, file || '#' || h || '/Source@' || (front + 3 + n), h || ' / Source', front + 3 + n, front + 4 + n, file || '#' || h || '@' || (front + 2), source || chr(10) FROM m)"""
FRONTMATTER_SPLIT = f"WITH {_FRONTED} SELECT chunk_id, (doc_id % 20)::VARCHAR AS api_version, source || ',' || lang AS tags, doc_id % 2 = 0 AS deprecated, 'generic' AS type, start::BIGINT AS start FROM c"


def q_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(chunk_markdown(_fronted(spark, sf_dir)))


CHUNK_IDS = f"""WITH {_FRONTED} SELECT chunk_id, heading, start::BIGINT AS start, "end"::BIGINT AS "end", parent_id, content FROM c"""


#: Sources by the remainder of p_partkey, with {n} for it. The first has statements only.
_SHAPES = (
    "x = {n};\nrun(x);\n",
    "class Part{n} {\n  price(tax: number): number {\n    return tax; // {\n  }\n}\nfunction make{n}() { return '}'; }\n",
    "@Component struct Page{n} { @State x: number = {n}\n  build() {\n    Text(`a ${`b ${x} {`} c`).width(1 / 2)\n  }\n  @Builder menu() { Row() {} }\n}\n",
    "const r = /[`/]{2}'/;\n@Injectable() export class Svc{n}<T extends {x: number}> {\n  run = async (a: T): Promise<void> => {\n    go(a)\n  }\n}\n",
    "export const f{n} = async (a: (x) => void) => {\n  a('}');\n}\nnamespace N{n} {\n  export enum E { A }\n}\ntype T{n} = { a: string }\n",
    "/* class No { */\ninterface I{n} { a(): void; b: { c: number } }\nfunction g{n}(): { a: number } {\n  function h() { return a / 2 }\n  return h() / 3\n}\n",
)


def q_sections_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of all documents as files whose lines lie in ranges over all tasks."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\n| "))
    body = F.concat(F.lit("before\n# "), "source", F.lit("\n| "), text, F.lit("\n### End\n"), "lang", F.lit("\n## Last\n\n# Next\nx"))
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), body.alias("body"))
    s = wide_sections(files, "file", "body")
    return s.select("file", F.col("section").cast("long").alias("section"), F.array_join("heading_path", " / ").alias("heading"), F.col("parent_section").cast("long").alias("parent_section"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("content").alias("content_md5"))


SECTIONS_WIDE = """
WITH t AS (SELECT 'd' || doc_id AS file, source, lang, '| ' || replace(replace(coalesce(text, ''), chr(13), ''), chr(10), chr(10) || '| ') AS body FROM documents),
n AS (SELECT *, len(string_split(body, chr(10))) AS n FROM t)
SELECT file, 1::BIGINT AS section, source AS heading, NULL::BIGINT AS parent_section, 3::BIGINT AS start, (2 + n)::BIGINT AS "end", md5(body) AS content_md5 FROM n
UNION ALL SELECT file, 2, source || ' / End', 1, n + 4, n + 4, md5(lang) FROM n UNION ALL SELECT file, 4, 'Next', NULL, n + 8, n + 8, md5('x') FROM n
"""


def q_metadata_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested front matter read by path, and metadata through JSON and back."""
    n = F.col("doc_id").cast("string")
    front = F.concat(F.lit("---\nowner: {team: "), "source", F.lit(", ids: ["), n, F.lit(", 7, "), n, F.lit("]}\nflag: true\n---\n"))
    files = read(spark, sf_dir, "documents").select(n.alias("source"), F.concat(front, F.coalesce("text", F.lit(""))).alias("text"))
    kept = front_matter(files).withColumn("front", from_json(to_json(F.col("front"))))
    at = lambda path, kind: read_path(F.col("front"), path, kind)
    return kept.select("source", at("$.owner.team", "string").alias("team"), at("$.owner.ids[2]", "bigint").alias("third"), at("$.flag", "boolean").alias("flag"), at("$.owner.team", "int").alias("not_a_number"), to_json(F.col("front")).alias("json"))


METADATA_VARIANT = """
SELECT doc_id::VARCHAR AS source, source AS team, doc_id AS third, TRUE AS flag, NULL::INT AS not_a_number,
       '{"flag":true,"owner":{"ids":[' || doc_id || ',7,' || doc_id || '],"team":"' || source || '"}}' AS json
FROM documents
"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    text = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % len(_SHAPES) + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("p"), n, F.lit(".ts")).alias("source"), F.lit("arkts").alias("lang"), F.replace(text, F.lit("{n}"), n).alias("text"))


def q_code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Dispatcher.default().chunk_as(_code(spark, sf_dir), "arkts")
    return c.select("chunk_id", F.array_join("heading_path", " / ").alias("heading"), F.col("line_range.start").cast("long").alias("start"), F.col("line_range.end").cast("long").alias("end"), "parent_id", "type")


CODE_CHUNKS = """
WITH shapes(k, path, start, "end", up) AS (VALUES
  (0, '', 1, 2, NULL), (1, 'Part{n}', 1, 5, NULL), (1, 'Part{n}/price', 2, 4, 'Part{n}@1'), (1, 'make{n}', 6, 6, NULL), (2, 'Page{n}', 1, 6, NULL), (2, 'Page{n}/build', 2, 4, 'Page{n}@1'), (2, 'Page{n}/menu', 5, 5, 'Page{n}@1'),
  (3, 'Svc{n}', 2, 6, NULL), (3, 'Svc{n}/run', 3, 5, 'Svc{n}@2'), (4, 'f{n}', 1, 3, NULL), (4, 'N{n}', 4, 6, NULL), (4, 'N{n}/E', 5, 5, 'N{n}@4'), (4, 'T{n}', 7, 7, NULL),
  (5, 'I{n}', 2, 2, NULL), (5, 'g{n}', 3, 6, NULL), (5, 'g{n}/h', 4, 4, 'g{n}@3'))
SELECT replace('p{n}.ts#' || path || '@' || start, '{n}', p_partkey::VARCHAR) AS chunk_id, replace(replace(path, '{n}', p_partkey::VARCHAR), '/', ' / ') AS heading, start::BIGINT AS start, "end"::BIGINT AS "end",
       replace('p{n}.ts#' || up, '{n}', p_partkey::VARCHAR) AS parent_id, 'code_example' AS type
FROM part JOIN shapes ON p_partkey % 6 = k
"""


def q_languages_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all files whose language has a chunker, and the files of the others."""
    other = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".kt")).alias("source"), F.lit("kotlin").alias("lang"), F.lit("fun x() {}").alias("text"))
    files = _fronted(spark, sf_dir).unionByName(_code(spark, sf_dir)).unionByName(other)
    d = Dispatcher.default()
    made = d.chunk(files).groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("files"))
    left = files.filter(~F.col("lang").isin(d.supported())).groupBy("lang").agg(F.lit(0).cast("long").alias("chunks"), F.count(F.lit(1)).alias("files"))
    return made.unionByName(left)


LANGUAGES_UNION = """
SELECT 'markdown' AS lang, 2 * count(*) AS chunks, count(*) AS files FROM documents
UNION ALL SELECT 'arkts', sum([1, 3, 3, 2, 4, 3][p_partkey % 6 + 1])::BIGINT, count(*) FROM part UNION ALL SELECT 'kotlin', 0, count(*) FROM part
"""


# ---- stores ----------------------------------------------------------------------------------------------------------


def q_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, upserted, deleted from, compacted and read again: what is left, by source."""
    store, chunks = Store(spark, scratch(spark, "store")), _chunks(spark, sf_dir)
    store.save(chunks.filter("chunk_id % 2 = 0"), "none", 0, fulltext=False)
    store.upsert(chunks.filter("chunk_id % 3 = 0").withColumn("content", F.lit("new")))
    store.delete(chunks.filter("chunk_id % 10 = 0").select("chunk_id"))
    before = store.count()
    store.compact()
    again = Store(spark, store.root, read_only=True)
    c = again.chunks("none")
    return c.groupBy(F.get("tags", F.lit(0)).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).cast("long").alias("chars"), F.lit(before - again.count()).cast("long").alias("lost"))


STORE_ROUNDTRIP = """
SELECT source, count(*) AS n, sum(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE length(text) END)::BIGINT AS chars, 0::BIGINT AS lost
FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 10 <> 0 GROUP BY source
"""


def q_get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return get_by_id(c, "7").unionByName(get_by_id(c, "none such")).select("chunk_id", F.md5("content").alias("content_md5"))


GET_BY_ID = "SELECT doc_id::VARCHAR AS chunk_id, md5(text) AS content_md5 FROM documents WHERE doc_id = 7"


# ---- search ----------------------------------------------------------------------------------------------------------


def q_blank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of blank and of other queries; full text is asked for the other ones only."""
    asked = text_queries(spark).unionByName(spark.createDataFrame([("b1", ""), ("b2", " \t")], "query_id string, query string"))
    hits = bm25_topk(_chunks(spark, sf_dir), asked, 10)
    return asked.select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg(F.count("chunk_id").alias("hits"))


BLANK_QUERY = _BM25.format(values=_VALUES, where="TRUE") + "SELECT v.query_id, count(bm.chunk_id) AS hits FROM (SELECT query_id FROM q UNION ALL VALUES ('b1'), ('b2')) v LEFT JOIN bm ON bm.query_id = v.query_id AND bm.rank <= 10 GROUP BY 1"


def q_smoke_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoke_totals(text_queries(spark), bm25_topk(_chunks(spark, sf_dir), text_queries(spark), 3))


SMOKE_TOTALS = _BM25.format(values=_VALUES, where="TRUE") + "SELECT (SELECT count(*) FROM q) AS total, count(DISTINCT query_id) AS answered FROM bm"


def q_null_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store without full text has no hits for any query, whatever it holds."""
    store, asked = Store(spark, scratch(spark, "store")), text_queries(spark)
    store.save(_chunks(spark, sf_dir), "none", 0, fulltext=False)
    index = store.text_index()
    hits = null_search(asked, "long") if index is None else search_blocks(index, asked, 10)
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counted, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("hits"), F.lit(store.chunks("none").count()).cast("long").alias("chunks"))


NULL_SEARCH = f"SELECT query_id, 0::BIGINT AS hits, (SELECT count(*) FROM documents) AS chunks FROM (VALUES {_VALUES}) AS v(query_id, query)"


def _lettered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).withColumn("source", F.get("tags", F.lit(0))).withColumn("embedding", letter_frequencies(F.col("content")))


def q_two_stage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty candidates for each query, the five longest of them: retrieval to a wider budget, then scores of another kind and a cut."""
    longest = rerank_by(lambda raw, content: F.length(content).cast("double"))
    hits = retrieve(text_queries(spark), _lettered(spark, sf_dir), letter_frequencies, Options(top_k=5, pre_rerank_k=20), rerank=longest)
    return hits.select("query_id", "rank", "chunk_id", "score", F.col("found_by").alias("found_by"))


_HYBRID = _BM25.format(values=_VALUES, where="TRUE") + _FUSED[: _FUSED.rindex("SELECT")].rstrip()
TWO_STAGE_RERANK = (
    _HYBRID
    + """, z AS (SELECT o.query_id, o.chunk_id, length(d.text)::DOUBLE AS score FROM o JOIN documents d ON d.doc_id = o.chunk_id WHERE o.rank <= 20),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z)
SELECT query_id, rank, chunk_id, score, 'reranked' AS found_by FROM y WHERE rank <= 5"""
)


def q_stub_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve(text_queries(spark), _lettered(spark, sf_dir), letter_frequencies, Options(top_k=3), rerank=stub_rerank)
    return hits.select("query_id", "rank", "chunk_id", "score")


STUB_RERANK = _HYBRID + " SELECT query_id, rank, chunk_id, score FROM o WHERE rank <= 3"


def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations of the best hit of each query."""
    c = _lettered(spark, sf_dir).withColumn("heading_path", F.when(F.col("chunk_id") % 2 == 0, F.array("source")).otherwise(F.array().cast("array<string>")))
    c = c.withColumn("line_range", F.when(F.col("chunk_id") % 3 == 0, F.struct(F.lit(1).alias("start"), F.col("chunk_id").cast("int").alias("end"))))
    hits = retrieve(text_queries(spark), c.drop("heading_path", "line_range"), letter_frequencies, Options(top_k=1)).select("query_id", "rank", "chunk_id", "score")
    return cite(hits.join(c.select("chunk_id", "source", "heading_path", "line_range"), "chunk_id")).select("query_id", "chunk_id", "source", "score", "heading", "lines")


CITATIONS = (
    _HYBRID
    + """ SELECT o.query_id, o.chunk_id, d.source, o.score, CASE WHEN chunk_id % 2 = 0 THEN d.source ELSE '(root)' END AS heading,
CASE WHEN chunk_id % 3 = 0 THEN 'L1-' || chunk_id ELSE 'L?' END AS lines FROM o JOIN documents d ON d.doc_id = o.chunk_id WHERE o.rank = 1"""
)


def q_migration_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(migration_query(F.col("role"), F.col("text"), "the target platform")).alias("query_md5"))


MIGRATION_QUERY = "SELECT conv_id, turn, md5(role || ' migration to the target platform: ' || text) AS query_md5 FROM conversations"


def q_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the asked width, equal for equal texts and no others."""
    d = read(spark, sf_dir, "documents").select("source", "text", hash_embed(F.col("text"), 16).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return d.groupBy("source").agg(F.count_distinct("v").alias("vectors"), F.round(F.min(norm), 4).alias("least_norm"), F.round(F.max(norm), 4).alias("greatest_norm"), F.max(F.size("v")).cast("long").alias("width"))


HASH_EMBEDDING = "SELECT source, count(DISTINCT text) AS vectors, 1.0::DOUBLE AS least_norm, 1.0::DOUBLE AS greatest_norm, 16::BIGINT AS width FROM documents GROUP BY source"


def q_rule_enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _asked(spark, sf_dir).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("raw").alias("query"))
    return rule_enhance(a).select("query_id", F.md5("raw").alias("raw_md5"), (F.col("raw") == F.col("rewritten")).alias("kept"), "intent", F.size("entities").cast("long").alias("n_entities"), F.md5("hyde_doc").alias("hyde_md5"))


def _templates() -> str:
    from ..functions.enhance import TEMPLATES

    return " ".join(f"WHEN '{k}' THEN {_sql_template(t)}" for k, t in TEMPLATES.items())


RULE_ENHANCE = (
    f"WITH {_ASKED}, "
    + r"""p AS (SELECT *, list_filter(regexp_extract_all(raw, '[\p{L}\p{N}_.]+'), lambda x: strlen(x) >= 2 AND regexp_matches(x, '[\p{Lu}.0-9]')) AS v FROM i)
SELECT conv_id || '/' || turn AS query_id, md5(raw) AS raw_md5, TRUE AS kept, intent, len(list_filter(v, lambda x, k: k = 1 OR x <> v[k - 1]))::BIGINT AS n_entities, md5(CASE intent """
    + _templates()
    + " END) AS hyde_md5 FROM p"
)

# ---- evaluation and logs ---------------------------------------------------------------------------------------------


def q_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and percentiles over a query set, with made-up latencies."""
    top, truth = _ranked(spark, sf_dir)
    results = per_query(top.withColumn("latency_ms", F.pmod(F.col("query_id") * 37, F.lit(101)).cast("long")), truth, 10, "vec_id")
    s = summarize(results)
    return s.select("n_queries", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), F.round("latency_mean", 9).alias("latency_mean"), "latency_p50", "latency_p99")


EVAL_SUMMARY = f"""WITH {_OTHERS},
e AS (SELECT query_id, count(*) FILTER (good)::DOUBLE / max(n.n) AS recall, coalesce(1.0e0 / min(rank) FILTER (good), 0.0e0) AS mrr, (query_id * 37) % 101 AS latency FROM t JOIN n USING (query_id) GROUP BY query_id),
l AS (SELECT list_sort(list(latency)) AS v FROM e)
SELECT count(*) AS n_queries, round(avg(recall), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(latency), 9) AS latency_mean,
       (SELECT v[least(len(v) // 2, len(v) - 1) + 1] FROM l)::BIGINT AS latency_p50, (SELECT v[ceil(0.99 * len(v))::BIGINT] FROM l)::BIGINT AS latency_p99 FROM e"""


def q_stats_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("round"), F.col("event_id").alias("commit"), F.when(F.col("value") > 50, F.floor("value")).alias("lines_added"))
    return by_key(e, "round")


STATS_BY_ROUND = "SELECT user_id AS round, event_id::VARCHAR AS commit, CASE WHEN value > 50 THEN floor(value)::BIGINT::VARCHAR ELSE '—' END AS lines_added FROM events WHERE event_id % 3 = 0 AND user_id IS NOT NULL"


def q_stats_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.when(F.col("event_type") != "click", F.col("event_type")).alias("feature"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("commit"))
    return by_key(e, "feature").groupBy("feature", (F.col("commit") == "—").alias("dashed")).agg(F.count(F.lit(1)).alias("n"))


STATS_BY_FEATURE = "SELECT event_type AS feature, event_id % 2 <> 0 AS dashed, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1, 2"


def q_telemetry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a log of JSON lines and read with the log's schema; what it lacks is null."""
    folder = scratch(spark, "log")
    e = read(spark, sf_dir, "events")
    e.select(F.col("event_id").cast("string").alias("commit"), F.col("event_type").alias("type"), F.floor("value").cast("int").alias("lines_added"), "props").write.json(folder)
    log = load_telemetry(spark, folder)
    return by_type(log).join(log.groupBy("type").agg(F.sum("lines_added").cast("long").alias("lines_added"), F.count("round").alias("rounds"), F.count_distinct("commit").alias("commits")), "type")


TELEMETRY_SCAN = "SELECT event_type AS type, count(*) AS entries, sum(floor(value))::BIGINT AS lines_added, 0::BIGINT AS rounds, count(DISTINCT event_id) AS commits FROM events GROUP BY 1"


def q_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(read(spark, sf_dir, "events"), "30 minutes")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


EVENT_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM c GROUP BY user_id
"""

QUERIES = {
    "corpus_paths": q_corpus_paths, "utf8_decode": q_utf8_decode, "utf8_audit": q_utf8_audit, "file_checksums": q_file_checksums, "frontmatter_split": q_frontmatter_split, "chunk_ids": q_chunk_ids,
    "code_chunks": q_code_chunks, "languages_union": q_languages_union, "store_roundtrip": q_store_roundtrip, "get_by_id": q_get_by_id, "blank_query": q_blank_query, "smoke_totals": q_smoke_totals,
    "sections_wide": q_sections_wide, "metadata_variant": q_metadata_variant,
    "null_search": q_null_search, "two_stage_rerank": q_two_stage_rerank, "stub_rerank": q_stub_rerank, "citations": q_citations, "migration_query": q_migration_query, "hash_embedding": q_hash_embedding,
    "rule_enhance": q_rule_enhance, "eval_summary": q_eval_summary, "stats_by_round": q_stats_by_round, "stats_by_feature": q_stats_by_feature, "telemetry_scan": q_telemetry_scan, "event_sessions": q_event_sessions,
}
SQL = {
    "corpus_paths": CORPUS_PATHS, "utf8_decode": UTF8_DECODE, "utf8_audit": UTF8_AUDIT, "file_checksums": FILE_CHECKSUMS, "frontmatter_split": FRONTMATTER_SPLIT, "chunk_ids": CHUNK_IDS,
    "code_chunks": CODE_CHUNKS, "languages_union": LANGUAGES_UNION, "store_roundtrip": STORE_ROUNDTRIP, "get_by_id": GET_BY_ID, "blank_query": BLANK_QUERY, "smoke_totals": SMOKE_TOTALS,
    "sections_wide": SECTIONS_WIDE, "metadata_variant": METADATA_VARIANT,
    "null_search": NULL_SEARCH, "two_stage_rerank": TWO_STAGE_RERANK, "stub_rerank": STUB_RERANK, "citations": CITATIONS, "migration_query": MIGRATION_QUERY, "hash_embedding": HASH_EMBEDDING,
    "rule_enhance": RULE_ENHANCE, "eval_summary": EVAL_SUMMARY, "stats_by_round": STATS_BY_ROUND, "stats_by_feature": STATS_BY_FEATURE, "telemetry_scan": TELEMETRY_SCAN, "event_sessions": EVENT_SESSIONS,
}
