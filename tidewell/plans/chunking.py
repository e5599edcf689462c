"""Queries on chunking, indexing and parent expansion. Markdown is built from `conversations` by the same string expressions in both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lang import detect_lang
from ..operators.context import console_preview, expand_to_parent, flatten_with_parent_content, heading_display, lines_display, parent_audit, parents_of, preview
from ..sources.corpus import folder_counts
from ..sources.index import delete, index_stats, last_write
from ..sources.markdown import chunk_type, platform_name, sections
from .search import read


def _markdown(spark: SparkSession, sf_dir: str, intro: str) -> DataFrame:
    """conv_id and body: a heading for the conversation, one below it for each turn. intro: what the first heading holds."""
    c = read(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.col("text"))
    turns = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    return turns.select("conv_id", F.concat(F.lit("# conversation "), F.col("conv_id").cast("string"), F.lit("\n" + intro), F.col("t")).alias("body"))


_SECTIONS = """c AS (
  SELECT conv_id, '# conversation ' || conv_id || chr(10) || '{intro}' || string_agg('## ' || turn || ' ' || role || chr(10) || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id
), l AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM c),
v AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*#{{1,6}}( .*)?$') THEN length(regexp_extract(line, '^\\s*(#{{1,6}})', 1)) END AS level FROM l),
s AS (SELECT *, count(level) OVER w AS section, max(CASE WHEN level = 1 THEN pos END) OVER w AS h1, max(CASE WHEN level = 2 THEN pos END) OVER w AS h2 FROM v
      WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
h AS (SELECT conv_id, section, pos, level, h1, h2, trim(regexp_extract(line, '^\\s*#{{1,6}} (.*)$', 1)) AS title FROM s WHERE level IS NOT NULL),
t AS (SELECT conv_id, section, string_agg(line, chr(10) ORDER BY pos) AS content, count(*) AS n FROM s WHERE section > 0 AND level IS NULL GROUP BY 1, 2),
k AS (SELECT h.conv_id, h.section, CASE WHEN h.level = 2 AND p.pos IS NOT NULL THEN p.title || ' / ' || h.title ELSE h.title END AS heading,
             CASE WHEN h.level = 2 THEN p.section END AS up, h.pos + 1 AS start, h.pos + n AS "end", content
      FROM h JOIN t USING (conv_id, section) LEFT JOIN h p ON p.conv_id = h.conv_id AND p.pos = h.h1 AND p.level = 1 WHERE regexp_matches(content, '\\S'))"""


def q_markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(_markdown(spark, sf_dir, ""), "conv_id", "body")
    return s.select("conv_id", F.col("section").cast("long").alias("section"), F.array_join("heading_path", " / ").alias("heading"), F.col("parent_section").cast("long").alias("parent_section"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "content")


_CHUNKS_SQL = """ SELECT k.conv_id, k.section, k.heading, p.section AS parent_section, k.start::BIGINT AS start, k."end"::BIGINT AS "end", k.content
FROM k LEFT JOIN k p ON p.conv_id = k.conv_id AND p.section = k.up"""
MARKDOWN_CHUNKS = "WITH " + _SECTIONS.format(intro="").replace("\\\\", "\\") + _CHUNKS_SQL


def q_markdown_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(_markdown(spark, sf_dir, "An introduction.\n"), "conv_id", "body")
    return s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("parent_section").alias("with_parent"), F.sum(F.size("heading_path")).cast("long").alias("depth"))


MARKDOWN_PARENTS = (
    "WITH "
    + _SECTIONS.format(intro="An introduction.' || chr(10) || '").replace("\\\\", "\\")
    + " SELECT k.conv_id, count(*) AS chunks, count(p.section) AS with_parent, sum(CASE WHEN k.heading LIKE '% / %' THEN 2 ELSE 1 END)::BIGINT AS depth FROM k LEFT JOIN k p ON p.conv_id = k.conv_id AND p.section = k.up GROUP BY k.conv_id"
)


def _turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each conversation of four turns or more, and one for each turn, whose parent is its conversation's."""
    c = read(spark, sf_dir, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    title = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    top = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select(name.alias("chunk_id"), F.concat(title, F.lit(" of "), F.col("n").cast("string")).alias("content"), F.array(title).alias("heading_path"), F.lit(None).cast("string").alias("parent_id"))
    turns = c.select(F.concat(name, F.lit("t"), F.col("turn").cast("string")).alias("chunk_id"), F.col("text").alias("content"), F.array(title, F.col("role")).alias("heading_path"), name.alias("parent_id"))
    return top.unionByName(turns)


_TURNS = """top AS (SELECT 'c' || conv_id AS chunk_id, 'conversation ' || conv_id || ' of ' || count(*) AS content, NULL AS parent_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4),
ch AS (SELECT * FROM top UNION ALL SELECT 'c' || conv_id || 't' || turn, text, 'c' || conv_id FROM conversations)"""


def q_expand_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_chunks(spark, sf_dir)
    return expand_to_parent(chunks, chunks).select("chunk_id", "parent_content", "parent_found")


EXPAND_PARENT = f"WITH {_TURNS} SELECT h.chunk_id, p.content AS parent_content, p.chunk_id IS NOT NULL AS parent_found FROM ch h LEFT JOIN ch p ON p.chunk_id = h.parent_id AND h.parent_id <> h.chunk_id"


def q_flatten_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_chunks(spark, sf_dir)
    return flatten_with_parent_content(expand_to_parent(chunks, chunks)).select("chunk_id", "content")


FLATTEN_PARENT = f"WITH {_TURNS} SELECT h.chunk_id, coalesce(p.content, h.content) AS content FROM ch h LEFT JOIN ch p ON p.chunk_id = h.parent_id"


def q_parents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents of the assistants' turns, and of what has none."""
    chunks = _turn_chunks(spark, sf_dir)
    asked = chunks.filter("element_at(heading_path, -1) <> 'user'").select("chunk_id")
    return parents_of(chunks, asked.unionByName(asked)).select("child_id", "chunk_id", "content")


PARENTS_OF = f"""WITH {_TURNS}, a AS (SELECT 'c' || conv_id || 't' || turn AS child_id, 'c' || conv_id AS up FROM conversations WHERE role <> 'user')
SELECT child_id, chunk_id, content FROM a JOIN top ON chunk_id = up"""


def q_strict_parent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_chunks(spark, sf_dir)
    return parent_audit(expand_to_parent(chunks, chunks))


STRICT_PARENT_AUDIT = f"WITH {_TURNS} SELECT count(*) AS n_hits, count(*) FILTER (p.chunk_id IS NULL) AS n_missing FROM ch h LEFT JOIN ch p ON p.chunk_id = h.parent_id"


def q_citation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    path = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(F.array(F.col("conv_id").cast("string"), F.col("role")))
    lines = F.when(F.col("role") != "system", F.struct((F.col("turn") + 1).alias("start"), (F.col("turn") + 9).alias("end")))
    return c.select("conv_id", "turn", heading_display(path).alias("heading"), lines_display(lines).alias("lines"), console_preview(F.col("text")).alias("preview"), preview(F.col("text"), 500).alias("preview_500"))


CITATION_PREVIEW = """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN '(root)' ELSE conv_id || ' > ' || role END AS heading, CASE WHEN role = 'system' THEN 'L?' ELSE 'L' || (turn + 1) || '-' || (turn + 9) END AS lines,
       replace(substr(text, 1, 200), chr(10), ' ') || CASE WHEN strlen(text) > 200 THEN '…' ELSE '' END AS preview, substr(text, 1, 500) AS preview_500
FROM conversations
"""


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".ETS").when(F.col("lang") == "fr", ".kt").otherwise("")
    return read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("source"), "text")


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("source"), F.lit(None).cast("string").alias("text"))


_FILES = """f AS (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.ETS' WHEN 'fr' THEN '.kt' ELSE '' END AS source, text FROM documents
  UNION ALL SELECT regexp_extract(url, '://[^/?#]*([^?#]*)', 1), NULL FROM pages),
d AS (SELECT source, text, CASE lower(regexp_extract(source, '[^/.][^/]*\\.([^./]+)$', 1)) WHEN 'md' THEN 'markdown' WHEN 'ets' THEN 'arkts' WHEN 'kt' THEN 'kotlin' ELSE 'auto' END AS lang FROM f)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_files(spark, sf_dir).unionByName(_page_paths(spark, sf_dir)).withColumn("lang", detect_lang(F.col("source")))


def q_lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("first"))


LANG_DETECT = f"WITH {_FILES} SELECT lang, count(*) AS n, min(source) AS first FROM d GROUP BY lang".replace("\\\\", "\\")


def q_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each line with text of the files that have a chunker."""
    files = _files(spark, sf_dir)
    chunks = files.filter(F.col("lang").isin("markdown", "arkts")).select("source", F.explode(F.split("text", "\n")).alias("line")).filter(F.length(F.trim("line")) > 0)
    return index_stats(files, chunks, ["markdown", "arkts"])


INDEX_STATS = f"""WITH {_FILES}, c AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM d WHERE lang IN ('markdown', 'arkts'))
SELECT (SELECT count(DISTINCT source) FROM c WHERE trim(line) <> '') AS files, (SELECT count(*) FROM c WHERE trim(line) <> '') AS chunks,
       (SELECT count(*) FROM d WHERE lang NOT IN ('markdown', 'arkts')) AS skipped""".replace("\\\\", "\\")


def q_corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folder_counts(_document_files(spark, sf_dir), ("src0", "src1", "src2", "src3", "absent"))


CORPUS_COUNTS = "SELECT f AS folder, count(doc_id) AS n FROM (VALUES ('src0'), ('src1'), ('src2'), ('src3'), ('absent')) AS v(f) LEFT JOIN documents ON source = f GROUP BY f"


def _platform_raw() -> Column:
    return F.when(F.col("lang") == "en", "Harmony").when(F.col("lang") == "de", "OpenHarmony").when(F.col("lang") == "fr", "iOS").otherwise("windows")


def q_frontmatter_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("source") == "src0", "API_DOC").when(F.col("source") == "src1", "error_fix").when(F.col("source") == "src2", "nonsense")
    d = read(spark, sf_dir, "documents").select(platform_name(_platform_raw()).alias("platform"), chunk_type(kind).alias("type"))
    return d.groupBy("platform", "type").agg(F.count(F.lit(1)).alias("n"))


FRONTMATTER_APPLY = """
SELECT CASE lang WHEN 'en' THEN 'harmonyos' WHEN 'de' THEN 'harmonyos' WHEN 'fr' THEN 'ios' END AS platform,
       CASE source WHEN 'src0' THEN 'api_doc' WHEN 'src1' THEN 'error_fix' ELSE 'generic' END AS type, count(*) AS n FROM documents GROUP BY 1, 2
"""


def q_upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.concat_ws("|", "source", "lang").alias("key"), "doc_id", "n_chars")
    return last_write(d, "key", F.col("doc_id"))


UPSERT_LAST_WRITE = "SELECT source || '|' || lang AS key, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1"


def q_delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = read(spark, sf_dir, "labels").filter("toxic = 1")
    return delete(read(spark, sf_dir, "documents").select("doc_id", "source"), toxic, "doc_id")


DELETE_IDS = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"

QUERIES = {
    "markdown_chunks": q_markdown_chunks, "markdown_parents": q_markdown_parents, "expand_parent": q_expand_parent, "flatten_parent": q_flatten_parent,
    "strict_parent_audit": q_strict_parent_audit, "parents_of": q_parents_of, "citation_preview": q_citation_preview, "lang_detect": q_lang_detect, "index_stats": q_index_stats,
    "corpus_counts": q_corpus_counts, "frontmatter_apply": q_frontmatter_apply, "upsert_last_write": q_upsert_last_write, "delete_ids": q_delete_ids,
}
SQL = {
    "markdown_chunks": MARKDOWN_CHUNKS, "markdown_parents": MARKDOWN_PARENTS, "expand_parent": EXPAND_PARENT, "flatten_parent": FLATTEN_PARENT,
    "strict_parent_audit": STRICT_PARENT_AUDIT, "parents_of": PARENTS_OF, "citation_preview": CITATION_PREVIEW, "lang_detect": LANG_DETECT, "index_stats": INDEX_STATS,
    "corpus_counts": CORPUS_COUNTS, "frontmatter_apply": FRONTMATTER_APPLY, "upsert_last_write": UPSERT_LAST_WRITE, "delete_ids": DELETE_IDS,
}
