"""Queries on retrieval quality, query enhancement and log reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.enhance import INTENT_KEYWORDS, TEMPLATES, classify_intent, extract_entities, hyde_document
from ..operators.containment import contained
from ..operators.evaluate import exact_percentiles, per_query, per_query_judged
from ..operators.logs import annotate, append_new, classify_change, classify_path, override_reason, pending, summary, top_n, trend
from ..operators.vector import vector_topk
from ..streaming.ingest import windowed_counts
from .search import _SCORES, _vectors, read


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of each query vector."""
    corpus, queries = _vectors(spark, sf_dir)
    top = vector_topk(corpus, queries, 11, "vec_id").filter("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return top.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10")


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The ten nearest others of each query vector, and all others of its label: what a list of misses is made of."""
    e = read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    same = asked.join(e.select("vec_id", "label"), "label").filter("vec_id <> query_id")
    truth = same.groupBy("query_id").agg(F.array_sort(F.collect_list("vec_id")).alias("relevant"))
    return _top(spark, sf_dir), truth


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The hits with whether their label is the query's, and how many others have it. A number for each label, no lists."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = _top(spark, sf_dir)
    hit, asked = e.withColumnRenamed("label", "hit_label"), e.withColumnRenamed("vec_id", "query_id")
    judged = top.join(hit, "vec_id").join(asked, "query_id").select("query_id", "rank", (F.col("hit_label") == F.col("label")).alias("relevant"))
    sizes = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    return judged, asked.filter("query_id % 50 = 0").join(sizes, "label").select("query_id", "n_relevant")


_OTHERS = (
    _SCORES.format(where=" WHERE c.vec_id <> q.query_id")
    + """, t AS (SELECT *, label = q_label AS good FROM r WHERE rank <= 10),
n AS (SELECT query_id, count(*) AS n FROM s WHERE label = q_label GROUP BY 1)"""
)


def q_eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_query_judged(*_judged(spark, sf_dir), 10).select("query_id", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), "hits")


EVAL_RECALL_MRR = f"""WITH {_OTHERS}
SELECT query_id, round(count(*) FILTER (good)::DOUBLE / max(n.n), 9) AS recall, round(coalesce(1.0e0 / min(rank) FILTER (good), 0.0e0), 9) AS mrr, count(*) FILTER (good) AS hits
FROM t JOIN n USING (query_id) GROUP BY query_id"""


def q_eval_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_query(*_ranked(spark, sf_dir), 10, "vec_id").select("query_id", F.array_join(F.transform("missed", lambda x: x.cast("string")), ",").alias("missed"), F.size("missed").cast("long").alias("n_missed"))


EVAL_MISSED = f"""WITH {_OTHERS}, m AS (SELECT s.query_id, s.vec_id FROM s WHERE s.label = s.q_label AND (s.query_id, s.vec_id) NOT IN (SELECT (query_id, vec_id) FROM t))
SELECT query_id, coalesce(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id), '') AS missed, count(vec_id) AS n_missed FROM (SELECT DISTINCT query_id FROM s) LEFT JOIN m USING (query_id) GROUP BY query_id"""


def q_eval_benchmark_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: documents that hold the item as it stands. Returned: the first five that hold it in any case. Items found nowhere have recall 0."""
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    truth = contained(d, b, "doc_id", "text", "item_id", "text").groupBy(F.col("item_id").alias("query_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("relevant"))
    truth = b.select(F.col("item_id").alias("query_id")).join(truth, "query_id", "left")
    low = lambda df: df.withColumn("text", F.lower("text"))
    found = contained(low(d), low(b), "doc_id", "text", "item_id", "text").withColumnRenamed("item_id", "query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).cast("long"))
    return per_query(found, truth, 5, "doc_id").select("query_id", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), "hits")


EVAL_BENCHMARK_QRELS = """
WITH m AS (SELECT item_id, doc_id, contains(d.text, b.text) AS good FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text))),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM m),
a AS (SELECT item_id, count(*) FILTER (good) AS n, count(*) FILTER (good AND rank <= 5) AS hits, min(rank) FILTER (good AND rank <= 5) AS first FROM r GROUP BY 1)
SELECT b.item_id AS query_id, round(CASE WHEN coalesce(n, 0) = 0 THEN 0.0e0 ELSE hits::DOUBLE / n END, 9) AS recall, round(coalesce(1.0e0 / first, 0.0e0), 9) AS mrr, coalesce(hits, 0) AS hits
FROM benchmark b LEFT JOIN a USING (item_id)
"""


def q_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_percentiles(read(spark, sf_dir, "events"), "event_type", "value")


LATENCY_PERCENTILES = """
WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[least(len(v) // 2, len(v) - 1) + 1] AS p50, v[ceil(0.99 * len(v))::BIGINT] AS p99, len(v)::BIGINT AS n FROM l
"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as queries, with a keyword by role and place."""
    word = F.when(F.col("role") == "system", "Adaptive").when(F.col("turn") == 0, "Router 页面").when(F.col("turn") == 1, "修复").when(F.col("turn") == 2, "KMP").otherwise("列表")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 3, F.col("text")).otherwise(F.concat("text", F.lit(" "), word)).alias("raw"))


_ASKED = """a AS (SELECT conv_id, turn, CASE WHEN turn > 3 THEN text ELSE text || ' ' || CASE WHEN role = 'system' THEN 'Adaptive' WHEN turn = 0 THEN 'Router 页面' WHEN turn = 1 THEN '修复' WHEN turn = 2 THEN 'KMP' ELSE '列表' END END AS raw FROM conversations),
i AS (SELECT *, CASE """ + " ".join(f"WHEN {' OR '.join(f'contains(lower(raw), {k!r})' for k in keys)} THEN '{name}'" for name, keys in INTENT_KEYWORDS) + " ELSE 'generic' END AS intent FROM a)"  # fmt: skip


def q_intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", classify_intent(F.col("raw")).alias("intent"))


INTENT_CLASSIFY = f"WITH {_ASKED} SELECT conv_id, turn, intent FROM i"


def q_hyde_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", F.md5(hyde_document(F.col("raw"), classify_intent(F.col("raw")))).alias("hyde_md5"))


def _sql_template(template: str) -> str:
    head, tail = template.replace("{{", "\0").replace("}}", "\1").split("{}")
    text = lambda s: "'" + s.replace("\0", "{").replace("\1", "}").replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"{text(head)} || raw || {text(tail)}"


HYDE_TEMPLATE = f"WITH {_ASKED} SELECT conv_id, turn, md5(CASE intent " + " ".join(f"WHEN '{k}' THEN {_sql_template(t)}" for k, t in TEMPLATES.items()) + " END) AS hyde_md5 FROM i"


def q_entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = extract_entities(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", F.size("e").cast("long").alias("n_entities"), F.md5(F.array_join("e", " ")).alias("entities_md5"))


ENTITY_EXTRACT = r"""
WITH p AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_.]+'), lambda x: strlen(x) >= 2 AND regexp_matches(x, '[\p{Lu}.0-9]')) AS v FROM documents),
e AS (SELECT doc_id, list_filter(v, lambda x, i: i = 1 OR x <> v[i - 1]) AS e FROM p)
SELECT doc_id, len(e)::BIGINT AS n_entities, md5(array_to_string(e, ' ')) AS entities_md5 FROM e
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a development log."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("commit"), F.col("event_type").alias("type"), F.to_date("ts").alias("day"), F.floor("value").alias("lines_added"), F.when(F.col("event_type") != "click", F.col("user_id")).alias("lines_removed"), F.when(F.col("value") > 50, F.col("user_id")).alias("input_tokens_actual"), F.lit(None).cast("long").alias("output_tokens_actual"))


_LOG = "g AS (SELECT event_id AS commit, event_type AS type, ts::DATE AS day, floor(value)::BIGINT AS lines_added, CASE WHEN event_type <> 'click' THEN user_id END AS lines_removed, CASE WHEN value > 50 THEN user_id END AS input_tokens_actual FROM events)"


def q_stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_log(spark, sf_dir))


STATS_SUMMARY = f"""WITH {_LOG} SELECT count(*) AS entries, coalesce(sum(lines_added), 0)::BIGINT AS lines_added, coalesce(sum(lines_removed), 0)::BIGINT AS lines_removed, coalesce(sum(input_tokens_actual), 0)::BIGINT AS input_tokens,
0::BIGINT AS output_tokens, count(input_tokens_actual) AS annotated, (5 * (coalesce(sum(lines_added), 0) + coalesce(sum(lines_removed), 0)))::BIGINT AS estimated_tokens FROM g"""


def q_stats_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend(_log(spark, sf_dir), "day", "lines_added")


STATS_TREND = f"""WITH {_LOG}, d AS (SELECT day, coalesce(sum(lines_added), 0)::BIGINT AS total FROM g GROUP BY day)
SELECT day, total, sum(total) OVER (ORDER BY day)::BIGINT AS running, (5 * sum(total) OVER (ORDER BY day))::BIGINT AS running_estimate FROM d"""


def q_stats_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(_log(spark, sf_dir).select("commit", "lines_added"), "lines_added", 5)


STATS_TOPN = f"WITH {_LOG} SELECT commit, lines_added FROM g ORDER BY lines_added DESC NULLS LAST, commit LIMIT 5"


def q_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).filter("type = 'click'").select("commit", "type", "lines_added")
    return append_new(log, _log(spark, sf_dir).select("commit", "type", "lines_added")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("commit").alias("commits"))


LOG_APPEND = "SELECT event_type AS type, count(*) AS n, count(DISTINCT event_id) AS commits FROM events GROUP BY 1"


def q_log_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = read(spark, sf_dir, "events").select(F.col("event_id").alias("commit"), F.when(F.col("event_type") == "click", F.lit(1).cast("long")).alias("input_tokens_actual"))
    return annotate(_log(spark, sf_dir).select("commit", "type", "input_tokens_actual"), notes)


LOG_ANNOTATE = f"WITH {_LOG} SELECT commit, type, CASE WHEN type = 'click' THEN 1 ELSE input_tokens_actual END AS input_tokens_actual FROM g"


def q_change_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    return classify_change(p.withColumn("kind", classify_path(F.col("path"), ("/en/1", "/fr/"), ("/en/2", "/es/"))), "host")


CHANGE_CLASSIFY = """
WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT host, bool_or(starts_with(path, '/en/1') OR starts_with(path, '/fr/')) AS m, bool_or(starts_with(path, '/en/2') OR starts_with(path, '/es/')) AS b FROM p GROUP BY host)
SELECT host, CASE WHEN m AND b THEN 'mixed' WHEN m THEN 'meta' WHEN b THEN 'business' ELSE 'unknown' END AS change FROM h
"""


def q_pending_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(read(spark, sf_dir, "documents"), "doc_id", "text", "^(All rights|Licensed|This work|The )")


PENDING_SCAN = """
SELECT * FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(All rights|Licensed|This work|The )')))::BIGINT AS n_pending FROM documents) WHERE n_pending > 0
"""


def q_override_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", override_reason(F.col("text"), r"\bthe\s+(\w+)").alias("reason"))
    return c.filter(F.col("reason").isNotNull())


OVERRIDE_AUDIT = r"SELECT * FROM (SELECT conv_id, turn, nullif(regexp_extract(text, '\bthe\s+(\w+)', 1), '') AS reason FROM conversations) WHERE reason IS NOT NULL"


def q_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(read(spark, sf_dir, "events"), "1 day").select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


WINDOWED_COUNTS = "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

QUERIES = {
    "eval_recall_mrr": q_eval_recall_mrr, "eval_missed": q_eval_missed, "eval_benchmark_qrels": q_eval_benchmark_qrels, "latency_percentiles": q_latency_percentiles,
    "intent_classify": q_intent_classify, "hyde_template": q_hyde_template, "entity_extract": q_entity_extract, "stats_summary": q_stats_summary, "stats_trend": q_stats_trend,
    "stats_topn": q_stats_topn, "log_append": q_log_append, "log_annotate": q_log_annotate, "change_classify": q_change_classify, "pending_scan": q_pending_scan,
    "override_audit": q_override_audit, "windowed_counts": q_windowed_counts,
}
SQL = {
    "eval_recall_mrr": EVAL_RECALL_MRR, "eval_missed": EVAL_MISSED, "eval_benchmark_qrels": EVAL_BENCHMARK_QRELS, "latency_percentiles": LATENCY_PERCENTILES,
    "intent_classify": INTENT_CLASSIFY, "hyde_template": HYDE_TEMPLATE, "entity_extract": ENTITY_EXTRACT, "stats_summary": STATS_SUMMARY, "stats_trend": STATS_TREND,
    "stats_topn": STATS_TOPN, "log_append": LOG_APPEND, "log_annotate": LOG_ANNOTATE, "change_classify": CHANGE_CLASSIFY, "pending_scan": PENDING_SCAN,
    "override_audit": OVERRIDE_AUDIT, "windowed_counts": WINDOWED_COUNTS,
}
