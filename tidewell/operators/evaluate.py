"""Retrieval quality: recall, reciprocal rank, misses and latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError


def per_query(returned: DataFrame, truth: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """query_id, recall, mrr, hits, missed and latency_ms for each row of truth (query_id, relevant).

    Recall counts distinct relevant ids and is 0 without any; missed keeps the order and the repeats of relevant.
    """
    latency = F.max("latency_ms") if "latency_ms" in returned.columns else F.lit(None).cast("long")
    top = returned.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).alias("id")))), lambda x: x["id"]).alias("ids"), latency.alias("latency_ms"))
    kind = dict(returned.dtypes)[id_col]
    r = truth.select("query_id", "relevant").join(top, "query_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast(f"array<{kind}>")))
    want = F.array_distinct(F.coalesce("relevant", F.array().cast(f"array<{kind}>")))
    hits = F.size(F.array_intersect("ids", want))
    recall = F.when(F.size(want) == 0, F.lit(0.0)).otherwise(hits / F.size(want))
    first = F.array_position(F.transform("ids", lambda i: F.array_contains(want, i)), True)
    mrr = F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0))
    missed = F.filter("relevant", lambda i: ~F.array_contains("ids", i))
    return r.select("query_id", recall.alias("recall"), mrr.alias("mrr"), hits.cast("long").alias("hits"), missed.alias("missed"), "latency_ms")


def per_query_judged(judged: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """query_id, recall, mrr and hits for each row of totals (query_id, n_relevant); judged: query_id, rank and whether the hit is relevant. What is relevant need not be listed."""
    good = (F.col("rank") <= k) & F.coalesce("relevant", F.lit(False))
    found = judged.groupBy("query_id").agg(F.count_if(good).alias("hits"), F.min(F.when(good, F.col("rank"))).alias("first"))
    r = totals.join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    recall = F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(F.lit(0.0))
    return r.select("query_id", recall.alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), "hits")


def upper_median(values: Column) -> Column:
    """sorted[min(n / 2, n - 1)]: an element, not an interpolation."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.get(s, F.least(F.floor(n / 2).cast("int"), n - 1))


def nearest_rank(values: Column, q: float) -> Column:
    """sorted[ceil(q n) - 1]."""
    s = F.array_sort(values)
    return F.get(s, F.greatest(F.lit(0), F.ceil(F.lit(q) * F.size(s)).cast("int") - 1))


def exact_percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, p50 (upper median), p99 (nearest rank) and n, exact, without gathering a group anywhere.

    A mergeable sketch gives values shortly below and above each place, with room for its error. What lies below is counted, and only the few values
    in between are put in order.
    """
    room, accuracy = 0.002, 10_000
    g, v = F.col(group).alias("_g"), F.col(value).alias("_v")
    rows = df.select(g, v).filter("_v IS NOT NULL")
    near = [min(1.0, max(0.0, q + d)) for q in (0.5, 0.99) for d in (-room, room)]
    bounds = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", near, accuracy).alias("_b"))
    places = (F.least(F.floor(F.col("_n") / 2), F.col("_n") - 1), F.ceil(F.col("_n") * 0.99) - 1)
    bounds = bounds.select(F.col("_g").alias("_h"), "_n", *(p.alias(f"_place{k}") for k, p in enumerate(places)), *(F.get("_b", F.lit(2 * k + i)).alias(f"_{side}{k}") for k in (0, 1) for i, side in enumerate(("lo", "hi"))))
    met = rows.join(bounds, F.col("_g").eqNullSafe(F.col("_h")))
    within = [F.col("_v").between(F.col(f"_lo{k}"), F.col(f"_hi{k}")) for k in (0, 1)]
    below = [F.count_if(F.col("_v") < F.col(f"_lo{k}")).alias(f"_below{k}") for k in (0, 1)]
    # a row is counted once, for both places; equal values between bounds are counted, not listed
    met = met.withColumn("_in", F.when(within[0] | within[1], F.col("_v")))
    counted = met.groupBy("_g", *(c for c in bounds.columns if c != "_h"), "_in").agg(F.count(F.lit(1)).alias("_c"), *below)
    whole, upto = Window.partitionBy("_g"), Window.partitionBy("_g").orderBy(F.col("_in").asc_nulls_first())
    hits = []
    for k in (0, 1):
        inside = F.coalesce(F.col("_in").between(F.col(f"_lo{k}"), F.col(f"_hi{k}")), F.lit(False))
        to = F.sum(f"_below{k}").over(whole) + F.sum(F.when(inside, F.col("_c")).otherwise(0)).over(upto)
        hits.append(F.when(inside & (to - F.col("_c") <= F.col(f"_place{k}")) & (F.col(f"_place{k}") < to), F.col("_in")).alias(f"_hit{k}"))
    placed = counted.select("_g", "_n", *hits)
    return placed.groupBy(F.col("_g").alias(group)).agg(F.max("_hit0").alias("p50"), F.max("_hit1").alias("p99"), F.max("_n").alias("n"))


def summarize(results: DataFrame) -> DataFrame:
    """n_queries, mean recall and mrr, mean, p50 and p99 latency, as one row. An empty query set is an error."""
    if results.isEmpty():
        raise ConfigError("the query set is empty")
    means = results.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("latency_ms").alias("latency_mean"))
    places = exact_percentiles(results.withColumn("_all", F.lit(0)), "_all", "latency_ms").select(F.col("p50").alias("latency_p50"), F.col("p99").alias("latency_p99"))
    return means.join(F.broadcast(places), F.lit(True), "left")  # one row each


def report(results: DataFrame, title: str, run_at: str) -> str:
    """A Markdown report: summary, a row for each query, and the misses."""
    s = summarize(results).first()
    cell = lambda x: str(x).replace("|", "\\|")
    short = lambda x: x if len(x) <= 40 else x[:38] + "…"
    out = [f"# {title}", "", f"Run at {run_at}. Queries: {s['n_queries']}.", "", "| metric | value |", "|---|---|"]
    out += [f"| {name} | {s[key]:.3f} |" if isinstance(s[key], float) else f"| {name} | {s[key]} |" for name, key in (("recall", "recall"), ("MRR", "mrr"), ("mean latency ms", "latency_mean"), ("p50 latency ms", "latency_p50"), ("p99 latency ms", "latency_p99"))]
    out += ["", "| query | recall | MRR | hits |", "|---|---|---|---|"]
    rows = results.orderBy("query_id").collect()
    out += [f"| {cell(short(str(r['query_id'])))} | {r['recall']:.3f} | {r['mrr']:.3f} | {r['hits']} |" for r in rows]
    failed = [r for r in rows if r["missed"]]
    if failed:
        out += ["", "## Misses", ""] + [f"- {cell(r['query_id'])}: {', '.join(map(cell, r['missed']))}" for r in failed]
    return "\n".join(out) + "\n"


def smoke_totals(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """total and answered (queries with a hit), as one row."""
    answered = hits.select("query_id").distinct().withColumn("answered", F.lit(1))
    return queries.join(answered, "query_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("answered").alias("answered"))


def smoke_report(queries: DataFrame, hits: DataFrame, title: str, run_at: str) -> str:
    """A Markdown report of a query set without ground truth: its hits, what was expected, and totals. hits: the top few of each query."""
    by_query: dict = {}
    for h in hits.orderBy("query_id", "rank").collect():
        by_query.setdefault(h["query_id"], []).append(h)
    number = lambda x: "—" if x is None else f"{x:.4f}"
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", f"Run at {run_at}."]
    for q in queries.orderBy("query_id").collect():
        out += ["", f"## {q['query_id']}: {q['query']}", "", f"Expected: {q['expect'] or '—'}", "", "| rank | chunk | score | vector | full text |", "|---|---|---|---|---|"]
        out += [f"| {h['rank']} | {cell(h['chunk_id'])} | {number(h['score'])} | {number(h['vector_score'])} | {number(h['bm25_score'])} |" for h in by_query.get(q["query_id"], [])]
    total, answered = smoke_totals(queries, hits).first()
    return "\n".join([*out, "", f"Queries: {total}, with hits: {answered}.", ""])
