import pytest
from pyspark.sql import functions as F

from tidewell.errors import RetrievalError
from tidewell.functions.embed import hash_embed
from tidewell.operators import blocks, context, filters, fulltext, fusion, vector
from tidewell.operators.filters import Filters


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_vector_topk_unit_vectors(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0]), ("c", [0.0, 0.0, 1.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [0.9, 0.1, 0.0, 0.0])], "query_id string, embedding array<double>")
    out = rows(vector.vector_topk(corpus, q, 2).orderBy("rank"), "rank", "chunk_id")
    assert out == [(1, "a"), (2, "b")]


def test_vector_topk_empty_sides(spark):
    corpus = spark.createDataFrame([], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    assert vector.vector_topk(corpus, q, 2).count() == 0
    assert vector.vector_topk(corpus, q.limit(0), 2).count() == 0


def test_vector_ties_go_to_the_lesser_id_in_any_partitioning(spark):
    corpus = spark.createDataFrame([(f"c{i:02}", [1.0, 0.0]) for i in range(40)], "chunk_id string, embedding array<double>").repartition(7)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [r[0] for r in rows(vector.vector_topk(corpus, q, 3).orderBy("rank"), "chunk_id")] == ["c00", "c01", "c02"]


def test_wrong_width_is_an_error(spark):
    bad = spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0] * 4)], "query_id string, embedding array<double>")
    with pytest.raises(Exception, match="width"):
        vector.vector_topk(bad, q, 1).collect()
    with pytest.raises(Exception, match="width"):
        vector.check_dim(bad, "embedding", 4).collect()


def test_rrf(spark):
    ranks = {"x": {"m": 1, "n": 2, "o": 3}, "y": {"n": 1, "p": 2, "m": 4}, "z": {"o": 1}}
    lists = [spark.createDataFrame([("q", r, c) for c, r in ranks[k].items()], "query_id string, rank long, chunk_id string") for k in "xyz"]
    want = {c: sum(1 / (60 + r[c]) for r in ranks.values() if c in r) for c in "mnop"}
    out = rows(fusion.rrf_fuse(lists).orderBy("rank"), "chunk_id", "score")
    assert [c for c, _ in out] == sorted(want, key=lambda c: (-round(want[c], 9), c)) and all(s == pytest.approx(want[c], abs=1e-8) for c, s in out)
    assert rows(fusion.rrf_fuse(lists[::-1]).orderBy("rank"), "chunk_id", "score") == out
    tied = rows(fusion.rrf_fuse([lists[2], lists[1].filter("rank = 1")]).orderBy("rank"), "chunk_id")
    assert tied == [("n",), ("o",)]  # equal scores: the lesser id first
    with pytest.raises(ValueError):
        fusion.rrf_fuse([])


BOATS = [("b1", "Ferries to the northern islands leave at noon", "Harbour / Timetable"), ("b2", "渡轮 时刻表 the night boat", "Harbour / Winter"), ("b3", "mooring fees, banana boats and anagrams", "Prices"), ("b4", None, "Lost and found"), ("b5", "", "")]


def boats(spark):
    return spark.createDataFrame(BOATS, "chunk_id string, content string, heading string")


def test_bm25(spark):
    ask = lambda t, **kw: rows(fulltext.bm25_topk(boats(spark), spark.createDataFrame([("q", t)], "query_id string, query string"), 5, **kw).orderBy("rank"), "chunk_id")
    assert ask("时刻") == [("b2",)] and ask("NORTH leave") == [("b1",)] and ask("north mooring") == []
    assert ask("   ") == [] and ask("x") == [] and ask("found") == [] and ask(None) == []
    both = {"field": ("content", "heading")}
    assert ask("found", **both) == [("b4",)] and ask("timetable noon", **both) == [("b1",)] and sorted(ask("harbour", **both)) == [("b1",), ("b2",)]
    assert fulltext.bm25_topk(boats(spark).limit(0), spark.createDataFrame([("q", "boat")], "query_id string, query string"), 5).count() == 0


def test_query_syntax(spark):
    def ask(t):
        q = spark.createDataFrame([("q", t)], "query_id string, query string")
        return sorted(r[0] for r in rows(fulltext.bm25_topk(boats(spark), q, 5, field=("content", "heading"), syntax=True), "chunk_id"))

    assert ask('"night boat"') == ["b2"] and ask('"boat night"') == [] and ask("boat -banana") == ["b2"] and ask("+boat +fees") == ["b3"]
    assert ask("heading:harbour") == ["b1", "b2"] and ask("content:harbour") == [] and ask('heading:"lost and"') == ["b4"]
    assert ask('boat "unclosed') == [] and ask("no:such") == [] and ask("-boat") == [] and ask('"') == []


def test_overlapping_grams_count(spark):
    assert [fulltext.occurrences(t, g) for t, g in (("banana", "ana"), ("aaaa", "aa"), ("aaaa", "aaa"), ("abab", "ab"), ("xyz", "zz"))] == [2, 3, 2, 2, 0]
    d = spark.createDataFrame([("a", "banana aaaa"), ("b", None)], "chunk_id string, content string")
    got = {r.term: r.tf for r in fulltext.postings(d).collect()}
    assert all(fulltext.occurrences("banana aaaa", g) == n for g, n in got.items()) and sum(got.values()) == 10 + 9


def test_scan_and_postings_agree(spark):
    both = ("content", "heading")
    index = blocks.index_of(boats(spark).repartition(3), both)
    q = spark.createDataFrame([("1", "boat"), ("2", "harbour the"), ("3", "an"), ("4", "the 时刻表"), ("5", "b"), ("6", '"night boat"'), ("7", "heading:harbour -banana"), ("8", "nanaba")], "query_id string, query string")
    for syntax in (False, True):
        scan = sorted(rows(fulltext.bm25_topk(boats(spark), q, 2, field=both, syntax=syntax), "query_id", "rank", "chunk_id", "score"))
        assert scan == sorted(rows(blocks.search_blocks(index, q, 2, syntax=syntax), "query_id", "rank", "chunk_id", "score")) and len(scan) > 5


def test_null_vectors_are_not_found(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "query_id string, embedding array<double>")
    assert rows(vector.vector_topk(c, q, 5), "query_id", "chunk_id") == [("q", "a")]


def test_filters_differ_by_branch(spark):
    data = [("a", ["harmonyos"], "12", False, ["ui"]), ("b", [], None, False, []), ("c", ["android"], "11", True, ["ui", "x"])]
    c = spark.createDataFrame(data, "chunk_id string, platforms array<string>, api_version string, deprecated boolean, tags array<string>")
    got = lambda f: sorted(r[0] for r in rows(c.filter(f), "chunk_id"))
    assert got(filters.vector_filter(Filters())) == ["a", "b"] and got(filters.fulltext_filter(Filters(include_deprecated=True))) == ["a", "b", "c"]
    assert got(filters.vector_filter(Filters(platforms=("harmonyos",)))) == ["a", "b"] and got(filters.fulltext_filter(Filters(platforms=("harmonyos",)))) == ["a"]
    assert got(filters.vector_filter(Filters(api_version="12"))) == ["a", "b"] and got(filters.fulltext_filter(Filters(api_version="12"))) == ["a"]
    assert got(filters.vector_filter(Filters(tags=("ui", "x"), include_deprecated=True))) == ["a", "c"] and got(filters.fulltext_filter(Filters(tags=("ui", "x"), include_deprecated=True))) == ["c"]


def test_threshold_drops_unknown_scores(spark):
    h = spark.createDataFrame([("a", 0.8), ("b", None), ("c", 0.2)], "chunk_id string, vector_score double")
    assert rows(filters.score_threshold(h, 0.5), "chunk_id") == [("a",)]


def test_parents(spark):
    c = spark.createDataFrame([("p1", None, "parent", ["P"]), ("c1", "p1", "child", ["P", "C"]), ("o", None, "orphan", []), ("x", "gone", "dangling", []), ("s", "s", "self", [])], "chunk_id string, parent_id string, content string, heading_path array<string>")
    e = context.expand_to_parent(c, c)
    assert sorted(rows(e, "chunk_id", "parent_found")) == [("c1", True), ("o", False), ("p1", False), ("s", False), ("x", False)]
    assert dict(rows(context.flatten_with_parent_content(e), "chunk_id", "content"))["c1"] == "parent"
    with pytest.raises(RetrievalError):
        context.expand_strict(c, c)
    assert context.expand_strict(c.filter("chunk_id = 'c1'"), c).count() == 1
    assert rows(context.parent_of(c, "c1"), "chunk_id") == [("p1",)]


def test_scores_from_distances(spark):
    d = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (7.0,), (-1.0,), (None,), (float("nan"),)], "d double")
    assert [r[0] for r in d.select(vector.distance_score(F.col("d"))).collect()] == [1.0, 0.75, 0.0, 0.0, 1.0, None, None]


def test_previews(spark):
    d = spark.createDataFrame([("é" * 150, ["a", "b"]), ("x\ny", [])], "t string, h array<string>")
    out = rows(d, context.console_preview(F.col("t")), context.heading_display(F.col("h")))
    assert out == [("é" * 150 + "…", "a > b"), ("x y", "(root)")]


def test_hash_embedding(spark):
    d = spark.createDataFrame([("one",), ("one",), ("two",)], "t string").select(hash_embed(F.col("t"), 32).alias("v"))
    a, b, c = (r[0] for r in d.collect())
    assert a == b != c and sum(x * x for x in a) == pytest.approx(1, abs=1e-5)
