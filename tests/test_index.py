"""Blocks of postings, clusters of vectors and deletion bitmaps against plain scans."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators import blocks, clusters, fulltext, vector
from tidewell.operators.filters import Filters, fulltext_filter, vector_filter
from tidewell.sources.index import Store

BOTH = ("content", "heading_path")


@given(st.lists(st.integers(0, 1 << 50)))
def test_deltas(x):
    raw, sizes = blocks.pack_deltas(np.array(x, dtype=np.int64))
    assert blocks.unpack_deltas(raw.tobytes()).tolist() == x and sizes.sum() == len(raw)


def decoded(texts):
    """(term, document) -> (tf, places) of encode_field."""
    lengths = np.array([fulltext.gram_count(len(t)) for t in texts])
    made = blocks.encode_field("f", texts, np.arange(len(texts)), lengths)
    out = {}
    if made:
        for k in range(len(made["n"])):
            at, tf = np.frombuffer(made["offsets"][k].as_py(), dtype=np.uint8), np.frombuffer(made["tf"][k].as_py(), dtype="<u4")
            raw = made["places"][k].as_py()
            run = blocks.unpack_deltas(raw) if raw is not None else None
            for j, d in enumerate(at.tolist()):
                places = None if run is None else np.cumsum(run[int(tf[:j].sum()) : int(tf[: j + 1].sum())]).tolist()
                out[made["term"][k].as_py(), d] = int(tf[j]), places
            dl = lengths[at]
            assert made["max_tf"][k].as_py() == tf.max() and made["min_ratio"][k].as_py() == (dl / tf).min()
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aab é日\U0001f600\n", max_size=12), min_size=1, max_size=6))
def test_blocks_hold_every_occurrence(texts):
    want = {}
    for d, t in enumerate(texts):
        for n in (2, 3):
            for i in range(len(t) - n + 1):
                want.setdefault((t[i : i + n], d), []).append(i)
    got = decoded(texts)
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(got[k][1] == v for k, v in want.items() if len(k[0]) == 2)


def corpus(seed=1, n=900):
    r = random.Random(seed)
    words = ["the", "then", "thenthe", "banana", "ananab", "nab", "a", "时刻表", "刻表时", "x-y", *("".join(r.choice("abn") for _ in range(r.randint(1, 7))) for _ in range(60))]
    text = lambda: " ".join(r.choice(words) for _ in range(r.choice((0, 1, 3, 8, 40, 90))))
    return [(i, None if i % 97 == 5 else text(), [r.choice(("src0", "src1")), r.choice(words)], r.choice((["en"], ["de"], [])), i % 11 == 0) for i in range(n)]


SCHEMA = "chunk_id long, content string, heading_path array<string>, platforms array<string>, deprecated boolean"
ASKED = [("1", "the"), ("2", "banana"), ("3", "thenthe nab"), ("4", '"the banana"'), ("5", "heading_path:src1 +a -nab"), ("6", "时刻表"), ("7", "content:src0"), ("8", "anan the"), ("9", "an"), ("10", '"n b" -heading_path:"src0 / the"'), ("11", ""), ("12", "zzz")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(*d, [1.0, 0.0]) for d in corpus()], SCHEMA + ", embedding array<float>").repartition(3).cache()


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id string, query string")


def listed(df):
    return sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect()))


@pytest.mark.parametrize(("first", "k"), [(1, 3), (8, 10), (2, 500)])
def test_search_gives_the_hits_of_a_scan(spark, documents, tmp_path, first, k, monkeypatch):
    """After writes that replace and delete, with and without a filter; whatever is read first."""
    monkeypatch.setattr(blocks, "FIRST", first)
    store = Store(spark, str(tmp_path / "s"))
    store.save(documents.withColumn("content", F.when(F.col("chunk_id") % 5 == 0, "the old banana").otherwise(F.col("content"))), "m", 2)
    store.delete(documents.filter("chunk_id % 7 = 0").select("chunk_id"))
    store.upsert(documents.filter("chunk_id % 5 = 0 OR chunk_id % 14 = 0"))
    live = documents.filter("chunk_id % 7 <> 0 OR chunk_id % 14 = 0 OR chunk_id % 5 = 0")
    flat = live.withColumn("heading_path", F.array_join("heading_path", " / "))
    for syntax in (False, True):
        want = listed(fulltext.bm25_topk(flat, asked(spark), k, field=BOTH, syntax=syntax))
        assert listed(blocks.search_blocks(store.text_index(), asked(spark), k, syntax=syntax)) == want and len(want) > 4
    keep = fulltext_filter(Filters(platforms=("en",)))
    want = listed(fulltext.bm25_topk(flat, asked(spark), k, field=BOTH, keep=keep, syntax=True))
    assert listed(blocks.search_blocks(store.text_index(), asked(spark), k, keep=keep, syntax=True)) == want and len(want) > 4
    posting = lambda df: sorted((r.field, r.term, r.id, r.tf, r.dl) for r in df.collect())
    assert posting(store.postings()) == posting(fulltext.postings(flat, field=BOTH))
    stats = {(r.term, r.df) for r in store.text_index().terms.filter("field = 'content'").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").collect()}
    assert stats == {(r.term, r.df) for r in blocks.gram_stats(live).collect()}


def test_windows_that_cannot_win_are_not_read(spark, tmp_path):
    """A frequent word that a few short texts are made of: its other postings stay where they are."""
    texts = [(i, "the " + " ".join(f"w{(i * 7 + j) % 101}" for j in range(200))) for i in range(6000)] + [(10_000 + i, "the the the the") for i in range(30)]
    df = spark.createDataFrame(texts, "chunk_id long, content string").repartition(2)
    store = Store(spark, str(tmp_path / "s"))
    store.save(df, "m", 0)
    counter = {}
    q = spark.createDataFrame([("q", "the")], "query_id string, query string")
    got = listed(blocks.search_blocks(store.text_index(), q, 10, counter=counter))
    assert got == listed(fulltext.bm25_topk(df, q, 10)) and counter["windows"] > 20
    assert counter["blocks_read"] < 0.5 * counter["blocks"] and counter["windows_read"] < 0.5 * counter["windows"]


def test_bounds_hold():
    """No posting scores more than its block's header says, whatever the mean length."""
    r = random.Random(2)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(0, 60))) for _ in range(200)]
    lengths = np.array([fulltext.gram_count(len(t)) for t in texts])
    made = blocks.encode_field("f", texts, np.arange(len(texts)), lengths)
    for avg in (0.5, 10.0, 1e4):
        plan = blocks.Plan([], ("f",), {("f", made["term"][k].as_py()): 1.5 for k in range(len(made["n"]))}, {"f": avg})
        for k in range(len(made["n"])):
            term = made["term"][k].as_py()
            bound = plan.bound([fulltext.Word(term, (term,))], {("f", term): (made["max_tf"][k].as_py(), made["min_ratio"][k].as_py())})
            for d, tf in zip(np.frombuffer(made["offsets"][k].as_py(), dtype=np.uint8), np.frombuffer(made["tf"][k].as_py(), dtype="<u4"), strict=True):
                assert fulltext.bm25(1.5, int(tf), int(lengths[d]), avg) <= bound + 1e-12
    assert blocks.Plan([], ("f",), {}, {"f": 1.0}).bound([fulltext.Word("ab", ("ab",))], {}) is None


# ---- bitmaps ---------------------------------------------------------------------------------------------------------


def test_reading_joins_nothing(spark, documents, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(documents, "m", 2)
    store.delete(documents.filter("chunk_id % 3 = 0").select("chunk_id"))
    for df in (store.chunks(), store.postings()):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert store.chunks().count() == store.count() == 600 and store.chunks().filter("chunk_id % 3 = 0").count() == 0
    assert sorted(store.chunks().columns) == sorted(documents.columns)


def test_replace_and_bounded_bitmaps(spark, documents, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(documents, "m", 2)
    store.LOOKUP = 10  # more ids than that are joined
    store.replace(documents.filter("chunk_id < 100").select("chunk_id"), documents.filter("chunk_id IN (5, 950)").withColumn("content", F.lit("new")))
    assert store.count() == 801 and store.chunks().filter("content = 'new'").count() == 1 and store.manifest()["lengths"]["n"] == 801
    full = store.chunks().select(F.coalesce("content", F.lit("")).alias("c")).collect()
    assert store.manifest()["lengths"]["content"] == sum(fulltext.gram_count(len(r.c)) for r in full)
    store.DEAD_BYTES = 1
    store.delete(documents.filter("chunk_id = 500").select("chunk_id"))
    assert len(store.manifest()["segments"]) == 1 and store.dead(store.manifest()).size == 0 and store.count() == 800


# ---- vectors ---------------------------------------------------------------------------------------------------------


def vectors(spark, grouped, n=1500, d=12):
    g = np.random.default_rng(4)
    x = g.standard_normal((n, d))
    if grouped:
        x = g.standard_normal((25, d))[g.integers(0, 25, n)] * 5 + 0.02 * x
    rows = [(i, [float(c) for c in v], "en" if i % 3 else "de") for i, v in enumerate(x)] + [(n, None, "en")]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, lang string").repartition(3)


@pytest.mark.parametrize("grouped", [True, False])
def test_clustered_search_is_exact(spark, grouped, monkeypatch):
    df = vectors(spark, grouped)
    q = df.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding").unionByName(spark.createDataFrame([(9, None), (8, [0.0] * 12)], "query_id long, embedding array<float>"))
    index = clusters.index_of(df, size=20)
    for keep in (None, F.col("lang") == "de"):
        want = listed(vector.vector_topk(df if keep is None else df.filter(keep), q, 7))
        counter = {}
        assert listed(clusters.clustered_topk(index, q, 7, keep=keep, counter=counter)) == want
        assert counter["clusters"] >= 60
    one = q.filter("query_id = 100")
    counter = {}
    monkeypatch.setattr(clusters, "FIRST", 2)
    assert listed(clusters.clustered_topk(index, one, 5, counter=counter)) == listed(vector.vector_topk(df, one, 5))
    assert not grouped or counter["clusters_read"] < 0.6 * counter["clusters"]
    monkeypatch.setattr(clusters, "MOST", 1)
    assert listed(clusters.clustered_topk(index, q, 7)) == listed(vector.vector_topk(df, q, 7))
    assert clusters.clustered_topk(clusters.index_of(df.limit(0)), q, 7).count() == 0


def test_stored_vectors(spark, documents, tmp_path):
    df = vectors(spark, True).withColumn("content", F.lit("x")).withColumn("deprecated", F.col("chunk_id") % 4 == 0).withColumn("platforms", F.array("lang"))
    store = Store(spark, str(tmp_path / "s"))
    store.save(df.filter("embedding IS NOT NULL"), "m", 12, fulltext=False)
    store.delete(df.filter("chunk_id % 5 = 0").select("chunk_id"))
    q = df.filter("chunk_id % 200 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    keep = vector_filter(Filters(platforms=("de",)))
    want = vector.vector_topk(df.filter("chunk_id % 5 <> 0").filter(keep), q, 6)
    assert listed(clusters.clustered_topk(store.vector_index(), q, 6, keep=keep)) == listed(want)
    bare = Store(spark, str(tmp_path / "t"))
    bare.save(documents.drop("embedding"), "m", 0)
    assert bare.vector_index() is None
