"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, where the operators' own tests have none."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, common, decontam, lines, mixing, quality, recompress, simhash, suffix

from .conftest import SCHEMA
from .test_documents import brute_lines, brute_print, brute_quality


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(7)
    return "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(1, 30))) for _ in range(6000))


def test_quality_of_long_and_repeated_texts(spark, long_text):
    df = spark.createDataFrame([(1, long_text), (1, long_text), (2, None), (2, None)], "doc_id long, text string")
    out = quality.judge(df).select("doc_id", "quality.*").collect()
    assert len(out) == 4 and len(set(out)) == 2
    q = next(r for r in out if r.doc_id == 1)
    want = brute_quality_linear(long_text)
    assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want and q.n_words > 80_000
    with pytest.raises(ValueError, match="already"):
        quality.judge(df.withColumn("Quality", F.lit(1)))
    assert quality.judge(df.limit(0)).count() == 0


def brute_quality_linear(text):
    """As brute_quality, without counting each window anew."""
    words = text.split()
    seen = {}
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])] = seen.get(tuple(words[i : i + 3]), 0) + 1
    cover = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    ls = [x for x in text.split("\n") if x.strip()]
    assert brute_quality("a b c a b c a b") == (8, 8, 0, 0, 8)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(cover)


def test_lines_of_long_texts(spark, long_text):
    tail = "\nshared line"
    rows = [(i, long_text + tail if i < 2 else f"own {i}" + tail) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.size(F.split("text", "\n")))
    got = lines.dedup_lines(df, dropped="gone").select("doc_id", "n", "gone", F.sha2("text", 256))
    assert sorted(map(tuple, got.collect())) == brute_lines(rows)
    odd = spark.createDataFrame([(str(i), "same", 1, 2, 3) for i in range(10)] + [("99", "other", 1, 2, 3)], "doc_id string, text string, nil_of_row int, Id_of_bitmap int, n_bits int")
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns and sorted(r.text for r in out.collect()) == [""] * 10 + ["other"]
    with pytest.raises(ValueError, match="already"):
        lines.dedup_lines(odd, dropped="Id_of_bitmap")


def test_mixing_of_odd_rows(spark, long_text):
    rows = [("a", "x y z", "s"), ("a", "x y z", "s"), (None, "p q", "s"), (None, "p q", "s"), ("b", long_text, "t"), ("c", None, "t"), ("d", "", None), ("e", "one two", None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id string, text string, source string, size int, taken int, h int")
    out = [r.asDict() for r in mixing.mix(df).collect()]
    assert sorted((r["doc_id"] or "", r["size"]) for r in out) == sorted((i or "", len((t or "").split())) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out) and mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_many_sources(spark):
    """More sources than any task would rank alone, against the rule step by step."""
    n = 300
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id")).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 7 % 50 + 1).cast("int")).alias("text"))
    names = sorted(f"host{i}" for i in range(n))
    size = {f"host{i}": i * 7 % 50 + 1 for i in range(n)}
    weight, target, open_, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}, set(names), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.discard(s)
    for r in mixing.mix(df).collect():
        assert r.target == pytest.approx(target[r.source])


def test_mixing_is_unbiased(spark):
    """Documents of one size are alike, so their mean number of copies is the source's rate, for each size."""
    n = 12_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.repeat(F.lit("w "), (F.col("id") / 4 % 6 + 1).cast("int")).alias("text"))
    means = {}
    for seed in range(4):
        for r in mixing.mix(df, seed=seed).groupBy("source", "size").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n"), F.first(F.col("target") / F.col("source_size")).alias("rate")).collect():
            c, k, _ = means.get((r.source, r["size"]), (0, 0, 0))
            means[r.source, r["size"]] = (c + r.c, k + r.n, r.rate)
    assert len(means) == 12
    for c, k, rate in means.values():
        assert abs(c / k - rate) < 4 * (0.25 / k) ** 0.5 + 1e-9


def test_fingerprint_of_a_long_text(long_text):
    text = long_text[:250_000]
    assert int.from_bytes(simhash.fingerprints_of([text.encode()])[0].astype(">u8").tobytes(), "big") == brute_print(text)


def test_chat_of_long_texts(spark, long_text):
    rows = [(1, t, ("user", "assistant")[t % 2], long_text[: 200_000 + t]) for t in range(6)]
    blocks = chat.render_blocks(chat.reconstruct(chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    out = chat.join_blocks(blocks.withColumn("loss", chat.learned_text(F.col("piece"), F.col("spans"))), "loss").withColumn("turns", chat.parse(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in out.turns] == [r[2:] for r in rows] and out.loss == "".join(r[3] for r in rows if r[2] == "assistant")


def test_pipeline_of_null_and_empty_texts(spark, tmp_path):
    """Nulls in every column, empty and repeated rows pass all stages; extra columns stay until the last."""
    prose = " ".join(f"the{'' if i % 4 else ' of'} word{i}" for i in range(90))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (3, prose, "en", None, len(prose)), (3, prose, "en", None, len(prose)), (4, prose + " more", None, "s", None), (None, prose, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], SCHEMA + ", gone_id string")
    spark.createDataFrame([(None, None), (1, ""), (2, "never found in any text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        out = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
        ids = sorted((-1 if r.doc_id is None else r.doc_id for r in out.collect()))
        assert ids == ([-1, 3, 3] if some is docs else [])
        assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == len(ids)


def test_folders_of_a_cluster_are_named(monkeypatch):
    """Without a shared folder a cluster gets an error, not a folder of one machine."""

    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(type("S", (), {"sparkContext": Context()})())


@pytest.mark.parametrize("run", [suffix.dedup, recompress.dedup, simhash.near_duplicates, simhash.dedup, lambda d: decontam.occurrences(d, d.select(F.lit(1).alias("item_id"), F.lit("a benchmark item of some length").alias("text")).limit(1))], ids=["op3", "op6", "op9", "near_dedup", "op10"])
def test_ids_are_numbers_or_read_as_one(spark, run):
    text = " ".join(f"word{i}" for i in range(60))
    good = spark.createDataFrame([("1", text), ("2", text), (None, "x"), ("3", "a benchmark item of some length")], "doc_id string, text string")
    assert run(good).count() > 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        run(spark.createDataFrame([("one", text)], "doc_id string, text string")).count()
