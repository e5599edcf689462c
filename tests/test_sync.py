"""State by file: what a changed, moved, removed or touched file does to the store, and which texts go to the model."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import embed as embedding
from tidewell.shared import running_sums
from tidewell.sources import index
from tidewell.streaming.ingest import ingest

from .test_sources import FakeSession, FakeTokens


@pytest.fixture
def model(tmp_path):
    """embed(column), and a function that lists the texts that it has seen."""
    seen = tmp_path / "seen"
    seen.mkdir()

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        for t in texts:
            with open(seen / f"{os.getpid()}", "a") as f:
                f.write(repr(t) + "\n")
        return texts.map(lambda t: [float(len(t)), 1.0])

    return embed, lambda: sorted(x for p in seen.iterdir() for x in p.read_text().splitlines())


def contents(store):
    return sorted((r.chunk_id, r.content, tuple(r.embedding)) for r in store.chunks().collect())


def test_sync(spark, tmp_path, model):
    embed, seen = model
    root = tmp_path / "corpus"
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "x.md").write_text("# Hidden\nx\n")
    (root / "a.md").write_text("# A\nfirst\n## B\nsecond\n")
    (root / "b[1].md").write_text("# C\nthird\n")
    (root / "c.kt").write_text("fun x() {}")
    store = index.Store(spark, str(tmp_path / "s"))
    run = lambda: index.sync_folder(spark, str(root), store, embed, "m", 2)
    assert run() == {"added": 3, "changed": 0, "touched": 0, "removed": 0}
    first = contents(store)
    assert [c for c, _, _ in first] == ["a.md#A/B@4", "a.md#A@2", "b[1].md#C@2"] and len(seen()) == 3
    version = store.manifest()["version"]
    assert run() == {"added": 0, "changed": 0, "touched": 0, "removed": 0} and store.manifest()["version"] == version
    # the sections move down: their old chunks go, their texts are known
    (root / "a.md").write_text("\n\n# A\nfirst\n## B\nchanged\n")
    assert run()["changed"] == 1
    assert [c for c, _, _ in contents(store)] == ["a.md#A/B@6", "a.md#A@4", "b[1].md#C@2"] and len(seen()) == 4 and seen().count(repr("first")) == 1
    # another time, the same bytes
    os.utime(root / "b[1].md", (1, 1))
    assert run() == {"added": 0, "changed": 0, "touched": 1, "removed": 0} and len(seen()) == 4
    assert run() == {"added": 0, "changed": 0, "touched": 0, "removed": 0}
    (root / "a.md").unlink()
    (root / "d.md").write_text("# D\nthird\n")
    assert run() == {"added": 1, "changed": 0, "touched": 0, "removed": 1}
    assert [c for c, _, _ in contents(store)] == ["b[1].md#C@2", "d.md#D@2"] and len(seen()) == 4
    store.compact()
    assert {r.source for r in store.files().collect()} == {"b[1].md", "c.kt", "d.md"} and run()["added"] == 0
    # a second index of the same texts asks the model for nothing
    assert index.index_folder(spark, str(root), store, embed, "m", 2) == {"files": 2, "chunks": 2, "skipped": 1} and len(seen()) == 4


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, model):
    embed, seen = model
    root = tmp_path / "corpus"
    root.mkdir()
    (root / "a.md").write_text("# A\nfirst\n## B\nsecond\n")
    store = index.Store(spark, str(tmp_path / "s"))
    for checkpoint in ("one", "two"):  # the second knows of no batch before
        ingest(spark, str(root), store, str(tmp_path / checkpoint), embed, "m", 2).awaitTermination()
        assert [c for c, _, _ in contents(store)] == ["a.md#A/B@4", "a.md#A@2"] and len(seen()) == 2


def test_batches_of_like_length():
    texts = ["x" * n for n in (5, 300, 1, 0, 40, 41, 299, 2)]
    parts = embedding.by_length(texts, 3, 100)
    assert sorted(i for p in parts for i in p) == list(range(8)) and all(len(p) <= 3 and (len(p) == 1 or max(len(texts[i]) for i in p) * len(p) <= 100) for p in parts)
    words = ["ab abcd", "abc", "", "a b c d e", "abcdef ab", "a"]
    hidden = lambda feed: (feed["input_ids"][:, :, None] * [1.0, 2.0]) + [0.0, 1.0]
    together = embedding.pooled(FakeSession(hidden), FakeTokens(), words)
    assert embedding.embedded(FakeSession(hidden), FakeTokens(), words, 2, 8) == pytest.approx(together)


def test_running_sums(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") * 37 % 11).alias("v")).repartition(5)
    out = running_sums(df, {"total": F.col("v"), "n": F.lit(1).cast("long")}, "id")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    total = 0
    for r in sorted(out.collect()):
        total += r.v
        assert (r.total, r.n) == (total, r.id + 1)
    assert running_sums(df.limit(0), {"total": F.col("v")}, "id").count() == 0
