from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tidewell.llm import registry

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="no tables")


def rows(relation):
    names = [d[0] for d in relation.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_give_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    names, want = rows(con.execute(registry.SQL[name]))
    df = registry.QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == names
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == want


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "mixing"]
    out = corpus_pipeline.run(spark, str(DATA))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(str(DATA / "labels.parquet")).collect()}
    kept = {r.doc_id for r in out.collect()}
    assert not any(labels.get(i) == 0 for i in kept) and sum(labels.get(i) == 1 for i in kept) > 30
