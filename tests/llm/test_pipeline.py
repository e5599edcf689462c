import random

import corpus_pipeline
from pyspark.sql import functions as F

from tidewell.llm import lines

from .conftest import SCHEMA


def prose(r, k):
    return " ".join(r.choice(["the", "of", "and", "to", "that", "with"]) if i % 3 == 0 else "".join(r.choice("abcdeilnorst") for _ in range(r.randint(3, 8))) for i in range(k))


def before_mixing(spark, folder, docs):
    """What the last stage is given."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "an item that no document has in it")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
    return docs


def test_one_of_many_copies_stays_whole(spark, tmp_path):
    r = random.Random(8)
    refrain = prose(r, 12)
    text = "\n".join([prose(r, 60), refrain, prose(r, 50), refrain, prose(r, 40)])
    rows = [(i, text, "en", "s", len(text)) for i in range(40, 65)] + [(40, text, "en", "s", len(text))]  # the first is there twice
    rows += [(i, t, "en", "s", len(t)) for i in range(5) for t in [prose(r, 150)]]
    out = before_mixing(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {x.doc_id for x in out if x.text == text and x.n_chars == len(text)} == {40}
    assert len([x for x in out if x.text and x.doc_id < 5]) == 5 and not [x for x in out if x.text and x.doc_id > 40]


def test_first_document_keeps_its_lines(spark):
    """The first document's places of a line go on over batches and partitions."""
    rows = [(7, "a\n" * 400 + "own"), (3, "a\n" * 3000 + "b"), (3, "a\n" * 3000 + "b"), (None, "a"), *((i, "A\nb") for i in range(20, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {}
        for x in lines.dedup_lines(df, keep_first="document").collect():
            got.setdefault(x.doc_id, []).append(x.text)
        assert got.pop(3) == ["a\n" * 3000 + "b"] * 2 and got.pop(7) == ["own"] and {t for v in got.values() for t in v} == {""}
        first = lines.dedup_lines(df, keep_first=True).filter("doc_id = 3").collect()
        assert [x.text for x in first] == ["a\nb"] * 2  # equal rows keep the same place
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
