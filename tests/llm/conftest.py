import hashlib
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=5, n=60):
    """Small documents with exact and near copies, shared passages and lines, nulls, empty and odd texts."""
    r = random.Random(seed)
    vocab = ["the", "of", "and", "was", "río", "straße", "ab", "né", "x", *("".join(r.choice("abcdeéß") for _ in range(r.randint(2, 9))) for _ in range(150))]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, line = sentence(30), "  All Rights reserved.\t"
    docs = []
    for i in range(n):
        t = "\n".join(sentence(r.randint(3, 25)) for _ in range(r.randint(1, 6)))
        if i % 5 == 1:
            t += "\n" + line
        if i % 6 == 2:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if i % 7 == 3 and docs:
            t = docs[r.randrange(len(docs))][1] or ""
        if i % 9 == 4 and docs:
            w = (docs[r.randrange(len(docs))][1] or "a b").split(" ")
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        docs.append((i, t, "en", f"src{i % 4}" if i % 11 else None, len(t)))
    docs += [(n, None, "en", "src0", 0), (n + 1, "", None, None, None), (n + 2, " \t\n ", "de", "src1", 4), (n + 3, "a b a b a b a b " * 20, "en", "src1", 9), (n + 4, "é" * 120, "fr", "src2", 120), (n + 5, "é" * 130, "fr", "src2", 130), (n + 6, "one", "en", "src2", 3)]
    r.shuffle(docs)
    return docs


@pytest.fixture(scope="session")
def docs():
    return make_docs()


@pytest.fixture(scope="session")
def docs_df(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_df(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
