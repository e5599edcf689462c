import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewell.llm import recompress, suffix

from .conftest import SCHEMA, sha


def brute_words(docs, size=13):
    words = [(i, (t or "").encode().split()) for i, t, *_ in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def brute_bytes(docs, size=50):
    texts = [(i, (t or "").encode()) for i, t, *_ in docs]
    first = {}
    for i, t in texts:
        for k in range(len(t) - size + 1):
            x = t[k : k + size]
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if first[t[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return sorted(out)


def got_words(df):
    return sorted(tuple(r) for r in recompress.dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())


def got_bytes(df):
    return sorted(tuple(r) for r in suffix.dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


def test_words_against_brute_force(docs, docs_df):
    want = brute_words(docs)
    assert sum(w[2] for w in want) > 100
    assert got_words(docs_df) == want


def test_bytes_against_brute_force(docs, docs_df):
    want = brute_bytes(docs)
    assert sum(w[2] for w in want) > 1000
    assert got_bytes(docs_df) == want


def test_small_blocks_give_the_same(spark, docs, docs_df, monkeypatch):
    monkeypatch.setattr("tidewell.llm.blocks.BLOCK_BYTES", 700)
    from tidewell.llm import blocks

    packed = blocks.pack(docs_df, "doc_id", "text")
    assert packed.count() > 20
    assert got_words(docs_df.repartition(11)) == brute_words(docs)
    assert got_bytes(docs_df.repartition(11)) == brute_bytes(docs)


@pytest.mark.parametrize("hot", [0, 1, 3])
def test_hot_symbols_and_anchors(docs, docs_df, monkeypatch, hot):
    """With hot = 0 every anchor is hot, so that all windows go by all they hold."""
    monkeypatch.setattr("tidewell.llm.blocks.BLOCK_BYTES", 900)
    monkeypatch.setattr("tidewell.llm.blocks.HOT_BLOCKS", hot)
    assert got_words(docs_df.repartition(5)) == brute_words(docs)
    assert got_bytes(docs_df.repartition(5)) == brute_bytes(docs)


def test_common_phrase_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr("tidewell.llm.blocks.BLOCK_BYTES", 2000)
    monkeypatch.setattr("tidewell.llm.blocks.HOT_BLOCKS", 4)
    r = random.Random(6)
    phrase = " ".join(f"w{k}" for k in range(12))
    rows = [(i, f"{r.randrange(40)} x{r.randrange(4)} {phrase} y{r.randrange(4)} {r.randrange(40)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_words(df) == brute_words(rows) and got_bytes(df) == brute_bytes(rows)


def test_words_of_one_hash_are_told_apart(spark):
    """The two Thue-Morse words over a and b have equal polynomial hashes to any odd base; they are different words all the same."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    blocks = [recompress.Words(_block(f"{x} {x}".encode())).hash for x in (one, other)]
    assert (blocks[0] == blocks[1]).all()
    twelve = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{twelve} {one}"), (2, f"{twelve} {other}"), (3, f"{twelve} {one}"), (4, f"{one} {other} {twelve}"), (5, f"{one} {one} {twelve}"), (6, f"{one} {other} {twelve}")]
    got = got_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_words(rows) and [x[2] for x in got] == [0, 0, 13, 0, 0, 14]


def _block(data):
    from tidewell.llm import blocks

    row = {"block": 0, "ids": np.array([0]).tobytes(), "lengths": np.array([len(data)]).tobytes(), "digests": bytes(16), "data": zstandard.compress(data), "raw": len(data)}
    return blocks.Block(row)


def test_equal_hashes_do_not_make_equal_rows(monkeypatch):
    monkeypatch.setattr(recompress, "mix64", lambda x: x & np.uint64(3))  # nearly all collide
    r = np.random.default_rng(1)
    rows, ids = r.integers(0, 3, (500, 4), dtype=np.uint64), r.integers(0, 99, 500)
    least = {}
    for x, i in zip(map(tuple, rows.tolist()), ids.tolist(), strict=True):
        least[x] = min(least.get(x, i), i)
    assert recompress.least_of_equal(rows, ids).tolist() == [least[tuple(x)] for x in rows.tolist()]


def test_permuted_prefixes():
    r = random.Random(3)
    for text in (bytes(r.randrange(2) for _ in range(300)), b"abcabcab" * 30, b"a" * 90, bytes(r.randrange(256) for _ in range(200)) * 2):
        t = np.frombuffer(text, dtype=np.uint8)
        sa = suffix.suffix_array(t)
        got = suffix.permuted_prefixes(t, sa, 60, np.arange(0, len(t), 40))
        for k in range(1, len(sa)):
            a, b = text[sa[k] :], text[sa[k - 1] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert min(got[sa[k]], 20) == min(n, 20)  # 60 less the way from a start


def test_periodic_texts(spark):
    rows = [(1, "ab" * 100), (2, "ab" * 40 + "c" + "ab" * 40), (3, "a" * 200), (4, "b" + "a" * 60), (5, "x y " * 30), (6, "y x " * 30), (7, "z " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_bytes(df) == brute_bytes(rows) and got_words(df) == brute_words(rows)


def test_ids(spark):
    """Equal ids do not remove each other's text; a null id counts as the greatest."""
    t = " ".join(f"word{i}" for i in range(20))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (0, "other"), (None, None)], "doc_id long, text string")
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in recompress.dedup(df).collect()) == [(-1, 0, 0), (-1, 20, 20), (0, 1, 0), (1, 20, 0), (1, 20, 0)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, r.n_spans) for r in suffix.dedup(df).collect()) == [(-1, 0, 0), (-1, len(t), 1), (0, 0, 0), (1, 0, 0), (1, 0, 0)]


def test_empty_and_extra_columns(spark, empty_df):
    assert got_words(empty_df) == [] and got_bytes(empty_df) == []
    odd = spark.createDataFrame([(1, "a b", 1, 2, 3)], "doc_id long, text string, block int, payload int, kept int")
    assert got_words(odd)[0][:3] == (1, 2, 0) and got_bytes(odd)[0][:3] == (1, 3, 0)


def test_long_text(spark):
    r = random.Random(1)
    long = " ".join(str(r.randrange(10**6)) for _ in range(120_000))
    part = long[400_000:400_500]
    rows = [(1, long), (2, "p " + part + " q"), (3, long)]
    df = spark.createDataFrame(rows, SCHEMA.split(", lang")[0])
    w, b = got_words(df), got_bytes(df)
    assert [x[2] for x in w][0] == 0 and w[2][2] == w[2][1] == 120_000 and w[1][2] > 50
    assert b[0][2] == 0 and b[2][2] == b[2][1] and b[1][2] >= 500 and b[1][3] == 1


@pytest.mark.parametrize("alphabet", [1, 2, 3, 256])
def test_suffix_array(alphabet):
    r = random.Random(alphabet)
    for n in (1, 2, 7, 60, 900):
        t = bytes(r.randrange(alphabet) for _ in range(n)) * r.choice((1, 2))
        for base in (0, 1 << 18):
            assert suffix.suffix_array(np.frombuffer(t, dtype=np.uint8), base).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_symbols_agree_inside_equal_windows():
    """A symbol decided by words [lo, hi) appears wherever these words do."""
    from types import SimpleNamespace

    r = np.random.default_rng(2)
    core = r.integers(0, 6, 60).astype(np.uint64)
    seen = []
    for _ in range(2):
        words = np.concatenate([r.integers(0, 6, 20).astype(np.uint64), core, r.integers(0, 6, 20).astype(np.uint64)])
        x, _, lo, hi = recompress.symbols(SimpleNamespace(hash=words, owner=np.zeros(100, dtype=np.int64)))
        seen.append({(n, a, b) for n, a, b in zip(x.tolist(), lo.tolist(), hi.tolist(), strict=True) if a >= 20 and b <= 80})
    assert seen[0] == seen[1] and len(seen[0]) > 5


def test_runs_are_packed_and_found_again(docs):
    """Anchors kept by runs are those of every stretch."""
    texts = [(d[1] or "").encode() for d in docs]
    ends = np.cumsum([len(t) for t in texts])

    class Block:
        ids, lengths, data = np.arange(len(texts)), np.array([len(t) for t in texts]), b"".join(texts)
        starts = ends - [len(t) for t in texts]

    Block.ends = ends
    copy = np.arange(len(texts)) % 7 == 3
    runs = suffix._runs(Block, copy, 50)
    again = suffix._Runs.unpacked(*runs.packed())
    assert all((getattr(runs, k) == getattr(again, k)).all() for k in ("start", "count", "anchor")) and runs.count.max() <= 27
    want = []
    for lo, t, c in zip(Block.starts.tolist(), texts, copy.tolist(), strict=True):
        if not c:
            a, h = suffix.anchors(np.frombuffer(t, dtype=np.uint8), 50)
            want += [(lo + i, lo + int(x), int(h[x])) for i, x in enumerate(a)]
    _, h = runs.names(Block, 8)
    got = [(int(s) + i, int(x), int(y)) for s, n, x, y in zip(runs.start, runs.count, runs.anchor, h, strict=True) for i in range(int(n))]
    assert got == want and len(got) > 1000


def test_messages_of_many_shards(docs, docs_df, monkeypatch):
    """Copies and anchors are asked for at partitions of their own size, however many shards there are; blocks grow with the input; stretches are spread out a few runs at a time."""
    from tidewell.llm import blocks

    asked, answer = [], blocks.answer

    def counted(questions, reply, n_parts):
        asked.append((n_parts, questions.filter("part >= 0").count()))
        return answer(questions, reply, n_parts)

    monkeypatch.setattr(blocks, "answer", counted)
    monkeypatch.setattr(suffix, "RAW_PER_PARTITION", 300)
    monkeypatch.setattr(suffix, "AT_ONCE", 7)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 500)
    monkeypatch.setattr(blocks, "MOST_BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "BLOCKS_PER_CORE", 1)
    raw = sum(len((t or "").encode()) for _, t, *_ in docs)
    assert blocks.growing(docs_df, "text") == min(2000, raw // 4) > 500
    assert got_bytes(docs_df) == brute_bytes(docs)
    n_blocks = blocks.pack(docs_df, "doc_id", "text", block_bytes=blocks.growing(docs_df, "text")).count()
    (copies, n_copies), (names, n_names), (shards, _) = asked
    assert copies == names == 4 and shards > 60 and n_copies <= 4 * n_blocks and n_names <= 4 * n_blocks
