"""Packing against the tokenizer itself: every id once, windows full, groups balanced."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import packing

P = pytest.importorskip("public_tokenizers")
NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(NAME))


def check(rows, got, tokenizer, tiers=packing.TIERS):
    """rows: (id, text); got: pieces. Returns how many sequences are padded."""
    want = sorted(((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows), key=repr)
    pieces, sequences = {}, {}
    for p in got:
        pieces.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    spans = {}
    for i, ids in want:
        spans.setdefault((i, len(ids)), []).append(ids)
    assert spans.keys() == pieces.keys()
    for key, texts in spans.items():
        own = sorted(pieces[key], key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == sum(map(len, texts))
        for p in own:
            assert any(zlib.crc32(struct.pack(f"<{p['length']}I", *ids[p["start"] : p["start"] + p["length"]])) == p["ids_crc32"] for ids in texts if p["start"] + p["length"] <= len(ids))
        if len(texts) == 1:
            ends = [0] + [p["start"] + p["length"] for p in own]
            assert [p["start"] for p in own] == ends[:-1] and ends[-1] == key[1]
    short = 0
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        ends = [0]
        for p in own:
            assert p["offset"] == ends[-1] and p["length"] > 0
            ends.append(ends[-1] + p["length"])
        assert len({(p["tier"], p["step_group"]) for p in own}) == 1
        short += ends[-1] != own[0]["tier"]
        assert ends[-1] <= own[0]["tier"] and own[0]["tier"] in tiers
    assert sorted(sequences) == list(range(len(sequences)))
    return short


def pieces(df, **options):
    return packing.pack(df, NAME, **options).select("sequence_id", "step_group", "tier", F.inline("pieces")).collect()


def test_packing(docs, docs_df, tokenizer):
    rows = [(d[0], d[1]) for d in docs]
    got = pieces(docs_df)
    assert check(rows, got, tokenizer) == 1  # the only padding
    assert sorted(map(tuple, pieces(docs_df)), key=repr) == sorted(map(tuple, got), key=repr)


def test_packing_of_odd_rows(spark, tokenizer):
    r = random.Random(1)
    long = " ".join(f"{r.choice('abcdefgh')}{r.randrange(999)}" for _ in range(40_000))
    odd = ["", None, " \n", " a b　c\x1cd\x85e", "Á éx", "<|endoftext|> <|startoftext|>x<|endoftext|>", "it's we'll THEY'VE I'm", "ΣΑΣ ΣΑΣ.", "x" * 30_000, "日本語のテキスト 12345", "a\x00b", "ab'\ns", "İstanbul ﬁ K"]
    rows = [(f"d{i}", t) for i, t in enumerate(odd)] + [("long", long), ("long", long), (None, "no id"), (None, None), ("d1", None)]
    df = spark.createDataFrame([(*t, 1, 2, "x") for t in rows], "doc_id string, text string, tier int, Length int, pieces string").repartition(5)
    assert check(rows, pieces(df), tokenizer) <= 1
    assert packing.pack(df.limit(0), NAME).count() == 0
    with pytest.raises(ValueError, match="twice"):
        packing.pack(df, NAME, tiers=(3, 5))


@pytest.mark.parametrize("tiers", [(8,), (4, 8, 16), (64, 128)])
def test_rests_meet_up_the_tree(spark, tokenizer, tiers, monkeypatch):
    """Many small tasks: what they leave meets in groups, and only one sequence is padded."""
    monkeypatch.setattr(packing, "FAN", 3)
    rows = [(i, "one two three four five six seven " * (i % 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20, "doc_id")
    assert check(rows, pieces(df, tiers=tiers), tokenizer, tiers) <= 1


def test_tiers_hold_documents_of_their_size(spark):
    """Short documents fill gaps of long windows; few documents are cut."""
    r = random.Random(9)
    df = spark.createDataFrame([(i, "word " * r.choice((30, 90, 300, 700, 1500, 5000))) for i in range(600)], "doc_id long, text string").coalesce(2)
    got = pieces(df)
    by = {}
    for p in got:
        by.setdefault(p["sequence_id"], []).append(p)
    assert {p["tier"] for p in got} >= {1024, 2048}
    mixed = [own for own in by.values() if own[0]["tier"] == 2048 and len(own) > 1]
    assert mixed and all(max(p["length"] for p in own) > 1024 for own in mixed)
    cuts = len(got) - len({(p["doc_id"], p["doc_tokens"]) for p in got})
    assert cuts < 1.5 * len(by)


def test_step_groups_are_balanced(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, "word " * r.randrange(1, 1500)) for i in range(1500)], "doc_id long, text string").coalesce(3)
    step = 16 * 2048
    groups = packing.pack(df, NAME, step_tokens=step).groupBy("tier", "step_group").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum(F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["length"])).alias("tokens")).collect()
    assert len({g["step_group"] for g in groups}) == len(groups)
    for tier in packing.TIERS:
        own = [g for g in groups if g["tier"] == tier]
        if len(own) > 1:
            assert max(g["n"] for g in own) - min(g["n"] for g in own) <= 1 and all(g["tokens"] <= step for g in own)
            costs = [g["cost"] / g["n"] for g in own]
            assert max(costs) < 1.1 * min(costs)


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    encode = packing.Encoder(P.path(NAME))
    for text in ("a b c d", "e f g a", "q " * 9 + "z" * 100, "h i j k l m n o p"):
        assert encode(text.encode(), 1).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert len(encode.known) <= 9 and len(encode.parts) <= 9 and not any(len(w) > packing.WORD_BYTES for w in [*encode.known, *encode.parts])


def test_words_are_those_of_whole_texts(tokenizer, monkeypatch):
    """Plain and odd words of many alphabets, also when the ends of parts do not add up."""
    r = random.Random(8)
    letters = "abcXYZéßøıİŉǅªº²½×÷'’_-.,<|>09٣ΣςЖ日ａ́\u200b\xa0\x1c"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(50)) for _ in range(200)]
    encode = packing.Encoder(P.path(NAME))
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [encode(t.encode(), 1).tolist() for t in texts] == want
    encode.ends[:] = True
    encode.known.clear()
    encode.parts.clear()
    assert [encode(t.encode(), 1).tolist() for t in texts] == want
