import random

import numpy as np
import pytest
import zstandard

from tidewell.llm import blocks, shingles, simhash


def as_block(texts):
    lengths = np.array([len(t) for t in texts])
    row = {"block": 1, "ids": np.arange(len(texts)).tobytes(), "lengths": lengths.tobytes(), "digests": bytes(16 * len(texts)), "data": zstandard.compress(b"".join(texts)), "raw": int(lengths.sum())}
    return blocks.Block(row)


def odd_texts(seed):
    """Chains of texts with ever more changed words, in several patterns, on both sides of the share of near copies; and short and blank ones."""
    r = random.Random(seed)
    texts = [b"", b" \t", b"A b", b"a  B\n", b"a b c d e", b"A b c d e f", b"x" * 100 + b" yy " + b"Q" * 64, b"X" * 100 + b"  yy " + b"q" * 64, b" lead", b"trail "]
    for g in range(12):
        n = r.choice([3, 5, 6, 7, 12, 40, 90])
        base = [f"g{g}w{i}" if g % 3 else r.choice("abc") for i in range(n)]
        for k in range(8):
            w = base.copy()
            for i in range(r.randrange(6), n, 6) if k % 2 else r.sample(range(n), min(n, k)):  # every sixth word: the fewest common shingles that may do
                w[i] = f"y{g}z{k}v{i}"
            texts.append(" ".join(w).upper().encode() if k == 4 else " ".join(w).encode())
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_near_copies_take_a_common_shingle(seed):
    texts = odd_texts(seed)
    found = shingles.Shingles(as_block(texts), 5, np.zeros(len(texts), dtype=bool))
    owner, name = found.names()
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    assert np.bincount(owner, minlength=len(texts)).tolist() == [max(1, len(x)) for x in sets]
    holders = {}
    for i, x in zip(owner.tolist(), name.tolist(), strict=True):
        holders.setdefault(x, set()).add(i)
    assert len(holders) == len({x for s in sets for x in s.tolist()}) + 1  # and that of texts without words
    taken = [set() for _ in texts]
    for i, x in zip(*(v.tolist() for v in found.taken(np.array([len(holders[x]) > 1 for x in name.tolist()]), simhash.SIMILAR)), strict=True):
        taken[i].add(x)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if simhash.similar(sets[i], sets[j], 5)]
    assert len(near) > 30 and all(taken[i] & taken[j] for i, j in near)
    assert any(not t for t in taken)  # and some texts are ruled out


def test_unrelated_texts_are_not_compared(spark, monkeypatch):
    """Near copies are found among texts that share shingles; the others' fingerprints are neither made nor compared."""

    def no_links(*_):
        raise AssertionError("all pairs of fingerprints")

    monkeypatch.setattr(simhash, "links", no_links)
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(10_000)}" for _ in range(60)) for _ in range(400)]
    texts += [t.replace(t.split()[30], "changed") for t in texts[:20]] + texts[50:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(df).collect()}
    assert got == {i: i if i < 400 else i - 400 if i < 420 else i - 370 for i in range(430)}
