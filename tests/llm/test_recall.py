"""How many of the near copies in the tables near_dedup links, by exact sets of shingles over all rows."""

from collections import defaultdict
from pathlib import Path

import pytest

from tidewell.llm import simhash

DATA = Path("/root/testdata/sf0.01/documents.parquet")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = (text or "").translate(FOLD).split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_pairs(sets, least):
    """Pairs of different sets with a Jaccard similarity of at least `least`, each with it: those that share a shingle are counted, all of them."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for own in holders.values():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                common[i, j] += 1
    for (i, j), n in common.items():
        similarity = n / (len(sets[i]) + len(sets[j]) - n)
        if similarity >= least:
            yield i, j, similarity


def recall(spark, path):
    """(linked, all) pairs of different texts by least similarity, and how many linked pairs of them have next to nothing in common."""
    df = spark.read.parquet(str(path)).select("doc_id", "text")
    root = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    texts = defaultdict(list)
    for r in df.collect():
        texts[shingles(r.text)].append(r.doc_id)
    assert all(len({root[i] for i in ids}) == 1 for s, ids in texts.items() if s)  # equal shingles are the same text but for white space
    sets = [s for s in texts if s]
    one = [root[texts[s][0]] for s in sets]
    found = {0.8: [0, 0], 0.5: [0, 0]}
    for i, j, similarity in near_pairs(sets, 0.5):
        for least, counts in found.items():
            if similarity >= least:
                counts[0] += one[i] == one[j]
                counts[1] += 1
    return found


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_near_copies_of_the_tables_are_linked(spark):
    found = recall(spark, DATA)
    assert found[0.8][0] == found[0.8][1] and found[0.5][1] > 10 and found[0.5][0] >= 0.9 * found[0.5][1]
