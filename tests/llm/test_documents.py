import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import chat, common, decontam, htmltext, lines, mixing, quality, simhash, urls

from .conftest import SCHEMA, sha

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_quality(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(cover)


def test_quality_measures(docs, docs_df):
    got = {r.doc_id: r.quality for r in quality.judge(docs_df).select("doc_id", "quality").collect()}
    for i, t, *_ in docs:
        q, want = got[i], brute_quality(t)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (q.kept and q.base_failed)


def test_quality_filter_keeps_columns(spark, docs_df, empty_df):
    good = " ".join(f"{w} the of" for w in "river mill town summer people garden winter bridge valley harvest market church meadow orchard castle forest island".split()) + " and was in it that"
    bad = " | ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, good, 7), (2, bad, 8), (3, None, 9)], "doc_id long, text string, _quality int")
    out = quality.quality_filter(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()][0][0] == 1 and out.count() == 1
    assert quality.quality_filter(empty_df).count() == 0


def brute_lines(docs, least=10, first=False):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    rows = [(i, [(x, key(x)) for x in (t or "").split("\n")]) for i, t in docs]
    seen = {}
    for i, ls in rows:
        for _, k in ls:
            if k:
                seen.setdefault(k, set()).add(i)
    out, taken = [], set()
    for i, ls in sorted(rows, key=lambda r: r[0]):
        kept = []
        for x, k in ls:
            gone = k and len(seen[k]) >= least
            if gone and first and k not in taken:
                taken.add(k)
                gone = False
            if not gone:
                kept.append(x)
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("least,first,parts", [(10, False, "4"), (3, False, "40"), (2, True, "4"), (3, True, "40")])
def test_lines(spark, docs, docs_df, least, first, parts):
    """With 40 partitions the runs of common lines go on over partition edges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = docs_df.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")))
        out = lines.dedup_lines(df, min_docs=least, keep_first=first, dropped="gone").select("doc_id", "n_lines", "gone", F.sha2(F.coalesce("text", F.lit("")), 256))
        assert sorted(tuple(r) for r in out.collect()) == brute_lines([d[:2] for d in docs], least, first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_line_and_columns(spark, empty_df):
    rows = [(i, f"own {i}\nHOT\n" if i % 3 else "hot", i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos long").repartition(5)
    out = lines.dedup_lines(df)
    assert out.columns == df.columns and {r.text for r in out.filter("doc_id % 3 = 0").collect()} == {""} and out.filter("text = concat('own ', doc_id, '\n')").count() == 400
    assert lines.dedup_lines(empty_df).count() == 0
    twice = spark.createDataFrame([(1, "a\na")] * 12 + [(None, "a")] * 3, "doc_id long, text string")
    assert lines.dedup_lines(twice, min_docs=3).filter("text = ''").count() == 0  # two documents, whatever their rows
    assert lines.dedup_lines(twice, min_docs=2).filter("text = ''").count() == 15


def brute_print(text, size=4, seed=42):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), seed) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("radius", [4, 20])
def test_simhash(docs, docs_df, radius):
    out = simhash.near_duplicates(docs_df, radius=radius).select("doc_id", F.hex("fp").alias("fp"), "component_id").collect()
    prints = {i: brute_print(t) for i, t, *_ in docs}
    assert {r.doc_id: int(r.fp, 16) for r in out} == prints
    ids = sorted(prints)
    assert {r.doc_id: r.component_id for r in out} == brute_components(ids, [prints[i] for i in ids], radius)


@pytest.mark.parametrize("words,radius", [(1, 4), (1, 12), (4, 52)])
def test_linked_tiles(words, radius):
    r = np.random.default_rng(words)
    a = r.integers(0, 2**64, (300, words), dtype=np.uint64)
    a[200:] = a[:100] ^ (np.uint64(1) << r.integers(0, 64, (100, words), dtype=np.uint64))
    a = np.unique(a, axis=0)
    b = np.unique(a[50:120] ^ (np.uint64(1) << r.integers(0, 64, (70, words), dtype=np.uint64)), axis=0)
    as_int = lambda x: [int.from_bytes(p, "big") for p in simhash._packed(x)]
    for one, other in ((a, None), (a, b)):
        u, v = simhash.linked(one, other, radius)
        every = as_int(one) + (as_int(other) if other is not None else [])
        want = {(p, q) for i, p in enumerate(every) for q in every[:i] if (other is None or (p in as_int(other)) != (q in as_int(other))) and bin(p ^ q).count("1") <= radius}
        root = {p: p for p in every}
        for p, q in sorted(want):
            x, y = root[p], root[q]
            for k in root:
                if root[k] in (x, y):
                    root[k] = min(x, y)
        got = dict(zip(as_int(u), as_int(v), strict=True))
        assert {p: got.get(p, p) for p in root} == root


@pytest.mark.parametrize("room", [5, 1 << 18])
def test_long_chain_of_components(spark, monkeypatch, room):
    monkeypatch.setattr(simhash, "CONTRACT", room)
    n = 60
    edges = spark.createDataFrame([(bytes([i + 1]), bytes([i])) for i in range(n)] + [(b"\xf1", b"\xf0")], "u binary, v binary").repartition(7)
    got = {bytes(r.node)[0]: bytes(r.root)[0] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 0xF0: 0xF0, 0xF1: 0xF0}


def test_hot_labels(spark):
    """A key that most rows share, and a thousand others."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 1111).alias("k"))
    labels = spark.range(-1, 2000).select(F.col("id").alias("k_"), (F.col("id") * 2).alias("label"))
    got = common.join_hot(rows, labels, "k", "k_")
    assert got.filter("label <> 2 * k").count() == 0 and got.select("id").distinct().count() == got.count() == 20_000
    assert common.join_hot(rows, labels.filter("k_ > 5"), "k", "k_").count() == rows.filter("k > 5").count() and common.join_hot(rows.limit(0), labels, "k", "k_").count() == 0


def test_near_dedup(spark, empty_df):
    base = " ".join(f"w{i * 7 % 101}q{i}" for i in range(300))
    near = base.replace("w7q1 ", "changed ")
    rows = [(5, near, "x"), (2, base, "y"), (9, base, "z"), (7, "something else entirely " * 3, "q"), (8, None, None), (3, "", None), (None, base, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id or -1 for r in out.collect()) == [-1, 2, 3, 7]
    assert simhash.dedup(empty_df).count() == 0


def brute_similar(texts, size=5):
    """The least place of each text's component over all pairs of near copies."""
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    shingles = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]

    def share(i, j):
        w = words[i]
        covered = {k + x for k in range(max(1, len(w) - size + 1)) if tuple(w[k : k + size]) in shingles[j] for x in range(min(size, len(w)))}
        return len(covered) / len(w)

    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (not words[i] and not words[j] or words[i] and words[j] and shingles[i] & shingles[j] and min(share(i, j), share(j, i)) >= 0.8):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("block", [256, 7])
def test_near_dedup_verifies_links(spark, monkeypatch, block):
    """Groups with similarities on both sides of 0.8; with small blocks they meet in pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    r = random.Random(3)
    texts = [None, "", " \n", "A b", "a  B", "a b c"]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(200)]
        for k in range(16):
            start = r.randrange(200)
            n = (4, 12, 24, 34, 45, 60)[g] if k else 0  # so many words of a stretch are others
            texts.append(" ".join(f"x{g}y{k}z{i}" if start <= i < start + n else w for i, w in enumerate(base)))
    for k in range(12):  # scattered changes
        texts.append(" ".join(f"v{k}u{i}" if k and r.random() < 0.05 else f"s{i}" for i in range(150)))
    texts += texts[8:11] + [t.upper() for t in texts[30:33]]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, gone_id int, gone_a int").repartition(5)
    want = brute_similar(texts)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and 20 < len(set(want)) < 95 and len(set(want[-18:-6])) < 3
    out = simhash.dedup(df)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == sorted(set(want))
    raw = simhash.near_duplicates(df, radius=88, size=5, words=4, repeats=False).select("component_id").distinct().count()
    assert raw < len(set(want))  # the fingerprints alone join more


def brute_edits(item, text):
    """Least edits between the item and any stretch of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, ch in enumerate(item, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (ch != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(r, x, edits, letters="qz"):
    y = list(x)
    for _ in range(edits):
        p = r.randrange(len(y))
        kind = r.randrange(3)
        if kind == 0:
            y[p] = r.choice(letters)
        elif kind == 1 and len(y) > 1:
            del y[p]
        else:
            y.insert(p, r.choice(letters))
    return "".join(y)


def test_decontamination(spark, empty_df):
    """Items of all lengths, also those whose budget leaves nothing of the lemma's bound for eight characters."""
    r = random.Random(4)
    plain = lambda t: " ".join((t or "").lower().split())
    noise = lambda n: "".join(r.choice("abcdef ghi") for _ in range(n))
    items = [plain(noise(n)) for n in (5, 7, 8, 9, 10, 12, 15, 20, 23, 30, 31, 40, 80, 120)] + ["", None]
    rows = []
    for n in range(160):
        x = items[n % 14]
        rows.append((n, noise(r.randrange(50)) + edited(r, x, r.randrange(len(x) // 10 + 2)).upper() * r.choice((1, 1, 3)) + "\n " + noise(r.randrange(50))))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, items[12]), (903, items[12]), (None, items[13]), (904, "nothing here")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, item_id int").repartition(3)
    bench = spark.createDataFrame([(k, t, 0) for k, t in enumerate(items)], "item_id long, text string, edits int")
    got = sorted(((-1 if x.doc_id is None else x.doc_id, x.item_id, x.edits) for x in decontam.occurrences(docs, bench).collect()))
    want, hit = [], set()
    for i, t in rows:
        for k, item in enumerate(items):
            if item and plain(t) and (e := brute_edits(item, plain(t))) <= len(item) // 10:
                want.append((-1 if i is None else i, k, e))
                hit.add(i)
    assert got == sorted(want) and len(want) > 100 and sum(e > 0 for *_, e in want) > 20
    for x in decontam.occurrences(docs.filter("doc_id < 40"), bench).collect():
        assert brute_edits(items[x.item_id], plain(dict(rows)[x.doc_id])[x.start : x.end]) == x.edits
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in rows if i not in hit)
    assert decontam.occurrences(empty_df, bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_pieces(monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 500)
    r = random.Random(2)
    item = "".join(r.choice("abcdefgh ") for _ in range(200))
    filler = "".join(r.choice("stuvwxyz ") for _ in range(3000))
    benchmark = decontam.Benchmark([(1, item)])
    for at in range(0, 3000, 97):
        assert decontam.scan([decontam.normal(filler[:at] + " " + item + " " + filler[at:])], benchmark)


def test_decontamination_of_a_repetitive_text():
    """Nearly every diagonal of the text reaches the bound; each costs its band only."""
    item = "abcdefgh" * 25
    began = time.monotonic()
    assert not decontam.scan(["abcdefgx" * 30_000], decontam.Benchmark([(1, item)]))
    (found,) = decontam.scan(["abcdefgh" * 5 + "x" + "abcdefgh" * 19 + "abcdefg" + "x" * 4000], decontam.Benchmark([(1, item)]))
    assert found[4] == brute_edits(item, "abcdefgh" * 5 + "x" + "abcdefgh" * 19 + "abcdefg" + "x" * 40) and time.monotonic() - began < 20


def test_mixing(spark, docs, docs_df, empty_df):
    out = [r.asDict() for r in mixing.mix(docs_df).collect()]
    again = [r.asDict() for r in mixing.mix(docs_df.repartition(7)).collect()]
    order = lambda rows: sorted(map(str, rows))
    assert order(out) == order(again) and len(out) == len(docs)
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in docs}
    names = sorted({d[3] for d in docs if d[3] is not None}) + [None]
    total = {s: sum(size[d[0]] for d in docs if d[3] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    for s in names:
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own) + 1e-6
    assert mixing.mix(empty_df).count() == 0


def test_mixing_deep_tree_and_fairness(spark):
    n = 9000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 20).cast("int")).alias("text"))
    out = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in out) == n and all(abs(r.t - r.g) <= 20 for r in out)
    same = spark.createDataFrame([(1, "a b c", "s")] * 300, "doc_id long, text string, source string")
    assert mixing.mix(same).count() == 300


def test_chat_round_trip(spark):
    texts = ["", "plain", "\\", "\\b\\h\\t", "###", "####", "</turn>", "</turn", "### user:\n", "a\n\nb", "\\### Assistant: </turn> ok", "<</turn>>", "#\\##", None]
    rows = [(c, t, role, texts[(c * 5 + t) % len(texts)]) for c in range(6) for t in range(150 if c == 1 else 14) for role in [("user", "assistant", "sys:tem\n\\n", None, "a:\n###")[t % 5]]]
    rows += [(1, 3, "user", "twin"), (1, 3, "user", "twin"), (None, None, "user", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.render(chat.reconstruct(chat.conversation_events(conv))).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {r.conv_id: [(x.role, x.text) for x in r.turns] for r in out} == {c: [(a, b) for _, a, b in sorted(v)] for c, v in want.items()}


def brute_chat(events):
    """The final (turn, role, text) of each conversation, event by event."""
    convs = {}
    low = lambda t: -(10**30) if t is None else t
    for c, seq, turn, kind, role, text in sorted(events, key=lambda e: (e[1], e[4] or "", e[5] or "")):
        turns = convs.setdefault(c, {})
        mine = turns.setdefault(low(turn), [])
        if kind not in ("delta", "edit", "regenerate") or not mine:
            mine.append([seq, role or "", text or "", False])
        elif kind == "delta":
            mine[-1][2] += text or ""
        else:
            mine[-1][2] = text or ""
        if kind == "regenerate":
            for t, messages in turns.items():
                if t > low(turn):
                    for m in messages:
                        m[3] = m[3] or m[0] < seq
    return {c: [(m[1], m[2]) for t in sorted(turns) for m in turns[t] if not m[3]] for c, turns in convs.items()}


def test_chat_events(spark):
    schema = "conv_id long, seq long, turn long, kind string, role string, text string"
    ev = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", "assistant", "Hel"), (1, 3, 1, "delta", "assistant", "lo"), (1, 4, 2, "message", "user", "x"), (1, 5, 1, "regenerate", "assistant", "Bye"), (1, 6, 1, "delta", "assistant", "!"), (1, 7, 2, "message", "user", "y"), (1, 8, 0, "edit", "user", "hey"), (2, 0, 0, "delta", "user", "lost")]
    got = chat.reconstruct(spark.createDataFrame(ev, schema).repartition(3)).select("conv_id", "turn", "role", "text").collect()
    assert sorted(tuple(r) for r in got if r.conv_id == 1) == [(1, 0, "user", "hey"), (1, 1, "assistant", "Bye!"), (1, 2, "user", "y")]
    assert chat.render(chat.reconstruct(spark.createDataFrame([], schema))).count() == 0


def test_chat_events_against_brute_force(spark):
    """Long conversations with regenerations in many blocks of turns, in no order, and other columns beside."""
    r = random.Random(9)
    ev = []
    for c, turns in ((1, 400), (2, 30), (None, 9), (-5, 200)):
        for seq in range(6 * turns):
            turn = None if r.random() < 0.01 else r.randrange(-3, turns)
            ev.append((c, seq, turn, r.choice(("message", "message", "delta", "delta", "edit", "regenerate", "odd", None)), r.choice(("user", "assistant", None)), r.choice((f"t{seq}", "", None))))
    want = brute_chat(ev)
    r.shuffle(ev)
    df = spark.createDataFrame([(*e, 1, 2, "x") for e in ev], "conv_id long, seq long, turn long, kind string, role string, text string, block int, nil int, again string").repartition(5)
    out = chat.render(chat.reconstruct(df)).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    assert {x.conv_id: [(t.role, t.text) for t in x.turns] for x in out} == {c: v for c, v in want.items() if v}
    for x in out:
        texts = [t for role, t in want[x.conv_id] if role == "assistant"]
        assert [x.formatted[s.start : s.end] for s in x.loss_spans] == texts  # nothing to escape here


def test_chat_log_ends_in_the_conversations(spark):
    """The log of a table has all kinds of events and folds back to its rows, whatever the texts hold."""
    texts = ["", "plain", "\\", "###", "</turn>", "\\### Assistant: </turn> ok", "é𝄞 ü" * 50, None]
    rows = [(c, t, ("user", "assistant")[t % 2], texts[(c + 3 * t) % len(texts)]) for c in range(12) for t in range(c * 12)]
    rows += [(1, 3, "assistant", "twin"), (1, 3, "assistant", "twin"), (None, None, "assistant", "x"), (None, 2, None, "y"), (5, None, "user", "z"), (6, (1 << 63) - 1, "assistant", "last"), (6, -(1 << 63), "assistant", "first")]
    events = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"} and events.count() > 2 * len(rows)
    blocks = chat.render_blocks(chat.reconstruct(events.repartition(6))).withColumn("loss", chat.learned_text(F.col("piece"), F.col("spans")))
    out = chat.join_blocks(blocks, "loss").withColumn("turns", chat.parse(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-(1 << 64) if t is None else t, role or "", text or ""))
    assert {r.conv_id: [(x.role, x.text) for x in r.turns] for r in out} == {c: [(a, b) for _, a, b in sorted(v)] for c, v in want.items()}
    assert {r.conv_id: r.loss for r in out} == {c: "".join(b for _, a, b in sorted(v) if a == "assistant") for c, v in want.items()}


def test_url_rules(spark, empty_df):
    cases = {
        "https://a.EXAMPLE.net/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"), "http://x.net/en/": ("x.net", "/en/", "net/", "block"), "http://example.com/de/5#f": ("example.com", "/de/5", "example.com/de/", "block"),
        "http://w.org/fr/1": ("w.org", "/fr/1", "org/fr/", "allow"), "http://notexample.net/en/1": ("notexample.net", "/en/1", "net/", "block"), "http://w.org": ("w.org", "", None, None), "http://a.net?x": ("a.net", "", None, None),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "x://y://z/p": ("y:", "//z/p", None, None), "http://royal-casino.example.com/en/3": ("royal-casino.example.com", "/en/3", None, "block"),
    }
    df = spark.createDataFrame([(i, u, "clash", 1, 2) for i, u in enumerate(cases)], "page_id long, url string, HOST string, ruled int, Verdict int")
    out = urls.judge(df.unionAll(df))
    assert out.columns == ["page_id", "url", "ruled", "host", "path", "rule", "score", "verdict"]
    got = out.collect()
    assert len(got) == 2 * len(cases) and len({r.page_id for r in got}) == len(cases)
    for r in got:
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert urls.judge(empty_df.select("doc_id", F.col("text").alias("url"))).count() == 0
    long = spark.createDataFrame([("http://poker-casino.example.com/" + "q1w2/" * 40_000,)], "url string")
    assert urls.judge(long).first().verdict == "block"  # the path does not drown the host


def test_url_model_on_other_names(spark):
    """Names that the table lacks: such as share word parts with it, and such as share none and must be allowed."""
    bad = ["onlinecasinos", "bestpoker", "gamblers", "freepornsite", "e-pharmacies", "cheapviagras", "slotsbets", "adultwebcams", "spambacklinks", "jackpots-lottery", "paydayloan", "replicas"]
    good = ["historical-society", "universities", "schools", "musicals", "bakers", "gardeners", "national-archives", "weatherman", "mapsandbooks", "citymuseums", "farmers-markets", "chessclub"]
    alien = ["xylophone", "quixotic", "wuthering", "jyväskylä", "zzyzx", "ytterby", "kwikfit", "uxbridge", "vowchurch", "iffley", "yggdrasil", "ouzel"]
    df = spark.createDataFrame([(f"http://www.{n}.example.com/en/{i}", k) for k, names in enumerate((bad, good, alien)) for i, n in enumerate(names)], "url string, k int")
    blocked = {r.k: r.n for r in urls.judge(df).groupBy("k").agg(F.count_if(F.col("verdict") == "block").alias("n")).collect()}
    assert blocked[0] >= 6 and blocked[1] <= 1 and blocked[2] <= 2


#: Innocent names with a word to block in them, or its beginning; none is in the table.
INNOCENT = """
trainspotting bettertogether credits-union advert-standards assessment bingley cheapside betty-crafts abbey-bets-school leadership broadway headland gladstone badminton readers threadneedle downloads-docs
gradschool cryptozoology cryptic-crosswords encryption accreditors sexton-family sussex-walks essexcounty dietitian nutrition medsoc medley-choir bingen-rhein crackle-glaze firecrackers seongnam museonline
niagarafalls adulteducation escorted-tours discountenance cheapstow clickety rambling-roses lotus-pottery replicas-museum softwarefoundry spokane lendlease linkoping slotcars-club prizegiving counterfoil
""".split()


def test_url_model_on_innocent_names(spark):
    df = spark.createDataFrame([(f"https://www.{n}.example.com/index.html",) for n in INNOCENT], "url string")
    assert urls.judge(df).filter("verdict = 'block'").count() <= len(INNOCENT) // 4


def reference_text(page):
    """The extraction by Python's own parser, for pages with an article: the blocks under it that are under no aside element or marked one."""
    import html.parser

    class Reader(html.parser.HTMLParser):
        block = set("article p h1 h2 h3 div section ul li footer nav aside header body form table tr td blockquote pre".split())

        def __init__(self):
            super().__init__()
            self.open, self.out, self.text = [], [], []

        def flush(self):
            words = "".join(self.text).split()
            inside = [i for i, (t, _) in enumerate(self.open) if t == "article"]
            if words and inside and not any(mark for _, mark in self.open[inside[-1] + 1 :]):
                self.out.append(" ".join(words))
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.text.append(" ")
            if tag in self.block:
                self.flush()
                if self.open and self.open[-1][0] == "p":
                    self.open.pop()
                self.open.append((tag, tag in ("nav", "aside", "footer", "form") or any(k == "class" and v in ("comments", "ad") for k, v in attrs)))
            elif tag in ("script", "style", "title"):
                self.open.append((tag, True))

        def handle_endtag(self, tag):
            if tag in self.block or tag in ("script", "style", "title"):
                if tag in ("script", "style", "title"):
                    self.text = []
                else:
                    self.flush()
                if any(t == tag for t, _ in self.open):
                    while self.open.pop()[0] != tag:
                        pass

        def handle_data(self, data):
            if not (self.open and self.open[-1][0] in ("script", "style", "title")):
                self.text.append(data)

    reader = Reader()
    reader.feed(page)
    reader.flush()
    return "\n".join(reader.out)


def test_html_against_a_parser():
    """Made-up pages of all sorts of blocks, extracted by an independent reader."""
    r = random.Random(5)
    words = lambda n: " ".join(r.choice(("mill", "r&amp;d", "town", "&eacute;t&eacute;", "river", "a&lt;b", "old")) for _ in range(n))
    tree = htmltext.trained_tree()
    for _ in range(300):
        body = ""
        for _ in range(r.randrange(1, 9)):
            body += r.choice((f"<p>{words(r.randrange(1, 40))}</p>", f"<p><b>{words(9)}<br>{words(2)}<p>{words(1)}</p>", f"<h2>{words(3)}</h2>", f"<ul><li><a href=x>{words(2)}</a></li><li>{words(4)}</li></ul>", f"<div class=ad>{words(6)}</div>"))
            body += r.choice(("", "<script>var a='<p>';</script>", "<!-- <p>no</p> -->", f"<div class='comments'><p>{words(20)}</p></div>", f"<aside><p>{words(12)}</p></aside>", "\n", f"<span class=\"x>y\">{words(2)}</span>"))
        page = f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body><nav><ul><li><a href=1>{words(1)}</a></li></ul></nav><div class='ad'>{words(8)}</div><article><h1>{words(4)}</h1>{body}</article><footer>&copy; {words(9)}</footer></body></html>"
        assert htmltext.main_text(page, tree) == reference_text(page)


def test_html(spark, empty_df):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=1>Home</a></nav><div class='ad'>Buy this now please.</div><article><h1>A &amp; B</h1><p>One\n two&nbsp;three<br>four</p><p><b>Un<i>closed<p>Next &am</article><section class=comments><p>nice post</p></section><footer>&copy; me</footer>"
    rows = [(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 2), (3, "v", "", 3), (4, "w", "<script>no end", 4), (5, "x", "<article><p>a < b &lt; c</p><!-- <p>hidden</p> --><p>d", 5)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, _html int"))
    assert out.columns == ["page_id", "url", "_html", "text"]
    got = sorted(tuple(r) for r in out.select("page_id", "text").collect())
    one = "A & B\nOne two three four\nUnclosed\nNext &am"
    assert got == [(1, one), (1, one), (2, ""), (3, ""), (4, ""), (5, "a < b < c\nd")]
    assert htmltext.extract(empty_df.select("doc_id", F.col("text").alias("html"))).count() == 0


ARTICLE = "the old mill by the river was open to all people of the town"


@pytest.mark.parametrize(
    "before",
    ["<nav><svg class='i'/></nav>", "<svg data-x='a>b' /><div><svg><text>no</text></svg></div>", "<svg-icon></svg-icon>", "<select-box>", "<title-bar></title-bar><template-x></template-x>", "<svg>", "<SELECT name=a>", "<iframe src='x'/><iframe>no</iframe>", "<title>no</title><title>", "<svg><svg>no</svg></svg>"]
    + ["<textarea>no</TEXTAREA >", "<script-x></script-x>", "<script>'<svg>'</script>", "<style/>no</style>", "<math/>", "<div class='layout has-sidebar'>", "<div id=sidebar-wrapper><p data-id='ad'></p>", "<p class=ad>" + "<b>" * 9 + "Buy now<p>", "<!-->"],
)
def test_html_skips_no_article(before):
    tree = htmltext.trained_tree()
    page = f"{before}<article data-id='ad'><h1 class=\"post-header\">A title</h1><p>{ARTICLE} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> so</p><noscript><p>without scripts</p></noscript><ul><li><a href=1>link</a></li></ul><object>as text</object><p>{ARTICLE} <select><option>no</select>twice</p></article><svg><title>no</title></svg><script>no"
    assert htmltext.main_text(page, tree) == f"A title\n{ARTICLE} x=1 so\nwithout scripts\nlink\nas text\n{ARTICLE} twice"


def some(n, k=0):
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.mark.parametrize(
    "kept",
    [
        "<h1>Title</h1><p>{40}</p><p>KEEP{12} <a href=x>{2}</a></p><p>{30}</p>", "<p>{40}</p><p>KEEP{20} <a href=x>{2}</a> {5}</p><p>{30}</p>", "<p>{40}</p><p>KEEP{40} <a href=x>{4}</a> {5}</p><p>{30}</p>",
        "<div>{30}</div><div>KEEP{25} <a href=x>{3}</a> {8}</div><div>{28}</div>", "<article><p>{40}</p><div class='notice-board'><p>KEEP{20}</p></div></article>", "<article><p>{40}</p><section class='search'><p>KEEP{20}</p></section></article>",
        "<article><p>{40}</p><section id='comment-on-policy'><p>KEEP{20}</p></section></article>", "<article><div class='page-header'><h1>KEEP{5}</h1></div><p>{40}</p></article>", "<main><div class='ad-hoc-committee'><p>KEEP{9}</p></div></main>",
    ],
)
def test_html_keeps_linked_paragraphs_and_misleading_names(kept):
    n = 0

    def fill(m):
        nonlocal n
        n += 1
        return some(int(m[1]), n)

    page = re.sub(r"\{(\d+)\}", fill, kept)
    found = htmltext.main_text(page, htmltext.trained_tree())
    wanted = re.sub(r"<[^>]*>", "", page.split("KEEP")[1].split("</p>")[0].split("</div>")[0].split("</h1>")[0])
    assert "KEEP" + wanted in found


@pytest.mark.parametrize("sizes", [(45, 50), (30, 30, 30), (80, 25), (50, 70, 90, 40), (26, 9), (100,)])
def test_html_keeps_the_last_paragraph(sizes):
    """Of pages without an article, with nothing after it."""
    texts = [some(n, k) for k, n in enumerate(sizes)]
    for tag in ("p", "div") if min(sizes) > 20 else ("p",):
        assert htmltext.main_text("".join(f"<{tag}>{t}</{tag}>" for t in texts), htmltext.trained_tree()) == "\n".join(texts)


def test_html_drops_comments_and_adverts_of_an_article():
    page = f"<article><p>{some(40)}</p><div class='ad'>{some(20, 1)}</div><section class='comments'><p>{some(30, 2)}</p></section><div class='comment-list'><p>{some(30, 3)}</p></div><div id='ad_box2'>{some(9, 4)}</div></article>"
    assert htmltext.main_text(page, htmltext.trained_tree()) == some(40)


@pytest.mark.parametrize("page", ["<script " * 100_000, '<a "' * 100_000, '<a x="' * 100_001, "<b>" * 50_000 + "<p>x</p>" * 50_000, "<svg>a" * 60_000, "<title>" * 100_000, "<!-- " * 100_000, "<div><li></li>" * 30_000, "&" * 300_000, "<" * 300_000, "<div class='" * 100_001], ids=lambda p: p[:6])
def test_html_of_hostile_pages_takes_linear_time(page):
    began = time.monotonic()
    htmltext.main_text(page, htmltext.trained_tree())
    assert time.monotonic() - began < 5


def tree_features(tree):
    return set() if isinstance(tree, bool) else {htmltext.FEATURES[tree[0]]} | tree_features(tree[2]) | tree_features(tree[3])


def test_html_tree_on_held_out_layouts():
    """The tree of all labelled layouts but one, on that one; then without the features that tags and class words give away."""
    assert {"words", "link_density", "words_after", "link_density_before", "link_density_after"} <= tree_features(htmltext.trained_tree())
    pages = htmltext.labelled_pages()
    n = len(htmltext.SCALES)
    for hidden, least in (((), 0.93), ((10, 11), 0.75), ((8, 9, 10, 11), 0.65)):
        right = total = 0
        for k in range(len(htmltext.LABELLED)):
            x, y = htmltext.training_table([p for i, p in enumerate(pages) if i // n != k])
            a, b = htmltext.training_table(pages[n * k : n * k + n])
            x[:, hidden], a[:, hidden] = 0, 0
            right += int((htmltext.classify(htmltext.grow(x, y, 8), a) == b).sum())
            total += len(b)
        assert right / total > least
