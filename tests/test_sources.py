import io
import json
import random
import tarfile
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import api
from tidewell.errors import ConfigError, DimensionError, NotFoundError, ParseError, ReadOnlyError, StorageError, UnsupportedLanguageError
from tidewell.functions import embed
from tidewell.functions.embed import hash_embed, hash_model_id
from tidewell.functions.enhance import classify_intent, extract_entities, rule_enhance
from tidewell.functions.lang import detect_lang
from tidewell.operators import evaluate, fulltext
from tidewell.sources import code, corpus, index, markdown, querysets
from tidewell.streaming.ingest import first_seen, ingest, windowed_counts


def md(spark, text, lang="markdown", **kw):
    files = spark.createDataFrame([("a.md", lang, text)], "source string, lang string, text string")
    return markdown.chunk_markdown(files, **kw).orderBy("line_range.start").collect()


def test_markdown_sections(spark):
    c = md(spark, "pre\n# Top\n## A\nbody a\n\n## B\nbody # b\n")
    assert [r.heading_path for r in c] == [["Top", "A"], ["Top", "B"]]
    assert c[0].content == "body a\n" and (c[0].line_range.start, c[0].line_range.end) == (4, 5) and c[0].chunk_id == "a.md#Top/A@4"
    assert [r.parent_id for r in c] == [None, None]
    c = md(spark, "# Top\nintro\n## A\nbody\n### Deep\nx\n## B\ny")
    assert [r.parent_id for r in c] == [None, "a.md#Top@2", "a.md#Top/A@4", "a.md#Top@2"]
    assert md(spark, "no heading") == [] and md(spark, "") == []
    assert len(md(spark, "# T\n```\n# not\n```\nx")) == 2 and len(md(spark, "# T\n```\n# not\n```\nx", fence_aware=True)) == 1
    assert len(md(spark, "####### seven\n#no\n# T\nx")) == 1


def test_front_matter(spark):
    head = "---\nplatforms: [Harmony, openharmony, windows]\napi_version: 12\ntype: API_DOC\ntags: [ui]\ndeprecated: true\napi_name: router\n---\n"
    for text in (head + "# T\nx\n", (head + "# T\nx\n").replace("\n", "\r\n")):
        (c,) = md(spark, text)
        assert c.platforms == ["harmonyos", "harmonyos"] and c.api_version == "12" and c.type == "api_doc" and c.tags == ["ui"] and c.deprecated and c.extra == {"api_name": "router"}
        assert c.line_range.start == 10
    with pytest.raises(ParseError):
        markdown.split_frontmatter("---\na: [\n---\n")
    assert markdown.split_frontmatter("---\nno end")[0] is None
    with pytest.raises(Exception, match=UnsupportedLanguageError.__name__):
        md(spark, "# T\nx", lang="kotlin")


TS = """import x from 'y';
class A extends B {
  field = 1;
  method(a: string): void { if (a) { call("}"); } }
}
function f() { return `{`; }
interface I { x: number }
enum E { P, Q }
const g = (a: number) => { return a; };
type T = string | number;
"""


def test_code_chunks():
    c = code.chunk_code("a.ts", TS)
    assert [r["heading_path"] for r in c] == [["A"], ["A", "method"], ["f"], ["I"], ["E"], ["g"], ["T"]]
    assert c[1]["parent_id"] == c[0]["chunk_id"] == "a.ts#A@2" and c[0]["line_range"] == {"start": 2, "end": 5}
    assert [r["chunk_id"] for r in code.chunk_code("a.ts", "x = 1;\ny();")] == ["a.ts#@1"]
    assert code.chunk_code("a.ts", " \n") == []
    s = code.chunk_code("v.ets", "@Entry\n@Component\nstruct Page {\n  build() {\n    Text('a')\n  }\n}")
    assert [r["heading_path"] for r in s] == [["Page"], ["Page", "build"]]


def test_languages(spark):
    names = {"a.md": "markdown", "b.ETS": "arkts", "c.tsx": "arkts", "d.kt": "kotlin", "e.swift": "swift", "f.json": "json", "g": "auto", "x.y/h": "auto", ".md": "auto", "p/.ts": "auto"}
    d = spark.createDataFrame([(k,) for k in names], "p string").select("p", detect_lang(F.col("p")).alias("l"))
    assert {r.p: r.l for r in d.collect()} == names


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "corpus"
    (d / "official").mkdir(parents=True)
    (d / "_index").mkdir()
    (d / "official" / "router.md").write_text("---\ntags: [nav]\n---\n# Router\nUse the router to push a page.\n## Params\nPass parameters here.\n")
    (d / "official" / "list.md").write_text("# List\nA lazy list of items.\n")
    (d / "a.ets").write_text("function go() { return 1; }\n")
    (d / "skip.kt").write_text("fun x() {}")
    (d / ".hidden.md").write_text("# H\nx")
    (d / "_index" / "i.md").write_text("# I\nx")
    (d / "bad.md").write_bytes(b"# Bad\nab\xffcd\n")
    return d


def test_index_query_evaluate(spark, folder, tmp_path):
    by_hash = lambda c: hash_embed(c, 16)
    store = index.Store(spark, str(tmp_path / "store"))
    with pytest.raises(NotFoundError):
        store.chunks()
    stats = index.index_folder(spark, str(folder), store, by_hash, hash_model_id(16), 16)
    assert stats == {"files": 4, "chunks": 5, "skipped": 1} and store.count() == 5
    assert {r.folder: r.n for r in corpus.folder_counts(corpus.scan(spark, str(folder))).collect()} == {"official": 2, "samples": 0, "migration": 0, "errors": 0, "custom": 0}
    bad = corpus.audit_utf8(corpus.scan(spark, str(folder))).collect()
    assert [(r.source, r.position, r.bytes_hex) for r in bad] == [("bad.md", 8, "ff")]
    engine = api.Engine(spark, index.Store(spark, str(tmp_path / "store"), read_only=True), by_hash, hash_model_id(16), 16, str(folder))
    hits = engine.one("Use the router to push a page.", k=2)
    assert hits[0]["source"] == "official/router.md" and hits[0]["rank"] == 1 and hits[0]["found_by"] == "hybrid"
    assert engine.one("Pass parameters here.", k=1, expand_parent=True)[0]["preview"] == "Use the router to push a page."
    assert engine.one("", k=2) == []
    with pytest.raises(ReadOnlyError):
        engine.store.save(store.chunks(), "x", 16)
    with pytest.raises(StorageError):
        store.chunks("other")
    e = tmp_path / "q.yaml"
    e.write_text("- {id: a, query: A lazy list of items., relevant: ['official/list.md#List@2']}\n- {id: b, query: nothing like it, relevant: [zzz]}\n")
    text = api.evaluate(engine, str(e), 3)
    assert "| recall | 0.500 |" in text and "- b: zzz" in text
    assert api.handle_http(engine, "GET", "/health")[0] == 200 and api.handle_http(engine, "POST", "/index")[0] == 501 and api.handle_http(engine, "POST", "/search", {})[0] == 400 and api.handle_http(engine, "GET", "/no")[0] == 404
    assert len(api.handle_http(engine, "POST", "/search", {"query": "router", "k": 1})[1]["hits"]) == 1
    ask = lambda m: api.handle_mcp(engine, json.dumps(m))
    assert len(ask({"id": 1, "method": "tools/list"})["result"]["tools"]) == 4 and ask({"method": "x"}) is None and api.handle_mcp(engine, "{")["error"]["code"] == -32700
    assert ask({"id": 1, "method": "no"})["error"]["code"] == -32601 and ask({"id": 1, "method": "tools/call", "params": {}})["error"]["code"] == -32602
    assert "router.md" in ask({"id": 1, "method": "tools/call", "params": {"name": "search_docs", "arguments": {"query": "router"}}})["result"]["content"][0]["text"]
    lsp = api.LspSession(engine)
    assert lsp.handle({"id": 1, "method": "shutdown"})["result"] is None and lsp.handle({"id": 2, "method": "initialize"})["error"]["code"] == -32600
    new = store.chunks().filter("source = 'official/list.md'").withColumn("content", F.lit("changed"))
    store.upsert(new)
    assert store.count() == 5 and store.chunks().filter("content = 'changed'").count() == 1
    store.delete(new.select("chunk_id"))
    assert store.count() == 4


def chunks_of(spark, texts):
    return spark.createDataFrame([(k, f"{k}.md", v, ["H", k], False, [1.0, 0.0]) for k, v in texts.items()], "chunk_id string, source string, content string, heading_path array<string>, deprecated boolean, embedding array<float>")


def test_store_versions(spark, tmp_path):
    """Each write adds a segment of its own size; statistics follow; a writer that dies half-way changes nothing."""
    store = index.Store(spark, str(tmp_path / "s"))
    with pytest.raises(NotFoundError):
        store.open_or_create("m", 0)
    assert store.open_or_create("m", 2)["embedder_dim"] == 2 and store.is_empty() and store.open_or_create("m", 0)["version"] == 1
    with pytest.raises(StorageError):
        store.open_or_create("other", 2)
    store.upsert(chunks_of(spark, {f"k{i}": f"text number {i} " * 40 for i in range(50)}))
    before = {p.name for p in (tmp_path / "s" / "segments").iterdir()}
    store.upsert(chunks_of(spark, {"k1": "changed text", "new": "another"}))
    store.delete(spark.createDataFrame([("k2",), ("nowhere",), ("k2",)], "chunk_id string"))
    (first, second) = sorted((p for p in (tmp_path / "s" / "segments").iterdir() if p.name not in before), key=lambda p: (p / "chunks").exists())
    assert spark.read.parquet(str(second / "chunks")).count() == 2 and not (first / "chunks").exists() and spark.read.parquet(str(second / "postings")).count() < 100
    want = {f"k{i}": f"text number {i} " * 40 for i in range(50)} | {"k1": "changed text", "new": "another"}
    del want["k2"]
    check = lambda s: ({r.chunk_id: r.content for r in s.chunks("m", 2).collect()}, s.count(), s.postings().filter("id = 'k1' AND field = 'content'").count(), s.postings().filter("id = 'k2'").count())
    assert check(store) == (want, 50, len(set(fulltext.gram_counts("changed text"))), 0)
    full = {f: sum(fulltext.gram_count(len(v if f == "content" else f"H / {k}")) for k, v in want.items()) for f in ("content", "heading_path")}
    assert {f: store.manifest()["lengths"][f] for f in full} == full
    (tmp_path / "s" / "manifests" / ".half").write_text("{")  # written, and not yet moved
    (tmp_path / "s" / "segments" / "orphan").mkdir()
    assert check(index.Store(spark, str(tmp_path / "s"), read_only=True)) == check(store)
    stale = store.manifest()
    store.upsert(chunks_of(spark, {"k3": "third"}))
    with pytest.raises(StorageError):
        store._commit(stale | {"version": stale["version"] + 1})  # another writer was faster
    want["k3"] = "third"
    store.compact()
    assert len(store.manifest()["segments"]) == 1 and "orphan" in store.vacuum() and check(store)[:2] == (want, 50)
    assert len(list((tmp_path / "s" / "segments").iterdir())) == 1 and {f: store.manifest()["lengths"][f] for f in full} == {f: sum(fulltext.gram_count(len(v if f == "content" else f"H / {k}")) for k, v in want.items()) for f in full}
    with pytest.raises(DimensionError):
        store.upsert(chunks_of(spark, {"w": "x"}).withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    store.MAX_SEGMENTS = 2
    for i in range(3):
        store.upsert(chunks_of(spark, {"k4": f"round {i}"}))
    assert len(store.manifest()["segments"]) <= 2 and store.chunks().filter("chunk_id = 'k4'").first().content == "round 2" and store.count() == 50


def test_upserts(spark):
    a = spark.createDataFrame([("x", "first"), ("y", "stays")], "chunk_id string, content string")
    b = spark.createDataFrame([("x", "second"), ("x", "second"), ("z", "new")], "chunk_id string, content string")
    once = index.upsert(a, b)
    assert sorted(map(tuple, once.collect())) == [("x", "second"), ("y", "stays"), ("z", "new")] == sorted(map(tuple, index.upsert(once, b).collect()))


def test_streaming_ingest_resumes(spark, folder, tmp_path):
    store, by_hash = index.Store(spark, str(tmp_path / "s")), lambda c: hash_embed(c, 8)
    run = lambda: ingest(spark, str(folder), store, str(tmp_path / "cp"), by_hash, hash_model_id(8), 8).awaitTermination()
    run()
    assert store.count() == 5
    version = store.manifest()["version"]
    run()
    assert store.manifest()["version"] == version
    (folder / "new.md").write_text("# New\nbody\n")
    run()
    assert store.count() == 6


def test_event_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:10:00", "b", 4.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n, r.total) for r in windowed_counts(e).collect()) == [("a", 3, 5.0), ("b", 1, 4.0)]
    assert first_seen(e).isStreaming is False


def test_enhancement(spark):
    q = spark.createDataFrame([("1", "Which Router 跳转 opens the map"), ("2", "old scenarios"), ("3", "mend the Error"), ("4", "good day"), ("5", "use Tide_2 in Chart.draw Chart.draw of v7 b, now")], "query_id string, query string")
    r = {x.query_id: x for x in rule_enhance(q).collect()}
    assert [r[k].intent for k in "12345"] == ["api_lookup", "migration", "error_fix", "generic", "generic"]
    assert r["5"].entities == ["Tide_2", "Chart.draw", "v7"] and r["4"].entities == []
    assert "good day" in r["4"].hyde_doc.split("\n")[0]
    assert q.select(classify_intent(F.lit(None).cast("string")), extract_entities(F.lit("A A b B"))).first()[1] == []


def test_evaluation(spark, tmp_path):
    """Four returned each: all, half, none, the last of three relevant; and a query without truth."""
    got = {"all": "prst", "half": "pxry", "none": "wxyz", "late": "xyzp"}
    ret = spark.createDataFrame([(q, k, c) for q, ids in got.items() for k, c in enumerate(ids, 1)], "query_id string, rank long, chunk_id string")
    truth = spark.createDataFrame([("all", ["p", "r", "s", "t"]), ("half", ["r", "p", "u", "v"]), ("none", ["a"]), ("late", ["p", "u", "p", "v"]), ("empty", []), ("null", None)], "query_id string, relevant array<string>")
    r = {x.query_id: x for x in evaluate.per_query(ret, truth, 4).collect()}
    assert {q: r[q].recall for q in r} == {"all": 1, "half": 0.5, "none": 0, "late": pytest.approx(1 / 3), "empty": 0, "null": 0}
    assert {q: r[q].mrr for q in r} == {"all": 1, "half": 1, "none": 0, "late": 0.25, "empty": 0, "null": 0} and r["late"].missed == ["u", "v"]
    assert evaluate.per_query(ret, truth, 1).filter("query_id = 'late'").first().hits == 0
    lat = spark.createDataFrame([("g", float(v)) for v in (5, 1, 4, 2)] + [("h", 7.0), ("n", None)], "g string, v double")
    assert sorted(map(tuple, evaluate.exact_percentiles(lat, "g", "v").collect())) == [("g", 4.0, 5.0, 4), ("h", 7.0, 7.0, 1)]
    with pytest.raises(ConfigError):
        evaluate.summarize(evaluate.per_query(ret, truth.limit(0), 3))
    p = tmp_path / "bad.yaml"
    p.write_text("a: [")
    with pytest.raises(ConfigError):
        querysets.load_queries(spark, str(p))


def test_percentiles_of_many_values(spark):
    """With ties over the middle, and values in range buckets."""
    r = random.Random(3)
    values = {"a": [r.gauss(0, 1) for _ in range(5000)], "b": [float(r.randrange(3)) for _ in range(4001)], "c": [1.0] * 10}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(6)
    for x in evaluate.exact_percentiles(df, "g", "v").collect():
        s = sorted(values[x.g])
        assert (x.p50, x.p99, x.n) == (s[min(len(s) // 2, len(s) - 1)], s[-(-99 * len(s) // 100) - 1], len(s))


def test_smoke_report(spark, tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("queries:\n- {id: a, query: one, expect: c1}\n- {id: b, query: two}\n")
    q = querysets.load_smoke(spark, str(p))
    hits = spark.createDataFrame([("a", 1, "x|y", 0.5, None, 0.25)], "query_id string, rank long, chunk_id string, score double, vector_score double, bm25_score double")
    text = evaluate.smoke_report(q, hits, "Smoke", "now")
    assert "| 1 | x\\|y | 0.5000 | — | 0.2500 |" in text and text.endswith("Queries: 2, with hits: 1.\n")


def test_framing():
    """Messages with a Content-Length header, one after another."""
    out = io.BytesIO()
    api.write_frame(out, {"id": 1, "text": "é"})
    api.write_frame(out, {"method": "exit"})
    lines = io.BytesIO(out.getvalue())
    assert api.read_frame(lines) == {"id": 1, "text": "é"} and api.read_frame(lines) == {"method": "exit"} and api.read_frame(lines) is None
    with pytest.raises(ConfigError):
        api.read_frame(io.BytesIO(b"Other: 1\r\n\r\n{}"))


def test_http_server_and_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("tidewell.session.session", lambda *_, **__: spark)
    root = str(tmp_path / "cli")
    assert api.main(["--index", root, "--dim", "8", "index", str(folder), "--checkpoint", str(tmp_path / "cp")]) == 0
    assert json.loads(capsys.readouterr().out) == {"chunks": 5}
    api.main(["--index", root, "--dim", "8", "query", "router page", "-k", "1", "--rerank", "--pre-rerank-k", "3"])
    assert "router.md" in capsys.readouterr().out
    api.main(["corpus", "list", str(folder)])
    assert "official 2" in capsys.readouterr().out
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        tar.add(folder / "official", "top/official")
    api.main(["corpus", "pull", "--from-file", str(tmp_path / "a.tar"), "--target", str(tmp_path / "out"), "--strip-components", "1"])
    assert capsys.readouterr().out == "2\n" and (tmp_path / "out" / "official" / "list.md").exists()
    with pytest.raises(ConfigError):
        corpus.unpack(str(tmp_path / "a.tar"), str(tmp_path / "out"))
    engine = api.Engine(spark, index.Store(spark, root, read_only=True), lambda c: hash_embed(c, 8), hash_model_id(8), 8)
    with api.http_server(engine, port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"
        assert json.load(urllib.request.urlopen(f"{base}/health"))["status"] == "ok"
        found = json.load(urllib.request.urlopen(f"{base}/search", json.dumps({"query": "lazy list", "k": 1}).encode()))
        assert found["hits"][0]["source"] == "official/list.md"
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{base}/search", b"{")
        server.shutdown()


class FakeTokens:
    """A tokenizer of one token for each word."""

    def encode_batch(self, texts):
        words = [(t if isinstance(t, str) else " ".join(t)).split() for t in texts]
        width = max(map(len, words), default=0)
        make = lambda w: type("E", (), {"ids": [len(x) for x in w] + [0] * (width - len(w)), "attention_mask": [1] * len(w) + [0] * (width - len(w)), "type_ids": [0] * width})()
        return [make(w) for w in words]


class FakeSession:
    def __init__(self, run):
        self.answer = run

    def get_inputs(self):
        return [type("I", (), {"name": n})() for n in ("input_ids", "attention_mask")]

    def run(self, _, feed):
        return [self.answer(feed)]


def test_pooling_of_a_model():
    """Means over the mask, of unit length; texts without tokens give zeros."""
    hidden = lambda feed: np.stack([feed["input_ids"], feed["input_ids"] ** 2], axis=2).astype(float)
    got = embed.pooled(FakeSession(hidden), FakeTokens(), ["ab abcd", "abc", ""])
    want = [np.array([3.0, 10.0]), np.array([3.0, 9.0]), np.zeros(2)]
    assert np.allclose(got, [w / max(1e-9, np.linalg.norm(w)) for w in want])


@pytest.mark.parametrize("shape", [lambda x: x, lambda x: x[:, None], lambda x: np.stack([-x, x], axis=1)])
def test_logits_of_a_reranker(shape):
    """Scores of shape [n], [n, 1], or the second column of wider ones."""
    total = lambda feed: shape(feed["input_ids"].sum(axis=1).astype(float))
    assert embed.logits(FakeSession(total), FakeTokens(), [("ab", "abc"), ("a", "b")]) == [5.0, 2.0]
