"""Folders and archives read by ranges, heading stacks over pieces of a file, metadata as VARIANT."""

import io
import os
import random
import tarfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import metadata
from tidewell.sources import archive, headings, markdown


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "corpus"
    (root / "official" / "deep").mkdir(parents=True)
    (root / ".git" / "objects").mkdir(parents=True)
    (root / "_index").mkdir()
    (root / ".git" / "objects" / "secret.md").write_text("never")
    (root / "_index" / "i.md").write_text("never")
    (root / ".hidden.md").write_text("never")
    (root / "official" / "a.md").write_text("# A\nx")
    (root / "official" / "deep" / "b.ets").write_bytes(b"\xff\x00b")
    (root / "empty.md").write_text("")
    with tarfile.open(root / "pack.tar", "w") as tar, tarfile.open(root / "small.tar.gz", "w:gz") as packed:
        for name, data in [("top/one.md", b"1" * 5000), ("top/.x/two.md", b"no"), ("top/three.md", b"3" * 3000), ("../out.md", b"no"), ("top/é.md", b"5")]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
            packed.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("top/link.md")
        link.type, link.linkname = tarfile.SYMTYPE, "one.md"
        tar.addfile(link)
    return root


WANT = {"official/a.md": b"# A\nx", "official/deep/b.ets": b"\xff\x00b", "empty.md": b"", **{f"{a}/top/{n}": d for a in ("pack.tar", "small.tar.gz") for n, d in (("one.md", b"1" * 5000), ("three.md", b"3" * 3000), ("é.md", b"5"))}}


@pytest.mark.parametrize("room", [1, 4000, 1 << 25])
def test_corpus_source(spark, folder, room):
    df = archive.read_corpus(spark, str(folder), room)
    rows = df.collect()
    assert {r.source: bytes(r.content) for r in rows} == WANT and len(rows) == len(WANT) and all(r.length == len(r.content) for r in rows)
    assert {r.lang for r in rows if r.source.endswith(".ets")} == {"arkts"}
    pieces = archive._Reader(str(folder), room).partitions()
    of_pack = [p for p in pieces if any("pack.tar" in x[1] for x in p.parts)]
    assert len(of_pack) == (1 if room > 10_000 else 2 if room == 4000 else 3)  # several tasks read one archive


def test_hidden_folders_are_never_entered(folder, monkeypatch):
    """Also if they cannot be read: what the planner asks the file system for is recorded."""
    from pyarrow import fs

    asked = []
    plain = fs.FileSelector
    monkeypatch.setattr(fs, "FileSelector", lambda p, *a, **k: asked.append(str(p)) or plain(p, *a, **k))
    os.chmod(folder / ".git", 0)
    try:
        parts = [x for p in archive._Reader(str(folder), 100).partitions() for x in p.parts]
    finally:
        os.chmod(folder / ".git", 0o755)
    assert {x[1] for x in parts if "small" not in x[1]} == {k for k in WANT if "small" not in k} and asked and not any(".git" in a or "_index" in a for a in asked)


def test_an_archive_is_a_root(spark, folder, tmp_path):
    got = archive.read_corpus(spark, str(folder / "pack.tar"), 10)
    assert {r.source for r in got.collect()} == {"pack.tar/top/one.md", "pack.tar/top/three.md", "pack.tar/top/é.md"}
    (tmp_path / "none").mkdir()
    assert archive.read_corpus(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        archive.read_corpus(spark, str(tmp_path / "nowhere")).count()


# ---- headings --------------------------------------------------------------------------------------------------------

LINES = st.lists(st.sampled_from(["# a", "## b", "### c", "#### d", "###### e", "text", "", "```", "#no", "  ## x ", "##"]), max_size=30)


def effect(lines, fence_aware, fences=0):
    e = headings.Effect(fences=fences)
    for x in lines:
        headings.read_line(x, e, fence_aware)
    e.fences -= fences
    return e


@given(LINES, LINES, LINES, st.booleans())
def test_effects_are_a_monoid(a, b, c, fence_aware):
    whole = effect(a + b + c, fence_aware)
    ea = effect(a, fence_aware)
    eb = effect(b, fence_aware, ea.fences % 2)
    ec = effect(c, fence_aware, (ea.fences + eb.fences) % 2)
    assert ea.then(eb).then(ec) == whole == ea.then(eb.then(ec)) and headings.Effect().then(whole) == whole == whole.then(headings.Effect())


@pytest.mark.parametrize("fence_aware", [False, True])
def test_wide_sections_are_sections(spark, fence_aware):
    r = random.Random(3)
    line = lambda: r.choice(["# a", "## b c", "### d", "text", "text", "", "```", "more text", "####### no"])
    files = [(f"f{i}", "\n".join(line() for _ in range(r.choice((0, 1, 5, 40, 700))))) for i in range(25)] + [("none", "no heading"), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(files, "file string, body string")
    shape = lambda d: sorted(map(tuple, d.select("file", F.col("section").cast("long"), "heading_path", F.col("parent_section").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), "content").collect()), key=repr)
    want = shape(markdown.sections(df, "file", "body", fence_aware))
    assert shape(headings.wide_sections(df, "file", "body", fence_aware)) == want and len(want) > 100


def test_one_file_uses_many_tasks(spark):
    body = "# Top\n" + "\n".join(f"## S{i}\ntext {i}\n### D\ndeep" for i in range(4000))
    out = headings.wide_sections(spark.createDataFrame([("f", body)], "file string, body string"), "file", "body")
    assert out.count() == 8000 and {tuple(r.heading_path) for r in out.filter("content = 'text 3999'").collect()} == {("Top", "S3999")}
    lines = spark.createDataFrame([("f", body)], "key string, body string").select("key", F.posexplode(F.split("body", "\n")).alias("pos", "line")).repartitionByRange(4, "key", "pos")
    assert max(r[0] for r in lines.groupBy(F.spark_partition_id()).count().select("count").collect()) < 0.5 * lines.count()


# ---- metadata --------------------------------------------------------------------------------------------------------


def test_nested_front_matter(spark):
    text = "---\nowner:\n  team: ui\n  ids: [1, 2.5, null, {deep: [true]}]\nwhen: 2024-01-02\n---\n# T\nx"
    df = markdown.front_matter(spark.createDataFrame([("a.md", text), ("b.md", "# no front"), ("c.md", None)], "source string, text string"))
    at = lambda p, k="string": metadata.read_path(F.col("front"), p, k)
    rows = {r[0]: tuple(r)[1:] for r in df.select("source", at("$.owner.team"), at("$.owner.ids[1]", "double"), at("$.owner.ids[3].deep[0]", "boolean"), at("$.owner.ids[2]", "int"), at("$.no"), at("$.when")).collect()}
    assert rows == {"a.md": ("ui", 2.5, True, None, None, "2024-01-02"), "b.md": (None,) * 6, "c.md": (None,) * 6}
    again = df.select("source", metadata.from_json(metadata.to_json(F.col("front"))).alias("front"))
    assert [r.j for r in again.select(metadata.to_json(F.col("front")).alias("j")).collect()] == [r.j for r in df.select(metadata.to_json(F.col("front")).alias("j")).collect()]
    assert spark.createDataFrame([("{bad",)], "t string").select(metadata.from_json(F.col("t")).isNull().alias("n")).first().n


def test_metadata_of_chunks(spark, tmp_path):
    c = markdown.chunk_markdown(spark.createDataFrame([("a.md", "markdown", "---\ntags: [x, y]\napi_name: go\n---\n# T\nx")], "source string, lang string, text string"))
    m = c.select("chunk_id", metadata.metadata(c.columns).alias("m"))
    m.write.parquet(str(tmp_path / "m"))
    row = spark.read.parquet(str(tmp_path / "m")).select(metadata.read_path(F.col("m"), "$.tags[1]"), metadata.read_path(F.col("m"), "$.line_range.start", "int"), metadata.read_path(F.col("m"), "$.extra.api_name")).first()
    assert tuple(row) == ("y", 6, "go")
