"""Markdown files to chunks by heading, in window expressions.

A heading line opens a section; a section's chunk is its lines without the heading, as they stand, unless all are blank. Text before the first
heading is dropped. The heading stack at a line is, for each level, the last heading of that level that no lower-numbered level has
followed. A chunk's parent is the section one up the stack, if that section had text of its own. By default a "#" line inside a
code fence counts as a heading; `fence_aware` leaves fences alone.
"""

from __future__ import annotations

import json

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParseError, UnsupportedLanguageError
from ..functions.metadata import from_json

LEVELS = range(1, 7)
HEADING = r"^\s*(#{1,6})(?: (.*))?$"

_FRONT = T.StructType(
    [
        T.StructField("platforms", T.ArrayType(T.StringType())),
        T.StructField("api_version", T.StringType()),
        T.StructField("deprecated", T.BooleanType()),
        T.StructField("type", T.StringType()),
        T.StructField("source_framework", T.StringType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("api_name", T.StringType()),
        T.StructField("json", T.StringType()),
    ]
)
_SPLIT = T.StructType([T.StructField("front", _FRONT), T.StructField("body", T.StringType()), T.StructField("offset", T.IntegerType())])


def split_frontmatter(text: str) -> tuple[dict | None, str, int]:
    """(fields, body, lines before the body). A first line of dashes without a closing one is body; bad YAML is an error."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return None, text, 0
    for end in range(1, len(lines)):
        if lines[end].strip() == "---":
            try:
                fields = yaml.safe_load("\n".join(lines[1:end])) or {}
            except yaml.YAMLError as e:
                raise ParseError(f"bad front matter: {e}") from e
            if not isinstance(fields, dict):
                raise ParseError("front matter is not a mapping")
            return fields, "\n".join(lines[end + 1 :]), end + 1
    return None, text, 0


def _strings(x: object) -> list[str]:
    return [] if x is None else [str(v) for v in x] if isinstance(x, list) else [str(x)]


def _string(x: object) -> str | None:
    return None if x is None else str(x)


@F.pandas_udf(_SPLIT)
def _split(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        f, body, offset = split_frontmatter(t or "")
        front = None if f is None else {
            "platforms": _strings(f.get("platforms")), "api_version": _string(f.get("api_version")), "deprecated": bool(f.get("deprecated", False)),
            "type": _string(f.get("type")), "source_framework": _string(f.get("source_framework")), "complexity": _string(f.get("complexity")),
            "tags": _strings(f.get("tags")), "api_name": _string(f.get("api_name")), "json": json.dumps(f, default=str, ensure_ascii=False),
        }
        rows.append((front, body, offset))
    return pd.DataFrame(rows, columns=["front", "body", "offset"])


def front_matter(files: DataFrame) -> DataFrame:
    """source and front, the front matter of Markdown files (source, text) as VARIANT, nested values and all; null without any."""
    return files.select("source", from_json(_split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")))["front"]["json"]).alias("front"))


def platform_name(raw: Column) -> Column:
    """The platform that a synonym stands for, or null."""
    low = F.lower(raw)
    return F.when(low.isin("harmonyos", "harmony", "openharmony"), "harmonyos").when(low.isin("android", "ios"), low)


def chunk_type(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin("api_doc", "code_example", "migration_rule", "error_fix"), low).otherwise("generic")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else null."""
    return F.when(line.rlike(HEADING), F.length(F.regexp_extract(line, HEADING, 1)))


def sections(docs: DataFrame, key: str, body: str, fence_aware: bool = False) -> DataFrame:
    """key, section, heading_path, parent_section, start, end and content of each chunk; lines count from 1 in the body."""
    lines = docs.select(F.col(key), F.posexplode(F.split(F.col(body), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = heading_level(F.col("line"))
    if fence_aware:
        fence = F.col("line").rlike(r"^\s*(```|~~~)").cast("int")
        lines = lines.withColumn("_open", F.sum(fence).over(w) % 2)
        level = F.when((F.col("_open") == 0) & (fence == 0), level)
    lines = lines.withColumn("level", level).withColumn("section", F.count("level").over(w))
    heads = lines.filter(F.col("level").isNotNull()).select(key, "section", "level", "pos", F.trim(F.regexp_extract("line", HEADING, 2)).alias("title"))
    # headings are few: the stack is kept for them, not for lines
    hw = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("level") == n, F.struct("section", "title"))).over(hw).alias(f"l{n}") for n in LEVELS]
    stack = heads.select(key, "section", "level", "pos", *last)
    slots = []
    for n in LEVELS:
        below = [F.coalesce(F.col(f"l{j}.section"), F.lit(0)) for j in LEVELS if j < n]
        live = F.col(f"l{n}").isNotNull() & (F.lit(n) <= F.col("level"))
        for b in below:
            live = live & (F.col(f"l{n}.section") > b)
        slots.append(F.when(live, F.col(f"l{n}")))
    stack = stack.withColumn("stack", F.filter(F.array(*slots), lambda s: s.isNotNull()))
    stack = stack.select(key, "section", "pos", F.transform("stack", lambda s: s["title"]).alias("heading_path"), F.when(F.size("stack") > 1, F.element_at("stack", -2)["section"]).alias("up"))
    text = lines.filter((F.col("section") > 0) & F.col("level").isNull()).groupBy(key, "section").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    text = text.select(key, "section", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"), F.size("ls").alias("n")).filter(F.length(F.trim(F.regexp_replace("content", r"\s", ""))) > 0)
    chunks = stack.join(text, [key, "section"]).select(key, "section", "heading_path", "up", (F.col("pos") + 2).alias("start"), (F.col("pos") + 1 + F.col("n")).alias("end"), "content")
    has = chunks.select(key, F.col("section").alias("up"), F.col("section").alias("parent_section"))
    return chunks.join(has, [key, "up"], "left").select(key, "section", "heading_path", "parent_section", "start", "end", "content")


def chunk_markdown(files: DataFrame, fence_aware: bool = False) -> DataFrame:
    """CHUNK rows of Markdown files (source, lang, text). Any other language is an error."""
    rows = files.withColumn("text", F.when(F.col("lang") == "markdown", F.col("text")).otherwise(F.raise_error(F.concat(F.lit(f"{UnsupportedLanguageError.__name__}: not markdown: "), F.col("source")))))
    split = rows.select("source", "lang", _split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))).alias("s")).select("source", "lang", "s.front", "s.body", "s.offset")
    found = sections(split, "source", "body", fence_aware)
    meta = split.drop("body")
    c = found.join(meta, "source").withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.col("end") + F.col("offset"))
    ident = lambda path, start: F.concat(F.col("source"), F.lit("#"), F.array_join(path, "/"), F.lit("@"), start.cast("string"))
    c = c.withColumn("chunk_id", ident(F.col("heading_path"), F.col("start")))
    parent = c.select("source", F.col("section").alias("parent_section"), F.col("chunk_id").alias("parent_id"))
    c = c.join(parent, ["source", "parent_section"], "left")
    front = F.col("front")
    named = F.filter(F.transform(F.coalesce(front["platforms"], F.array().cast("array<string>")), platform_name), lambda p: p.isNotNull())
    return c.select(
        "chunk_id", "source", "lang", "content", "heading_path", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("line_range"),
        named.alias("platforms"), front["api_version"].alias("api_version"), F.coalesce(front["deprecated"], F.lit(False)).alias("deprecated"), chunk_type(front["type"]).alias("type"),
        front["source_framework"].alias("source_framework"), front["complexity"].alias("complexity"), F.coalesce(front["tags"], F.array().cast("array<string>")).alias("tags"), "parent_id",
        F.when(front["api_name"].isNotNull(), F.create_map(F.lit("api_name"), front["api_name"])).otherwise(F.create_map().cast("map<string,string>")).alias("extra"),
    )
