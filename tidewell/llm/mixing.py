"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source gets the same expected number of copies, target / source size. Its whole part is certain; the
fractional parts are rounded by the pivotal method: two units trade words (copy probability times size) in a random
direction until one of them is integral, which keeps every expectation and the sum of words. Units meet in small
groups of hashed documents, each group hands one residual unit up, and residuals of `FAN` groups meet again, so the reduction
tree has log_FAN(n) levels and no task ever holds more than about FAN units of a source, however large it is. The
taken words of a source miss its target by one document's size at most.

Sources are ranked and filled up by running sums over range partitions, so there may be as many as there are hosts. Ids may be of any type that a hash takes. Null texts and texts without words have size zero and are never taken, very long ones are single units; a null source is a source of its own and
comes last. Other columns are not read. An empty table gives no rows. Repeated rows are mixed one by one. Randomness is a hash of the rows, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, join_hot, let, shared_checkpoint, table

FAN = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, h (a hash of the row) and c (which of equal rows it is), in the shared checkpoint."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(f"`{doc_id}`"), body).alias("h"))
    equal = rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    return shared_checkpoint(equal.withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n"))


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, n, source_size and target: shares by weight, held at cap times the source's size, the excess shared again."""
    s = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = _running(s, {"rank": F.lit(1)}, F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank").cast("long") % len(weights) + 1).cast("int")).cast("double")).withColumn("most", cap * F.col("source_size"))
    # by the level at which each is full: what the fuller ones before it take leaves a level for the rest
    s = shared_checkpoint(_running(s, {"most_before": F.col("most"), "weight_before": F.col("weight"), "place": F.lit(1)}, F.col("most") / F.col("weight"), "rank"))
    total = s.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    s = s.crossJoin(F.broadcast(total))  # one row
    level = (share * F.col("all_size") - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before"))
    s = s.withColumn("level", level)
    first = s.filter(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min(F.struct("place", "level"))["level"].alias("found"))
    s = s.crossJoin(F.broadcast(first))  # one row
    return s.select("source", "n", "source_size", F.when(F.col("found").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("found") * F.col("weight"))).alias("target"))


def _running(df: DataFrame, sums: dict[str, Column], *order: Column | str) -> DataFrame:
    """df with running sums over all rows before each, in a global order: sums within range partitions, and of the partitions before. No task has all rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("*", *(v.cast("double").alias(f"_{k}") for k, v in sums.items()))
    rows = shared_checkpoint(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(*(F.sum(f"_{k}").alias(f"_{k}_of_part") for k in sums))  # a row for each partition
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    nil = F.lit(0.0)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{k}_of_part").over(ahead), nil).alias(f"_{k}_ahead") for k in sums))
    out = rows.join(parts, "_part").select(*df.columns, *((F.coalesce(F.sum(f"_{k}").over(inner), nil) + F.col(f"_{k}_ahead")).alias(k) for k in sums))
    return out


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")) / float(1 << 53)


def _unit(x: Column, p: Column) -> Column:
    return F.struct(x["h"].alias("h"), x["c"].alias("c"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["base"].alias("base"), p.cast("double").alias("p"))


def _trade(a: Column, b: Column, seed: int) -> Column:
    """(left, stays): of two units, the one that became integral and the other, with their new probabilities."""
    ma, mb, ra, rb = a["p"] * a["size"], b["p"] * b["size"], (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
    gain, loss = F.least(ra, mb), F.least(ma, rb)
    up = _uniform(F.lit(seed), a["h"], a["c"], b["h"], b["c"]) * (gain + loss) < loss
    clip = lambda p: F.when(p < 1e-12, F.lit(0.0)).when(p > 1 - 1e-12, F.lit(1.0)).otherwise(p)
    one, nought = F.lit(1.0), F.lit(0.0)
    pair = lambda left, stays: F.struct(left.alias("left"), stays.alias("stays"))
    return (
        F.when(up & (ra <= mb), pair(_unit(a, one), _unit(b, clip(b["p"] - gain / b["size"]))))
        .when(up, pair(_unit(b, nought), _unit(a, clip(a["p"] + gain / a["size"]))))
        .when(ma <= rb, pair(_unit(a, nought), _unit(b, clip(b["p"] + loss / b["size"]))))
        .otherwise(pair(_unit(b, one), _unit(a, clip(a["p"] - loss / a["size"]))))
    )


def _round_group(units: Column, seed: int, id_type: str) -> Column:
    """The units of a group, all but the last integral."""
    unit_type = f"struct<h:bigint,c:bigint,doc_id:{id_type},size:bigint,base:bigint,p:double>"
    start = F.struct(F.get(units, F.lit(0)).alias("stays"), F.array().cast(f"array<{unit_type}>").alias("out"))
    merge = lambda acc, x: let(_trade(acc["stays"], x, seed), lambda t: F.struct(t["stays"].alias("stays"), F.array_append(acc["out"], t["left"]).alias("out")))
    return F.aggregate(F.slice(units, 2, F.size(units)), start, merge, lambda acc: F.array_append(acc["out"], acc["stays"]))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, one row for each row of docs."""
    keys = ("source", "source_size", "target")
    rows = sized(docs, doc_id, source, text)
    goal = shared_checkpoint(targets(rows, weights, share, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    units = join_hot(rows.withColumn("key", key), goal.withColumn("key_", key).drop("source"), "key", "key_").drop("key", "key_")
    units = units.withColumn("base", F.floor(rate + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), rate - F.col("base"))).withColumn("p", F.when(F.col("p") < 1e-12, F.lit(0.0)).otherwise(F.col("p")))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    groups = F.ceil(F.col("n") / F.lit(FAN))
    fields = ("h", "c", "doc_id", "size", "base", "p")
    id_type = dict(rows.dtypes)["doc_id"]
    done = [units.filter(~open_).select(*keys, *fields)]
    current = units.filter(open_).select(*keys, *fields, F.pmod(F.xxhash64(F.lit(seed), "h", "c"), groups).alias("b"))
    most = goal.agg(F.max("n")).first()[0] or 0
    level = 0
    while True:
        most = -(-most // FAN)
        level += 1
        out = current.groupBy(*keys, "b").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("units"))
        out = out.withColumn("units", _round_group(F.col("units"), seed + level, id_type))
        out = out.withColumn("n", F.size("units")).select(*keys, "b", "n", F.posexplode("units").alias("i", "u"))
        out = out.select(*keys, *(F.col(f"u.{f}").alias(f) for f in fields), "b", (F.col("i") + 1 < F.col("n")).alias("decided"))
        if most <= 1:
            done.append(out.select(*keys, *(F.col(f) for f in fields[:-1]), F.when(F.col("decided"), F.col("p")).otherwise((_uniform(F.lit(seed), "h", "c") < F.col("p")).cast("double")).alias("p")))
            break
        out = shared_checkpoint(out)
        done.append(out.filter("decided").select(*keys, *fields))
        current = out.filter("NOT decided").select(*keys, *fields, F.floor(F.col("b") / FAN).alias("b"))
    copies = (F.col("base") + F.col("p")).cast("long")
    return reduce(DataFrame.unionByName, done).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_mixing that no draw decides, and whether the draw keeps its bounds."""
    mixed = shared_checkpoint(mix(table(spark, sf_dir, "documents")))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sums = mixed.groupBy(key.alias("key_")).agg((F.abs(F.sum("taken") - F.max("target")) <= F.max("size") + 1e-6).alias("near"))
    rows = join_hot(mixed.withColumn("key", key), shared_checkpoint(sums), "key", "key_")
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("taken").between(0, 2 * F.col("size")) & F.col("near")).alias("in_bounds"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


MIXING_TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
f(round, source, source_size, weight, target) AS (
  SELECT 0, source, source_size, weight, NULL::DOUBLE FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, CASE WHEN target IS NULL AND share > 2 * source_size THEN 2.0 * source_size ELSE target END
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(target) OVER (), 0)) * weight / sum(weight) FILTER (target IS NULL) OVER () AS share FROM f)
  WHERE round < (SELECT count(*) FROM s) + 1
),
l AS (SELECT * FROM f WHERE round = (SELECT max(round) FROM f)),
t AS (SELECT source, source_size, coalesce(target, (1.5 * sum(source_size) OVER () - coalesce(sum(target) OVER (), 0)) * weight / sum(weight) FILTER (target IS NULL) OVER ()) AS target FROM l)
SELECT d.doc_id, d.size, t.source_size, round(t.target, 6) AS target, TRUE AS in_bounds FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
