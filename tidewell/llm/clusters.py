"""Centroid clustering by filtering ball trees: whole balls go to one centroid where the triangle inequality says so, leaves are compared exactly.

Each task builds a tree over each block of its vectors, once; blocks and trees wait in the shared checkpoint. A node stores its radius, its count and the exact integer sum of
its vectors. In a round a node keeps the centroids that can be nearest to some vector of its ball: with centre distance d and radius r those with d - r not above the least d + r. If one is
left, the node's count and sum go to it as they are; else its children ask, and a leaf computes exact integer distances to the centroids left. A task hands on one count and
one sum by centroid and dimension, so what is shuffled does not grow with the vectors, and nothing is dealt by vector or cluster: a vector that a third of
all rows share spreads like others (where only one vector is in a ball, the ball is a leaf). The driver holds the k centroids.

Components become integers floor(scale * component). Rows whose vector is null, of another width, or holds a null or non-finite component are dropped; repeated ids and
rows count one by one. The first centroids are the k vectors with the least hashes (ties: the lesser vector; null ids last), fewer if there are fewer. Other columns are not read, whatever
their names. An empty table gives no rows. A component of MOST / scale or more is an error; so distances fit a long for up to 2^17 dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table
from .whitening import as_matrix, integers, is_whole

#: Vectors of a block, and of a leaf.
BLOCK, LEAF = 8192, 48
#: Bound of a component as integer.
MOST = 1 << 22


# ---- trees -----------------------------------------------------------------------------------------------------------


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of x's rows in the tree, and its nodes, parents first: lo and hi in that order, left and right child (-1: leaf), sums and radius."""
    order = np.arange(len(x))
    lo, hi, left, right, sums, radius = [0], [len(x)], [-1], [-1], [], []
    at = 0
    while at < len(lo):
        a, b = lo[at], hi[at]
        own = x[order[a:b]]
        total = own.sum(0)
        sums.append(total)
        off = own - total / (b - a)
        radius.append(float(np.sqrt((off * off).sum(1).max())) * (1 + 1e-9))
        if b - a > leaf and (own != own[0]).any():
            widest = int((own.max(0) - own.min(0)).argmax())
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, widest], middle, kind="introselect")]
            left[at], right[at] = len(lo), len(lo) + 1
            lo += [a, a + middle]
            hi += [a + middle, b]
            left += [-1, -1]
            right += [-1, -1]
        at += 1
    ints = {k: np.array(v, dtype=np.int64) for k, v in (("lo", lo), ("hi", hi), ("left", left), ("right", right))}
    return order, ints | {"sums": np.array(sums, dtype=np.int64), "radius": np.array(radius)}


_BLOCK = ("x", "lo", "hi", "left", "right", "sums", "radius")


def _blocks(width: int, size: int, leaf: int):
    """Rows of (ids, x and the tree as bytes), one for each `size` vectors of a task."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        x = as_matrix(rows.column("x").combine_chunks(), width)
        order, tree = build(x, leaf)
        packed = {"x": x[order].astype("<i4"), **tree}
        ids = rows.column("id").combine_chunks().take(pa.array(order))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([np.ascontiguousarray(packed[k]).tobytes()], pa.binary()) for k in _BLOCK)], names=["ids", *_BLOCK])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in stream:
            for at in range(0, batch.num_rows, size):
                waiting.append(batch.slice(at, size))
                n += waiting[-1].num_rows
                while n >= size:
                    rows = pa.Table.from_batches(waiting)
                    yield block(rows.slice(0, size))
                    rest = rows.slice(size)
                    waiting, n = rest.to_batches(), rest.num_rows
        if n:
            yield block(pa.Table.from_batches(waiting))

    return run


def _tree(batch: pa.RecordBatch, row: int, width: int) -> dict[str, np.ndarray]:
    kinds = {"x": "<i4", "radius": "<f8"}
    t = {k: np.frombuffer(batch.column(k)[row].as_buffer(), dtype=kinds.get(k, "<i8")) for k in _BLOCK}
    return t | {k: t[k].reshape(-1, width) for k in ("x", "sums")}


# ---- rounds ----------------------------------------------------------------------------------------------------------


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances as longs. Products are of doubles where those are exact too, which is the faster way."""
    far = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * far * far < 1 << 53 else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def filtered(tree: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple[int, int | np.ndarray, np.ndarray | None]]:
    """(node, cluster, distances) of nodes that share the tree's vectors among them: one cluster for a whole ball (no distances), or clusters and distances of a leaf's vectors."""
    counts = tree["hi"] - tree["lo"]
    places = centroids.astype(np.float64)
    front, open_ = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
    while len(front):
        centre = tree["sums"][front] / counts[front, None]
        # differences, not products: a radius of zero must not drown in rounding
        d = np.empty(open_.shape)
        for k, c in enumerate(places):
            off = centre - c
            d[:, k] = np.sqrt((off * off).sum(1))
        r, slack = tree["radius"][front, None], 1e-9 * (1.0 + d)
        nearest = np.where(open_, d + r + slack, np.inf).min(1, keepdims=True)
        open_ &= d - r - slack <= nearest
        alone, leaf = open_.sum(1) == 1, tree["left"][front] < 0
        for at in np.flatnonzero(alone):
            yield int(front[at]), int(open_[at].argmax()), None
        for at in np.flatnonzero(leaf & ~alone):
            near = np.flatnonzero(open_[at])
            found = distances(tree["x"][tree["lo"][front[at]] : tree["hi"][front[at]]], centroids[near])
            best = found.argmin(1)  # the first of equals, and near is ascending
            yield int(front[at]), near[best], found[np.arange(len(best)), best]
        deeper = ~alone & ~leaf
        front, open_ = np.concatenate([tree["left"][front[deeper]], tree["right"][front[deeper]]]), np.concatenate([open_[deeper]] * 2)


def _rounder(centroids: np.ndarray, width: int):
    """(cluster, i, s) of a task: sums by dimension, and at i = -1 the count."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), width + 1), dtype=np.int64)
        for batch in stream:
            for row in range(batch.num_rows):
                t = _tree(batch, row, width)
                single = np.full(len(t["x"]), -1)
                for node, cluster, far in filtered(t, centroids):
                    if far is None:
                        total[cluster, 0] += t["hi"][node] - t["lo"][node]
                        total[cluster, 1:] += t["sums"][node]
                    else:
                        single[t["lo"][node] : t["hi"][node]] = cluster
                order = np.argsort(single, kind="stable")[(single < 0).sum() :]
                if len(order):
                    starts = np.flatnonzero(np.r_[True, np.diff(single[order]) > 0])
                    at = single[order][starts]
                    total[at, 0] += np.diff(np.r_[starts, len(order)])
                    total[at, 1:] += np.add.reduceat(t["x"][order].astype(np.int64), starts, axis=0)
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i - 1, pa.int32()), pa.array(total[k, i], pa.int64())], names=["cluster", "i", "s"])

    return run


def _assigner(centroids: np.ndarray, width: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                t = _tree(batch, row, width)
                cluster, distance = np.empty(len(t["x"]), dtype=np.int32), np.empty(len(t["x"]), dtype=np.int64)
                for node, k, far in filtered(t, centroids):
                    lo, hi = t["lo"][node], t["hi"][node]
                    cluster[lo:hi] = k
                    distance[lo:hi] = distances(t["x"][lo:hi], centroids[k : k + 1])[:, 0] if far is None else far
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def cluster(df: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 256, salt: str = "2:", first: Column | None = None, block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """id, cluster and distance for each whole vector of this width, and the final centroids. first: vectors with its least values are the first centroids. block, leaf: vectors of a tree and of its leaves."""
    i, v = F.col(f"`{id_col}`"), F.col(f"`{vector}`")
    kind = df.select(i.alias("id")).schema["id"].dataType.simpleString()
    rows = df.filter(is_whole(v) & (F.size(v) == width)).select(i.alias("id"), integers(v, scale, MOST).alias("x"), (F.sha2(F.concat(F.lit(salt), i.cast("string")), 256) if first is None else first).alias("h"))
    blocks = shared_checkpoint(rows.select("id", "x").mapInArrow(_blocks(width, block, leaf), f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in _BLOCK)))
    seeds = rows.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).select("x").collect()  # k vectors, by the least of each task
    centroids = np.array([s["x"] for s in seeds], dtype=np.int64).reshape(-1, width)
    schema = f"id {kind}, cluster int, distance long"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col), centroids
    for _ in range(rounds):
        sums: dict[int, dict[int, int]] = {}
        for t in blocks.mapInArrow(_rounder(centroids, width), "cluster int, i int, s long").groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k centroids
            sums.setdefault(t["cluster"], {})[t["i"]] = int(t["s"])
        for c, own in sums.items():
            centroids[c] = [own.get(j, 0) // own[-1] for j in range(width)]
    return blocks.mapInArrow(_assigner(centroids, width), schema).withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia (sums of distances over the cluster and over all) and centroid_sha256. A row for each of k centroids is made and broadcast, whatever the clusters' sizes."""
    spark = assigned.sparkSession
    found = {t["cluster"]: int(t["s"]) for t in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(found.values())
    fits = lambda s: s if s < 1 << 63 else None
    known = [(c, fits(s), fits(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in found.items()]
    by_cluster = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(by_cluster), "cluster")


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"), 40, 5)
    assigned = shared_checkpoint(assigned)
    return with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int) -> str:
    """Rounds as common table expressions; a row for each vector and dimension."""
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        "e AS MATERIALIZED (SELECT r, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v)",
        f"s AS MATERIALIZED (SELECT x, (row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1)::INT AS k FROM v QUALIFY k < {k})",
        "c0 AS MATERIALIZED (SELECT k, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM s)",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, k, sum((c - m) * (c - m))::BIGINT AS d FROM e JOIN c{n} USING (i) GROUP BY r, k)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            parts.append(f"t{n} AS (SELECT k, i, sum(c)::BIGINT AS t, count(*) AS n FROM e JOIN a{n} USING (r) GROUP BY k, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce((t - ((t % n) + n) % n) // n, m) AS m FROM c{n} LEFT JOIN t{n} USING (k, i))")
    parts.append(f"h AS (SELECT k, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (k) JOIN v USING (r)"""


OP12_SQL = _sql(40, 5)
