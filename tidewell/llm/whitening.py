"""Embedding whitening: blockwise TSQR compresses the centred rows to R, one-sided Jacobi rotations give components and standard deviations.

The fit list has each distinct vector once, so a vector that a third of all rows share weighs and moves as one (the distinct combines before it shuffles).
Each task folds its rows, batch by batch, into one triangular R of the vectors' width; R's of `FAN` tasks are stacked and reduced again, up a tree, until one is
left. Its columns have the lengths and angles of the columns of all centred rows, so no covariance is formed and small deviations keep their digits. Plane
rotations, a sweep of disjoint pairs at a time, make R's columns orthogonal; the product of the rotations has the components, the columns' lengths the deviations. The
driver holds one R and sums for each dimension, which are bounded by the width of the vectors.

Entries become integers floor(scale * entry), so sums and deviations are exact. Rows whose vector is null or empty, or holds a null or non-finite entry, are dropped; null and
repeated ids and repeated rows stay, each with its own result. Vectors have the width that most of the fit list has (the greater of equals); others are dropped. An entry beyond
MOST is an error. Other columns are not read, whatever their names. A component without spread (fewer distinct vectors than dimensions) has a null whitened value and is explained as 0 (null if nothing
spreads); the identity error is that of the components with spread, null if there are none. A deviation beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table

#: R's that one task of the tree stacks.
FAN = 32
#: Bound of an integer entry.
MOST = 1 << 40
_SWEEPS = 60


# ---- integer vectors -------------------------------------------------------------------------------------------------


def is_whole(vector: Column) -> Column:
    """A vector with entries, none of them null or non-finite."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def integers(vector: Column, scale: int, most: int = MOST) -> Column:
    """floor(scale * entry) of each entry, as longs."""
    too_large = F.raise_error(F.lit(f"an entry of a vector is beyond {most} / {scale}"))
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) * scale < most, F.floor(c.cast("double") * scale)).otherwise(too_large.cast("long")))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; all have this width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# ---- factors ---------------------------------------------------------------------------------------------------------


def stack(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """R of the rows that r stands for, and these."""
    rows = rows if r is None else np.vstack([r, rows])
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def _pairings(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """d - 1 (or d) rounds of disjoint pairs, in which all pairs of 0 .. d - 1 meet once."""
    ring = list(range(d + d % 2))
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], reversed(ring[half:]), strict=True) if max(a, b) < d]
        yield np.array([p for p, _ in pairs], dtype=int), np.array([q for _, q in pairs], dtype=int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and the right singular vectors as columns, the largest entry of each positive."""
    a, v = r.astype(np.float64), np.eye(r.shape[1])
    scale = np.abs(a).max(initial=0.0)
    a = a / scale if scale else a
    for _ in range(_SWEEPS):
        turned = False
        for p, q in _pairings(a.shape[1]):
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            on = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if not on.any():
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (beta - alpha) / (2.0 * gamma)
                t = np.where(on, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1.0 + zeta * zeta)), 0.0)
            c = 1.0 / np.sqrt(1.0 + t * t)
            s = c * t
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0)) * scale
    order = np.argsort(-sigma, kind="stable")
    v = v[:, order]
    return sigma[order], v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


# ---- fit -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What a fit found: n vectors, their sums, components as columns, and the deviation along each (0: no spread)."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    deviations: np.ndarray
    scale: int

    @property
    def explained(self) -> list[float | None]:
        e = self.deviations**2
        return [float(x / e.sum()) if e.sum() else None for x in e]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, rounded once."""
        if self.n * MOST < 1 << 62 or self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61:
            return (self.n * x - np.array(self.sums, dtype=np.int64)) / float(self.n)
        return ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exact; null beyond a long."""
        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if x.shape[1] * far * far < 1 << 63:
            y = self.n * x - np.array(self.sums, dtype=np.int64)
            return (y * y).sum(1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return [t if t < 1 << 63 else None for t in (y * y).sum(1)]

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """Rows of x on the first components, each of deviation 1; NaN where there is no spread."""
        d = np.where(self.deviations > 0, self.deviations, np.nan)[:components]
        return self.centred(x) @ (self.components[:, :components] / d)


def fit_list(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Each distinct integer vector x once."""
    v = F.col(f"`{vector}`")
    return df.filter(is_whole(v)).select(integers(v, scale).alias("x")).distinct()


def _sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, i, total) of a task: sums of dimension i, and at i = -1 the number of vectors."""
    totals: dict[int, list[int]] = {}
    for batch in stream:
        column = batch.column(0)
        widths = np.diff(column.offsets.to_numpy())
        for w in np.unique(widths).tolist():
            x = as_matrix(column.filter(pa.array(widths == w)), w)
            own = totals.setdefault(w, [0] * (w + 1))
            own[0] += len(x)
            for i, s in enumerate(x.sum(0).tolist(), 1):
                own[i] += s
    rows = [(w, i - 1, str(s)) for w, own in totals.items() for i, s in enumerate(own)]
    if rows:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["width", "i", "total"]), schema=pa.schema([("width", pa.int32()), ("i", pa.int32()), ("total", pa.string())]), preserve_index=False)


def _factors(n: int, sums: tuple[int, ...]):
    """(part, rows, r) of a task: R of its centred rows."""
    w = Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), 0)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in stream:
            for at in range(0, batch.num_rows, 4096):
                r = stack(r, w.centred(as_matrix(batch.column(0).slice(at, 4096), len(sums))))
        if r is not None:
            yield _factor_row(TaskContext.get().partitionId(), r)

    return run


_FACTOR = "part long, r binary"


def _factor_row(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.ascontiguousarray(r, dtype="<f8").tobytes()], pa.binary())], names=["part", "r"])


def _reducer(width: int):
    """The R of a group of R's, in the order of their parts."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        r = None
        for found in group.sort_by("part").column("r").to_pylist():
            r = stack(r, np.frombuffer(found, dtype="<f8").reshape(-1, width))
        return pa.Table.from_batches([_factor_row(key[0].as_py(), r)])

    return run


def fit(df: DataFrame, vector: str = "embedding", scale: int = 256) -> tuple[Whitening, DataFrame] | None:
    """The whitening of df's vectors and its fit list; None if no vector is whole."""
    listed = shared_checkpoint(fit_list(df, vector, scale))
    totals: dict[int, dict[int, int]] = {}
    for t in listed.mapInArrow(_sums, "width int, i int, total string").groupBy("width", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect():  # a row for each dimension
        totals.setdefault(t["width"], {})[t["i"]] = int(t["s"])
    if not totals:
        return None
    width = max(totals, key=lambda w: (totals[w][-1], w))
    n, sums = totals[width][-1], tuple(totals[width][i] for i in range(width))
    listed = listed.filter(F.size("x") == width)
    level = shared_checkpoint(listed.mapInArrow(_factors(n, sums), _FACTOR))
    most = level.agg(F.max("part")).first()[0] + 1
    while most > 1:
        most = -(-most // FAN)
        level = shared_checkpoint(level.groupBy(F.floor(F.col("part") / FAN).alias("part_")).applyInArrow(_reducer(width), _FACTOR))
    (row,) = level.collect()  # one R
    r = np.frombuffer(row["r"], dtype="<f8").reshape(-1, width)
    sigma, v = jacobi(r)
    rank = min(n - 1, width)
    spread = (np.arange(width) < rank) & (sigma > sigma[0] * 1e-13 * max(width, 1))
    return Whitening(n, sums, v, np.where(spread, sigma / np.sqrt(n), 0.0), scale), listed


def _products(w: Whitening, components: int):
    """(i, j, s) of a task: sums of products of whitened values."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components, components))
        for batch in stream:
            if batch.num_rows:
                y = w.whiten(as_matrix(batch.column(0), len(w.sums)), components)
                total += y.T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "s"])

    return run


def identity_error(w: Whitening, listed: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of the fit list's whitened vectors minus the identity, over components with spread."""
    spread = int((w.deviations[:components] > 0).sum())
    if not spread:
        return None
    found = listed.mapInArrow(_products(w, spread), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(t["s"] / w.n - (t["i"] == t["j"])) for t in found)


# ---- results ---------------------------------------------------------------------------------------------------------


def _projector(w: Whitening, components: int, error: float | None):
    explained = w.explained[:components]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = as_matrix(part.column(1), len(w.sums))
                m, y = len(x), w.whiten(x, components)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), components))), pa.array(np.tile(np.arange(1, components + 1), m), pa.int32()), pa.array(np.full(m * components, w.n), pa.int64()),
                    pa.array([v for v in w.deviation(x) for _ in range(components)], pa.int64()), pa.array(y.ravel(), pa.float64(), mask=np.isnan(y.ravel())),
                    pa.array(explained * m, pa.float64()), pa.array([error] * (m * components), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error for each whole vector of df and each of the first components."""
    i, v = F.col(f"`{id_col}`"), F.col(f"`{vector}`")
    kind = df.select(i.alias("id")).schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(df, vector, scale)
    if found is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    w, listed = found
    components = min(components, len(w.sums))
    rows = df.filter(is_whole(v) & (F.size(v) == len(w.sums))).select(i.alias("id"), integers(v, scale).alias("x"))
    return rows.mapInArrow(_projector(w, components, identity_error(w, listed, components)), schema).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def whitening_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11_whitening gives apart from the eigenvectors, so that SQL can check it: the fit list's size, exact deviations, and the mean squares of whitened values by component."""
    return op11_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation", (F.col("identity_error") < 1e-9).alias("is_identity"))


WHITENING_FIT_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT DISTINCT x FROM v),
e AS (SELECT unnest(x) AS c, generate_subscripts(x, 1) AS i FROM f),
s AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, sum(c)::BIGINT AS s FROM e GROUP BY i)),
n AS (SELECT count(*)::BIGINT AS n FROM f)
SELECT vec_id, n, list_sum(list_transform(list_zip(x, s), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2])))::BIGINT AS deviation, TRUE AS is_identity FROM v, s, n
"""
