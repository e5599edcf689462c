"""Whitening against an eigenvalue solver, clusters against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import clusters, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, x int, Cluster int, n long"


def vectors(r, n, d, spread=1.0):
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    return [[c + spread * r.gauss(0, 0.3) * (1 + j) / d for j, c in enumerate(r.choice(centres))] for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    """Vectors of width 8 with repeated rows and ids, one that a third of the rows share, and rows that go."""
    r = random.Random(3)
    rows = [(i, v) for i, v in enumerate(vectors(r, 400, 8))]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [None] * 8), (2003, [1.0] * 7 + [None]), (2004, [math.nan] + [0.0] * 7), (2005, [math.inf] + [0.0] * 7), (2006, [-math.inf] * 8), (2007, [0.5] * 5)]
    r.shuffle(rows)
    return rows, spark.createDataFrame([(*t, 1, 2, 3) for t in rows], EMBEDDINGS).repartition(7)


def whole(rows, width=8):
    out = [(i, [np.float32(c) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(256 * float(c)) for c in v]) for i, v in out]


def check_whitening(rows, got, components=4):
    kept = whole(rows)
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == components * len(kept)
    by = {}
    for t in got:
        by.setdefault((t["vec_id"], t["deviation"]), {}).setdefault(t["component"], []).append(t)
    for i, x in kept:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(1, components + 1):
            for t in by[i, deviation][c]:
                want = (np.array(x) - sums / n) @ v[:, c - 1] / math.sqrt(e[c - 1])
                assert t["n"] == n and abs(abs(t["whitened"]) - abs(want)) < 1e-9
                assert t["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-12) and t["identity_error"] < 1e-12
    for c in range(1, components + 1):  # one sign for all rows
        signs = {np.sign(t["whitened"] * ((np.array(x) - sums / n) @ v[:, c - 1])) for i, x in kept for t in by[i, sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))][c]}
        assert len(signs - {0.0}) == 1


@pytest.mark.parametrize("fan", [2, 32])
def test_whitening(table, fan, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", fan)
    check_whitening(table[0], whitening.whiten(table[1]).collect())


def test_whitening_of_little(spark, table):
    assert whitening.whiten(table[1].limit(0)).count() == 0 and whitening.whiten(table[1].filter("vec_id = 2000")).count() == 0
    one = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0])], "vec_id string, embedding array<double>")).collect()
    assert len(one) == 4 and all((t["n"], t["deviation"], t["whitened"], t["explained"], t["identity_error"]) == (1, 0, None, None, None) for t in one)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id int, embedding array<double>")).collect()
    first, others = [t for t in line if t["component"] == 1], [t for t in line if t["component"] > 1]
    assert sorted(round(abs(t["whitened"]), 9) for t in first) == sorted(round(abs(i - 4) / math.sqrt(60 / 9), 9) for i in range(9))
    assert all(t["explained"] == pytest.approx(1) and t["identity_error"] < 1e-12 for t in first) and all(t["whitened"] is None and t["explained"] < 1e-12 for t in others)
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], "vec_id int, embedding array<double>")).count()


def test_deviations_beyond_a_long():
    w = whitening.Whitening(1 << 40, (3, -5), np.eye(2), np.ones(2), 1)
    x = np.array([[1 << 39, 7], [0, 0]])
    assert w.deviation(x) == [None, 34]
    assert w.centred(x)[0, 0] == pytest.approx(float(1 << 39), rel=1e-15)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_jacobi(d):
    g = np.random.default_rng(d)
    u, v = np.linalg.qr(g.standard_normal((d, d)))[0], np.linalg.qr(g.standard_normal((d, d)))[0]
    sigma = 10.0 ** -np.linspace(0, 12, d)
    s, components = whitening.jacobi((u * sigma) @ v.T)
    assert s[0] == pytest.approx(sigma[0], rel=1e-13) and np.abs(s - sigma).max() < 1e-14
    assert np.abs(components.T @ components - np.eye(d)).max() < 1e-13
    # columns of very different size: small deviations keep their digits, which a covariance would lose
    tall = g.standard_normal((50, d)) * 10.0 ** -np.arange(0, 2 * d, 2).clip(0, 20)
    found, _ = whitening.jacobi(np.linalg.qr(tall, mode="r"))
    assert found == pytest.approx(np.linalg.svd(tall, compute_uv=False), rel=1e-6, abs=1e-30) or d > 8


def test_factors_of_parts_are_those_of_all():
    rows = np.random.default_rng(1).standard_normal((1000, 6))
    r = None
    for at in range(0, 1000, 7):
        r = whitening.stack(r, rows[at : at + 7])
    assert np.allclose(r.T @ r, rows.T @ rows)


# ---- clusters --------------------------------------------------------------------------------------------------------


def brute_clusters(kept, k, rounds):
    key = lambda t: (t[0] is None, hashlib.sha256(f"2:{t[0]}".encode()).hexdigest(), t[1])
    centroids = [list(x) for _, x in sorted(kept, key=key)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *reversed(nearest(x))) for i, x in kept]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in out), key=repr)


@pytest.mark.parametrize(("k", "rounds", "block", "leaf"), [(12, 5, 64, 4), (1, 2, 8192, 48), (2000, 1, 100, 8)])
def test_clusters(table, k, rounds, block, leaf):
    assigned, centroids = clusters.cluster(table[1], k, rounds, width=8, block=block, leaf=leaf)
    got = clusters.with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_clusters(whole(table[0]), k, rounds)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(str(i), [float(i % 3), 0.0]) for i in range(60)] + [("m", [0.5, 0.0]), ("m", [1.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assigned, centroids = clusters.cluster(df, 7, 0, width=2)  # copies among the centroids
    got = clusters.with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_clusters([(i, [math.floor(256 * c) for c in v]) for i, v in rows], 7, 0)


def test_clusters_of_nothing(spark, table):
    for some in (table[1].limit(0), table[1].filter("vec_id >= 2000")):
        assigned, centroids = clusters.cluster(some, 40, 5, width=8)
        out = clusters.with_inertia(assigned, centroids)
        assert out.count() == 0 and set(out.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e9])], "vec_id int, embedding array<double>"), 1, 1, width=1)


def test_balls_go_whole():
    """In separate groups, most vectors are settled by a ball; all are settled as by all distances."""
    g = np.random.default_rng(2)
    places = g.integers(-4000, 4000, (5, 16))
    x = places[g.integers(0, 5, 3000)] + g.integers(-40, 40, (3000, 16))
    order, tree = clusters.build(x)
    tree["x"] = x[order]
    found, balls = np.full(len(x), -1), 0
    for node, k, far in clusters.filtered(tree, places):
        lo, hi = tree["lo"][node], tree["hi"][node]
        assert (found[lo:hi] == -1).all()
        found[lo:hi] = k
        balls += hi - lo if far is None else 0
        if far is None:
            assert (tree["x"][lo:hi].sum(0) == tree["sums"][node]).all()
    exact = ((tree["x"][:, None, :] - places[None]) ** 2).sum(2)
    assert (found == exact.argmin(1)).all() and balls > 0.8 * len(x)
    assert (clusters.distances(x, places) == ((x[:, None, :] - places[None]) ** 2).sum(2)).all()
    wide = np.array([[(1 << 30) - 1, 1 << 29]])
    assert clusters.distances(wide, -wide)[0, 0] == 4 * sum(int(c) ** 2 for c in wide[0])


def test_a_common_vector_is_one_leaf(spark):
    same = spark.range(50_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assigned, centroids = clusters.cluster(same, 3, 2, width=2)
    assert centroids.tolist() == [[256, 512]] * 3 and assigned.groupBy("cluster", "distance").count().collect() == [(0, 0, 50_000)]
