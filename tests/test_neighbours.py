"""kNN, LOF and DBSCAN against brute force, with leaves far smaller than the data and a heap of copies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import neighbours
from tallygrid.operators.neighbours import dbscan, impute_knn, lof


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, .3, (120, 2)), rng.normal(3, .3, (120, 2)), rng.uniform(-3, 6, (30, 2)), np.tile([[1.5, 1.5]], (90, 1))])
    p = pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1], "v": np.where(np.arange(len(x)) % 7 == 0, np.nan, x[:, 0] * 2)})
    z = (x - x.mean(0)) / x.std(0)
    return p, np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))


def test_dbscan(spark, cloud):
    p, dist = cloud
    got = dbscan(spark.createDataFrame(p), ["a", "b"], 0.25, 6, leaf_points=40).orderBy("id").toPandas()["cluster"].to_numpy()
    core = (dist <= .25).sum(1) >= 6
    want, n = np.full(len(p), -1), 0
    for i in np.flatnonzero(core):
        if want[i] < 0:
            todo, want[i] = [i], n
            while todo:
                j = todo.pop()
                for m in np.flatnonzero((dist[j] <= .25) & core & (want < 0)):
                    want[m] = n
                    todo.append(m)
            n += 1
    for i in np.flatnonzero(~core):
        c = np.where(core, dist[i], np.inf)
        want[i] = want[c.argmin()] if c.min() <= .25 else -1
    pairs = set(zip(want, got))
    assert len(pairs) == len(set(want)) == len(set(got)) and all((a == -1) == (b == -1) for a, b in pairs)


def test_lof(spark, cloud):
    p, dist = cloud
    k = 7
    got = lof(spark.createDataFrame(p), ["a", "b"], k, leaf_points=40).orderBy("id").toPandas()["lof"].to_numpy()
    d = dist.copy()
    np.fill_diagonal(d, np.inf)
    kd = np.sort(d, 1)[:, k - 1]
    near = [np.flatnonzero(d[i] <= kd[i]) for i in range(len(p))]
    lrd = np.array([1 / (np.maximum(kd[near[i]], d[i][near[i]]).mean() + 1e-10) for i in range(len(p))])
    np.testing.assert_allclose(got, [lrd[near[i]].mean() / lrd[i] for i in range(len(p))], rtol=1e-6)


def test_impute_knn(spark, cloud):
    p, dist = cloud
    k = 5
    d = spark.createDataFrame(p).withColumn("v", F.nanvl("v", F.lit(None)))
    got = impute_knn(d, "v", ["a", "b"], k, leaf_points=40).orderBy("id").toPandas()["v"].to_numpy()
    v = p["v"].to_numpy()
    has, want = ~np.isnan(v), v.copy()
    for i in np.flatnonzero(~has):
        c = np.where(has, dist[i], np.inf)
        want[i] = v[c <= np.sort(c)[k - 1]].mean()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_full_leaves_are_split_in_rounds(spark, monkeypatch):
    """A top of four leaves, two levels a round: several rounds, and no leaf stays full however the values pile up."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (1500, 2)), rng.normal(0, 1e-4, (1500, 2)),
                        np.column_stack([np.zeros(1000), np.arange(1000.)]), np.column_stack([rng.integers(0, 2, 500), rng.normal(0, 1, 500)])])
    monkeypatch.setattr(neighbours, "SUB_DEPTH", 2)
    points = spark.createDataFrame([(p,) for p in np.unique(x, axis=0).tolist()], "x array<double>")
    tree = neighbours.plant(points, 50, top_leaves=4)
    assert tree.depth == 2 and len(tree.splits) >= 2
    sizes = neighbours.with_leaf(points, tree).groupBy("leaf").count().toPandas()["count"]
    assert sizes.max() <= 100 and sizes.sum() == points.count()
    # A point with no radius reaches its own leaf and no other; with any radius it reaches all.
    at = neighbours.with_leaf(points, tree)
    home = neighbours.visiting(points.withColumn("radius", F.lit(1e-300)), tree)
    assert at.join(home, ["x", "leaf"], "left_anti").isEmpty()
    some = neighbours.visiting(points.limit(3).withColumn("radius", F.lit(float("inf"))), tree)
    assert some.groupBy("x").agg(F.countDistinct("leaf").alias("n")).where(F.col("n") < len(sizes)).isEmpty()


def test_results_do_not_depend_on_the_rounds(spark, cloud, monkeypatch):
    p, _ = cloud
    d = spark.createDataFrame(p)
    v = d.withColumn("v", F.nanvl("v", F.lit(None)))
    run = lambda: (lof(d, ["a", "b"], 7, leaf_points=25).orderBy("id").toPandas()["lof"], dbscan(d, ["a", "b"], .25, 6, leaf_points=25).orderBy("id").toPandas()["cluster"],
                   impute_knn(v, "v", ["a", "b"], 5, leaf_points=25).orderBy("id").toPandas()["v"])
    one = run()
    whole = neighbours.plant
    monkeypatch.setattr(neighbours, "plant", lambda points, leaf_points: whole(points, leaf_points, top_leaves=2))
    monkeypatch.setattr(neighbours, "SUB_DEPTH", 1)
    for a, b in zip(one, run()):
        pd.testing.assert_series_equal(a, b, rtol=1e-9)


def test_comparisons_hold_bounded_memory():
    """However many points visit a leaf, a task holds a bounded block of distances."""
    rng = np.random.default_rng(3)
    q, p = rng.normal(0, 1, (700, 2)), rng.normal(0, 1, (60_000, 2))
    seen = 0
    for lo, d in neighbours._blocks(q[:40], p):
        assert lo == seen and d.size <= 1 << 20
        seen += len(d)
        np.testing.assert_allclose(d, np.sqrt(((q[lo:lo + len(d), None] - p[None]) ** 2).sum(2)))
    assert seen == 40


def test_least_and_reachable_equal_plain_versions():
    rng = np.random.default_rng(4)
    d = rng.integers(0, 30, (50, 200)).astype(float)
    for m in (1, 7, 200, 300):
        o = neighbours._least(d, m)
        np.testing.assert_array_equal(np.take_along_axis(d, o, 1), np.sort(d, 1)[:, :m])
        assert all(len(set(r)) == len(r) for r in o.tolist())
    c = rng.uniform(0, 10, (300, 2))
    near = ((c[:, None] - c[None]) ** 2).sum(2) <= .4 ** 2
    want, n = np.full(300, -1), 0
    for i in range(300):
        if want[i] < 0:
            todo, want[i] = [i], n
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & (want < 0)):
                    want[j] = n
                    todo.append(j)
            n += 1
    np.testing.assert_array_equal(neighbours._reachable(c, .4), want)
