"""Extra trees beside a plain recursive version with the same draws."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallygrid.operators import extratrees as et


def data(classes):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((1000, 4)), 3)
    x[:, 3] = 5.0  # no node can split on it
    y = (x[:, 0] * 3 + (x[:, 1] > 0.6)).astype(int) if classes else np.round(x[:, 0] * 4 - x[:, 1] ** 2 + rng.normal(0, 0.05, 1000), 3)
    return x, y.astype(float)


def grow(x, y, rows, seed, tree, node, depth, classes, tried, out):
    stats = np.eye(classes)[y[rows].astype(int)].sum(0) if classes else np.array([len(rows), y[rows].sum(), (y[rows] ** 2).sum()])
    best = (1e-9, None)
    u, may = et.draws(seed, tree, node, x.shape[1], tried)
    if depth:
        for f in may:
            lo, hi = x[rows, f].min(), x[rows, f].max()
            cut = lo + u[f] * (hi - lo)
            left = rows[x[rows, f] <= cut]
            if hi > lo and 0 < len(left) < len(rows):
                s = np.eye(classes)[y[left].astype(int)].sum(0) if classes else np.array([len(left), y[left].sum(), (y[left] ** 2).sum()])
                g = et.gain(s, stats, classes)
                if g > best[0] + 1e-12:
                    best = (g, (f, cut, left, np.setdiff1d(rows, left)))
    if best[1] is None:
        out[rows] = et._value(stats, classes)
        return
    _, _, left, right = best[1]
    grow(x, y, left, seed, tree, 2 * node, depth - 1, classes, tried, out)
    grow(x, y, right, seed, tree, 2 * node + 1, depth - 1, classes, tried, out)


@pytest.mark.parametrize("classes, slots", [(0, 400_000), (0, 24), (4, 400_000)])
def test_equals_a_plain_version(spark, monkeypatch, tmp_path, classes, slots):
    monkeypatch.setattr(et, "SLOTS", slots)
    x, y = data(classes)
    d = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i long, a double, b double, c double, e double, y double").repartition(4)
    est = et.ExtraTrees("v", "y", numTrees=5, maxDepth=4, classes=classes, seed=9)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list("abce"), outputCol="v"), est]).fit(d)
    got = dict(pipe.transform(d).select("i", "prediction").collect())
    want = np.zeros((1000, classes or 1))
    for t in range(5):
        out = np.zeros((1000, classes or 1))
        grow(x, y, np.arange(1000), 9, t, 1, 4, classes, 2 if classes else 4, out)
        want += out / 5
    want = want.argmax(1) if classes else want[:, 0]
    assert np.allclose([got[i] for i in range(1000)], want, atol=1e-9)
    weights = pipe.stages[-1].featureImportances.toArray()
    assert abs(weights.sum() - 1) < 1e-9 and weights[3] == 0 and weights.argmax() == 0
    pipe.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(d)
    assert dict(again.select("i", "prediction").collect()) == got
    assert pipe.transform(d.limit(0)).count() == 0


def test_one_row_and_one_value(spark):
    d = VectorAssembler(inputCols=["a"], outputCol="v").transform(spark.createDataFrame([(1.0, 3.0)] * 5, "a double, y double"))
    assert {r["prediction"] for r in et.ExtraTrees("v", "y", numTrees=2, maxDepth=3).fit(d).transform(d).collect()} == {3.0}


def test_tasks_get_numbers_not_lists():
    import pandas as pd
    from tallygrid.operators import extratrees
    b = pd.DataFrame({"x0": [1.0, 2.0], "x1": [3.0, 4.0], "y": [0.0, 1.0]})
    np.testing.assert_array_equal(extratrees._features(b, 2), [[1.0, 3.0], [2.0, 4.0]])
