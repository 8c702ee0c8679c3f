import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, connect
from tallygrid.llm import topk
from tallygrid.llm.queries import ORACLES, QUERIES


def test_query_equals_sql(spark, sf):
    message, ok = compare(spark, connect(sf), "op4_topk", QUERIES["op4_topk"], ORACLES["op4_topk"], sf)
    assert ok, message


def brute(vectors, is_query, k):
    good = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for i, v in good:
        if is_query(i):
            got = sorted((-int(v @ w), j) for j, w in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(got)]
    return sorted(out)


@pytest.mark.parametrize("seed,block", [(1, 16), (2, 4096)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(seed)
    scale = rng.choice([0.01, 1.0, 30.0], 150)
    rows = [(int(i), [float(x) for x in rng.normal(size=12) * s]) for i, s in enumerate(scale)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, [1.0, None]), (204, [float("nan")] * 12), (205, [float("inf")] * 12), (None, rows[1][1]),
             (206, []), (207, [0.0] * 12), (208, [5.0, -3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = sorted(tuple(r) for r in topk.search(d, F.col("vec_id") % 5 == 0, 7).collect())
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(rows, lambda i: i % 5 == 0, 7)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0, 20).count() == 0
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.5])], schema)
    assert [tuple(r) for r in topk.search(d, F.col("vec_id") == 0, 20).collect()] == [(0, 1, 1, 64 * 64 + 32 * 128)]


def test_most_candidates_are_dropped_before_the_last_plane():
    rng = np.random.default_rng(3)
    x = np.sort(np.floor(rng.normal(size=(2000, 64)) * 8), 0).astype(np.float32)
    planes, left = topk.planes_of(x)
    assert np.allclose(np.sum(planes, 0), x) and (np.diff(left, axis=0) <= 1e-9).all() and (left[-1] < 1e-6).all()


def test_huge_components(spark):
    rows = [(i, [1e25 * (-1) ** i, float(i), 3e38]) for i in range(25)] + [(30, [1e9, 2.0, -5e8]), (31, [3.0, 2.0, 1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, 3).collect()
    assert len(got) == 12 and {r["rank"] for r in got} == {1, 2, 3}
    d = spark.createDataFrame([(0, [2.0 ** 20, 1.0]), (1, [2.0 ** 20, 3.0]), (2, [-(2.0 ** 21), 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.search(d, F.col("vec_id") == 0, 5).orderBy("rank").collect()] == [
        (1, 2 ** 52 + 3 * 4096), (2, -(2 ** 53))]
