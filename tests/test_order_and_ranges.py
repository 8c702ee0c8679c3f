"""Range joins, ranks, time windows and user aggregates beside plain versions, on busy keys and odd values."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrid.catalog import QUERIES
from tallygrid.functions import ordering
from tallygrid.operators import features, ml, userfn
from tallygrid.operators import relational as R

INF = float("inf")


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(1)
    points = [(i, i % 3, rng.choice([0.0, -1e-9, 5.0, 1e18, -1e18, None, rng.uniform(-50, 50), rng.uniform(-1e6, 1e6)])) for i in range(300)]
    ranges = [(j, j % 3, lo, lo + rng.choice([1e-9, 0.5, 1.0, 4.0, 1e3, 3e5, 1e18, -1.0, 0.0])) for j in range(120) for lo in [rng.choice([0.0, 5.0, -1e18, rng.uniform(-60, 60), rng.uniform(-1e6, 1e6)])]]
    ranges += [(500, 0, -INF, 3.0), (501, 0, 2.0, INF), (502, 0, -INF, INF), (503, 0, None, 3.0), (504, 0, 1.0, None)]
    p, r = spark.createDataFrame(points, "p long, g long, x double"), spark.createDataFrame(ranges, "r long, g long, lo double, hi double")
    for by in ([], ["g"]):
        got = R.range_join(p, r if by else r.drop("g"), "x", "lo", "hi", by).select("p", "r").collect()
        want = Counter((a, b) for a, g, x in points for b, h, lo, hi in ranges if None not in (x, lo, hi) and lo <= x < hi and (g == h or not by))
        assert Counter(map(tuple, got)) == want and len(want) > 1000


def test_a_range_is_listed_twice_at_most(spark):
    r = spark.createDataFrame([(i, float(i), i + 2.0 ** (i % 30) + 0.3) for i in range(400)], "r long, lo double, hi double")
    joined = R.range_join(spark.createDataFrame([(1.0,)], "x double"), r, "x", "lo", "hi")
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "_cell" in plan and "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    cells = [len({np.floor(lo / w), np.floor(hi / w)}) for _, lo, hi in r.collect() for w in [2.0 ** np.ceil(np.log2(hi - lo))]]
    assert max(cells) <= 2
    assert R.range_join(spark.createDataFrame([(1.0,)], "x double"), r.limit(0), "x", "lo", "hi").count() == 0


def test_range_totals_equal_all_pairs(spark):
    rng = random.Random(2)
    points = [(i, i % 3 or None, rng.choice([0.0, 5.0, 1e18, None, INF, -INF, float(rng.randint(-9, 9)), rng.uniform(-50, 50)])) for i in range(300)]
    ranges = [(j // 2, j % 3 or None, lo, lo + rng.choice([1e-9, 0.5, 4.0, 1e3, -1.0, 0.0])) for j in range(120) for lo in [rng.choice([0.0, 5.0, -1e18, rng.uniform(-60, 60)])]]
    ranges += [(500, 1, -INF, 3.0), (501, 1, 2.0, INF), (502, 1, -INF, INF), (503, 1, None, 3.0), (504, 1, 1.0, None), (505, 1, 900.0, 901.0)]
    p, r = spark.createDataFrame(points, "p long, g long, x double"), spark.createDataFrame(ranges, "r long, g long, lo double, hi double")
    totals = {"n": (F.count(F.lit(1)), F.sum), "least": (F.min("p"), F.min)}
    for by in ([], ["g"]):
        want = Counter()
        for j, h, lo, hi in ranges:
            hit = [a for a, g, x in points if None not in (x, lo, hi) and lo <= x < hi and (not by or g is not None and g == h)]
            if hit:
                want[(j, lo, hi, len(hit), min(hit))] += 1
        got = R.range_join(p, r, "x", "lo", "hi", by, totals).select("r", "lo", "hi", "n", "least").collect()
        assert Counter(map(tuple, got)) == want and len(want) > 30
    assert R.range_join(p, r.limit(0), "x", "lo", "hi", totals=totals).count() == 0
    assert R.range_join(p.limit(0), r, "x", "lo", "hi", totals=totals).count() == 0


def test_range_totals_list_no_pairs(spark, sf):
    """40,000 points in each of 20,000 ranges, and the query's plan: blocks are joined, not points."""
    p = spark.range(40000).select("id", F.col("id").cast("double").alias("x"))
    r = spark.range(20000).select(F.col("id").alias("r"), (-1.0 - F.col("id")).alias("lo"), (40000.0 + F.col("id")).alias("hi"))
    d = R.range_join(p, r, "x", "lo", "hi", totals={"n": (F.count(F.lit(1)), F.sum)})
    assert d.agg(F.sum("n").alias("pairs")).first()["pairs"] == 800_000_000
    plan = QUERIES["R06_range_join_mixed_lengths"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and "_cell" not in plan


@pytest.mark.parametrize("descending", [False, True])
def test_ranking_equals_one_window(spark, descending):
    rng = random.Random(4)
    # One key has nine rows of ten, one value a third of them.
    rows = [(i, None if i % 97 == 0 else "hot" if i % 10 else f"k{i % 5}", None if i % 41 == 0 else 7.0 if i % 3 == 0 else float(rng.randint(0, 300))) for i in range(4000)]
    d = spark.createDataFrame(rows, "i long, g string, x double").repartition(5)
    first = F.desc_nulls_last("x") if descending else F.asc_nulls_last("x")
    w, u = W.partitionBy("g").orderBy(first), W.partitionBy("g").orderBy(first, "i")
    want = d.select("i", F.rank().over(w), F.dense_rank().over(w), F.row_number().over(u), F.round(F.percent_rank().over(w), 9), F.lead("i").over(u))
    got = R.ranking(d, ["g"], "x", ["i"], descending, "i").select("i", "rank", "dense_rank", "row_number", F.round("percent_rank", 9), "next_i")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = R.ranking(d, [], "x", ["i"]).select("i", "row_number").collect()
    assert sorted(r["row_number"] for r in whole) == list(range(1, 4001))
    assert R.ranking(d.limit(0), ["g"], "x", ["i"]).count() == 0


def test_ranking_spreads_a_busy_key(spark):
    d = spark.range(20000).select("id", F.lit("hot").alias("g"), (F.col("id") * 7919 % 20011).cast("double").alias("x"))
    cuts = ordering.cut_points(d, F.col("x"))
    sizes = [r["count"] for r in ordering.with_chunk(d, F.col("x"), cuts).groupBy(ordering.CHUNK).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 20000 / len(sizes)


def test_chunks_are_dealt_by_rows(spark, monkeypatch):
    """Adaptive execution merges partitions by bytes; a task's rows stay bounded, and windows take the rows as they are dealt."""
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 1000)
    d = spark.range(20000).select("id", F.concat(F.lit("g"), (F.col("id") % 10 == 0).cast("string")).alias("g"), (F.col("id") % 2003).cast("double").alias("x"))
    out = R.ranking(d, ["g"], "x", ["id"]).select("id", "rank", "row_number")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    want = d.select("id", F.rank().over(W.partitionBy("g").orderBy("x")), F.row_number().over(W.partitionBy("g").orderBy("x", "id")))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    ordered = ordering.chunked(d, ["g"], F.col("x"))
    assert ordered.rdd.getNumPartitions() == 20
    assert ordered.withColumn("n", F.row_number().over(W.partitionBy("g", ordering.CHUNK).orderBy("x")))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_time_windows_over_many_chunks(spark, monkeypatch):
    """Thousands of chunks of one entity, with gaps; entities that are in few of them."""
    monkeypatch.setattr(features, "cut_points", lambda df, number: ordering.cut_points(df, number, 600))
    rng = random.Random(6)
    rows = [(i, "busy" if i % 5 else f"e{i % 4}", rng.randint(0, 400) * 3600 + rng.randint(0, 3), None if i % 11 == 0 else float(rng.randint(-9, 9))) for i in range(2500)]
    d = spark.createDataFrame(rows, "i long, g string, s long, v double").withColumn("ts", F.timestamp_seconds("s")).repartition(4)
    for days in (1, 6):
        got = features.rolling_time(d, "v", ["g"], "ts", days, ["sum", "count", "max", "min"])
        got = {r["i"]: (r[f"v_sum_{days}d"], r[f"v_count_{days}d"], r[f"v_max_{days}d"], r[f"v_min_{days}d"]) for r in got.collect()}
        by = defaultdict(list)
        for _, g, s, v in rows:
            by[g].append((s, v))
        for i, g, s, _ in rows:
            seen = [v for t, v in by[g] if s - days * 86400 < t <= s and v is not None]
            assert got[i] == ((sum(seen), len(seen), max(seen), min(seen)) if seen else (None, 0, None, None))


def test_time_windows_hold_no_list_of_chunks(spark):
    d = spark.createDataFrame([(1, "a", 1.0)], "i long, g string, v double").withColumn("ts", F.timestamp_seconds("i"))
    plan = features.rolling_time(d, "v", ["g"], "ts", 2)._jdf.queryExecution().analyzed().toString()
    assert "collect_list" not in plan


def test_user_aggregate_combines_before_the_shuffle(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 10 else None if i % 20 else f"k{i % 7}", rng.random(), i % 2) for i in range(6000)]
    d = spark.createDataFrame(rows, "i long, g string, x double, s0 long").repartition(6)
    seen = spark.sparkContext.accumulator(0)

    def update(v: pd.DataFrame) -> tuple:
        seen.add(1)
        return len(v), float(v["x"].sum()), float((v["x"] ** 2).sum())

    def merge(s: pd.DataFrame) -> tuple:
        assert len(s) <= 64  # states, not rows, whatever the group's size
        return int(s["n"].sum()), float(s["t"].sum()), float(s["q"].sum())

    def finish(s: pd.DataFrame) -> pd.Series:
        return (s["q"] / s["n"] - (s["t"] / s["n"]) ** 2) ** 0.5

    got = userfn.aggregate(d, ["g"], ["x"], update, merge, finish, "n long, t double, q double", "double", "spread")
    assert got.columns == ["g", "spread"]
    want = d.groupBy("g").agg(F.stddev_pop("x")).collect()
    got = {r["g"]: r["spread"] for r in got.collect()}
    assert got.keys() == {r[0] for r in want} and all(abs(got[r[0]] - r[1]) < 1e-9 for r in want)
    assert 0 < seen.value <= 6 * 10
    one = userfn.aggregate(d, [], ["x"], update, merge, finish, "n long, t double, q double", "double", "spread").collect()
    assert len(one) == 1 and abs(one[0]["spread"] - d.agg(F.stddev_pop("x")).first()[0]) < 1e-9
    assert userfn.aggregate(d.limit(0), ["g"], ["x"], update, merge, finish, "n long, t double, q double", "double", "spread").count() == 0


def test_lag_forecasts(spark):
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
    rows = [(s, d, float(5 + (d % 7) * 3 + d * 0.2 + s)) for s in range(4) for d in range(60)] + [(9, 3, 8.0), (9, 5, 4.0)]
    d = spark.createDataFrame(rows, "s long, d long, y double").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))

    def run(**more):
        out = ml.forecast_lags(d, "ts", "y", 12, ["s"], (1, 2, 7), **more)
        return {(r["s"], str(r["date"])): r["predicted"] for r in out.collect()}

    plain = {}
    train = [(x, [y[i - n] for n in (1, 2, 7)], y[i]) for x, y in series(rows).items() for i in range(7, len(y))]
    a = np.array([[1.0, *l] for _, l, _ in train])
    coef = np.linalg.lstsq(a, np.array([t for *_, t in train]), rcond=None)[0]
    for s, y in series(rows).items():
        y, last = [0.0] * (7 - len(y)) + y, max(x for k, x, _ in rows if k == s)
        for h in range(1, 13):
            y.append(float(coef @ np.array([1.0, y[-1], y[-2], y[-7]])))
            plain[s, str(pd.Timestamp("1970-01-01") + pd.Timedelta(days=last + h))[:10]] = y[-1]
    got = run()
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-6 for k in plain)
    stepped = run(estimator=LinearRegression(featuresCol="__x", labelCol="__y", solver="normal", standardization=False))
    assert all(abs(stepped[k] - plain[k]) < 1e-4 for k in plain)
    tree = run(estimator=DecisionTreeRegressor(featuresCol="__x", labelCol="__y"))
    assert tree.keys() == plain.keys() and all(0 <= v <= 40 for v in tree.values())
    short = ml.forecast_lags(d.where("s = 9"), "ts", "y", 3, ["s"], (1, 7)).collect()  # no day has all lags
    assert [r["predicted"] for r in short] == [0.0, 0.0, 0.0]


def series(rows):
    out = {}
    for s in {r[0] for r in rows}:
        days = {d: y for k, d, y in rows if k == s}
        out[s] = [days.get(d, 0.0) for d in range(min(days), max(days) + 1)]
    return out
