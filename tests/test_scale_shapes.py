"""Skewed keys, repeated values and data layout must not change results; plans must not gather rows in one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrid.functions.ordering import average_ranks, carry, dense_codes, time_steps
from tallygrid.functions.quantiles import exact_quantiles
from tallygrid.functions.wide import value_counts
from tallygrid.operators import clean, features, fuzzy, relational


@pytest.fixture(scope="module")
def hot():
    """4,000 rows; one key holds more than a third, another has one row, timestamps repeat."""
    rng = np.random.default_rng(7)
    n = 4000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n))
    key[5] = 999
    p = pd.DataFrame({"id": range(n), "k": key, "t": rng.integers(0, 1500, n), "v": np.round(rng.normal(50, 20, n), 1)})
    p.loc[rng.random(n) < 0.3, "v"] = np.nan
    return p


def frame(spark, p, parts):
    return spark.createDataFrame(p).withColumn("v", F.nanvl("v", F.lit(None))).repartition(parts, F.xxhash64("id"))


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_exact(spark, hot, parts):
    d = frame(spark, hot, parts)
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.999, "e": 1.0}
    got = exact_quantiles(d, ["v", "t"], probs).toPandas().set_index("column")
    for c in ("v", "t"):
        for n, q in probs.items():
            assert got.loc[c, n] == pytest.approx(hot[c].quantile(q), rel=1e-12)
    by = exact_quantiles(d, ["v"], {"m": 0.5}, by=["k"]).toPandas().set_index("k")["m"]
    pd.testing.assert_series_equal(by.sort_index(), hot.groupby("k")["v"].median().dropna().sort_index(), check_names=False)


@pytest.mark.parametrize("values", [[3.0], [1.0, 1e300, -1e300], [0.0, -0.0, 5e-324], [1e-9 * i for i in range(100)], [-5.0] * 9 + [2.0],
                                    [1.7e15 + i for i in range(1000)]])
def test_quantiles_odd_values(spark, values):
    d = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(d, ["x"], {"q": 0.3, "m": 0.5}).first()
    assert got["q"] == pytest.approx(np.quantile(values, 0.3), rel=1e-12)
    assert got["m"] == pytest.approx(np.quantile(values, 0.5), rel=1e-12)


def test_quantiles_weighted_and_empty(spark):
    d = spark.createDataFrame([(1.0, 3), (2.0, 0), (10.0, 2)], "x double, w long")
    assert exact_quantiles(d, ["x"], {"m": 0.5}, weight="w").first()["m"] == 1.0
    assert exact_quantiles(d.where("false"), ["x"], {"m": 0.5}).count() == 0


def test_lags_and_rolling_with_hot_key(spark, hot):
    d = frame(spark, hot, 5)
    s = hot.sort_values(["k", "t", "id"])
    got = features.lags(d, "v", ["k"], ["t", "id"], [1, 30]).toPandas().set_index("id").sort_index()
    for n in (1, 30):
        np.testing.assert_allclose(got[f"v_lag_{n}"], s.groupby("k")["v"].shift(n).set_axis(s["id"]).sort_index())
    got = features.rolling(d, "v", ["k"], ["t", "id"], 9, ["mean", "max"], 2).toPandas().set_index("id").sort_index()
    r = s.set_index("id").groupby("k")["v"].rolling(9, min_periods=2)
    np.testing.assert_allclose(got["v_rolling_mean_9"], r.mean().droplevel(0).sort_index(), rtol=1e-9)
    np.testing.assert_allclose(got["v_rolling_max_9"], r.max().droplevel(0).sort_index())


def test_fill_with_hot_key_and_missing_key(spark, hot):
    p = hot.copy()
    d = frame(spark, p, 5).withColumn("k", F.when(F.col("k") != 3, F.col("k")))
    s = p.sort_values(["t", "id"])
    for back in (False, True):
        got = clean.ffill(d, ["v"], ["t", "id"], ["k"], backward=back).toPandas().set_index("id").sort_index()["v"]
        g = s.groupby("k")["v"]
        np.testing.assert_allclose(got, (g.bfill() if back else g.ffill()).set_axis(s["id"]).sort_index())


def test_running_total(spark, hot):
    p = hot.fillna({"v": 0})
    got = relational.running_total(frame(spark, p, 3), ["k"], ["t", "id"], "v", "r").toPandas().set_index("id").sort_index()["r"]
    s = p.sort_values(["t", "id"])
    np.testing.assert_allclose(got, s.groupby("k")["v"].cumsum().set_axis(s["id"]).sort_index(), rtol=1e-9)


def test_ranks(spark, hot):
    got = average_ranks(frame(spark, hot, 4), "v").toPandas().set_index("value")["rank"]
    v = hot["v"].dropna()
    want = v.rank().groupby(v).first()
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_time_steps(spark, hot):
    d = spark.createDataFrame(hot[["id", "t"]]).withColumn("ts", F.timestamp_seconds("t"))
    got = time_steps(d, "ts").groupBy("gap").agg(F.sum("n").alias("n")).toPandas().set_index("gap")["n"].sort_index()
    want = hot["t"].sort_values().diff().dropna().value_counts().sort_index()
    assert got.to_dict() == want.to_dict()


def test_rolling_time(spark, hot):
    p = hot.fillna({"v": 1.0}).assign(ts=lambda x: pd.Timestamp("2024-01-01") + pd.to_timedelta(x["t"], unit="h"))
    d = spark.createDataFrame(p[["id", "k", "ts", "v"]])
    got = features.rolling_time(d, "v", ["k"], "ts", 2, ["sum"]).toPandas().set_index("id").sort_index()["v_sum_2d"]
    want = {}
    for _, g in p.groupby("k"):
        for i, t in zip(g["id"], g["t"]):
            want[i] = g.loc[(g["t"] <= t) & (g["t"] > t - 48), "v"].sum()
    np.testing.assert_allclose(got, [want[i] for i in got.index], rtol=1e-9)


def test_asof_matches_pandas(spark, hot):
    p = hot.dropna().sort_values("t")
    b = p[p["id"] % 3 == 0].drop_duplicates(["k", "t"])[["k", "t", "v"]].rename(columns={"v": "w"})
    a = p[["id", "k", "t"]]
    for direction in ("backward", "forward"):
        got = relational.asof_join(spark.createDataFrame(a), spark.createDataFrame(b), "t", ["k"], direction).toPandas().set_index("id").sort_index()["w"]
        want = pd.merge_asof(a, b, on="t", by="k", direction=direction).set_index("id").sort_index()["w"]
        np.testing.assert_allclose(got.astype(float), want)


def test_dense_codes(spark):
    d = spark.createDataFrame([(f"v{i:03d}",) for i in range(200)], "x string").repartition(6)
    got = dense_codes(d, "x").toPandas().set_index("value")["code"]
    assert [got[f"v{i:03d}"] for i in range(200)] == list(range(200))


def test_fuzzy_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcd"), rng.integers(3, 45))) for _ in range(60)]
    names = set(base)
    for b in base:  # one to four edits
        for _ in range(3):
            s = list(b)
            for _ in range(rng.integers(1, 5)):
                i = int(rng.integers(0, len(s)))
                s[i:i + 1] = [["x"], [], [s[i], "y"]][rng.integers(0, 3)]
                s = s or ["z"]
            names.add("".join(s))
    d = spark.createDataFrame([(n,) for n in names], "x string")
    for t in (70, 80, 90):
        got = fuzzy.fuzzy_pairs(d, "x", t, limit=None).select("value_a", "value_b").collect()
        a, b = d.select(F.col("x").alias("a")), d.select(F.col("x").alias("b"))
        want = a.crossJoin(b).where("a < b").where(
            1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")) >= t / 100 - 1e-12).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in want}, t


def test_fuzzy_ratio_equals_all_pairs(spark):
    from difflib import SequenceMatcher
    names = ["john smith", "jon smith", "john smyth", "johnn smith", "mary jones", "mary jonas", "usa", "us", "u.s.a", "acme corporation limited",
             "acme corporation limted", "acme corp limited", "customer#000000001", "customer#000000002", "ab" * 14, "ab" * 13 + "ac", "", "a"]
    d = spark.createDataFrame([(n,) for n in names], "x string")
    for t in (85, 90):
        got = {tuple(r) for r in fuzzy.fuzzy_pairs(d, "x", t, "ratio", limit=None).select("value_a", "value_b").collect()}
        want = {(a, b) for a in names for b in names if a < b and a and SequenceMatcher(None, a, b).ratio() >= t / 100}
        assert got == want, t


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["root"] for r in fuzzy.components(e, "a", "b").collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 43


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_level_single_partition(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "value")
    for out in (features.lags(d, "value", ["user_id"], ["ts", "event_id"]), carry(d, ["user_id"], ["ts", "event_id"], ["value"])):
        assert "SinglePartition" not in plan(out)
    # Without keys only the table of chunk ends (one row per chunk) may be gathered.
    assert plan(average_ranks(d, "value")).count("SinglePartition") <= 1


def test_fuzzy_plan_has_no_cross_join(spark, sf):
    d = spark.read.parquet(f"{sf}/customer.parquet")
    p = plan(fuzzy.fuzzy_pairs(d, "c_name", 90))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_fuzzy_keys_are_not_sent_to_the_driver(spark, tmp_path):
    """A file looks small enough to send to every task, but each of its values has many keys."""
    spark.range(300).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS v").write.parquet(str(tmp_path / "v"))
    pairs = fuzzy.fuzzy_pairs(spark.read.parquet(str(tmp_path / "v")), "v", 90)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 300 * (9 + 9 + 2) // 2


def test_scan_pushes_filter_and_columns(spark, sf):
    from tallygrid.catalog import QUERIES
    p = QUERIES["S02_parquet_scan"](spark, sf)
    text = p._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,49.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double,l_returnflag:string>" in text


def test_value_counts_combine_before_the_shuffle(spark, sf):
    p = plan(value_counts(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_returnflag", "l_tax"]))
    assert p.count("HashAggregate") >= 2


def test_hot_value_survives_every_layout(spark, hot):
    d = frame(spark, hot, 1)
    one = {tuple(r) for r in value_counts(d, ["k", "t"]).collect()}
    assert one == {tuple(r) for r in value_counts(d.repartition(9), ["k", "t"]).collect()}
