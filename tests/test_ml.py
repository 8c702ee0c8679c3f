"""Training, selection, persistence and prediction on planted data."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import analytics, ml

SIZES = {"boosted_trees": {"maxIter": 5, "maxDepth": 3}, "random_forest": {"numTrees": 8, "maxDepth": 5}, "extra_trees": {"numTrees": 8, "maxDepth": 5}, "linear": {"maxIter": 50}}


@pytest.fixture(scope="module")
def data(spark):
    d = spark.range(300).select(
        "id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("kind"), F.expr("timestamp_seconds(id * 86400)").alias("ts"))
    d = d.withColumn("a", F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, float("inf")).otherwise(F.col("a")))
    d = d.withColumn("y", 3 * F.coalesce(F.when(F.col("a") < 100, F.col("a")), F.lit(8.0)) - 2 * F.col("b"))
    return d.withColumn("label", F.when(F.col("kind") == "x", "alpha").when(F.col("b") > 2, "beta").otherwise("gamma"))


def test_regression(spark, data, tmp_path):
    t = ml.auto_train(data, "y", "regression", ["id"], ["a", "b", "kind"], sizes=SIZES, n_folds=2)
    m = {r["metric"]: r["value"] for r in t.metrics.collect()}
    s = {r["family"]: r["cv_score"] for r in t.scores.collect()}
    assert m["r2"] > 0.8 and set(s) == {"boosted_trees", "random_forest", "extra_trees", "linear"} and t.best == max(s, key=s.get)
    assert ml.importance(t, spark).first()["feature"] == "a"
    p = str(tmp_path / "m")
    ml.save_model(t, p)
    model, meta = ml.load_model(spark, p)
    out = ml.predict(data, model, meta["features"], "guess")
    assert out.count() == 300 and out.columns == [*data.columns, "guess"]
    # Inputs come back untouched, infinities included.
    assert out.where("a = double('infinity')").count() == data.where("a = double('infinity')").count()
    assert ml.model_report(spark, p).where("section = 'scores'").count() == 4


def test_string_labels_and_training_codes(spark, data):
    t = ml.auto_train(data, "label", "classification", ["id"], ["a", "b", "kind"], families=["random_forest"], sizes=SIZES, n_folds=2)
    assert t.labels == ["alpha", "beta", "gamma"]
    m = {r["metric"]: r["value"] for r in t.metrics.collect()}
    assert m["accuracy"] > 0.9 and m["f1_weighted"] > 0.9
    # A new frame with a single category must get the codes learned in training.
    part = data.where("kind = 'x'").withColumn("kind", F.lit("x"))
    got = ml.predict(part, t.model, t.features, "guess", t.labels).groupBy("guess").count().orderBy(F.desc("count")).first()
    assert got["guess"] == "alpha"
    with pytest.raises(ValueError, match="missing feature"):
        ml.predict(data.drop("b"), t.model, t.features)


def test_time_ordered_training(spark, data):
    shuffled = data.orderBy(F.xxhash64("id"))
    s = ml.split(shuffled, "time", ts="ts").groupBy("split").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    s = {r["split"]: r for r in s.collect()}
    assert s["train"]["hi"] < s["test"]["lo"]
    f = ml.folds(shuffled, "time", 4, ts="ts").groupBy("fold").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("fold").collect()
    assert [r["fold"] for r in f] == [0, 1, 2, 3] and all(x["hi"] < y["lo"] for x, y in zip(f, f[1:]))


def test_stratified_split_keeps_shares(data):
    d = ml.split(data, "stratified", ["id"], "label").groupBy("label").agg(F.avg((F.col("split") == "test").cast("int")).alias("s"))
    assert all(abs(r["s"] - 0.2) < 0.02 for r in d.collect())


def test_too_few_rows(data):
    with pytest.raises(ValueError, match="fewer than"):
        ml.prepare(data.limit(9), ["a"], "y")


def test_forecast_has_real_trend(spark):
    d = spark.range(70).selectExpr("timestamp_seconds(id * 86400) as ts", "100 + 2D * id + if(weekday(date_from_unix_date(cast(id as int))) = 6, 50, 0) as v")
    f = ml.forecast(d, "ts", "v", 14).orderBy("date").collect()
    assert len(f) == 14
    for i, r in enumerate(f):
        want = 100 + 2 * (70 + i) + (50 if r["date"].weekday() == 6 else 0)
        assert r["predicted"] == pytest.approx(want, abs=3)


def test_oversample_balances(data):
    n = {r["label"]: r["count"] for r in ml.oversample(data, "label", ["id"]).groupBy("label").count().collect()}
    assert max(n.values()) / min(n.values()) < 1.2


def test_clusters_and_forest_find_planted_groups(spark):
    d = spark.range(600).select("id", F.when(F.col("id") < 300, F.randn(1)).otherwise(F.randn(2) + 12).alias("u"), F.randn(3).alias("w"))
    got = analytics.kmeans(d, ["u", "w"], 2).groupBy((F.col("id") < 300).alias("g")).agg(F.countDistinct("cluster").alias("k")).collect()
    assert [r["k"] for r in got] == [1, 1]
    odd = d.withColumn("u", F.when(F.col("id") == 7, 100.0).otherwise(F.col("u")))
    top = analytics.isolation_forest(odd, ["u", "w"], ["id"], 20, 600).orderBy(F.desc("anomaly_score")).limit(3).collect()
    assert 7 in [r["id"] for r in top] and all(0.5 < r["anomaly_score"] <= 1 for r in top)
    proj, comp = analytics.pca(d, ["u", "w"], 2)
    assert proj.count() == 600 and comp.agg(F.sum("explained")).first()[0] == pytest.approx(2.0)


def test_ridge_penalty_is_on_the_sum_of_squares(spark):
    import numpy as np
    from pyspark.ml import Pipeline
    d = spark.range(400).select("id", (F.col("id") % 23).cast("double").alias("a"), ((F.col("id") * 7) % 31).cast("double").alias("b"))
    d = d.withColumn("__y", 40 * F.col("a") - 3 * F.col("b") + F.sin("id") * 5)
    y = np.array([r["__y"] for r in d.orderBy("id").collect()])
    x = np.array([[r["a"], r["b"]] for r in d.orderBy("id").collect()])
    for alpha in (1.0, 200.0):
        est = ml.candidates("regression", sizes={"linear": {"alpha": alpha}}, rows=400, deviation=float(y.std()))["linear"]
        m = Pipeline(stages=[*ml.feature_stages(d, ["a", "b"], scale=True), est]).fit(d).stages[-1]
        z = (x - x.mean(0)) / x.std(0, ddof=1)
        want = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
        assert np.allclose(m.coefficients.toArray(), want, rtol=1e-4)


def test_text_feature_of_many_values(spark):
    d = spark.range(1500).select("id", F.concat(F.lit("v"), F.col("id") % 1000).alias("kind"), (F.col("id") % 7).cast("double").alias("a"))
    d = d.withColumn("y", (F.col("a") > 3).cast("string"))
    t = ml.auto_train(d, "y", "classification", ["id"], ["kind", "a"], families=["random_forest", "linear"], sizes=SIZES, n_folds=2)
    assert {r["metric"]: r["value"] for r in t.metrics.collect()}["accuracy"] > 0.9
    assert {r["feature"] for r in ml.importance(t, spark).collect()} == {"kind", "a"}


def test_model_selection_is_registered_whole(spark, monkeypatch, tmp_path):
    """The query compares all families at their default sizes over all folds and rows."""
    from tallygrid.catalog import QUERIES
    rows = [(i, f"{i % 5}-URGENT", 100.0 * i, datetime.date(1995, 1 + i % 12, 1)) for i in range(40)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    seen = []

    def train(df, target, task, key, features=None, ts=None, families=None, sizes=None, n_folds=5, seed=42):
        seen.append((df.count(), families, ml.candidates(task, sizes=sizes), n_folds))
        return ml.Trained(None, task, "linear", features, target, df.sparkSession.range(1), None)

    monkeypatch.setattr(ml, "auto_train", train)
    QUERIES["L08_model_selection"](spark, str(tmp_path))
    (n, families, models, n_folds), = seen
    assert n == 40 and families is None and n_folds == 5
    boosted, forest, extra, linear = (models[k] for k in ("boosted_trees", "random_forest", "extra_trees", "linear"))
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), forest.getNumTrees(), forest.getMaxDepth(), linear.getMaxIter()) == (200, 6, 150, 10, 1000)
    assert (extra.getOrDefault("numTrees"), extra.getOrDefault("maxDepth")) == (150, 10)
