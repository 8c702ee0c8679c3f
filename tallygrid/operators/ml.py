"""Model training, selection, metrics, persistence, prediction and forecasting on Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, IndexToString, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import NAME_NOT_FEATURE, as_double, name_matches, numeric_columns, quoted, string_columns
from ..functions.ordering import micros, null_safe_join
from ..functions.quantiles import exact_quantiles, one_row
from ..session import cut_lineage
from .clean import resample
from .extratrees import ExtraTrees
from .features import fold_of, lags as lagged
from .temporal import time_split

# --- Fixed values: default sizes of the model families --------------------------------------
DEFAULTS = {"boosted_trees": {"maxIter": 200, "stepSize": 0.1, "maxDepth": 6},
            "random_forest": {"numTrees": 150, "maxDepth": 10}, "extra_trees": {"numTrees": 150, "maxDepth": 10}, "linear": {"maxIter": 1000, "alpha": 1.0}}
MIN_ROWS = 10
# -------------------------------------------------------------------------------------------


def select_features(df: DataFrame, target: str, ts: str | None = None, features: list[str] | None = None,
                    mode: str = "token") -> list[str]:
    """The given features that exist, else numeric columns that are not target, time or identifier."""
    if features:
        return [c for c in features if c in df.columns]
    return [c for c in numeric_columns(df) if c not in (target, ts) and not name_matches(c, NAME_NOT_FEATURE, mode)]


def prepare(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rows with a target; infinities in the features read as missing. Fails below ten rows."""
    numbers = set(numeric_columns(df))
    inf = float("inf")
    clean = lambda c: F.when(~as_double(df, c).isin(inf, -inf), as_double(df, c))
    out = df.select(*[(clean(c) if c in numbers and c in features else quoted(c)).alias(c) for c in df.columns])
    out = out.where(quoted(target).isNotNull())
    if out.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"fewer than {MIN_ROWS} usable rows")
    return out


def feature_stages(df: DataFrame, features: list[str], scale: bool = False) -> list:
    """Category codes, medians and assembly as stages that are fitted on training rows only.

    Codes are numbers to the models, not categories, so a text of many values
    does not run into the trees' limit of categories.
    """
    texts = [c for c in features if c in string_columns(df)]
    nums = [c for c in features if c not in texts]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__code", handleInvalid="keep", stringOrderType="alphabetAsc")
              for c in texts]
    if texts:  # an expression drops the mark of a category
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"`{c}__code` + 0D AS `{c}__number`" for c in texts) + " FROM __THIS__"))
    if nums:
        stages.append(Imputer(inputCols=nums, outputCols=[f"{c}__filled" for c in nums], strategy="median"))
    stages.append(VectorAssembler(inputCols=[f"{c}__filled" for c in nums] + [f"{c}__number" for c in texts], outputCol="__x"))
    if scale:
        stages.append(StandardScaler(inputCol="__x", outputCol="__xs", withMean=True, withStd=True))
    return stages


def split(df: DataFrame, kind: str = "random", key: list[str] = (), target: str | None = None, ts: str | None = None,
          test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split`` train/test: by a hash of the key, the same per class, or by time."""
    if kind == "time":
        return time_split(df, ts, 1 - test)
    u = fold_of([quoted(k) for k in key], 1000000, seed)
    if kind == "random":
        return df.withColumn("split", F.when(u < test * 1000000, "test").otherwise("train"))
    d = df.withColumn("_u", u)
    cut = exact_quantiles(d, ["_u"], {"_cut": test}, by=[target]).drop("column")
    return d.join(cut, target, "left").withColumn(
        "split", F.when(F.col("_u") < F.col("_cut"), "test").otherwise("train")).select(*df.columns, "split")


def folds(df: DataFrame, kind: str = "random", n: int = 5, key: list[str] = (), target: str | None = None,
          ts: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..n-1: by hash, by hash quantiles inside each class, or by time quantiles.

    Time folds are evaluated expanding: fold i is tested on rows of fold i after
    training on the folds before it.
    """
    u = fold_of([quoted(k) for k in key], 1000000, seed) if key else None
    if kind == "random":
        return df.withColumn("fold", (u % n).cast("int"))
    probs = {f"_q{i}": i / n for i in range(1, n)}
    edges = [F.col(q) for q in probs]
    if kind == "time":
        d = df.withColumn("_u", micros(df, ts))
        d = d.crossJoin(F.broadcast(one_row(exact_quantiles(d, ["_u"], probs), *probs)))
        f = sum([(F.col("_u") > e).cast("int") for e in edges], F.lit(0))
    else:
        d = df.withColumn("_u", u)
        d = d.join(exact_quantiles(d, ["_u"], probs, by=[target]).drop("column"), target, "left")
        f = sum([(F.col("_u") > e).cast("int") for e in edges], F.lit(0))
    return d.withColumn("fold", F.coalesce(f, F.lit(0)).cast("int")).select(*df.columns, "fold")


def candidates(task: str, classes: int = 2, sizes: dict | None = None, seed: int = 42, rows: int = 1, deviation: float = 1.0) -> dict:
    """Estimators by family.

    The linear penalty ``alpha`` belongs to the sum of squared errors (or of log
    losses) over ``rows``; Spark takes it on the mean loss, and for regression in
    units of the label's (population) standard ``deviation``.
    """
    s = {k: {**v, **(sizes or {}).get(k, {})} for k, v in DEFAULTS.items()}
    lin = s["linear"]
    if task == "regression":
        return {"boosted_trees": GBTRegressor(featuresCol="__x", labelCol="__y", seed=seed, **s["boosted_trees"]),
                "random_forest": RandomForestRegressor(featuresCol="__x", labelCol="__y", seed=seed, **s["random_forest"]),
                "extra_trees": ExtraTrees(featuresCol="__x", labelCol="__y", seed=seed, **s["extra_trees"]),
                "linear": LinearRegression(featuresCol="__xs", labelCol="__y", elasticNetParam=0.0, standardization=False,
                                           maxIter=lin["maxIter"], regParam=lin["alpha"] * deviation / rows)}
    gbt = GBTClassifier(featuresCol="__x", labelCol="__y", seed=seed, **s["boosted_trees"])
    return {"boosted_trees": gbt if classes <= 2 else OneVsRest(classifier=gbt, featuresCol="__x", labelCol="__y"),
            "random_forest": RandomForestClassifier(featuresCol="__x", labelCol="__y", seed=seed, **s["random_forest"]),
            "extra_trees": ExtraTrees(featuresCol="__x", labelCol="__y", classes=max(classes, 2), seed=seed, **s["extra_trees"]),
            "linear": LogisticRegression(featuresCol="__xs", labelCol="__y", standardization=False, maxIter=lin["maxIter"],
                                         regParam=lin["alpha"] / rows)}


@dataclass
class Trained:
    model: PipelineModel
    task: str
    best: str
    features: list[str]
    target: str
    scores: DataFrame          # family, cv_score (negative MAE or weighted F1)
    metrics: DataFrame         # metric, value on the held-out rows
    labels: list[str] = field(default_factory=list)


def auto_train(df: DataFrame, target: str, task: str, key: list[str], features: list[str] | None = None,
               ts: str | None = None, families: list[str] | None = None, sizes: dict | None = None, n_folds: int = 5,
               seed: int = 42) -> Trained:
    """Hold out a fifth, choose the family by cross-validation on the rest, measure it, refit on everything.

    Everything learned from data (category codes, medians, scaling) is a stage
    of the pipeline, so each fold and the hold-out see only training values.
    """
    feats = select_features(df, target, ts, features)
    if not feats:
        raise ValueError("no usable feature columns")
    timed = ts is not None and task == "regression"
    d = prepare(df.select(*dict.fromkeys([*feats, target, *key, *([ts] if ts else [])])), feats, target)
    labels: list[str] = []
    if task == "regression":
        d = d.withColumn("__y", as_double(d, target))
    else:
        index = StringIndexer(inputCol="__label", outputCol="__y", stringOrderType="alphabetAsc")
        d = d.withColumn("__label", quoted(target).cast("string"))
        fitted = index.fit(d)
        labels = list(fitted.labels)
        d = fitted.transform(d)
    kind = "time" if timed else "random" if task == "regression" else "stratified"
    # Trees and cross-validation read the rows many times: features, label and split are written once.
    by_class = "__y" if kind == "stratified" else None
    d = cut_lineage(split(d, kind, key, by_class, ts, seed=seed))
    train = cut_lineage(folds(d.where("split = 'train'"), kind, n_folds, key, by_class, ts, seed + 1))
    test = d.where("split = 'test'")
    ev = (RegressionEvaluator(labelCol="__y", metricName="mae") if task == "regression"
          else MulticlassClassificationEvaluator(labelCol="__y", metricName="f1"))
    sign = -1.0 if task == "regression" else 1.0
    size = d.agg(F.count("__y").alias("n"), F.stddev_pop("__y").alias("s")).first()
    est = {n: e for n, e in candidates(task, len(labels), sizes, seed, max(size["n"], 1), size["s"] or 1.0).items() if not families or n in families}
    scores, pipes = {}, {}
    for name, e in est.items():
        pipes[name] = Pipeline(stages=[*feature_stages(d, feats, scale=name == "linear"), e])
        if timed:
            got = []
            for i in range(1, n_folds):
                m = pipes[name].fit(train.where(F.col("fold") < i))
                got.append(ev.evaluate(m.transform(train.where(F.col("fold") == i))))
            scores[name] = float(sign * sum(got) / len(got))
        else:
            cv = CrossValidator(estimator=pipes[name], estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev,
                                numFolds=n_folds, foldCol="fold", parallelism=2)
            scores[name] = float(sign * cv.fit(train).avgMetrics[0])
    best = max(scores, key=scores.get)
    held = pipes[best].fit(train).transform(test)
    metrics = (regression_metrics(held, "__y") if task == "regression" else classification_metrics(held, "__y"))
    # The held-out rows are scored before the refit so that the numbers stay honest.
    rows = [(r["metric"], r["value"]) for r in metrics.collect()]
    spark = df.sparkSession
    final = pipes[best].fit(d)
    return Trained(final, task, best, feats, target, spark.createDataFrame(list(scores.items()), "family string, cv_score double"),
                   spark.createDataFrame(rows, "metric string, value double"), labels)


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Rows (metric, value): mae, r2 and, when every label is positive, mape."""
    y, p = as_double(pred, label), as_double(pred, prediction)
    r = pred.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(y - p)).alias("mae"), F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("v"),
        F.count(F.lit(1)).alias("n"), F.min(y).alias("lo"), F.avg(F.abs((y - p) / F.nullif(y, F.lit(0.0)))).alias("mape"))
    rows = F.array(F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")),
                   F.struct(F.lit("r2").alias("metric"), (1 - F.col("sse") / F.nullif(F.col("v") * F.col("n"), F.lit(0.0))).alias("value")),
                   F.struct(F.lit("mape").alias("metric"), F.when(F.col("lo") > 0, F.col("mape") * 100).alias("value")))
    return r.select(F.inline(rows)).where("value is not null")


def confusion(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(quoted(label).alias("label"), quoted(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Rows (metric, value): accuracy and F1 weighted by class size; classes never predicted score 0."""
    c = confusion(pred, label, prediction)
    truth = c.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("t"))
    guess = c.groupBy(F.col("prediction").alias("k")).agg(F.sum("n").alias("g"))
    hit = c.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("k"), F.col("n").alias("h"))
    j = truth.join(guess, "k", "left").join(hit, "k", "left").na.fill(0, ["g", "h"])
    f1 = F.col("t") * 2.0 * F.col("h") / (F.col("t") + F.col("g"))
    r = j.agg(F.sum("h").alias("h"), F.sum("t").alias("t"), F.sum(f1).alias("f"))
    return r.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("metric"), (F.col("h") / F.col("t")).alias("value")),
        F.struct(F.lit("f1_weighted").alias("metric"), (F.col("f") / F.col("t")).alias("value")))))


def importance(trained: Trained, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Rows (feature, importance): tree importances or absolute coefficients, highest first."""
    last = trained.model.stages[-1]
    vec = next(s for s in trained.model.stages if isinstance(s, VectorAssembler))
    names = [n.rsplit("__", 1)[0] for n in vec.getInputCols()]
    models = getattr(last, "models", None) or [last]
    total = [0.0] * len(names)
    for m in models:
        if hasattr(m, "featureImportances"):
            v = m.featureImportances.toArray()
        elif hasattr(m, "coefficientMatrix"):
            v = abs(m.coefficientMatrix.toArray()).sum(axis=0)
        else:
            v = abs(m.coefficients.toArray())
        total = [a + float(b) / len(models) for a, b in zip(total, v)]
    rows = sorted(zip(names, total), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def save_model(t: Trained, path: str) -> None:
    """The pipeline and one row of metadata beside it."""
    spark = t.scores.sparkSession
    t.model.write().overwrite().save(f"{path}/pipeline")
    meta = {"task": t.task, "best": t.best, "features": t.features, "target": t.target, "labels": t.labels,
            "metrics": {r["metric"]: r["value"] for r in t.metrics.collect()},
            "scores": {r["family"]: r["cv_score"] for r in t.scores.collect()},
            "importance": {r["feature"]: r["importance"] for r in importance(t, spark).collect()}}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/pipeline"), json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])


def model_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows (section, name, value) of a saved model."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    rows = [("model", k, str(meta[k])) for k in ("task", "best", "target")]
    rows += [(s, n, repr(v)) for s in ("metrics", "scores", "importance") for n, v in meta[s].items()]
    return spark.createDataFrame(rows, "section string, name string, value string")


def predict(df: DataFrame, model: PipelineModel, features: list[str], output: str = "prediction",
            labels: list[str] | None = None) -> DataFrame:
    """``df`` with the prediction; medians and category codes are those of the training rows."""
    gone = [c for c in features if c not in df.columns]
    if gone:
        raise ValueError(f"missing feature columns: {gone}")
    inf = float("inf")
    raw = {f"__in_{c}": quoted(c) for c in features}
    numbers = set(numeric_columns(df))
    d = df.withColumns(raw).withColumns({c: F.when(~as_double(df, c).isin(inf, -inf), as_double(df, c))
                                         for c in features if c in numbers})
    out = model.transform(d)
    p = F.col("prediction")
    if labels:
        out = IndexToString(inputCol="prediction", outputCol="__text", labels=labels).transform(out)
        p = F.col("__text")
    keep = [F.col(f"__in_{c}").alias(c) if c in features else quoted(c) for c in df.columns if c != output]
    return out.select(*keep, p.alias(output))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Rows (class, n, weight): rows / (classes x class rows)."""
    c = df.where(quoted(y).isNotNull()).groupBy(quoted(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(t)).select("class", "n", F.round(F.col("t") / (F.col("k") * F.col("n")), 6).alias("weight"))


def oversample(train: DataFrame, y: str, key: list[str], seed: int = 42) -> DataFrame:
    """Minority classes repeated to about the size of the largest; the hash of the key decides who gets one more.

    Only for training rows, after the split.
    """
    c = train.groupBy(quoted(y).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    f = c.crossJoin(F.broadcast(c.agg(F.max("_n").alias("_top")))).select("_c", (F.col("_top") / F.col("_n")).alias("_f"))
    u = fold_of([quoted(k) for k in key], 1000000, seed) / 1e6
    copies = (F.floor("_f") + (u < F.col("_f") - F.floor("_f")).cast("long")).cast("int")
    return train.join(f, quoted(y) == F.col("_c")).withColumn("_i", F.explode(F.sequence(F.lit(1), copies))).drop("_c", "_f", "_i")


def forecast(df: DataFrame, ts: str, value: str, periods: int = 30, by: list[str] = (), agg: str = "sum") -> DataFrame:
    """Rows (by.., date, predicted): linear trend plus weekday effect of each daily series, ``periods`` days ahead."""
    by = list(by)
    d = _daily(df, ts, value, by, agg)
    d = d.withColumn("t", F.unix_date(F.col("period").cast("date")).cast("double")).withColumn("wd", F.weekday("period"))
    # Days are counted from the first day of the series: the fit then has no large offsets.
    d = d.join(d.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1")), by) if by else d.crossJoin(
        F.broadcast(d.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))))
    d = d.withColumn("x", F.col("t") - F.col("t0"))
    fit = d.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"),
                             F.max("t0").alias("t0"), F.max("t1").alias("t1"))
    j = d.drop("t0", "t1").join(fit, by) if by else d.drop("t0", "t1").crossJoin(F.broadcast(fit))
    season = j.groupBy(*by, "wd").agg(F.avg(F.col("y") - F.col("base") - F.col("slope") * F.col("x")).alias("effect"))
    ahead = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn(
        "date", F.date_from_unix_date((F.col("t1") + F.col("h")).cast("int"))).withColumn("wd", F.weekday("date"))
    out = ahead.join(season, [*by, "wd"], "left")
    return out.select(*by, "date", (F.col("base") + F.col("slope") * (F.col("t1") - F.col("t0") + F.col("h"))
                                    + F.coalesce("effect", F.lit(0.0))).alias("predicted"))


def _daily(df: DataFrame, ts: str, value: str, by: list[str], agg: str) -> DataFrame:
    """Rows (by.., period, y): each series by day, from its first day to its last, days without rows at 0."""
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count}[agg]
    return resample(df, ts, "day", by, {"y": fn(quoted(value))}).na.fill(0.0, ["y"])


def _least_squares(train: DataFrame, names: list[str]) -> tuple[float, list[float]]:
    """Intercept and slopes of ``y`` from one row of moments; the least solution where lags are collinear."""
    pairs = [(a, b) for i, a in enumerate(names) for b in [*names[i:], "y"]]
    m = train.agg(*[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs], *[F.avg(c).alias(c) for c in [*names, "y"]]).first().asDict()
    if m["y"] is None:
        return 0.0, [0.0] * len(names)
    cov = np.array([[m.get(f"{a}|{b}", m.get(f"{b}|{a}")) for b in names] for a in names])
    slopes = np.linalg.lstsq(cov, np.array([m[f"{a}|y"] for a in names]), rcond=1e-12)[0]
    return float(m["y"] - slopes @ np.array([m[a] for a in names])), slopes.tolist()


def forecast_lags(df: DataFrame, ts: str, value: str, periods: int = 30, by: list[str] = (), lags: tuple[int, ...] = (1, 7),
                  agg: str = "sum", estimator=None) -> DataFrame:
    """Rows (by.., date, predicted): daily series carried ``periods`` days ahead by a model of their own earlier values.

    One model is fitted over the days of all series that have all ``lags``
    before them. A prediction then joins the values the next one looks back on.
    A series enters the recursion as one row with its last ``max(lags)`` values,
    which count 0 before its first day, as missing days do; it is never gathered.

    Without an ``estimator`` the model is least squares and the whole horizon is
    one expression over an array. A Spark ML regressor (of ``__x`` and ``__y``)
    is asked once for each day ahead, with every series as one row.
    """
    by, most = list(by), max(lags)
    names = [f"y_lag_{n}" for n in lags]
    d = cut_lineage(_daily(df, ts, value, by, agg))
    train = lagged(d, "y", by, ["period"], list(lags)).where(F.col(f"y_lag_{most}").isNotNull())
    day = F.unix_date(F.col("period").cast("date"))
    ends = d.groupBy(*by).agg(F.max(day).alias("last"))
    tail = null_safe_join(d.withColumn("t", day), ends, by) if by else d.withColumn("t", day).crossJoin(F.broadcast(ends))
    tail = tail.where(F.col("t") > F.col("last") - most).groupBy(*by).agg(  # at most ``most`` rows of each series
        F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("t", "y"))).alias("seen"))
    # Oldest first, padded in front.
    state = F.concat(F.array_repeat(F.lit(0.0), most - F.size("seen")), F.transform("seen", lambda x: x["y"].cast("double")))
    series = tail.select(*by, "last", state.alias("state"))
    if estimator is None:
        base, slopes = _least_squares(train, names)

        def step(acc: Column, _: Column) -> Column:
            nxt = sum((F.lit(b) * acc["state"][most - n] for b, n in zip(slopes, lags)), F.lit(base))
            return F.struct(F.concat(F.slice(acc["state"], 2, most - 1), F.array(nxt)).alias("state"), F.concat(acc["out"], F.array(nxt)).alias("out"))

        start = F.struct(F.col("state"), F.expr("CAST(array() AS array<double>)").alias("out"))
        run = F.aggregate(F.sequence(F.lit(1), F.lit(periods)), start, step)["out"]
    else:
        x = VectorAssembler(inputCols=names, outputCol="__x")
        model = estimator.fit(x.transform(train.withColumn("__y", F.col("y"))))
        series = series.withColumn("out", F.expr("CAST(array() AS array<double>)"))
        for i in range(periods):
            asked = series.withColumns({c: F.element_at("state", most - n + 1) for c, n in zip(names, lags)})
            series = model.transform(x.transform(asked)).select(
                *by, "last", F.concat(F.slice("state", 2, most - 1), F.array("prediction")).alias("state"), F.concat("out", F.array("prediction")).alias("out"))
            if i % 10 == 9:
                series = cut_lineage(series)
        run = F.col("out")
    out = series.select(*by, "last", F.posexplode(run).alias("h", "predicted"))
    return out.select(*by, F.date_from_unix_date(F.col("last") + F.col("h") + 1).alias("date"), "predicted")


def train_per_group(df: DataFrame, by: list[str], fn, schema: str) -> DataFrame:
    """A user's model per series: pandas frame in, pandas frame out.

    A series goes to one call as a whole, so aggregate to the series' calendar
    before (see ``resample``).
    """
    return df.groupBy(*by).applyInPandas(fn, schema)
