"""Reports over tables without a matching column, and over tables without rows."""

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import analytics, clean, features, merge, ml, profile as P, quality as Q, temporal
from tallygrid.plans import summaries as S

REPORTS = {
    "correlated_pairs": P.correlated_pairs, "duplicate_columns": P.duplicate_columns, "schema_anomalies": P.schema_anomalies,
    "pk_violations": P.pk_violations, "distributions": P.distributions, "missing_report": P.missing_report,
    "datetime_report": lambda d: P.datetime_report(d, "2024-01-01"), "date_order": Q.date_order_violations,
    "financial": Q.financial_violations, "encoding": Q.encoding_issues, "ranges": Q.validate_ranges, "scaling": Q.scaling_report,
    "packed": Q.packed_columns, "units": Q.unit_issues, "suspicions": Q.unit_suspicions,
    "validate_features": lambda d: Q.validate_features(d, ["absent", "gone"]),
    "key_uniqueness": lambda d: S.key_uniqueness({"t": d}), "time_grain": lambda d: S.time_grain({"t": d}),
    "granularity": lambda d: S.granularity({"t": d, "u": d}), "suggest_joins": lambda d: merge.suggest_joins({"t": d, "u": d.toDF("other")}),
}


@pytest.mark.parametrize("name", REPORTS)
def test_without_a_matching_column(spark, name):
    d = spark.createDataFrame([(True,), (None,)], "ok boolean")
    got = REPORTS[name](d)
    rows = got.collect()
    assert got.columns and (name in ("schema_anomalies", "missing_report", "validate_features", "granularity") or not rows)
    if name == "validate_features":
        assert [(r["column"], r["status"]) for r in rows] == [("absent", "missing"), ("gone", "missing")]


FULL = "order_id long, cost double, revenue double, profit double, start_date timestamp_ntz, end_date timestamp_ntz, name string, note string"


@pytest.mark.parametrize("name", [n for n in REPORTS if n != "suggest_joins"])
def test_without_rows(spark, name):
    got = REPORTS[name](spark.createDataFrame([], FULL))
    got.collect()


EMPTY_TYPES = ["correlated_pairs", "duplicate_columns", "pk_violations", "distributions", "datetime_report", "date_order", "financial",
               "encoding", "ranges", "scaling", "packed", "units", "key_uniqueness", "time_grain"]


@pytest.mark.parametrize("name", EMPTY_TYPES)
def test_empty_reports_keep_their_types(spark, name):
    none, some = spark.createDataFrame([(True,)], "ok boolean"), spark.createDataFrame([], FULL)
    assert REPORTS[name](none).dtypes == REPORTS[name](some).dtypes


MISSING = {
    "clip": lambda d: clean.clip(d, "x"), "clip_quantile": lambda d: clean.clip(d, "x", "quantile"), "flag": lambda d: clean.flag(d, "x", "outlier"),
    "log1p": lambda d: clean.log1p(d, "x"), "impute": lambda d: clean.impute(d, {"x": "median"}),
    "tiers": lambda d: analytics.tiers(d, "x", {"a": 0.5}), "z": lambda d: analytics.anomalies(d, "x", "g"),
    "iqr": lambda d: analytics.anomalies(d, "x", "g", "iqr"), "robust": lambda d: analytics.anomalies(d, "x", "g", "robust"),
    "bin_width": lambda d: features.bin_width(d, "x", 3), "bin_quantile": lambda d: features.bin_quantile(d, "x", 3),
    "time_split": lambda d: temporal.time_split(d, "t"), "time_folds": lambda d: ml.folds(d, "time", 3, ts="t"),
}


@pytest.mark.parametrize("name", MISSING)
def test_an_all_missing_column_loses_no_row(spark, name):
    d = spark.range(7).select("id", F.lit(None).cast("double").alias("x"), F.lit(None).cast("timestamp_ntz").alias("t"),
                              F.when(F.col("id") < 3, "g").alias("g"))
    assert sorted(r["id"] for r in MISSING[name](d).collect()) == list(range(7))


def test_limit_zero_is_a_limit(spark):
    d = spark.createDataFrame([("g", 1.0), ("g", 2.0), (None, 1.0), (None, 5.0)], "g string, x double")
    assert all(r["is_anomaly"] and r["score"] is not None for r in analytics.anomalies(d, "x", "g", limit=0).collect())


def test_digests_of_rows_tell_missing_values_apart(spark):
    from tallygrid.functions.wide import duplicate_rows
    d = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None), ("a", "b"), (None, None), (None, None)], "x string, y string")
    assert tuple(duplicate_rows(d).first()) == (7, 3, 5)
