"""Pair sums by blocks of columns against numpy, and the operators that go through them on wide tables."""

import numpy as np
import pandas as pd
import pytest

from tallygrid.functions import crossproducts as X
from tallygrid.operators import profile, quality, stats


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 12))
    x = base @ rng.normal(size=(12, 300)) + rng.normal(size=(700, 300)) + 1e6
    x[rng.random(x.shape) < .03] = np.nan
    x[:, 7] = 0.1
    x[:, 8] = np.nan
    return pd.DataFrame(x, columns=[f"v{i}" for i in range(300)])


def test_three_hundred_columns(spark, wide, monkeypatch):
    monkeypatch.setattr(X, "PANEL", 128)  # three passes
    got = stats.corr_matrix(spark.createDataFrame(wide).repartition(5)).toPandas()
    got = got.pivot(index="col_a", columns="col_b", values="r").loc[wide.columns, wide.columns].to_numpy()
    want = wide.corr(min_periods=2).to_numpy()
    np.fill_diagonal(want, 1.0)
    assert np.isnan(want).sum() == np.isnan(got).sum() > 0
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_same_as_an_expression_per_pair(spark, wide, monkeypatch):
    d = spark.createDataFrame(wide.iloc[:, :10])
    plain = profile.correlation_cells(d, d.columns).toPandas().set_index(["col_a", "col_b"])["r"].sort_index()
    monkeypatch.setattr(profile, "WIDE", 1)
    blocked = profile.correlation_cells(d, d.columns).toPandas().set_index(["col_a", "col_b"])["r"].sort_index()
    pd.testing.assert_series_equal(plain, blocked, atol=1e-9)


def test_vif_is_the_diagonal_of_the_inverse(spark, wide):
    full = wide.drop(columns=["v7", "v8"]).iloc[:, :120].fillna(1e6)
    got = quality.vif(spark.createDataFrame(full).repartition(3)).toPandas().set_index("column")["vif"]
    want = np.diag(np.linalg.inv(np.corrcoef(full.to_numpy(), rowvar=False)))
    np.testing.assert_allclose(got[full.columns].to_numpy(), want, rtol=1e-6)


def test_rows_sent_do_not_grow_with_the_rows_read(spark, wide):
    d = spark.createDataFrame(wide.iloc[:, :30])
    big = d.unionByName(d).unionByName(d).coalesce(1)
    c = d.columns
    assert X.pair_sums(big, c, X.centres(big, c)).count() == X.pair_sums(d, c, X.centres(d, c)).count() == 30 * 31 // 2


def test_empty_and_all_missing(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert X.correlations(none, ["a", "b"]).count() == 0
    assert quality.vif(none).count() == 0
    gone = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r["r"] for r in X.correlations(gone, ["a", "b"]).collect()] == [None]
