"""Every registered query against its checking SQL, whole results, smallest scale."""

import pytest

from check import compare, connect
from tallygrid.catalog import ORACLES, QUERIES

# Training is exercised once in test_ml.py; here it would only repeat.
SLOW = {"L05_train_regression", "L05_train_forecast_model", "L08_model_selection", "L11_importance", "L12_model_report", "A03_dbscan"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, sf, name):
    message, ok = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() == 11 and "median" in df.columns
