"""Sample-adjusted moments and safe correlation as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted skewness; 0 for a constant column, NULL below 3 values."""
    n = F.count(c).cast("double")
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis; 0 for a constant column, NULL below 4 values."""
    n = F.count(c).cast("double")
    k = F.kurtosis(c)
    adj = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * k + 6)
    return F.when(n > 3, F.coalesce(adj, F.lit(0.0)))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over pairwise complete rows; NULL where a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))
