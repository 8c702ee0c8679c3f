"""Aggregates ready to be drawn; drawing itself is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, quoted
from ..functions.quantiles import QUARTILES, exact_quantiles
from .relational import sample_rows
from .stats import corr_matrix

AGGS = {"mean": F.avg, "sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def line_data(df: DataFrame, ts: str, value: str, grain: str = "month", agg: str = "sum") -> DataFrame:
    return df.groupBy(F.date_trunc(grain, quoted(ts)).cast("timestamp_ntz").alias("period")).agg(
        AGGS[agg](quoted(value)).alias("value"), F.count(F.lit(1)).alias("n"))


def histogram_data(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Rows (bin, lo, hi, n), empty bins included; the largest value belongs to the last bin."""
    x = as_double(df, col)
    b = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1))
    counts = (df.select(x.alias("_x")).where("_x is not null").crossJoin(F.broadcast(b))
              .groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    grid = b.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("_lo") + step * F.col("bin")).alias("lo"), (F.col("_lo") + step * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"))


def heatmap_data(df: DataFrame, cols: list[str]) -> DataFrame:
    return corr_matrix(df, cols)


def bar_data(df: DataFrame, cat: str, value: str, agg: str = "mean") -> DataFrame:
    """One bar per category, highest first."""
    return df.groupBy(quoted(cat).alias("category")).agg(AGGS[agg](quoted(value)).alias("value")).orderBy(F.desc("value"), "category")


def box_data(df: DataFrame, cat: str, value: str) -> DataFrame:
    """Five numbers and the outlier count per category."""
    q = exact_quantiles(df, [value], QUARTILES, by=[cat]).drop("column")
    x = as_double(df, value)
    iqr = F.col("q3") - F.col("q1")
    out = (x < F.col("q1") - 1.5 * iqr) | (x > F.col("q3") + 1.5 * iqr)
    return df.join(q, cat).groupBy(quoted(cat).alias("category")).agg(
        F.min(x).alias("min"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.max(x).alias("max"), F.count_if(out).alias("outliers"))


def scatter_data(df: DataFrame, x: str, y: str, n: int, key: list[str]) -> DataFrame:
    """n points, the same on every run."""
    d = df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
    return sample_rows(d, n, key).select(*[quoted(k) for k in key], quoted(x).alias("x"), quoted(y).alias("y"))
