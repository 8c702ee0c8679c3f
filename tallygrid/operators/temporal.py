"""Time columns: gaps, monthly signal, chronological split, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, numeric_columns, quoted, string_columns
from ..functions.dates import parse_any
from ..functions.ordering import micros, running_before, time_steps
from ..functions.quantiles import exact_quantiles, one_row
from ..functions.special import p_kolmogorov


def _timed(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, parse_any(quoted(ts))) if ts in string_columns(df) else df


def temporal_gaps(df: DataFrame, ts: str) -> DataFrame:
    """One row: usable timestamps, span, median and largest step, steps over 5 medians."""
    d = _timed(df, ts)
    us = micros(d, ts)
    base = d.agg(F.count(F.lit(1)).alias("total_rows"), F.count(us).alias("valid_timestamps"),
                 F.min(us).alias("lo"), F.max(us).alias("hi"))
    steps = time_steps(d, ts)
    med = exact_quantiles(steps, ["gap"], {"median_gap": 0.5}, weight="n").drop("column")
    big = steps.crossJoin(F.broadcast(med)).agg(
        F.max("median_gap").alias("median_gap"), F.max("gap").alias("max_gap"),
        F.sum(F.when(F.col("gap") > 5 * F.col("median_gap"), F.col("n")).otherwise(0)).alias("gaps_5x"))
    return base.crossJoin(F.broadcast(big)).select(
        "total_rows", "valid_timestamps", (F.col("total_rows") - F.col("valid_timestamps")).alias("unparseable"),
        F.floor((F.col("hi") - F.col("lo")) / 86400e6).alias("span_days"),
        F.round("median_gap", 6).alias("median_gap_s"), F.round("max_gap", 6).alias("max_gap_s"),
        F.col("gaps_5x").cast("long").alias("gaps_over_5_medians"))


def monthly_signal(df: DataFrame, ts: str) -> DataFrame:
    """Rows (month, n, cv, uneven): rows per calendar month and their coefficient of variation."""
    d = _timed(df, ts)
    m = d.where(quoted(ts).isNotNull()).groupBy(F.month(ts).cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    cv = m.agg((F.stddev_samp("n") / F.greatest(F.avg("n"), F.lit(1.0))).alias("cv"))
    return m.crossJoin(F.broadcast(cv)).select("month", "n", F.round("cv", 6).alias("cv"),
                                               F.coalesce(F.col("cv") > 0.3, F.lit(False)).alias("uneven"))


def split_point(df: DataFrame, ts: str, q: float = 0.8) -> DataFrame:
    """One row (train_end): the moment below which a share ``q`` of the timestamps lies."""
    us = df.select(micros(df, ts).alias("t"))
    return exact_quantiles(us, ["t"], {"q": q}).select(
        F.timestamp_micros(F.floor("q")).cast("timestamp_ntz").alias("train_end"))


def time_split(df: DataFrame, ts: str, q: float = 0.8) -> DataFrame:
    """``df`` with ``split`` = train up to the split point, test after it; rows without a time are train."""
    us = df.select(micros(df, ts).alias("t"))
    cut = one_row(exact_quantiles(us, ["t"], {"_cut": q}), "_cut")
    return df.crossJoin(F.broadcast(cut)).withColumn(
        "split", F.when(micros(df, ts) > F.col("_cut"), "test").otherwise("train")).drop("_cut")


def ks_of_sides(sides: DataFrame, value: str, side: str) -> DataFrame:
    """One row per ``column``: two-sample KS between side 0 and side 1.

    ``sides`` has (column, value, side); counts per distinct value are cumulated
    in chunks of the value range.
    """
    hist = sides.groupBy("column", value).agg(
        F.sum((F.col(side) == 0).cast("long")).alias("n0"), F.sum((F.col(side) == 1).cast("long")).alias("n1"))
    cum = running_before(hist, value, ["n0", "n1"], by=["column"])
    tot = sides.groupBy("column").agg(F.sum((F.col(side) == 0).cast("long")).alias("t0"),
                                      F.sum((F.col(side) == 1).cast("long")).alias("t1"))
    gap = F.abs((F.col("before_n0") + F.col("n0")) / F.col("t0") - (F.col("before_n1") + F.col("n1")) / F.col("t1"))
    return cum.join(F.broadcast(tot), "column").groupBy("column").agg(
        F.max(gap).alias("statistic"), F.max("t0").alias("n0"), F.max("t1").alias("n1"))


def ks_drift(df: DataFrame, ts: str, cols: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Per numeric column: KS distance between the first and the last quarter of the rows in time.

    The quarters are bounded by the quartiles of the timestamps, so no global
    ordering of the rows is needed.
    """
    cols = cols or numeric_columns(df)
    us = micros(df, ts)
    d = df.select(us.alias("_t"), *[as_double(df, c).alias(c) for c in cols])
    q = exact_quantiles(d, ["_t"], {"a": 0.25, "b": 0.75}).drop("column")
    sided = d.crossJoin(F.broadcast(q)).withColumn(
        "side", F.when(F.col("_t") <= F.col("a"), 0).when(F.col("_t") > F.col("b"), 1)).where("side is not null")
    long = sided.unpivot(["side"], [quoted(c) for c in cols], "column", "value").where("value is not null")
    ks = ks_of_sides(long, "value", "side")
    means = long.groupBy("column").agg(F.avg(F.when(F.col("side") == 0, F.col("value"))).alias("mean_first"),
                                       F.avg(F.when(F.col("side") == 1, F.col("value"))).alias("mean_last"))
    en = F.sqrt(F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    out = ks.join(F.broadcast(means), "column").where((F.col("n0") > 10) & (F.col("n1") > 10))
    out = out.withColumn("p_value", p_kolmogorov(en * F.col("statistic")))
    return out.select("column", "n0", "n1", F.round("statistic", 6).alias("statistic"), "p_value",
                      (F.col("p_value") < alpha).alias("drift"), F.round("mean_first", 4).alias("mean_first"),
                      F.round("mean_last", 4).alias("mean_last"))
