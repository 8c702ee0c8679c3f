"""Labels: class balance, label quality, class separation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, numeric_columns, quoted
from ..functions.quantiles import exact_quantiles
from ..functions.wide import melt_numbers



def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Per class: count, share, and the ratio band of the whole column."""
    c = df.where(quoted(target).isNotNull()).groupBy(quoted(target).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.max("n").alias("major"), F.min("n").alias("minor"))
    ratio = F.col("major") / F.col("minor")
    return c.crossJoin(F.broadcast(t)).select(
        "class", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("pct"),
        F.round(ratio, 1).alias("imbalance_ratio"),
        F.when(F.round(ratio, 1) < 3, "balanced_enough").when(F.round(ratio, 1) < 10, "moderate_imbalance")
        .otherwise("severe_imbalance").alias("band"))


def label_quality(df: DataFrame, label: str) -> DataFrame:
    """One row: missing, constant, nearly unique, capped, outlying and nearly constant labels."""
    num = label in numeric_columns(df)
    x = as_double(df, label) if num else quoted(label)
    vals = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    d = vals.agg(F.count(F.lit(1)).alias("n_classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("present"),
                 F.max("n").alias("top"), F.min_by("n", "v").alias("at_min"), F.max_by("n", "v").alias("at_max"))
    base = df.agg(F.count(F.lit(1)).alias("rows"))
    j = base.crossJoin(F.broadcast(d))
    if num:
        q = exact_quantiles(df, [label], {"q1": 0.25, "q3": 0.75}).agg(F.max("q1").alias("q1"), F.max("q3").alias("q3"))
        iqr = F.col("q3") - F.col("q1")
        out = vals.crossJoin(F.broadcast(q)).agg(F.coalesce(F.sum(F.when(
            (F.col("v") < F.col("q1") - 3 * iqr) | (F.col("v") > F.col("q3") + 3 * iqr), F.col("n"))), F.lit(0))
            .alias("outlier_labels"))
        j = j.crossJoin(F.broadcast(out))
    else:
        j = j.withColumn("outlier_labels", F.lit(0).cast("long"))
    n, k = F.col("rows"), F.col("n_classes")
    fl = F.lit(num)
    return j.select(
        F.lit(label).alias("label"), n.alias("total_rows"), (n - F.col("present")).alias("null_labels"), k,
        (k == 1).alias("constant_label"), (~fl & (k / n > 0.8) & (k != 1)).alias("high_cardinality_label"),
        (fl & ((F.col("at_min") / F.col("present") > 0.05) | (F.col("at_max") / F.col("present") > 0.05)))
        .alias("truncated_label"), F.col("outlier_labels"),
        (~fl & (k >= 2) & (F.col("top") / F.col("present") > 0.95)).alias("near_constant_label"))


def class_separation(df: DataFrame, label: str, cols: list[str] | None = None, max_classes: int = 10) -> DataFrame:
    """Per feature: spread of the class means over the overall spread; only for 2 to ``max_classes`` classes."""
    cols = cols or sorted(c for c in numeric_columns(df) if c != label)
    d = df.withColumn("_label", quoted(label).cast("string"))
    long = melt_numbers(d, cols, ["_label"])
    overall = long.groupBy("column").agg(F.stddev_samp("value").alias("sd"))
    per = (long.where("_label is not null").groupBy("column", "_label").agg(F.avg("value").alias("m"))
           .groupBy("column").agg(F.stddev_samp("m").alias("spread"), F.count(F.lit(1)).alias("classes")))
    return per.join(F.broadcast(overall), "column").where(f"classes between 2 and {int(max_classes)}").select(
        "column", "classes", F.round(F.coalesce(F.col("spread") / F.nullif("sd", F.lit(0.0)), F.lit(0.0)), 3)
        .alias("separation"))
