"""Hypothesis tests: statistics from Spark aggregates, tail probabilities on the one-row result.

Every test returns ``test``, its statistic and degrees of freedom, ``p_value``
and ``significant`` (p < 0.05).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, numeric_columns, quoted
from ..functions.moments import safe_corr
from ..functions.ordering import average_ranks
from ..functions.special import p_chi2, p_f, p_kolmogorov, p_normal, p_t
from .profile import correlation_cells
from .temporal import ks_of_sides

ALPHA = 0.05


def _finish(df: DataFrame, test: str, p: Column, cols: list[str]) -> DataFrame:
    """Attach the p-value; ``significant`` is derived from it."""
    return df.withColumn("p_value", p).select(F.lit(test).alias("test"), *cols, "p_value",
                                              (F.col("p_value") < ALPHA).alias("significant"))


def _two_groups(df: DataFrame, col: str, group: str, groups: tuple | None):
    g = quoted(group)
    d = df.select(g.alias("g"), as_double(df, col).alias("v")).where("v is not null and g is not null")
    if groups is None:
        both = d.agg(F.min("g").alias("a"), F.max("g").alias("b"))
        d = d.crossJoin(F.broadcast(both)).withColumn("side", F.when(F.col("g") == F.col("a"), 0).when(F.col("g") == F.col("b"), 1))
    else:
        d = d.withColumn("side", F.when(F.col("g") == groups[0], 0).when(F.col("g") == groups[1], 1))
    return d.where("side is not null").select("side", "v")


def ttest_ind(df: DataFrame, col: str, group: str, equal_var: bool = True, groups: tuple | None = None) -> DataFrame:
    """Two independent samples, pooled or Welch. Without ``groups`` the smallest and largest label are compared."""
    d = _two_groups(df, col, group, groups)
    on = lambda s, fn: fn(F.when(F.col("side") == s, F.col("v")))
    r = d.agg(*[on(s, fn).alias(f"{n}{s}") for s in (0, 1) for n, fn in (("n", F.count), ("m", F.avg), ("s", F.var_samp))])
    n0, n1, s0, s1 = (F.col(x) for x in ("n0", "n1", "s0", "s1"))
    if equal_var:
        dof = n0 + n1 - 2
        se = F.sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / dof * (1 / n0 + 1 / n1))
    else:
        a, b = s0 / n0, s1 / n1
        dof = F.pow(a + b, F.lit(2)) / (a * a / (n0 - 1) + b * b / (n1 - 1))
        se = F.sqrt(a + b)
    r = r.withColumn("statistic", (F.col("m0") - F.col("m1")) / F.nullif(se, F.lit(0.0))).withColumn("dof", dof.cast("double"))
    return _finish(r, "t_independent" if equal_var else "t_welch", p_t(F.col("statistic"), F.col("dof")), ["statistic", "dof"])


def ttest_rel(df: DataFrame, a: str, b: str) -> DataFrame:
    x = as_double(df, a) - as_double(df, b)
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    r = r.withColumn("statistic", F.col("m") / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))).withColumn("dof", (F.col("n") - 1).cast("double"))
    return _finish(r, "t_paired", p_t(F.col("statistic"), F.col("dof")), ["statistic", "dof"])


def anova(df: DataFrame, col: str, group: str) -> DataFrame:
    d = df.select(quoted(group).alias("g"), as_double(df, col).alias("v")).where("v is not null and g is not null")
    g = d.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("s"))
    # Sums of squares about the mean of the group means, weighted: no second scan of the rows.
    r = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("s")).alias("ssw"),
              F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    ssb = F.col("q") - F.col("t") * F.col("t") / F.col("N")
    r = r.withColumn("df_between", (F.col("k") - 1).cast("double")).withColumn("df_within", (F.col("N") - F.col("k")).cast("double"))
    r = r.withColumn("statistic", ssb / F.col("df_between") / F.nullif(F.col("ssw") / F.col("df_within"), F.lit(0.0)))
    return _finish(r, "anova", p_f(F.col("statistic"), F.col("df_between"), F.col("df_within")), ["statistic", "df_between", "df_within"])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (a, b, n, row_total, col_total) of the cells that occur."""
    c = df.where(quoted(a).isNotNull() & quoted(b).isNotNull()).groupBy(
        quoted(a).cast("string").alias("a"), quoted(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra = c.groupBy("a").agg(F.sum("n").alias("row_total"))
    cb = c.groupBy("b").agg(F.sum("n").alias("col_total"))
    return c.join(ra, "a").join(cb, "b")


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories; Yates correction at one degree of freedom.

    The sum over all cells is total * (sum of n^2 / (row * column) - 1), so
    empty cells need no rows. In a 2 x 2 table every cell is equally far from
    its expectation, and the reciprocal expectations factor by margin.
    """
    t = contingency(df, a, b)
    ra = t.groupBy("a").agg(F.max("row_total").alias("r")).agg(F.count(F.lit(1)).alias("rows"), F.sum("r").alias("total"), F.sum(1 / F.col("r")).alias("ir"))
    cb = t.groupBy("b").agg(F.max("col_total").alias("c")).agg(F.count(F.lit(1)).alias("cols"), F.sum(1 / F.col("c")).alias("ic"))
    n, e = F.col("n"), F.col("row_total").cast("double") * F.col("col_total")
    r = t.crossJoin(F.broadcast(ra)).groupBy("rows", "total", "ir").agg(
        F.sum(n * n / e).alias("q"), F.max(F.abs(n - e / F.col("total"))).alias("d")).crossJoin(F.broadcast(cb))
    dof = ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("double")
    gap = F.greatest(F.col("d") - 0.5, F.lit(0.0))
    r = r.withColumn("dof", dof).withColumn("statistic", F.when(dof == 1, gap * gap * F.col("total") * F.col("ir") * F.col("ic"))
                                            .otherwise(F.col("total") * (F.col("q") - 1)))
    return _finish(r, "chi2", p_chi2(F.col("statistic"), F.col("dof")), ["statistic", "dof"])


def _corr_t(r: Column, n: Column) -> Column:
    return F.abs(r) * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = as_double(df, a), as_double(df, b)
    r = df.agg(safe_corr(x, y).alias("statistic"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"))
    return _finish(r, "pearson", p_t(_corr_t(F.col("statistic"), F.col("n")), F.col("n") - 2), ["statistic", "n"])


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows (col_a, col_b, r) for every ordered pair, the diagonal included."""
    cols = cols or numeric_columns(df)
    half = correlation_cells(df, cols)
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, r double")
    flip = half.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    return half.unionByName(flip).unionByName(diag)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; equal pairs are counted once."""
    d = df.select(as_double(df, a).alias("x"), as_double(df, b).alias("y")).where("x is not null and y is not null")
    rx = average_ranks(d, "x").select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    ry = average_ranks(d, "y").select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    p = d.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")).join(rx, "x").join(ry, "y")
    w, u, v = F.col("w"), F.col("rx"), F.col("ry")
    s = p.agg(F.sum(w).alias("n"), F.sum(w * u).alias("su"), F.sum(w * v).alias("sv"), F.sum(w * u * v).alias("suv"),
              F.sum(w * u * u).alias("suu"), F.sum(w * v * v).alias("svv"))
    n = F.col("n")
    cov = F.col("suv") - F.col("su") * F.col("sv") / n
    var = lambda q, m: F.col(q) - F.col(m) * F.col(m) / n
    s = s.withColumn("statistic", cov / F.nullif(F.sqrt(var("suu", "su") * var("svv", "sv")), F.lit(0.0)))
    return _finish(s, "spearman", p_t(_corr_t(F.col("statistic"), n), n - 2), ["statistic", "n"])


def normality(df: DataFrame, col: str) -> DataFrame:
    """Jarque-Bera from the moments (a test over the whole ordered sample does not distribute)."""
    x = as_double(df, col)
    r = df.agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"))
    r = r.withColumn("statistic", F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4))
    return _finish(r, "jarque_bera", F.exp(-F.col("statistic") / 2), ["statistic", "n"])


def _grouped_ranks(d: DataFrame, key: str) -> DataFrame:
    """Rows (key, n, rank_sum) plus the tie term, from counts per (value, key)."""
    ranks = average_ranks(d, "v").withColumnRenamed("n", "ties")
    counts = d.groupBy("v", key).agg(F.count(F.lit(1)).alias("c"))
    j = counts.join(ranks, F.col("v") == F.col("value"))
    per = j.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"))
    t = F.col("ties").cast("double")
    tie = ranks.agg(F.sum(t * t * t - t).alias("tie"))
    return per.crossJoin(F.broadcast(tie))


def mannwhitney(df: DataFrame, col: str, group: str, groups: tuple | None = None) -> DataFrame:
    """U of the first group, two-sided normal approximation with tie and continuity correction."""
    d = _two_groups(df, col, group, groups)
    per = _grouped_ranks(d, "side")
    on = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    r = per.agg(on(0, "n").alias("n0"), on(1, "n").alias("n1"), on(0, "rank_sum").alias("r0"), F.max("tie").alias("tie"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    r = r.withColumn("statistic", F.col("r0") - n0 * (n0 + 1) / 2)
    sd = F.sqrt(n0 * n1 / 12 * (n + 1 - F.col("tie") / (n * (n - 1))))
    r = r.withColumn("z", (F.greatest(F.abs(F.col("statistic") - n0 * n1 / 2) - 0.5, F.lit(0.0))) / F.nullif(sd, F.lit(0.0)))
    return _finish(r, "mann_whitney", p_normal(F.col("z")), ["statistic", "z"])


def kruskal(df: DataFrame, col: str, group: str) -> DataFrame:
    d = df.select(quoted(group).alias("g"), as_double(df, col).alias("v")).where("v is not null and g is not null")
    per = _grouped_ranks(d, "g")
    r = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"),
                F.max("tie").alias("tie"))
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    r = r.withColumn("statistic", h / F.nullif(1 - F.col("tie") / (n * n * n - n), F.lit(0.0))).withColumn("dof", (F.col("k") - 1).cast("double"))
    return _finish(r, "kruskal", p_chi2(F.col("statistic"), F.col("dof")), ["statistic", "dof"])


def ks_2samp(df: DataFrame, col: str, group: str, groups: tuple | None = None) -> DataFrame:
    d = _two_groups(df, col, group, groups).select(F.lit(col).alias("column"), F.col("v").alias("value"), "side")
    r = ks_of_sides(d, "value", "side")
    en = F.sqrt(F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    return _finish(r, "ks_two_sample", p_kolmogorov(en * F.col("statistic")), ["statistic", "n0", "n1"])
