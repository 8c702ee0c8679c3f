"""Clustering, segments, cohorts, anomalies, association rules, decomposition."""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.kinds import as_double, quoted
from ..functions.quantiles import exact_quantiles, one_row
from ..session import cut_lineage
from .clean import resample


def _scaled(df: DataFrame, cols: list[str], mean: bool = True) -> tuple[DataFrame, object]:
    d = df.withColumns({f"_x{i}": as_double(df, c) for i, c in enumerate(cols)})
    d = d.where(reduce(lambda a, b: a & b, [F.col(f"_x{i}").isNotNull() for i in range(len(cols))]))
    p = Pipeline(stages=[VectorAssembler(inputCols=[f"_x{i}" for i in range(len(cols))], outputCol="_raw"),
                         StandardScaler(inputCol="_raw", outputCol="_vec", withMean=mean, withStd=True)])
    return d, p.fit(d)


def _cluster(df, cols, algo):
    d, scaler = _scaled(df, cols)
    s = scaler.transform(d)
    model = algo.setFeaturesCol("_vec").setPredictionCol("cluster").fit(s)
    return model.transform(s).drop("_raw", "_vec", *[f"_x{i}" for i in range(len(cols))])


def kmeans(df: DataFrame, cols: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster``, on standardised columns; rows with a missing value are left out."""
    return _cluster(df, cols, KMeans(k=k, seed=seed))


def bisecting(df: DataFrame, cols: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Top-down hierarchy in place of bottom-up merging, which needs all pairs."""
    return _cluster(df, cols, BisectingKMeans(k=k, seed=seed))


def cluster_profile(clustered: DataFrame, cols: list[str], label: str | None = None) -> DataFrame:
    """Size, means and (with a 0/1 label) its share per cluster."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c)).alias(f"mean_{c}") for c in cols]]
    if label:
        aggs.append(F.avg(quoted(label).cast("double")).alias(f"share_{label}"))
    return clustered.groupBy("cluster").agg(*aggs)


def pca(df: DataFrame, cols: list[str], k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(projection, components): rows with ``pc1..pck``; rows (component, column, loading, explained)."""
    d, scaler = _scaled(df, cols)
    s = scaler.transform(d)
    m = PCA(k=k, inputCol="_vec", outputCol="_pc").fit(s)
    arr = vector_to_array("_pc")
    proj = m.transform(s).withColumns({f"pc{i + 1}": arr[i] for i in range(k)}).drop(
        "_raw", "_vec", "_pc", *[f"_x{i}" for i in range(len(cols))])
    load, var = m.pc.toArray(), m.explainedVariance.toArray()
    rows = [(i + 1, c, float(load[j, i]), float(var[i])) for i in range(k) for j, c in enumerate(cols)]
    return proj, df.sparkSession.createDataFrame(rows, "component int, column string, loading double, explained double")


def _score(x: Column, bounds: list[Column], high_is_good: bool) -> Column:
    n = len(bounds) + 1
    s = reduce(lambda a, b: a + b, [(x > b).cast("int") for b in bounds]) + 1
    return s if high_is_good else F.lit(n + 1) - s


# --- Fixed values: segments by recency score and mean of frequency and monetary scores -----
SEGMENTS = [("champions", 4, 4), ("loyal", 3, 3), ("recent", 4, 1), ("at_risk", 1, 3), ("hibernating", 1, 1)]
# -------------------------------------------------------------------------------------------


def rfm(df: DataFrame, key: str, ts: str, amount: str, as_of: str, q: int = 5) -> DataFrame:
    """Recency, frequency and monetary value per customer, scores 1..q from quantile bounds, and a segment.

    A segment needs at least its recency score and its rounded-down mean of the
    other two; the first that fits wins.
    """
    c = df.groupBy(key).agg(F.datediff(F.lit(as_of).cast("date"), F.max(quoted(ts).cast("date"))).alias("recency"),
                            F.count(F.lit(1)).alias("frequency"), F.sum(quoted(amount)).alias("monetary"))
    names = ["recency", "frequency", "monetary"]
    b = exact_quantiles(c, names, {f"b{i}": i / q for i in range(1, q)})
    one = b.agg(*[F.max(F.when(F.col("column") == n, F.col(f"b{i}"))).alias(f"_{n}{i}") for n in names for i in range(1, q)])
    bounds = lambda n: [F.col(f"_{n}{i}") for i in range(1, q)]
    s = c.crossJoin(F.broadcast(one)).select(
        key, *names, _score(F.col("recency"), bounds("recency"), False).alias("r_score"),
        _score(F.col("frequency"), bounds("frequency"), True).alias("f_score"),
        _score(F.col("monetary"), bounds("monetary"), True).alias("m_score"))
    fm = F.floor((F.col("f_score") + F.col("m_score")) / 2)
    seg = F.when(F.lit(False), "")
    for name, r, f in SEGMENTS:
        seg = seg.when((F.col("r_score") >= r) & (fm >= f), name)
    return s.withColumn("segment", seg)


def tiers(df: DataFrame, col: str, cuts: dict[str, float], quantile: bool = True, rest: str = "base") -> DataFrame:
    """Column ``tier``: first name (highest cut first) whose cut the value reaches; cuts are quantiles or thresholds."""
    order = sorted(cuts.items(), key=lambda kv: -kv[1])
    x = as_double(df, col)
    if quantile:
        names = [f"_t{i}" for i in range(len(order))]
        b = one_row(exact_quantiles(df, [col], {n: v for n, (_, v) in zip(names, order)}), *names)
        d, edge = df.crossJoin(F.broadcast(b)), [F.col(f"_t{i}") for i in range(len(order))]
    else:
        d, edge = df, [F.lit(float(v)) for _, v in order]
    t = F.when(x.isNull(), None)
    for (name, _), e in zip(order, edge):
        t = t.when(x >= e, name)
    return d.withColumn("tier", t.otherwise(rest)).drop(*[f"_t{i}" for i in range(len(order))])


def cohort(df: DataFrame, key: str, ts: str, grain: str = "month") -> DataFrame:
    """Rows (cohort, period, customers, cohort_size, retention): distinct customers per period since their first."""
    per = df.select(quoted(key).alias("k"), F.date_trunc(grain, quoted(ts)).cast("timestamp_ntz").alias("p")).distinct()
    first = per.groupBy("k").agg(F.min("p").alias("c"))
    step = {"month": lambda a, b: F.months_between(b, a), "week": lambda a, b: F.datediff(b, a) / 7,
            "day": lambda a, b: F.datediff(b, a), "year": lambda a, b: F.months_between(b, a) / 12}[grain]
    grid = per.join(first, "k").groupBy("c", F.round(step(F.col("c"), F.col("p"))).cast("int").alias("period")).agg(
        F.count(F.lit(1)).alias("customers"))
    size = first.groupBy("c").agg(F.count(F.lit(1)).alias("cohort_size"))
    return grid.join(F.broadcast(size) if grain != "day" else size, "c").select(
        F.date_format("c", "yyyy-MM-dd").alias("cohort"), "period", "customers", "cohort_size",
        F.round(F.col("customers") / F.col("cohort_size"), 6).alias("retention"))


def anomalies(df: DataFrame, col: str, by: str, method: str = "z", limit: float | None = None) -> DataFrame:
    """``df`` with ``score`` and ``is_anomaly`` inside each group: ``z``, ``iqr`` (fence distance) or ``robust`` (MAD).

    Rows whose group is missing are a group of their own.
    """
    x, names = as_double(df, col), df.columns
    # Quantiles leave out missing keys, so the group becomes a text that is never missing.
    df = df.withColumn("_by", F.coalesce(F.concat(F.lit("="), quoted(by).cast("string")), F.lit("")))
    by = "_by"
    if method == "z":
        b = df.groupBy(by).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
        score, cut = F.abs(x - F.col("_m")) / F.nullif("_s", F.lit(0.0)), 3.0 if limit is None else limit
    elif method == "iqr":
        q = exact_quantiles(df, [col], {"q1": 0.25, "q3": 0.75}, by=[by])
        b = q.select(by, F.col("q1").alias("_m"), F.col("q3").alias("_s"))
        score = F.greatest(F.col("_m") - x, x - F.col("_s")) / F.nullif(F.col("_s") - F.col("_m"), F.lit(0.0))
        cut = 1.5 if limit is None else limit
    else:
        # One row per group, used three times.
        med = cut_lineage(exact_quantiles(df, [col], {"_m": 0.5}, by=[by]).drop("column"))
        dev = df.join(med, by).withColumn("_d", F.abs(x - F.col("_m")))
        mad = exact_quantiles(dev, ["_d"], {"_s": 0.5}, by=[by]).drop("column")
        b = med.join(mad, by)
        score, cut = 0.6745 * F.abs(x - F.col("_m")) / F.nullif("_s", F.lit(0.0)), 3.5 if limit is None else limit
    return df.join(b, by, "left").withColumn("score", score).withColumn(
        "is_anomaly", F.coalesce(F.col("score") > cut, F.lit(False))).select(*[quoted(c) for c in names], "score", "is_anomaly")


def pair_rules(df: DataFrame, basket: str, item: str, min_support: float = 0.01) -> DataFrame:
    """Rows (antecedent, consequent, pair_count, support, confidence, lift) for pairs of frequent items.

    Rare items go first: a basket then holds at most the frequent items, of
    which there are at most (rows / (baskets x min_support)).
    """
    d = df.where(quoted(basket).isNotNull() & quoted(item).isNotNull()).select(
        quoted(basket).alias("b"), quoted(item).cast("string").alias("i")).distinct()
    n = d.select("b").distinct().agg(F.count(F.lit(1)).alias("n"))
    freq = d.groupBy("i").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).where(F.col("c") / F.col("n") >= min_support)
    kept = d.join(freq.select("i"), "i")
    sets = kept.groupBy("b").agg(F.array_sort(F.collect_list("i")).alias("s")).where(F.size("s") > 1)
    pairs = (sets.select("s", F.posexplode("s").alias("p", "x"))
             .select("x", F.explode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("y"))
             .groupBy("x", "y").agg(F.count(F.lit(1)).alias("pair_count")))
    both = pairs.select(F.inline(F.array(F.struct(F.col("x").alias("antecedent"), F.col("y").alias("consequent"), "pair_count"),
                                         F.struct(F.col("y").alias("antecedent"), F.col("x").alias("consequent"), "pair_count"))))
    fa = freq.select(F.col("i").alias("antecedent"), F.col("c").alias("ca"), "n")
    fb = freq.select(F.col("i").alias("consequent"), F.col("c").alias("cb"))
    return both.join(fa, "antecedent").join(fb, "consequent").where(F.col("pair_count") / F.col("n") >= min_support).select(
        "antecedent", "consequent", "pair_count", F.round(F.col("pair_count") / F.col("n"), 6).alias("support"),
        F.round(F.col("pair_count") / F.col("ca"), 6).alias("confidence"),
        F.round(F.col("pair_count") * F.col("n") / (F.col("ca") * F.col("cb")), 6).alias("lift"))


def assoc_rules(df: DataFrame, basket: str, item: str, min_support: float = 0.01, min_confidence: float = 0.1) -> DataFrame:
    """Rules of any length by parallel FP-growth, without building the item pairs.

    Items below the support cannot be in a rule; they leave the baskets before
    these are collected, while every basket still counts.
    """
    d = df.where(quoted(basket).isNotNull() & quoted(item).isNotNull()).select(
        quoted(basket).alias("b"), quoted(item).cast("string").alias("i")).distinct()
    n = d.select("b").distinct().agg(F.count(F.lit(1)).alias("n"))
    freq = d.groupBy("i").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).where(
        F.col("c") / F.col("n") >= min_support).select("i", F.lit(True).alias("often"))
    sets = d.join(freq, "i", "left").groupBy("b").agg(F.collect_list(F.when(F.col("often"), F.col("i"))).alias("items"))
    m = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets)
    return m.associationRules


def decompose(df: DataFrame, ts: str, value: str, period: int, freq: str = "day", by: list[str] = (),
              model: str = "additive", agg: str = "sum") -> DataFrame:
    """Trend (centred moving average), seasonal (mean per phase) and residual of each resampled series.

    Rows are aggregated to the calendar first, so a window holds the periods of
    one series, not its rows. Empty periods count as 0.
    """
    by = list(by)
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count}[agg]
    s = resample(df, ts, freq, by, {"observed": fn(quoted(value))}).na.fill(0.0, ["observed"])
    w = W.partitionBy(*by).orderBy("period")
    s = s.withColumn("pos", F.row_number().over(w) - 1)
    h = period // 2
    full = W.partitionBy(*by).orderBy("pos").rowsBetween(-h, h)
    if period % 2:
        ma = F.avg("observed").over(full)
    else:  # half weight for the two ends
        ends = F.lag("observed", h).over(w) + F.lead("observed", h).over(w)
        ma = (F.sum("observed").over(full) - ends / 2) / period
    s = s.withColumn("trend", F.when(F.count("observed").over(full) == 2 * h + 1, ma))
    add = model == "additive"
    s = s.withColumn("phase", F.col("pos") % period).withColumn(
        "_d", F.col("observed") - F.col("trend") if add else F.col("observed") / F.nullif("trend", F.lit(0.0)))
    ph = s.groupBy(*by, "phase").agg(F.avg("_d").alias("_p"))
    mid = W.partitionBy(*by)
    ph = ph.withColumn("seasonal", F.col("_p") - F.avg("_p").over(mid) if add else F.col("_p") / F.avg("_p").over(mid)).drop("_p")
    j = s.join(ph, [*by, "phase"], "left")
    resid = (F.col("observed") - F.col("trend") - F.col("seasonal") if add
             else F.col("observed") / F.nullif(F.col("trend") * F.col("seasonal"), F.lit(0.0)))
    return j.select(*by, "period", "observed", "trend", "seasonal", resid.alias("residual"))


def breakdown(df: DataFrame, label: str, by: str) -> DataFrame:
    """Rows (group, label, n, pct within the group)."""
    c = df.groupBy(quoted(by).alias("group"), quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("group").agg(F.sum("n").alias("t"))
    return c.join(t, "group").select("group", "label", "n", F.round(F.col("n") / F.col("t") * 100, 4).alias("pct"))


# Isolation forest ---------------------------------------------------------------------------

def _grow(x: np.ndarray, rng, depth: int, limit: int):
    n = len(x)
    spread = x.max(axis=0) - x.min(axis=0) if n else np.zeros(x.shape[1])
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or n <= 1 or len(usable) == 0:
        return n
    f = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return [f, cut, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)]


def _avg_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree, x: np.ndarray, idx: np.ndarray, depth: int, out: np.ndarray):
    if not isinstance(tree, list):
        out[idx] += depth + _avg_path(tree)
        return
    left = x[idx, tree[0]] < tree[1]
    _depths(tree[2], x, idx[left], depth + 1, out)
    _depths(tree[3], x, idx[~left], depth + 1, out)


def isolation_forest(df: DataFrame, cols: list[str], key: list[str], trees: int = 100, psi: int = 256, seed: int = 42) -> DataFrame:
    """``df`` with ``anomaly_score`` (0..1, higher is more isolated).

    ``trees`` x ``psi`` rows are taken in hash order of the key and dealt out to
    the trees, one task per tree; a smaller table deals each row to several
    trees. The fitted trees have a size fixed by those two numbers and travel
    with the scoring function.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(k).cast("string") for k in key]))
    xs = [as_double(df, c).alias(f"x{i}") for i, c in enumerate(cols)]
    sample = df.select(h.alias("_h"), *xs).na.drop().orderBy("_h").limit(trees * psi)
    sample = cut_lineage(sample)
    deals = min(trees, math.ceil(trees * psi / max(sample.count(), 1)))
    sample = sample.withColumn("tree", F.explode(F.array_distinct(F.array(*[
        F.pmod(F.xxhash64("_h", F.lit(j)), F.lit(trees)).cast("int") for j in range(deals)]))))
    names = [f"x{i}" for i in range(len(cols))]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_h")[names].to_numpy(float)
        tree = _grow(x, np.random.default_rng(seed + t), 0, math.ceil(math.log2(max(len(x), 2))))
        return pd.DataFrame({"tree": [t], "n": [len(x)], "body": [json.dumps(tree)]})

    built = sorted(sample.groupBy("tree").applyInPandas(build, "tree int, n long, body string").collect())
    forest = [(r["n"], json.loads(r["body"])) for r in built]
    norm = sum(_avg_path(n) for n, _ in forest) / max(len(forest), 1) or 1.0

    @F.pandas_udf("double")
    def score(s: pd.DataFrame) -> pd.Series:
        x = s.to_numpy(float)
        out = np.zeros(len(x))
        for _, tree in forest:
            _depths(tree, x, np.arange(len(x)), 0, out)
        r = np.power(2.0, -(out / len(forest)) / norm)
        r[np.isnan(x).any(axis=1)] = np.nan
        return pd.Series(r)

    return df.withColumn("anomaly_score", F.nanvl(score(F.struct(*xs)), F.lit(None).cast("double")))
