"""Feature engineering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.kinds import as_double, numeric_columns, quoted
from ..functions.ordering import (CHUNK, body, cut_points, dealt, dense_codes, micros, null_safe_join, row_window, with_chunk,
                                  with_reach)
from ..functions.quantiles import exact_quantiles, one_row
from ..functions.wide import column_stats
from ..session import spread
from .relational import asof_join

# --- Fixed values: windows and lags in rows -------------------------------------------------
LAGS = [1, 7, 30]
# -------------------------------------------------------------------------------------------


def date_features(df: DataFrame, ts: str) -> DataFrame:
    """Calendar parts; Monday is day 0; days since 1970 and since the first row."""
    t = quoted(ts)
    first = df.agg(F.min(t.cast("date")).alias("_first"))
    wd = F.weekday(t)
    return df.crossJoin(F.broadcast(first)).withColumns({
        f"{ts}_year": F.year(t), f"{ts}_quarter": F.quarter(t), f"{ts}_month": F.month(t), f"{ts}_day_of_week": wd,
        f"{ts}_day_of_year": F.dayofyear(t), f"{ts}_hour": F.hour(t), f"{ts}_is_weekend": (wd >= 5).cast("int"),
        f"{ts}_days_since_epoch": F.unix_date(t.cast("date")),
        f"{ts}_days_since_min": F.datediff(t.cast("date"), F.col("_first"))}).drop("_first")


def cyclical(df: DataFrame, col: str, period: float) -> DataFrame:
    a = 2 * math.pi * as_double(df, col) / period
    return df.withColumns({f"{col}_sin": F.sin(a), f"{col}_cos": F.cos(a)})


def lags(df: DataFrame, col: str, by: list[str], order_by: list[str], ns: list[int] = LAGS) -> DataFrame:
    """Earlier values of the same entity, by row; busy entities are evaluated in chunks."""
    d = with_reach(df, by, order_by, max(ns))
    w = row_window(by)
    return body(d.withColumns({f"{col}_lag_{n}": F.lag(quoted(col), n).over(w) for n in ns}))


def rolling(df: DataFrame, col: str, by: list[str], order_by: list[str], n: int, fns: list[str] = ("mean",),
            min_periods: int = 1) -> DataFrame:
    """Mean, std, max, min or sum over the last n rows of the same entity."""
    d = with_reach(df, by, order_by, n - 1) if n > 1 else with_reach(df, by, order_by, 1)
    w = row_window(by).rowsBetween(-(n - 1), 0)
    f = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}
    enough = F.count(quoted(col)).over(w) >= min_periods
    return body(d.withColumns({f"{col}_rolling_{k}_{n}": F.when(enough, f[k](quoted(col)).over(w)) for k in fns}))


def chunk_spans(whole: DataFrame, spans: DataFrame, by: list[str], merge: dict) -> DataFrame:
    """Rows (by.., chunk, _c0, _mid_*): aggregates of each entity's chunks strictly between ``_c0`` and the chunk.

    ``whole`` has one row per (entity, chunk). Each of its rows knows the
    aggregates of the 1, 2, 4, .. chunks from it on; a span is put together from
    one of them per binary digit of its length, without overlap.
    """
    line = W.partitionBy(*by).orderBy(CHUNK)
    w = whole.withColumn("_i", F.row_number().over(line))
    longest = w.agg(F.max("_i")).first()[0] or 1
    rows = {n: F.col(n) for n in merge}
    levels = []
    for k in range(longest.bit_length()):
        w = w.withColumns({f"_{n}{k}": c for n, c in rows.items()})
        levels.append(F.struct(F.lit(k).alias("_k"), *[F.col(f"_{n}{k}").alias(f"_mid_{n}") for n in merge]))
        ahead = {n: F.lead(f"_{n}{k}", 1 << k).over(line) for n in merge}
        two = {"s": lambda a, b: a + b, "c": lambda a, b: a + b, "hi": F.greatest, "lo": F.least}
        # Past an entity's last chunk there is nothing to add; such entries are never asked for.
        rows = {n: F.coalesce(two[n](F.col(f"_{n}{k}"), ahead[n]), F.col(f"_{n}{k}"), ahead[n]) for n in merge}
    table = w.select(*by, "_i", F.inline(F.array(*levels)))
    at = w.select(*by, F.col(CHUNK), "_i")
    s = null_safe_join(spans, at, [*by, CHUNK])
    # The entity's last chunk up to _c0, which need not have rows of it.
    lower = asof_join(spans.select(*by, "_c0").distinct(), at.select(*by, F.col(CHUNK).alias("_c0"), F.col("_i").alias("_i0")), "_c0", by)
    s = null_safe_join(s, lower, [*by, "_c0"]).withColumn("_i0", F.coalesce("_i0", F.lit(0)))
    n = F.col("_i") - 1 - F.col("_i0")
    # Digits from the highest: a piece begins after those of all higher digits.
    s = s.withColumn("_n", n).where("_n > 0")
    piece = [F.struct(F.lit(k).alias("_k"), (F.col("_i0") + 1 + F.shiftleft(F.shiftright("_n", k + 1), k + 1)).alias("_i")) for k in range(longest.bit_length())]
    s = s.select(*by, CHUNK, "_c0", "_n", F.inline(F.array(*piece))).where(F.expr("shiftright(_n, _k) & 1 = 1"))
    return null_safe_join(s, table, [*by, "_i", "_k"]).groupBy(*by, CHUNK, "_c0").agg(*[f(f"_mid_{n}").alias(f"_mid_{n}") for n, f in merge.items()])


def rolling_time(df: DataFrame, col: str, by: list[str], ts: str, days: int, fns: list[str] = ("sum",)) -> DataFrame:
    """sum, mean, count, max or min over the last ``days`` days up to and including the row, per entity.

    Time is cut into chunks of similar mass. A window is its part of the row's
    own chunk, the whole chunks before, and the end of the chunk it starts in;
    the last two come from tables of one row per (entity, chunk) and per
    (entity, time), so no task sees all rows of a busy entity.
    """
    by = list(by)
    width = days * 86400 * 1000000
    parts = {"s": F.sum, "c": F.count, "hi": F.max, "lo": F.min}
    start = F.col("_us") - width + 1
    d = df.withColumn("_us", micros(df, ts)).withColumn("_v", quoted(col))
    cuts = cut_points(d, F.col("_us").cast("double"))
    d = with_chunk(d, start.cast("double"), cuts).withColumnRenamed(CHUNK, "_c0")
    d = dealt(with_chunk(d, F.col("_us").cast("double"), cuts), by, df.count())
    own = W.partitionBy(*by, CHUNK).orderBy("_us").rangeBetween(-width + 1, 0)
    d = d.withColumns({f"_own_{n}": f("_v").over(own) for n, f in parts.items()})

    merge = {"s": F.sum, "c": F.sum, "hi": F.max, "lo": F.min}
    moments = d.groupBy(*by, CHUNK, "_us").agg(*[f("_v").alias(n) for n, f in parts.items()])
    back = W.partitionBy(*by, CHUNK).orderBy(F.desc("_us")).rowsBetween(W.unboundedPreceding, 0)
    ends = moments.select(*by, F.col(CHUNK).alias("_c0"), "_us", *[f(n).over(back).alias(f"_end_{n}") for n, f in merge.items()])
    asked = d.where(F.col("_c0") < F.col(CHUNK)).select(*by, "_c0", start.alias("_us")).distinct()
    ends = asof_join(asked, ends, "_us", [*by, "_c0"], "forward").withColumn("_us", F.col("_us") + width - 1)

    whole = moments.groupBy(*by, CHUNK).agg(*[f(n).alias(n) for n, f in merge.items()])
    spans = d.where(F.col("_c0") < F.col(CHUNK)).select(*by, CHUNK, "_c0").distinct()
    mids = chunk_spans(whole, spans, by, merge)

    j = null_safe_join(null_safe_join(d, mids, [*by, CHUNK, "_c0"]), ends, [*by, "_c0", "_us"])
    three = lambda n: [F.col(f"_own_{n}"), F.col(f"_mid_{n}"), F.col(f"_end_{n}")]
    add = lambda n: sum([F.coalesce(c, F.lit(0)) for c in three(n)], F.lit(0))
    total = F.when(add("c") > 0, add("s"))
    value = {"sum": total, "count": add("c"), "mean": total / F.nullif(add("c"), F.lit(0)), "max": F.greatest(*three("hi")), "min": F.least(*three("lo"))}
    return j.select(*[quoted(c) for c in df.columns], *[value[k].alias(f"{col}_{k}_{days}d") for k in fns])


def ratio(df: DataFrame, a: str, b: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{a}_to_{b}", as_double(df, a) / F.nullif(as_double(df, b), F.lit(0.0)))


def margin(df: DataFrame, revenue: str, cost: str, out: str = "margin") -> DataFrame:
    r = as_double(df, revenue)
    return df.withColumn(out, (r - as_double(df, cost)) / F.nullif(r, F.lit(0.0)))


def interact(df: DataFrame, a: str, b: str, op: str = "product") -> DataFrame:
    x, y = as_double(df, a), as_double(df, b)
    return df.withColumn(f"{a}_{op}_{b}", x * y if op == "product" else x + y)


def _ladder(x: Column, edges: list[Column]) -> Column:
    """0-based index of the right-closed interval; the lowest edge belongs to the first."""
    k = len(edges) - 1
    c = F.when(x < edges[0], None)
    for i in range(k):
        c = c.when(x <= edges[i + 1], F.lit(i))
    return c


def bin_edges(df: DataFrame, col: str, edges: list[float], out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_bin", _ladder(as_double(df, col), [F.lit(float(e)) for e in edges]))


def bin_width(df: DataFrame, col: str, n: int, out: str | None = None) -> DataFrame:
    """n intervals of equal width between the smallest and largest value."""
    x = as_double(df, col)
    b = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    edges = [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / n for i in range(n)] + [F.col("_hi")]
    return df.crossJoin(F.broadcast(b)).withColumn(out or f"{col}_bin", _ladder(x, edges)).drop("_lo", "_hi")


def bin_quantile(df: DataFrame, col: str, q: int, out: str | None = None) -> DataFrame:
    """q intervals holding about equally many rows."""
    names = [f"_e{i}" for i in range(q + 1)]
    b = one_row(exact_quantiles(df, [col], {n: i / q for i, n in enumerate(names)}), *names)
    edges = [F.col(f"_e{i}") for i in range(q + 1)]
    return (df.crossJoin(F.broadcast(b)).withColumn(out or f"{col}_bin", _ladder(as_double(df, col), edges))
            .drop(*[f"_e{i}" for i in range(q + 1)]))


def text_features(df: DataFrame, col: str, keywords: list[str] = ()) -> DataFrame:
    """Characters, words and one 0/1 column per keyword (anywhere, any case)."""
    c = quoted(col)
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return df.withColumns({f"{col}_chars": F.length(c), f"{col}_words": F.when(c.isNotNull(), words),
                           **{f"{col}_has_{k}": F.lower(c).contains(k.lower()).cast("int") for k in keywords}})


def sentiment(df: DataFrame, col: str, lexicon: DataFrame, key: list[str]) -> DataFrame:
    """Sum of lexicon scores (word, score) over the words of a text, per key; texts without hits score 0."""
    words = spread(df.select(*[quoted(k) for k in key], quoted(col))).select(*[quoted(k) for k in key], F.explode(F.split(F.lower(quoted(col)), r"[^\p{L}\p{N}']+")).alias("word"))
    # Only hits are grouped: a lexicon small enough is broadcast, and all other words end in the scan's stage.
    hits = (words.where("word <> ''").join(lexicon.select("word", "score"), "word")
            .groupBy(*key).agg(F.sum("score").alias("_s"), F.count(F.lit(1)).alias("_h")))
    return df.join(hits, key, "left").withColumns({
        f"{col}_sentiment": F.coalesce("_s", F.lit(0.0)), f"{col}_sentiment_hits": F.coalesce("_h", F.lit(0))}).drop("_s", "_h")


def frequency_encode(df: DataFrame, col: str) -> DataFrame:
    """Count and share of the row's value among non-missing rows."""
    c = df.where(quoted(col).isNotNull()).groupBy(quoted(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    t = df.agg(F.count(quoted(col)).alias("_t"))
    return (df.join(c, quoted(col) == F.col("_v"), "left").crossJoin(F.broadcast(t))
            .withColumns({f"{col}_count": F.col("_n"), f"{col}_share": F.col("_n") / F.col("_t")}).drop("_v", "_n", "_t"))


def poly(df: DataFrame, col: str, degree: int = 2) -> DataFrame:
    x = as_double(df, col)
    return df.withColumns({f"{col}_pow_{d}": F.pow(x, F.lit(float(d))) for d in range(2, degree + 1)})


def recency(df: DataFrame, key: str, ts: str, as_of: str, amount: str | None = None) -> DataFrame:
    """Per entity: days since the last row, rows, total and mean amount."""
    days = F.datediff(F.lit(as_of).cast("date"), F.max(quoted(ts).cast("date")))
    aggs = [days.alias("recency_days"), F.count(F.lit(1)).alias("frequency")]
    if amount:
        aggs += [F.sum(quoted(amount)).alias("monetary"), F.avg(quoted(amount)).alias("avg_amount")]
    return df.groupBy(key).agg(*aggs)


def days_until(df: DataFrame, col: str, as_of: str) -> DataFrame:
    return df.withColumn(f"{col}_days_until", F.datediff(quoted(col).cast("date"), F.lit(as_of).cast("date")))


def entity_agg(df: DataFrame, key: str, col: str, fns: list[str] = ("mean", "max", "count")) -> DataFrame:
    """Aggregates of the entity joined back to every row."""
    f = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "std": F.stddev_samp}
    a = df.groupBy(key).agg(*[f[k](quoted(col)).alias(f"{key}_{col}_{k}") for k in fns])
    return df.join(a, key, "left")


def one_hot(df: DataFrame, col: str, values: list | None = None, limit: int = 50) -> DataFrame:
    """One 0/1 column per value; without given values the column may have at most ``limit``."""
    if values is None:
        got = df.where(quoted(col).isNotNull()).select(quoted(col)).distinct().orderBy(quoted(col)).limit(limit + 1).collect()
        if len(got) > limit:
            raise ValueError(f"{col} has more than {limit} values")
        values = [r[0] for r in got]
    return df.withColumns({f"{col}_{v}": F.coalesce((quoted(col) == F.lit(v)).cast("int"), F.lit(0)) for v in values})


def label_encode(df: DataFrame, col: str) -> DataFrame:
    """0-based code in ascending order of the values, -1 for missing."""
    codes = dense_codes(df.where(quoted(col).isNotNull()).select(quoted(col)).distinct(), col)
    return df.join(codes.withColumnRenamed("value", "_v"), quoted(col) == F.col("_v"), "left").withColumn(
        f"{col}_code", F.coalesce("code", F.lit(-1)).cast("long")).drop("_v", "code")


def fold_of(keys: list[Column], n: int, seed: int = 42) -> Column:
    """Fold 0..n-1 from a hash of the key: the same on every run and engine."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n).cast("int")


def target_encode(train: DataFrame, col: str, target: str, fold: str, df: DataFrame | None = None) -> DataFrame:
    """Category means of the target.

    Training rows see only the other folds. ``df`` given: it is encoded with the
    means of all training rows instead. Unseen categories get the overall mean.
    """
    t = as_double(train, target)
    per = train.where(t.isNotNull()).groupBy(quoted(col).alias("_c"), quoted(fold).alias("_f")).agg(
        F.sum(t).alias("_s"), F.count(t).alias("_n"))
    whole = per.groupBy("_c").agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    mean = train.agg(F.avg(t).alias("_mean"))
    name = f"{col}_target"
    if df is not None:
        return (df.join(whole, quoted(col) == F.col("_c"), "left").crossJoin(F.broadcast(mean))
                .withColumn(name, F.coalesce(F.col("_all_s") / F.col("_all_n"), F.col("_mean"))).drop("_c", "_all_s", "_all_n", "_mean"))
    enc = per.join(whole, "_c").select("_c", "_f", ((F.col("_all_s") - F.col("_s")) / F.nullif(F.col("_all_n") - F.col("_n"), F.lit(0)))
                                       .alias("_e"))
    return (train.join(enc, (quoted(col) == F.col("_c")) & (quoted(fold) == F.col("_f")), "left")
            .crossJoin(F.broadcast(mean)).withColumn(name, F.coalesce("_e", "_mean")).drop("_c", "_f", "_e", "_mean"))


def drop_constant(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric features without variance are dropped."""
    cols = cols or numeric_columns(df)
    r = column_stats(df, cols, lambda c: {"flat": F.coalesce(F.min(as_double(df, c)) == F.max(as_double(df, c)), F.lit(True))})
    return df.drop(*[x["column"] for x in r.where("flat").collect()])
