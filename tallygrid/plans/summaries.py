"""Reports over several tables or several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import (NAME_DATETIME_SUMMARY, NAME_KEY, as_double, name_matches, names_like, numeric_columns,
                               quoted, share, string_columns, strip, tally, text_to_number, time_columns)
from ..functions.ordering import micros
from ..functions.wide import column_frame, column_stats, distinct_counts, duplicate_rows, nothing, value_counts
from ..operators.profile import column_statistics, correlated_pairs, distributions

# --- Fixed values: words in column names that suggest derived features ----------------------
RATIO_LEFT, RATIO_RIGHT = ["revenue", "sales", "income"], ["cost", "expense"]
MARGIN_LEFT, MARGIN_RIGHT = ["profit", "net"], ["revenue", "sales"]
# -------------------------------------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Column statistics of every table."""
    return _union([column_statistics(df, name) for name, df in tables.items()])


def table_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, rows, cols)."""
    return _union([df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(n).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("cols")) for n, df in tables.items()])


def data_summary(tables: dict[str, DataFrame], top: int = 3) -> DataFrame:
    """Rows (table, column, kind, rank, label, value): numeric summary, ``top`` categories, date spans in days, of all columns."""
    parts = []
    for name, df in tables.items():
        nums, cats, ts = numeric_columns(df), string_columns(df), time_columns(df)
        row = lambda kind, rank, label, value: F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).cast("long").alias("rank"), label.alias("label"), value.cast("double").alias("value"))
        if nums:
            s = column_stats(df, nums, lambda c: (lambda x: {
                "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "nulls": tally(x.isNull())})(as_double(df, c)))
            parts.append(s.select("column", F.inline(F.array(*[row("numeric", i, F.lit(k), F.round(k, 4)) for i, k in enumerate(
                ("mean", "std", "min", "max", "nulls"))]))).withColumn("table", F.lit(name)))
        for c in cats:
            v = df.where(quoted(c).isNotNull()).groupBy(quoted(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            best = v.orderBy(F.desc("n"), "v").limit(top).agg(F.array_sort(F.collect_list(
                F.struct((-F.col("n")).alias("o"), "v", "n"))).alias("a"))
            parts.append(best.select(F.posexplode("a").alias("i", "x")).select(
                F.lit(c).alias("column"), F.lit("category").alias("kind"), F.col("i").cast("long").alias("rank"),
                F.col("x.v").alias("label"), F.col("x.n").cast("double").alias("value"), F.lit(name).alias("table")))
        if ts:
            s = column_stats(df, ts, lambda c: {"days": F.floor((F.max(micros(df, c)) - F.min(micros(df, c))) / 86400e6)})
            parts.append(s.select("column", F.lit("datetime").alias("kind"), F.lit(0).cast("long").alias("rank"),
                                  F.lit("span_days").alias("label"), F.col("days").cast("double").alias("value"), F.lit(name).alias("table")))
    return _union([p.select("table", "column", "kind", "rank", "label", "value") for p in parts])


def _kind(df: DataFrame, c: str) -> str:
    return ("numeric" if c in numeric_columns(df) else "categorical" if c in string_columns(df)
            else "datetime" if c in time_columns(df) else "other")


def inspect_for_fe(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, column, kind, null_pct, mean, std, min, max)."""
    parts = []
    for name, df in tables.items():
        nums = set(numeric_columns(df))
        none_d = F.lit(None).cast("double")
        s = column_stats(df, df.columns, lambda c: (lambda x: {
            "null_pct": F.round(share(x.isNull()) * 100, 1),
            **{k: F.round(f(x), 4) if c in nums else none_d for k, f in (
                ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))}})(
            as_double(df, c) if c in nums else quoted(c)))
        facts = column_frame(df, df.columns, lambda c: {"kind": _kind(df, c)})
        parts.append(s.join(F.broadcast(facts), "column").select(F.lit(name).alias("table"), "column", "kind", "null_pct", "mean", "std", "min", "max"))
    return _union(parts)


def inspect_for_ml(tables: dict[str, DataFrame], max_classes: int = 30) -> DataFrame:
    """Rows (table, column, kind, null_count, nunique, target_candidate)."""
    parts = []
    for name, df in tables.items():
        s = column_stats(df, df.columns, lambda c: {"null_count": tally(quoted(c).isNull())})
        facts = column_frame(df, df.columns, lambda c: {"kind": _kind(df, c)})
        parts.append(s.join(F.broadcast(facts), "column").join(F.broadcast(distinct_counts(df, df.columns)), "column", "left").select(
            F.lit(name).alias("table"), "column", "kind", "null_count", F.coalesce("nunique", F.lit(0)).alias("nunique"),
            ((F.col("kind") != "datetime") & (F.coalesce("nunique", F.lit(0)) <= max_classes)).alias("target_candidate")))
    return _union(parts)


# --- Fixed values: severity of each issue; the text says which operator deals with it -------
ISSUES = {
    "duplicate_rows": ("medium", "Look at the copies, then remove them with dedup."),
    "missing_values": ("high", "Read missing_report and fill each column with impute."),
    "mixed_types": ("medium", "Decide the type and convert with cast_columns."),
    "whitespace": ("low", "Trim with standardize_text so that spellings meet."),
    "constant": ("low", "Nothing to learn from it: drop_columns."),
    "datetime_review": ("medium", "Turn the texts into times with parse_dates."),
}
# -------------------------------------------------------------------------------------------


def issue_summary(tables: dict[str, DataFrame], mode: str = "token") -> DataFrame:
    """Rows (table, column, issue, severity, rows_hit, action) over all tables."""
    parts = []
    for name, df in tables.items():
        texts = set(string_columns(df))
        zero = F.lit(0).cast("long")
        s = column_stats(df, df.columns, lambda c: (lambda x: {
            "rows": F.count(F.lit(1)), "present": F.count(x),
            "numbers": F.count(text_to_number(strip(x))) if c in texts else zero,
            "padded": tally(strip(x) != x) if c in texts else zero})(quoted(c)))
        facts = column_frame(df, df.columns, lambda c: {
            "is_text": c in texts, "dated": c in texts and name_matches(c, NAME_DATETIME_SUMMARY, mode)})
        j = s.join(F.broadcast(facts), "column").join(F.broadcast(distinct_counts(df, df.columns)), "column", "left")
        frac = F.col("numbers") / F.nullif("present", F.lit(0))
        hit = lambda issue, cond, n: F.struct(F.lit(issue).alias("issue"), F.coalesce(cond, F.lit(False)).alias("on"), n.alias("rows_hit"))
        found = j.select("column", F.explode(F.array(
            hit("missing_values", F.col("present") < F.col("rows"), F.col("rows") - F.col("present")),
            hit("mixed_types", F.col("is_text") & (frac > 0.1) & (frac < 0.9), F.col("numbers")),
            hit("whitespace", F.col("padded") > 0, F.col("padded")),
            hit("constant", F.col("nunique") == 1, F.col("present")),
            hit("datetime_review", F.col("dated"), F.col("present")))).alias("h")).where("h.on").select("column", "h.issue", "h.rows_hit")
        dup = duplicate_rows(df).where("surplus > 0").select(F.lit("*").alias("column"), F.lit("duplicate_rows").alias("issue"),
                                                            F.col("surplus").alias("rows_hit"))
        parts.append(found.unionByName(dup).withColumn("table", F.lit(name)))
    rules = F.create_map(*[x for k, (s, a) in ISSUES.items() for x in (F.lit(k), F.struct(F.lit(s).alias("s"), F.lit(a).alias("a")))])
    return _union(parts).withColumn("_r", rules[F.col("issue")]).select(
        "table", "column", "issue", F.col("_r.s").alias("severity"), "rows_hit", F.col("_r.a").alias("action"))


def key_uniqueness(tables: dict[str, DataFrame], mode: str = "token") -> DataFrame:
    """Rows (table, column, unique_values, total_rows, is_unique_key, duplicate_count) for key-like columns."""
    parts = []
    for name, df in tables.items():
        keys = names_like(df, NAME_KEY, mode)
        if keys:
            n = df.agg(F.count(F.lit(1)).alias("total_rows"))
            parts.append(distinct_counts(df, keys).crossJoin(F.broadcast(n)).select(
                F.lit(name).alias("table"), "column", F.col("nunique").alias("unique_values"), "total_rows",
                (F.col("nunique") == F.col("total_rows")).alias("is_unique_key"),
                (F.col("total_rows") - F.col("nunique")).alias("duplicate_count")))
    return _union(parts) if parts else nothing(next(iter(tables.values())), "table string, column string, unique_values long, "
                                               "total_rows long, is_unique_key boolean, duplicate_count long")


def time_grain(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, column, grain): timestamp, daily or monthly_or_coarser."""
    parts = []
    for name, df in tables.items():
        ts = time_columns(df)
        if ts:
            parts.append(column_stats(df, ts, lambda c: {
                "timed": F.bool_or((F.hour(quoted(c)) != 0) | (F.minute(quoted(c)) != 0)), "dayed": F.bool_or(F.dayofmonth(quoted(c)) != 1)}).select(
                F.lit(name).alias("table"), "column", F.when(F.col("timed"), "timestamp").when(F.col("dayed"), "daily")
                .otherwise("monthly_or_coarser").alias("grain")))
    return _union(parts) if parts else nothing(next(iter(tables.values())), "table string, column string, grain string")


def granularity(tables: dict[str, DataFrame], factor: float = 10) -> DataFrame:
    """Rows (table_a, table_b, row_ratio, rows_differ, grains_differ): pairs of tables that do not fit row by row."""
    n = table_totals(tables).select("table", "rows")
    g = time_grain(tables).groupBy("table").agg(F.array_sort(F.collect_set("grain")).alias("grains"))
    s = n.join(g, "table", "left")
    # One row per table on both sides.
    b = s.select(F.col("table").alias("table_b"), F.col("rows").alias("rb"), F.col("grains").alias("gb"))
    j = s.join(F.broadcast(b), F.col("table") < F.col("table_b"))
    ratio = F.greatest("rows", "rb") / F.greatest(F.least("rows", "rb"), F.lit(1))
    return j.select(F.col("table").alias("table_a"), "table_b", F.round(ratio, 1).alias("row_ratio"), (ratio > factor).alias("rows_differ"),
                    F.coalesce(F.col("grains") != F.col("gb"), F.lit(False)).alias("grains_differ"))


def suggest_features(df: DataFrame, mode: str = "token") -> DataFrame:
    """Rows (position, column, feature, reason): calendar parts, ratios, text length, frequency, cyclical."""
    rows, checks = [], []
    times, nums, texts = time_columns(df), numeric_columns(df), string_columns(df)
    for c in times:
        rows.append((c, "date_parts", "datetime decomposition", None))
        rows.append((c, "days_since_min", "ordinal time", "span"))
    for i, a in enumerate(nums):
        for b in nums[i + 1:]:
            if name_matches(a, RATIO_LEFT, mode) and name_matches(b, RATIO_RIGHT, mode):
                rows.append((f"{a},{b}", "ratio", "efficiency", None))
            if name_matches(a, MARGIN_LEFT, mode) and name_matches(b, MARGIN_RIGHT, mode):
                rows.append((f"{a},{b}", "margin", "profitability", None))
    rows += [(c, "text_length", "length may carry signal", "length") for c in texts]
    rows += [(c, "frequency_encoding", "moderate cardinality", "card") for c in texts]
    for c in df.columns:
        for word in ("month", "hour", "day"):
            if name_matches(c, [word], mode) and (word != "day" or name_matches(c, ["of", "week", "dow"], mode)):
                rows.append((c, "cyclical", f"{word} wraps around", None))
    plan = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                           "position int, column string, feature string, reason string, test string")
    checks.append(column_stats(df, times, lambda c: {"v": (F.max(micros(df, c)) - F.min(micros(df, c))) / 86400e6}).select(
        "column", F.lit("span").alias("test"), (F.col("v") > 365).alias("ok")) if times else None)
    if texts:
        checks.append(column_stats(df, texts, lambda c: {"v": F.avg(F.length(quoted(c)))}).select(
            "column", F.lit("length").alias("test"), (F.col("v") > 20).alias("ok")))
        checks.append(distinct_counts(df, texts).select(
            "column", F.lit("card").alias("test"), ((F.col("nunique") > 10) & (F.col("nunique") < 500)).alias("ok")))
    checks = [c for c in checks if c is not None]
    if checks:
        plan = plan.join(F.broadcast(_union(checks)), ["column", "test"], "left")
    else:
        plan = plan.withColumn("ok", F.lit(None).cast("boolean"))
    return plan.where(F.col("test").isNull() | F.col("ok")).select(
        "position", "column", "feature", "reason")


def findings(tables: dict[str, DataFrame], top: int | None = None) -> DataFrame:
    """Rows (table, kind, subject, detail, strength): dominant segments, anomalies, strong correlations; all, or the ``top`` strongest."""
    parts = []
    for name, df in tables.items():
        nums, texts = numeric_columns(df), string_columns(df)
        n = df.agg(F.count(F.lit(1)).alias("rows"))
        if texts:
            v = value_counts(df, texts)
            best = v.groupBy("column").agg(F.max(F.struct("n", "value")).alias("t")).crossJoin(F.broadcast(n))
            parts.append(best.select(F.lit("segment").alias("kind"), F.col("column").alias("subject"), F.col("t.value").alias("detail"),
                                     (F.col("t.n") / F.col("rows")).alias("strength"), F.lit(name).alias("table")))
        if nums:
            d = distributions(df, nums)
            parts.append(d.crossJoin(F.broadcast(n)).where("iqr_outliers > 0").select(
                F.lit("anomaly").alias("kind"), F.col("column").alias("subject"), F.col("recommendations").alias("detail"),
                (F.col("iqr_outliers") / F.col("rows")).alias("strength"), F.lit(name).alias("table")))
        if len(nums) > 1:
            parts.append(correlated_pairs(df, 0.3, nums).select(
                F.lit("correlation").alias("kind"), F.concat_ws(",", "col_a", "col_b").alias("subject"), F.lit("").alias("detail"),
                F.col("correlation").alias("strength"), F.lit(name).alias("table")))
    out = _union(parts).select("table", "kind", "subject", "detail", F.round("strength", 6).alias("strength"))
    return out if top is None else out.orderBy(F.desc("strength"), "table", "kind", "subject").limit(top)
