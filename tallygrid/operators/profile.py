"""Profiling reports. Each returns one row per column (or per table) with typed fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crossproducts import correlations
from ..functions.dates import parse_any
from ..functions.kinds import (FAKE_NULLS, NAME_DATETIME, NAME_DATETIME_WIDE, NAME_KEY, NAME_KEY_DUPLICATE,
                               NAME_POSITIVE, NAME_POSITIVE_OUTLIER, TEXT_PATTERNS, TEXT_SHARES, as_double, as_number,
                               name_matches, names_like, numeric_columns, quoted, share, string_columns, strip, tally,
                               text_to_number, time_columns, type_name)
from ..functions.moments import adjusted_kurtosis, adjusted_skew, safe_corr
from ..functions.quantiles import QUARTILES, exact_quantiles, read_back
from ..functions.wide import (column_frame, column_stats, distinct_counts, duplicate_rows, duplicate_values, nothing,
                              value_counts)
from ..session import spread


def advice(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, joined by ``;``."""
    return F.concat_ws(";", *[F.when(c, F.lit(t)) for c, t in pairs])


def fake_null(c: Column) -> Column:
    return strip(c).isin(FAKE_NULLS)


def numeric_facts(df: DataFrame, cols: list[str] | None = None, outliers: bool = True) -> DataFrame:
    """Per numeric column: count, moments, quartiles and, on request, outlier counts.

    Three kinds of scan: moments, narrowing for the quartiles, and conditional
    counts against the resulting bounds (one row per column, carried as literals).
    """
    cols = numeric_columns(df) if cols is None else cols
    if not cols:
        more = ", iqr_outliers long, extreme_outliers long, z_outliers long" if outliers else ""
        return nothing(df, "column string, n long, mean double, std double, min double, max double, skew double, kurt double, "
                           f"negatives long, zeros long, q1 double, median double, q3 double{more}")
    m = column_stats(df, cols, lambda c: (lambda x: {
        "n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x),
        "skew": adjusted_skew(x), "kurt": adjusted_kurtosis(x),
        "negatives": tally(x < 0), "zeros": tally(x == 0)})(as_double(df, c)))
    f = read_back(m.join(F.broadcast(exact_quantiles(df, cols, QUARTILES)), "column", "left"))
    if not outliers:
        return f
    known = {r["column"]: r for r in f.collect()}  # literals already; one row per column

    def beyond(c):
        b, v = known[c], as_double(df, c)
        zero = F.lit(0).cast("long")
        if b["q1"] is None:
            return {"iqr_outliers": zero, "extreme_outliers": zero, "z_outliers": zero}
        iqr = b["q3"] - b["q1"]
        far = tally(F.abs(v - b["mean"]) > 3 * b["std"]) if b["std"] else zero
        return {"iqr_outliers": tally((v < b["q1"] - 1.5 * iqr) | (v > b["q3"] + 1.5 * iqr)),
                "extreme_outliers": tally((v < b["q1"] - 3.0 * iqr) | (v > b["q3"] + 3.0 * iqr)), "z_outliers": far}

    o = column_stats(df, cols, beyond)
    return f.join(F.broadcast(o), "column", "left").na.fill(0, ["iqr_outliers", "extreme_outliers", "z_outliers"])


def profile(df: DataFrame, mode: str = "token", approx: bool = False) -> DataFrame:
    """Rows, duplicates and, per column, missing share, distinct values and the flags of the first look."""
    texts, numbers = set(string_columns(df)), set(numeric_columns(df))

    def make(c):
        x = quoted(c)
        is_text, is_num = c in texts, c in numbers
        return {"rows": F.count(F.lit(1)), "present": F.count(as_double(df, c) if is_num else x),
                "fake_nulls": tally(fake_null(x)) if is_text else F.lit(0).cast("long"),
                "number_share": share(text_to_number(x).isNotNull() & x.isNotNull()) if is_text
                else F.lit(None).cast("double"),
                "text_present": F.count(x) if is_text else F.lit(0).cast("long"),
                "std": F.stddev_samp(as_double(df, c)) if is_num else F.lit(None).cast("double")}

    base = column_stats(df, df.columns, make)
    facts = column_frame(df, df.columns, lambda c: {
        "dtype": type_name(df, c), "is_text": c in texts, "is_number": c in numbers,
        "datetime_name": c in texts and name_matches(c, NAME_DATETIME, mode)})
    n, d = F.col("rows"), F.coalesce("nunique", F.lit(0))
    num_frac = F.col("number_share") * n / F.nullif(F.col("text_present"), F.lit(0))
    j = (base.join(F.broadcast(facts), "column")
         .join(F.broadcast(distinct_counts(df, df.columns, approx)), "column", "left")
         .crossJoin(F.broadcast(duplicate_rows(df).select(F.col("surplus").alias("duplicate_rows")))))
    return j.select(
        "column", "dtype", "rows", "duplicate_rows",
        F.round((n - F.col("present")) / n * 100, 2).alias("null_pct"), d.alias("nunique"), "fake_nulls",
        F.coalesce(F.col("is_text") & (num_frac > 0.1) & (num_frac < 0.9), F.lit(False)).alias("mixed"),
        "datetime_name", (F.col("is_text") & (d / n > 0.95)).alias("id_like"),
        F.coalesce(F.col("is_number") & (F.col("std") == 0), F.lit(False)).alias("constant"))


def inspect_numeric(df: DataFrame, col: str) -> DataFrame:
    """Full distribution report of one column read as numbers (texts are converted where they can be)."""
    d = df.select(as_number(df, col).alias(col))
    raw = quoted(col)
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count(raw).alias("present"))
    return (numeric_facts(d, [col]).crossJoin(F.broadcast(counts))
            .join(F.broadcast(distinct_counts(df, [col])), "column", "left")
            .select("column", "total_rows", (F.col("total_rows") - F.col("present")).alias("null_count"), "nunique",
                    F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"),
                    F.round("std", 4).alias("std"), "min", "max", "q1", "q3", F.round("skew", 3).alias("skewness"),
                    F.round("kurt", 3).alias("kurtosis"), F.col("iqr_outliers").alias("outliers_iqr_count"),
                    F.col("negatives").alias("negative_count"), F.col("zeros").alias("zero_count"),
                    (F.col("present") - F.col("n")).alias("non_numeric_rows")))


def inspect_text(df: DataFrame, col: str) -> DataFrame:
    """Pattern shares, placeholder and white-space counts and the logical kind of a text column."""
    raw, s = quoted(col), strip(quoted(col))
    p = {n: share(s.rlike(r)) for n, r in TEXT_PATTERNS.items()}
    one = spread(df.select(raw)).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count(raw).alias("present"), tally(fake_null(raw)).alias("fake_nulls"),
        *[e.alias(f"_{n}") for n, e in p.items()],
        share(s.startswith("{")).alias("_brace"), share(s.startswith("[")).alias("_bracket"),
        tally(raw != s).alias("whitespace_issues"))
    # Distinct raw and lower-cased values from one grouping of the raw values.
    vals = (df.where(raw.isNotNull()).groupBy(raw.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy(F.lower(strip(F.col("v"))).alias("l")).agg(F.count(F.lit(1)).alias("raw")))
    d = vals.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("nunique"), F.count(F.lit(1)).alias("nunique_lower"))
    over = lambda n, t: F.coalesce(F.col(f"_{n}") > TEXT_SHARES[t], F.lit(False))
    ratio = F.col("nunique") / F.col("total_rows")
    return one.crossJoin(F.broadcast(d)).select(
        F.lit(col).alias("column"), "total_rows", (F.col("total_rows") - F.col("present")).alias("null_count"),
        "nunique", "fake_nulls", over("email", "email").alias("email"), over("phone", "phone").alias("phone"),
        over("url", "url").alias("url"), (over("brace", "json") | over("bracket", "json")).alias("json_like"),
        over("currency", "currency").alias("currency"), over("numeric_string", "numeric_string").alias("numeric_string"),
        reduce(lambda a, b: a | b, [over(n, "date") for n in TEXT_PATTERNS if n.startswith("date_")]).alias("date_string"),
        "whitespace_issues", (F.col("nunique") > F.col("nunique_lower")).alias("case_inconsistency"),
        F.when(ratio > 0.95, "id_or_high_cardinality_text")
        .when((F.col("nunique") <= 50) | (ratio < 0.2), "categorical").otherwise("free_text").alias("logical_type"))


def infer_kind(df: DataFrame) -> DataFrame:
    """Logical kind of every column: numeric, datetime, id, categorical or free text."""
    texts, times = set(string_columns(df)), set(time_columns(df))
    base = column_stats(df, df.columns, lambda c: {
        "rows": F.count(F.lit(1)), "present": F.count(quoted(c)), "numbers": F.count(as_number(df, c))})
    facts = column_frame(df, df.columns, lambda c: {"is_time": c in times})
    d, n = F.coalesce("nunique", F.lit(0)), F.col("rows")
    return (base.join(F.broadcast(facts), "column").join(F.broadcast(distinct_counts(df, df.columns)), "column", "left")
            .select("column", d.alias("nunique"),
                    F.when(F.col("is_time"), "datetime")
                    .when(F.col("numbers") > 0.6 * F.col("present"), "numeric")
                    .when(d / n > 0.95, "id").when((d <= 50) | (d / n < 0.2), "categorical")
                    .otherwise("free_text").alias("kind")))


def top_values(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """Most frequent values (trimmed) with count and share of the non-missing rows; ties by value."""
    v = strip(quoted(col).cast("string")).alias("value")
    counts = df.select(v).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(quoted(col)).alias("total"))
    return (counts.orderBy(F.desc("n"), "value").limit(k).crossJoin(F.broadcast(total))
            .select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")))


WIDE = 24  # columns beyond which pairs are summed as blocked products


def pairs(cols: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def correlation_cells(df: DataFrame, cols: list[str], over: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (col_a, col_b, r) for all pairs from one scan, over pairwise complete rows.

    All pairs of more than ``WIDE`` columns come from blocked products instead of an expression each.
    """
    if over is None and len(cols) > WIDE:
        names = F.array(*[F.lit(c) for c in cols])
        return correlations(df, cols).select(F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), "r")
    over = pairs(cols) if over is None else over
    if not over:
        return nothing(df, "col_a string, col_b string, r double")
    parts = []
    for lo in range(0, len(over), 60):
        block = over[lo:lo + 60]
        one = df.agg(*[safe_corr(as_double(df, a), as_double(df, b)).alias(f"_{i}") for i, (a, b) in enumerate(block)])
        parts.append(one.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_{i}").alias("r"))
            for i, (a, b) in enumerate(block)]))))
    return reduce(DataFrame.unionByName, parts)


def correlated_pairs(df: DataFrame, threshold: float = 0.95, cols: list[str] | None = None) -> DataFrame:
    cells = correlation_cells(df, cols or numeric_columns(df))
    return cells.where(F.abs("r") >= threshold).select("col_a", "col_b", F.round(F.abs("r"), 4).alias("correlation"))


def duplicate_columns(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Text column pairs that agree on almost every row; two missing values agree."""
    over = pairs(string_columns(df))
    if not over:
        return nothing(df, "col_a string, col_b string, pct_identical double")
    parts = []
    for lo in range(0, len(over), 60):
        block = over[lo:lo + 60]
        one = df.agg(*[share(quoted(a).eqNullSafe(quoted(b))).alias(f"_{i}") for i, (a, b) in enumerate(block)])
        parts.append(one.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_{i}").alias("same"))
            for i, (a, b) in enumerate(block)]))))
    return reduce(DataFrame.unionByName, parts).where(F.col("same") >= threshold).select(
        "col_a", "col_b", F.round(F.col("same") * 100, 2).alias("pct_identical"))


def schema_anomalies(df: DataFrame, mode: str = "token") -> DataFrame:
    """Columns that are all missing, constant, mixed, unevenly delimited or negative against their name."""
    texts, numbers = set(string_columns(df)), set(numeric_columns(df))
    none_d, zero = F.lit(None).cast("double"), F.lit(0).cast("long")

    def make(c):
        x, t = quoted(c), c in texts
        parts = F.size(F.split(x, ","))
        return {"present": F.count(x),
                "number_share": F.count(text_to_number(x)) / F.nullif(F.count(x), F.lit(0)) if t else none_d,
                "comma_share": share(x.contains(",")) if t else none_d,
                "parts_std": F.stddev_samp(F.when(x.isNotNull(), parts)) if t else none_d,
                "negatives": tally(quoted(c) < 0) if c in numbers and name_matches(c, NAME_POSITIVE, mode) else zero}

    j = column_stats(df, df.columns, make).join(F.broadcast(distinct_counts(df, df.columns)), "column", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.select("column", (F.col("present") == 0).alias("entirely_null"),
                    flag(F.col("nunique") == 1).alias("constant"),
                    flag((F.col("number_share") > 0) & (F.col("number_share") < 1)).alias("mixed_types"),
                    flag((F.col("comma_share") > 0.3) & (F.col("parts_std") > 1)).alias("delimited_variable"),
                    F.col("negatives").alias("negative_rows"))


def pk_violations(df: DataFrame, cols: list[str] | None = None, mode: str = "token") -> DataFrame:
    """Rows in groups of equal values of key-like columns; repeated missing values count as well."""
    cols = names_like(df, NAME_KEY, mode) if cols is None else cols
    if not cols:
        return nothing(df, "column string, duplicate_members long")
    nulls = column_stats(df, cols, lambda c: {"nulls": tally(quoted(c).isNull())})
    d = nulls.join(F.broadcast(duplicate_values(df, cols)), "column", "left")
    members = F.coalesce("members", F.lit(0)) + F.when(F.col("nulls") > 1, F.col("nulls")).otherwise(0)
    return d.select("column", members.alias("duplicate_members")).where(F.col("duplicate_members") > 0)


def distributions(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Shape and outliers of every numeric column with at least 5 values, and what to do about them."""
    f = numeric_facts(df, cols).where(F.col("n") >= 5)
    n, skewed = F.col("n"), F.abs("skew") > 1.5
    return f.select(
        "column", F.round("skew", 3).alias("skewness"), F.round("kurt", 3).alias("kurtosis"), "iqr_outliers",
        "z_outliers", F.col("negatives").alias("neg_count"), F.col("zeros").alias("zero_count"),
        advice((skewed & (F.col("negatives") == 0), "log1p_transform"),
               (skewed & (F.col("negatives") > 0), "yeo_johnson_transform"),
               (F.col("iqr_outliers") > n * 0.01, "clip_or_cap_outliers"),
               (F.col("z_outliers") > n * 0.005, "review_z_outliers"),
               (F.col("zeros") / n > 0.4, "zero_inflated")).alias("recommendations"))


def missing_report(df: DataFrame) -> DataFrame:
    """Missing counts per column and the imputation each calls for."""
    texts, numbers, times = set(string_columns(df)), set(numeric_columns(df)), set(time_columns(df))
    base = column_stats(df, df.columns, lambda c: (lambda x: {
        "rows": F.count(F.lit(1)), "present": F.count(x),
        "skew": adjusted_skew(x) if c in numbers else F.lit(None).cast("double")})(
        as_double(df, c) if c in numbers else quoted(c)))
    facts = column_frame(df, df.columns, lambda c: {
        "kind": "number" if c in numbers else "text" if c in texts else "time" if c in times else "other",
        "position": df.columns.index(c)})
    vc = value_counts(df, df.columns).groupBy("column").agg(
        F.max("n").alias("top"), F.count(F.lit(1)).alias("nunique"))
    # First text column in schema order with at most 20 values.
    groups = (vc.where(F.col("nunique") <= 20).join(F.broadcast(facts.where("kind = 'text'")), "column")
              .agg(F.min_by("column", "position").alias("group_column")))
    j = (base.join(F.broadcast(facts), "column").join(F.broadcast(vc), "column", "left")
         .crossJoin(F.broadcast(groups)))
    null_n = F.col("rows") - F.col("present")
    pct = null_n / F.col("rows") * 100
    is_num, group = F.col("kind") == "number", F.col("group_column").isNotNull()
    skewed = F.coalesce((F.col("present") > 5) & (F.abs("skew") > 1), F.lit(False))
    dominant = F.coalesce(F.col("top") / F.col("present") * 100 > 70, F.lit(False))
    rec = (F.when(pct > 60, F.lit("consider_dropping_column"))
           .when(is_num, F.concat(F.when(skewed, "fill_median").otherwise("fill_mean_or_median"),
                                  F.when(group, F.concat(F.lit(";groupby_fill_median:"), "group_column"))
                                  .otherwise("")))
           .when(F.col("kind") == "text", F.when(dominant, "fill_mode").otherwise("fill_constant"))
           .when(F.col("kind") == "time", F.lit("forward_or_backward_fill")).otherwise(""))
    return j.where(null_n > 0).select("column", null_n.alias("null_count"), F.round(pct, 2).alias("null_pct"),
                                      rec.alias("recommendations"))


def duplicate_report(df: DataFrame, mode: str = "token") -> DataFrame:
    """Rows (kind, column, duplicates): exact rows, repeated keys and repeated timestamps."""
    keys, times = names_like(df, NAME_KEY_DUPLICATE, mode), time_columns(df)
    parts = [duplicate_rows(df).select(F.lit("rows").alias("kind"), F.lit("*").alias("column"),
                                       F.col("surplus").alias("duplicates"))]
    for kind, cols in (("key", keys), ("timestamp", times)):
        if cols:
            parts.append(duplicate_values(df, cols).where("surplus > 0").select(
                F.lit(kind).alias("kind"), "column", F.col("surplus").alias("duplicates")))
    return reduce(DataFrame.unionByName, parts)


def category_report(df: DataFrame, col: str) -> DataFrame:
    """One row: distinct values, rare values, groups of spellings and the encoding they suggest."""
    v = (df.where(quoted(col).isNotNull()).groupBy(quoted(col).cast("string").alias("v"))
         .agg(F.count(F.lit(1)).alias("n")))
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    g = (v.crossJoin(F.broadcast(total)).groupBy(strip(F.lower("v")).alias("l"))
         .agg(F.count(F.lit(1)).alias("spellings"), tally(F.col("n") / F.col("rows") < 0.01).alias("rare"),
              F.max("rows").alias("rows")))
    r = g.agg(F.sum("spellings").alias("nunique"), tally(F.col("spellings") > 1).alias("variant_groups"),
              F.sum("rare").alias("rare_categories"), F.max("rows").alias("rows"))
    ratio = F.col("nunique") / F.col("rows")
    return r.select(
        F.lit(col).alias("column"), "nunique", F.round(ratio, 4).alias("cardinality_ratio"), "variant_groups",
        "rare_categories",
        F.when(ratio > 0.5, "high_cardinality").when(F.col("nunique") <= 10, "low_cardinality")
        .otherwise("moderate_cardinality").alias("encoding"))


def category_variants(df: DataFrame, col: str) -> DataFrame:
    """Spellings that agree after trimming and lower-casing: one row per spelling with its count."""
    v = (df.where(quoted(col).isNotNull()).groupBy(quoted(col).cast("string").alias("spelling"))
         .agg(F.count(F.lit(1)).alias("n")).withColumn("canonical", strip(F.lower("spelling"))))
    many = v.groupBy("canonical").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    return v.join(many, "canonical", "left_semi").select("canonical", "spelling", "n")


def datetime_report(df: DataFrame, as_of: str | None = None, mode: str = "token") -> DataFrame:
    """Time columns and text columns that parse as dates: range, future and very old values."""
    times = time_columns(df)
    named = [c for c in string_columns(df) if name_matches(c, NAME_DATETIME_WIDE, mode)]
    if not times + named:
        return nothing(df, "column string, already_parsed boolean, parse_pct double, first string, last string, future_dates long, pre_1900_dates long")
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")

    def make(c):
        x = quoted(c).cast("timestamp_ntz") if c in times else parse_any(quoted(c))
        return {"rows": F.count(F.lit(1)), "present": F.count(quoted(c)), "parsed": F.count(x),
                "first": F.min(x), "last": F.max(x), "future_dates": tally(x > now),
                "pre_1900_dates": tally(x < F.lit("1900-01-01").cast("timestamp_ntz"))}

    facts = column_frame(df, times + named, lambda c: {"already_parsed": c in times})
    j = column_stats(df, times + named, make).join(F.broadcast(facts), "column")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return j.where(F.col("already_parsed") | (F.col("parsed") > 0.5 * F.col("present"))).select(
        "column", "already_parsed", F.round(F.col("parsed") / F.nullif("rows", F.lit(0)) * 100, 2).alias("parse_pct"),
        fmt("first").alias("first"), fmt("last").alias("last"), "future_dates", "pre_1900_dates")


def outlier_report(df: DataFrame, col: str, mode: str = "token") -> DataFrame:
    """Fences and outlier counts of one column, and how to treat them."""
    d = df.select(as_number(df, col).alias(col))
    f = numeric_facts(d, [col]).where(F.col("n") >= 4)
    iqr, n = F.col("q3") - F.col("q1"), F.col("n")
    rec = (F.when((F.abs("skew") > 2) & (F.col("min") >= 0), "log1p_transform")
           .when(F.col("extreme_outliers") < n * 0.005, "clip_at_extreme_IQR_bounds")
           .when(F.col("iqr_outliers") < n * 0.02, "clip_at_1pct_99pct_quantiles")
           .otherwise("investigate_before_clipping"))
    neg = (F.col("min") < 0) & F.lit(name_matches(col, NAME_POSITIVE_OUTLIER, mode))
    return f.select("column", F.col("n").alias("count"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                    "min", "max", "q1", "q3", F.round(iqr, 4).alias("iqr"),
                    F.round(F.col("q1") - 1.5 * iqr, 4).alias("lower_fence"),
                    F.round(F.col("q3") + 1.5 * iqr, 4).alias("upper_fence"),
                    F.round(F.col("q1") - 3.0 * iqr, 4).alias("extreme_lower"),
                    F.round(F.col("q3") + 3.0 * iqr, 4).alias("extreme_upper"),
                    F.col("iqr_outliers").alias("mild_outlier_count"),
                    F.col("extreme_outliers").alias("extreme_outlier_count"),
                    F.col("z_outliers").alias("z_score_outlier_count"),
                    F.concat_ws(";", rec, F.when(neg, F.lit("flag_negatives_as_error"))).alias("recommendations"))


def extreme_samples(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """The k lowest and k highest values beyond the outer fences (side, value)."""
    d = df.select(as_number(df, col).alias("value")).where(F.col("value").isNotNull())
    q = exact_quantiles(d, ["value"], QUARTILES)
    iqr = F.col("q3") - F.col("q1")
    j = d.crossJoin(F.broadcast(q.drop("column")))
    low = j.where(F.col("value") < F.col("q1") - 3 * iqr).orderBy("value").limit(k)
    high = j.where(F.col("value") > F.col("q3") + 3 * iqr).orderBy(F.desc("value")).limit(k)
    return low.select(F.lit("low").alias("side"), "value").unionByName(
        high.select(F.lit("high").alias("side"), "value"))


def list_columns(df: DataFrame) -> DataFrame:
    """Rows (position, column, dtype, rows, cols)."""
    facts = column_frame(df, df.columns, lambda c: {"position": df.columns.index(c) + 1, "dtype": type_name(df, c),
                                                    "cols": len(df.columns)})
    return facts.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("rows"))))


def column_statistics(df: DataFrame, table: str) -> DataFrame:
    """Per column of a table: type, missing, distinct and the numeric summary."""
    numbers = numeric_columns(df)
    base = column_stats(df, df.columns, lambda c: (lambda x, num: {
        "rows": F.count(F.lit(1)), "present": F.count(x),
        **{n: (e(x) if num else F.lit(None).cast("double"))
           for n, e in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))}})(
        as_double(df, c) if c in numbers else quoted(c), c in numbers))
    facts = column_frame(df, df.columns, lambda c: {"dtype": type_name(df, c)})
    j = (base.join(F.broadcast(facts), "column")
         .join(F.broadcast(distinct_counts(df, df.columns)), "column", "left"))
    if numbers:
        j = j.join(F.broadcast(exact_quantiles(df, numbers, {"median": 0.5})), "column", "left")
    else:
        j = j.withColumn("median", F.lit(None).cast("double"))
    missing = F.col("rows") - F.col("present")
    return j.select(F.lit(table).alias("table"), "column", "dtype", missing.alias("missing"),
                    F.round(missing / F.col("rows") * 100, 1).alias("missing_pct"),
                    F.coalesce("nunique", F.lit(0)).alias("unique"),
                    *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max")])
