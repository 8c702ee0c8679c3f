"""Quality inspections: text, encoding, ranges, units, PII, leakage, sparsity, structure, before/after audits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crossproducts import centres, pair_sums
from ..functions.kinds import (BOILERPLATE, ENCODING_PATTERNS, NAME_COST, NAME_END, NAME_LEAK, NAME_LEAK_ID, NAME_PII,
                               NAME_PROFIT, NAME_RANGE, NAME_REVENUE, NAME_START, PII_PATTERNS, QUALITY_PATTERNS,
                               SENTINELS, UNIT_PATTERNS, as_double, as_number, name_matches, names_like,
                               numeric_columns, quoted, share, string_columns, strip, tally, time_columns, type_name)
from ..functions.moments import adjusted_skew
from ..functions.quantiles import read_back
from ..functions.wide import column_frame, column_stats, distinct_counts, duplicate_rows, nothing
from ..session import spread
from .profile import correlation_cells, fake_null



def _zero():
    return F.lit(0).cast("long")


def text_quality(df: DataFrame, col: str) -> DataFrame:
    """Length statistics and content problems of a text column."""
    c = quoted(col)
    n = F.length(c)
    one = spread(df.select(c)).agg(
        F.count(c).alias("row_count"), F.avg(n).alias("avg"), F.max(n).alias("max_length"), F.min(n).alias("min_length"),
        F.stddev_samp(n).alias("std"), *[share(c.rlike(p)).alias(k) for k, p in QUALITY_PATTERNS.items()],
        tally(strip(F.lower(c)).isin(BOILERPLATE)).alias("boilerplate_rows"),
        share(c.startswith("{") | c.startswith("[")).alias("json"))
    return one.select(
        F.lit(col).alias("column"), "row_count", F.round("avg", 1).alias("avg_length"),
        F.col("max_length").cast("long").alias("max_length"), F.col("min_length").cast("long").alias("min_length"),
        (F.col("html") > 0.1).alias("html_tags"), (F.col("escapes") > 0.1).alias("unicode_escapes"),
        (F.col("control") > 0).alias("control_characters"), "boilerplate_rows", (F.col("json") > 0.2).alias("embedded_json"),
        (F.col("std") > 2 * F.col("avg")).alias("high_length_variance"), (F.col("multiline") > 0.1).alias("multiline"))


def date_order_violations(df: DataFrame, over: list[tuple[str, str]] | None = None, mode: str = "token") -> DataFrame:
    """Rows (col_start, col_end, violations) where the end lies before the start; pairs without violations are left out."""
    if over is None:
        over = [(a, b) for a in names_like(df, NAME_START, mode) for b in names_like(df, NAME_END, mode) if a != b]
    if not over:
        return nothing(df, "col_start string, col_end string, violations long")
    ts = lambda c: quoted(c).cast("timestamp_ntz") if c in time_columns(df) else F.try_to_timestamp(
        quoted(c).cast("string")).cast("timestamp_ntz")
    one = df.agg(*[tally(ts(b) < ts(a)).alias(f"_{i}") for i, (a, b) in enumerate(over)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_start"), F.lit(b).alias("col_end"), F.col(f"_{i}").alias("violations"))
        for i, (a, b) in enumerate(over)]))).where("violations > 0")


def financial_violations(df: DataFrame, revenue: str | None = None, cost: str | None = None,
                         profit: str | None = None, tol: float = 0.01, mode: str = "token") -> DataFrame:
    """Rows (revenue, cost, profit, violations) where revenue - cost differs from profit by more than ``tol``."""
    number = set(numeric_columns(df))
    rs = [revenue] if revenue else [c for c in names_like(df, NAME_REVENUE, mode) if c in number]
    cs = [cost] if cost else [c for c in names_like(df, NAME_COST, mode) if c in number]
    ps = [profit] if profit else [c for c in names_like(df, NAME_PROFIT, mode) if c in number]
    triples = [(r, c, p) for r in rs for c in cs for p in ps if len({r, c, p}) == 3]
    if not triples:
        return nothing(df, "revenue string, cost string, profit string, violations long")
    d = lambda c: as_double(df, c)
    one = df.agg(*[tally(F.abs(d(r) - d(c) - d(p)) > tol).alias(f"_{i}") for i, (r, c, p) in enumerate(triples)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("revenue"), F.lit(c).alias("cost"), F.lit(p).alias("profit"),
                 F.col(f"_{i}").alias("violations")) for i, (r, c, p) in enumerate(triples)])))


def age_dob_mismatch(df: DataFrame, age: str, dob: str, as_of: str | None = None, years: float = 2.0) -> DataFrame:
    """One row: how often the stated age is off the birth date by more than ``years``."""
    now = F.lit(as_of).cast("date") if as_of else F.current_date()
    implied = F.datediff(now, quoted(dob).cast("date")) / 365.25
    return df.agg(tally(F.abs(as_double(df, age) - implied) > years).alias("mismatch_rows")).select(
        F.lit(age).alias("age_col"), F.lit(dob).alias("dob_col"), "mismatch_rows")


def encoding_issues(df: DataFrame) -> DataFrame:
    """Per text column: rows with mojibake, non-ASCII, NUL, direction marks or zero-width characters."""
    if not string_columns(df):
        return nothing(df, "column string, " + ", ".join(f"{k}_rows long" for k in ENCODING_PATTERNS))
    return column_stats(df, string_columns(df), lambda c: {
        f"{k}_rows": tally(quoted(c).rlike(p)) for k, p in ENCODING_PATTERNS.items()}, reads=string_columns(df))


def leakage_scan(df: DataFrame, target: str | None = None, threshold: float = 0.98, mode: str = "token") -> DataFrame:
    """Rows (column, reason, abs_corr): names that suggest the target, identifiers, near-perfect correlation."""
    spark = df.sparkSession
    named = [(c, "name_suggests_target") for c in df.columns if c != target and name_matches(c, NAME_LEAK, mode)]
    named += [(c, "id_column") for c in df.columns if c != target and name_matches(c, NAME_LEAK_ID, mode)]
    out = spark.createDataFrame([(c, r, None) for c, r in named], "column string, reason string, abs_corr double")
    numbers = numeric_columns(df)
    if target in numbers and len(numbers) > 1:
        cells = correlation_cells(df, numbers, [(c, target) for c in numbers if c != target])
        out = out.unionByName(cells.where(F.abs("r") > threshold).select(
            F.col("col_a").alias("column"), F.lit("correlates_with_target").alias("reason"),
            F.round(F.abs("r"), 4).alias("abs_corr")))
    return out


def _snapshot(df: DataFrame) -> DataFrame:
    base = column_stats(df, df.columns, lambda c: {"rows": F.count(F.lit(1)), "nulls": tally(quoted(c).isNull())})
    facts = column_frame(df, df.columns, lambda c: {"dtype": type_name(df, c)})
    return (base.join(F.broadcast(facts), "column")
            .join(F.broadcast(distinct_counts(df, df.columns)), "column", "left").na.fill(0, ["nunique"]))


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column of either frame: row, null and type changes, newly constant and all-missing columns."""
    b = _snapshot(before).select("column", *[F.col(c).alias(f"b_{c}") for c in ("rows", "nulls", "dtype", "nunique")])
    a = _snapshot(after).select("column", *[F.col(c).alias(f"a_{c}") for c in ("rows", "nulls", "dtype", "nunique")])
    rows = lambda d, n: d.agg(F.max(n).alias("x"))
    j = (b.join(a, "column", "full")
         .crossJoin(F.broadcast(rows(b, "b_rows").select(F.col("x").alias("br"))))
         .crossJoin(F.broadcast(rows(a, "a_rows").select(F.col("x").alias("ar")))))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.select(
        "column", F.when(F.col("b_rows").isNull(), "added").when(F.col("a_rows").isNull(), "removed")
        .otherwise("kept").alias("status"),
        (F.col("ar") - F.col("br")).alias("row_delta"), (F.col("a_nulls") - F.col("b_nulls")).alias("null_delta"),
        F.col("b_dtype").alias("dtype_before"), F.col("a_dtype").alias("dtype_after"),
        flag((F.col("a_nunique") <= 1) & (F.coalesce("b_nunique", F.lit(2)) > 1)).alias("new_constant"),
        flag(F.col("a_nulls") == F.col("a_rows")).alias("entirely_null"))


def compare_column(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """Two rows (before, after): nulls, distinct, mean, median, std, or the modal value of a text."""
    from ..functions.quantiles import exact_quantiles
    none_d = F.lit(None).cast("double")

    def side(df, name):
        num = col in numeric_columns(df)
        x = as_double(df, col) if num else quoted(col)
        base = df.agg(tally(x.isNull()).alias("null_count"), (F.avg(x) if num else none_d).alias("mean"),
                      (F.stddev_samp(x) if num else none_d).alias("std"))
        base = base.crossJoin(F.broadcast(distinct_counts(df, [col]).agg(F.coalesce(F.max("nunique"), F.lit(0)).alias("nunique"))))
        if num:
            med = exact_quantiles(df, [col], {"median": 0.5}).agg(F.max("median").alias("median"))
            base = base.crossJoin(F.broadcast(med)).withColumn("mode", F.lit(None).cast("string"))
        else:
            vals = df.where(x.isNotNull()).groupBy(x.cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            top = vals.groupBy("n").agg(F.min("v").alias("v")).agg(F.max_by("v", "n").alias("mode"))
            base = base.crossJoin(F.broadcast(top)).withColumn("median", none_d)
        return base.select(F.lit(name).alias("state"), F.lit(type_name(df, col)).alias("dtype"), "null_count", "nunique",
                           F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"),
                           F.round("std", 4).alias("std"), "mode")

    return side(before, "before").unionByName(side(after, "after"))


def validate_ranges(df: DataFrame, mode: str = "token") -> DataFrame:
    """Rows (column, rule, rows_hit, pct): values against the range their name implies, and frequent sentinels."""
    cols = [c for c in df.columns if c in numeric_columns(df) or c in string_columns(df)]
    if not cols:
        return nothing(df, "column string, rule string, rows_hit long, pct double")
    one_per = column_stats(df, cols, lambda c: (lambda x: {
        "n": F.count(x), "top": F.max(x), "age": tally((x < 0) | (x > 120)), "neg": tally(x < 0),
        "unit": tally((x < 0) | (x > 1)), "hundred": tally((x < 0) | (x > 100)),
        **{f"s{i}": tally(x == s) for i, s in enumerate(SENTINELS)}})(as_number(df, c)))
    facts = column_frame(df, cols, lambda c: {k: name_matches(c, w, mode) for k, w in NAME_RANGE.items()} | {
        "_": True}).withColumnsRenamed({k: f"is_{k}" for k in NAME_RANGE})
    j = one_per.join(F.broadcast(facts), "column").where("n > 0")
    rule = lambda name, cond, hits: F.struct(F.lit(name).alias("rule"), cond.alias("applies"), hits.alias("rows_hit"))
    small_top = F.col("top") <= 1.1
    rules = [rule("age_range_0_120", F.col("is_age") & (F.col("age") > 0), F.col("age")),
             rule("non_negative_financial", F.col("is_money") & (F.col("neg") > 0), F.col("neg")),
             rule("proportion_0_to_1", F.col("is_share") & small_top & (F.col("unit") > 0), F.col("unit")),
             rule("percentage_0_to_100", F.col("is_percent") & ~(F.col("is_share") & small_top) & (F.col("top") > 1)
                  & (F.col("hundred") > 0), F.col("hundred")),
             rule("count_non_negative", F.col("is_count") & (F.col("neg") > 0), F.col("neg"))]
    rules += [rule(f"sentinel_value_{s}_too_frequent", F.col(f"s{i}") / F.col("n") > 0.05, F.col(f"s{i}"))
              for i, s in enumerate(SENTINELS)]
    return j.select("column", "n", F.explode(F.array(*rules)).alias("r")).where("r.applies").select(
        "column", "r.rule", "r.rows_hit", F.round(F.col("r.rows_hit") / F.col("n") * 100, 2).alias("pct"))


def vif(df: DataFrame, cols: list[str] | None = None, intercept: bool = True, threshold: float = 5.0) -> DataFrame:
    """Variance inflation per column over complete rows.

    The k x k cross products about the means are summed by blocks of columns;
    the k x k inverse is solved on the driver. ``intercept=False`` regresses
    through the origin and compares centred variances.
    """
    import numpy as np
    cols = cols or numeric_columns(df)
    k = len(cols)
    empty = df.sparkSession.createDataFrame([], "column string, vif double, high boolean")
    if k < 2:
        return empty
    x = [f"x{i}" for i in range(k)]
    d = df.select(*[as_double(df, c).alias(n) for c, n in zip(cols, x)]).na.drop()
    middle = centres(d, x)
    n, sums, cov = 0, np.zeros(k), np.zeros((k, k))
    for r in pair_sums(d, x, middle).collect():  # one row per pair of columns
        n, sums[r["i"]], sums[r["j"]] = r["n"], r["sx"], r["sy"]
        c = r["sxy"] - r["sx"] * r["sy"] / r["n"]
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = 0.0 if abs(c) <= 1e-14 * r["sxy"] else c / r["n"]
    if n < k + 2:
        return empty
    mean = np.array(middle) + sums / n
    gram = cov + np.outer(mean, mean)
    out = []
    for i in range(k):
        o = [j for j in range(k) if j != i]
        if cov[i, i] <= 0:
            out.append((cols[i], 1.0))
            continue
        if intercept:
            beta, *_ = np.linalg.lstsq(cov[np.ix_(o, o)], cov[o, i], rcond=None)
        else:
            beta, *_ = np.linalg.lstsq(gram[np.ix_(o, o)], gram[o, i], rcond=None)
        resid = cov[i, i] - 2 * beta @ cov[o, i] + beta @ cov[np.ix_(o, o)] @ beta  # centred residual variance
        r2 = 1 - resid / cov[i, i]
        out.append((cols[i], float("inf") if r2 >= 1 - 1e-12 else float(1 / (1 - r2))))
    return df.sparkSession.createDataFrame([(c, v, v > threshold) for c, v in out],
                                           "column string, vif double, high boolean")


def scaling_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Ranges and the scaler each numeric column calls for; ``magnitude_ratio`` compares all ranges."""
    cols = cols or numeric_columns(df)
    if not cols:
        return nothing(df, "column string, min double, max double, mean double, std double, range double, skewness double, "
                           "recommendation string, magnitude_ratio double")
    f = read_back(column_stats(df, cols, lambda c: (lambda x: {
        "n": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x),
        "skew": adjusted_skew(x)})(as_double(df, c))).where("n >= 5"))
    known = {r["column"]: r for r in f.collect()}  # literals already; one row per column
    far = column_stats(df, list(known), lambda c: (lambda x: {"far": F.avg(F.when(
        x.isNotNull(), (F.abs(x - known[c]["mean"]) > 3 * known[c]["std"]).cast("double")))})(as_double(df, c))) if known else nothing(df, "column string, far double")
    rng = F.col("max") - F.col("min")
    mags = f.agg(F.max(rng).alias("hi"), F.min(F.when(rng > 0, rng)).alias("lo"))
    rec = (F.when((F.abs("mean") < 0.1) & (F.col("std") > 0.9) & (F.col("std") < 1.1), "already_standardized")
           .when((F.col("min") >= 0) & (F.col("max") <= 1), "already_min_max")
           .when((F.abs("skew") > 1.5) & (F.col("min") >= 0), "log1p_then_standardize")
           .when(F.col("far") > 0.01, "robust_scaler").otherwise("standard_scaler"))
    return f.join(F.broadcast(far), "column").crossJoin(F.broadcast(mags)).select(
        "column", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")], F.round(rng, 4).alias("range"),
        F.round("skew", 3).alias("skewness"), rec.alias("recommendation"),
        F.round(F.col("hi") / F.coalesce("lo", F.lit(1.0)), 1).alias("magnitude_ratio"))


def naming_issues(df: DataFrame) -> DataFrame:
    """Rows (column, issue) from the column names alone."""
    out = []
    for c in df.columns:
        if " " in c:
            out.append((c, "contains_space"))
        if re.search(r"[^a-zA-Z0-9_]", c):
            out.append((c, "special_characters"))
        if c not in (c.lower(), c.upper()):
            out.append((c, "mixed_case"))
        if c.startswith("Unnamed"):
            out.append((c, "unnamed_column"))
        if c.isdigit():
            out.append((c, "numeric_name"))
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        m = re.match(r"^([a-zA-Z_]+?)_?(\d+)$", c)
        if m:
            groups.setdefault(m.group(1), []).append(c)
    out += [(c, f"wide_format:{p}") for p, cs in groups.items() if len(cs) >= 3 for c in cs]
    return df.sparkSession.createDataFrame(out, "column string, issue string")


def packed_columns(df: DataFrame) -> DataFrame:
    """Rows (column, delimiter, avg_values): text columns that hold several values per cell."""
    delims = [",", "|", ";"]
    cols = string_columns(df)
    if not cols:
        return nothing(df, "column string, delimiter string, avg_values double")

    def make(c):
        x = quoted(c)
        out = {}
        for i, d in enumerate(delims):
            parts = F.when(x.isNotNull(), F.size(F.split(x, re.escape(d))))
            out |= {f"share{i}": share(x.contains(d)), f"std{i}": F.stddev_samp(parts), f"avg{i}": F.avg(parts)}
        return out

    j = column_stats(df, cols, make)
    hit = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.col(f"share{i}").alias("s"), F.col(f"std{i}").alias("d"),
                             F.col(f"avg{i}").alias("a")) for i, d in enumerate(delims)])
    first = F.try_element_at(F.filter(hit, lambda h: h["s"] > 0.4), F.lit(1))
    return j.select("column", first.alias("h")).where("h.d < 2").select(
        "column", "h.delimiter", F.round("h.a", 1).alias("avg_values"))


def unit_issues(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """Rows (column, domain, unit, rows_hit) for text columns that mix units of one domain."""
    cols = string_columns(df)
    if not cols:
        return nothing(df, "column string, domain string, unit string, rows_hit long")
    base = df.select(*[F.lower(quoted(c)).alias(c) for c in cols])
    first = base.unpivot([], [quoted(c) for c in cols], "column", "v").where(F.col("v").isNotNull())
    unit = F.array(*[F.struct(F.lit(d).alias("domain"), F.regexp_extract("v", p, 1).alias("unit"))
                     for d, p in UNIT_PATTERNS.items()])
    hits = (first.select("column", F.explode(F.filter(unit, lambda u: u["unit"] != "")).alias("u"))
            .groupBy("column", "u.domain", "u.unit").agg(F.count(F.lit(1)).alias("rows_hit")))
    mixed = hits.groupBy("column", "domain").agg(F.sum("rows_hit").alias("t"), F.count(F.lit(1)).alias("k")).where(
        (F.col("t") > min_rows) & (F.col("k") > 1))
    return hits.join(mixed, ["column", "domain"], "left_semi")


def unit_suspicions(df: DataFrame, mode: str = "token") -> DataFrame:
    """Numeric columns whose values look like two units: weights in kg and lb, temperatures in F."""
    w = [c for c in numeric_columns(df) if name_matches(c, ["weight", "mass"], mode)]
    t = [c for c in numeric_columns(df) if name_matches(c, ["temp", "temperature"], mode)]
    if not w + t:
        return df.sparkSession.createDataFrame([], "column string, domain string, suspicion string")
    j = column_stats(df, w + t, lambda c: (lambda x: {
        "n": F.count(x), "domain": F.lit("weight" if c in w else "temperature"),
        "light": tally((x >= 30) & (x <= 160)), "heavy": tally((x > 160) & (x <= 400)),
        "celsius": share((x >= -50) & (x <= 60))})(as_double(df, c)))
    lo, hi = F.least("light", "heavy"), F.greatest("light", "heavy")
    bimodal = (F.col("domain") == "weight") & (lo > 10) & (lo / F.nullif(hi, F.lit(0)) > 0.1)
    hot = (F.col("domain") == "temperature") & (F.col("celsius") < 0.5)
    return j.where("n >= 50").select("column", "domain", F.when(bimodal, "mixed_kg_and_lb").when(hot, "fahrenheit")
                                     .alias("suspicion")).where("suspicion is not null")


def sparsity(df: DataFrame) -> DataFrame:
    """Zeros and missing per column and over all cells."""
    numbers = set(numeric_columns(df))
    j = column_stats(df, df.columns, lambda c: (lambda x: {
        "rows": F.count(F.lit(1)), "nulls": tally(x.isNull()),
        "zeros": tally(x == 0) if c in numbers else _zero(),
        "other": tally(~x.isin(0, 1)) if c in numbers else F.lit(1).cast("long")})(
        as_double(df, c) if c in numbers else quoted(c)))
    total = j.agg(F.sum("rows").alias("cells"), F.sum(F.col("zeros") + F.col("nulls")).alias("empty"))
    pct = lambda x: F.round(x / F.col("rows") * 100, 1)
    sparse = (F.col("zeros") + F.col("nulls")) / F.col("rows") * 100
    return j.crossJoin(F.broadcast(total)).select(
        "column", pct(F.col("zeros")).alias("zero_pct"), pct(F.col("nulls")).alias("null_pct"),
        F.round(sparse, 1).alias("sparse_pct"), (sparse > 70).alias("sparse"), (F.col("other") == 0).alias("is_binary_01"),
        F.round(F.col("empty") / F.col("cells") * 100, 1).alias("overall_sparsity_pct"))


def scan_pii(df: DataFrame, threshold: float = 0.3, mode: str = "token", cols: list[str] | None = None) -> DataFrame:
    """Rows (column, pii_type, basis, match_rate_pct, masked_sample): by value pattern, else by column name.

    The sample is the smallest value with all but two characters at each end masked.
    """
    cols = cols or df.columns
    j = column_stats(df, cols, lambda c: (lambda x: {
        **{k: share(x.rlike(p)) for k, p in PII_PATTERNS.items()}, "sample": F.min(x)})(quoted(c).cast("string")), reads=cols)
    hit = F.array(*[F.struct(F.lit(k).alias("pii_type"), F.col(k).alias("rate")) for k in PII_PATTERNS])
    by_value = F.transform(F.filter(hit, lambda h: h["rate"] > threshold), lambda h: F.struct(
        h["pii_type"].alias("pii_type"), F.lit("value_pattern").alias("basis"),
        F.round(h["rate"] * 100, 1).alias("match_rate_pct")))
    named = {c: [k for k, w in NAME_PII.items() if name_matches(c.replace(" ", "_"), w, mode)][:1] for c in cols}
    facts = column_frame(df, cols, lambda c: {"named": (named[c] or [""])[0]})
    by_name = F.when(F.col("named") != "", F.array(F.struct(
        F.col("named").alias("pii_type"), F.lit("column_name").alias("basis"),
        F.lit(None).cast("double").alias("match_rate_pct")))).otherwise(F.slice(by_value, 1, 0))
    s = F.col("sample")
    mask = F.when(F.length(s) > 4, F.concat(F.substring(s, 1, 2), F.lit("***"), F.substring(s, -2, 2))).otherwise("***")
    return (j.join(F.broadcast(facts), "column")
            .withColumn("_h", F.explode(F.when(F.size(by_value) > 0, by_value).otherwise(by_name)))
            .select("column", "_h.pii_type", "_h.basis", "_h.match_rate_pct",
                    F.when(F.col("_h.basis") == "value_pattern", mask).alias("masked_sample")))


def quality_score(df: DataFrame) -> DataFrame:
    """One row: mean share of usable cells less the share of duplicate rows, never below 0."""
    texts = set(string_columns(df))
    j = column_stats(df, df.columns, lambda c: {
        "bad": share(quoted(c).isNull() | (F.coalesce(fake_null(quoted(c)), F.lit(False)) if c in texts else F.lit(False)))})
    return j.agg(F.avg(1 - F.col("bad")).alias("usable")).crossJoin(F.broadcast(duplicate_rows(df))).select(
        F.col("rows"), F.round("usable", 6).alias("usable_share"),
        F.round(F.col("surplus") / F.col("rows"), 6).alias("duplicate_share"),
        F.round(F.greatest(F.lit(0.0), F.col("usable") - F.col("surplus") / F.col("rows")), 6).alias("score"))


def validate_features(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """Per requested feature: does it exist, missing share, distinct values, variance, correlation with the target."""
    have = [c for c in cols if c in df.columns]
    numbers = set(numeric_columns(df))
    t = target if target in numbers else None
    gone = df.sparkSession.createDataFrame(
        [(c, "missing", None, None, None, None) for c in cols if c not in have],
        "column string, status string, null_pct double, nunique long, has_variance boolean, abs_corr double")
    if not have:
        return gone
    from ..functions.moments import safe_corr
    none_d = F.lit(None).cast("double")
    base = column_stats(df, have, lambda c: (lambda x: {
        "null_share": share(x.isNull()), "std": F.stddev_samp(x) if c in numbers else none_d,
        "r": safe_corr(x, as_double(df, t)) if t and c in numbers and c != t else none_d})(
        as_double(df, c) if c in numbers else quoted(c)))
    facts = column_frame(df, have, lambda c: {"is_number": c in numbers})
    j = base.join(F.broadcast(facts), "column").join(F.broadcast(distinct_counts(df, have)), "column", "left")
    ok = j.select("column", F.lit("present").alias("status"), F.round(F.col("null_share") * 100, 2).alias("null_pct"),
                  F.coalesce("nunique", F.lit(0)).alias("nunique"),
                  F.coalesce(F.when(F.col("is_number"), F.col("std") > 0).otherwise(F.col("nunique") > 1),
                             F.lit(False)).alias("has_variance"),
                  F.round(F.abs("r"), 4).alias("abs_corr"))
    return ok.unionByName(gone)
