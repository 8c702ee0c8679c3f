"""Cleaning transforms. None of them drops rows, except ``dedup``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_any
from ..functions.kinds import FAKE_NULLS, SENTINELS, as_double, quoted, string_columns, strip, text_to_number
from ..functions.ordering import carry
from ..functions.quantiles import exact_quantiles, one_row
from ..functions.wide import column_stats


def replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns replaced in place, order kept."""
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns],
                     *[e.alias(c) for c, e in new.items() if c not in df.columns])


def nullify(df: DataFrame, cols: list[str] | None = None, tokens: list[str] = FAKE_NULLS) -> DataFrame:
    cols = string_columns(df) if cols is None else cols
    return replace(df, {c: F.when(~strip(quoted(c)).isin(tokens), quoted(c)) for c in cols})


def nullify_sentinels(df: DataFrame, col: str, values: list[float] = SENTINELS) -> DataFrame:
    return replace(df, {col: F.when(~quoted(col).isin(values), quoted(col))})


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """One row (value): most frequent value, the smallest on a tie."""
    c = df.where(quoted(col).isNotNull()).groupBy(quoted(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("n").agg(F.min("value").alias("value")).agg(F.max_by("value", "n").alias("value"))


def impute(df: DataFrame, how: dict[str, object]) -> DataFrame:
    """Fill per column: ``mean``, ``median``, ``mode`` or ``("constant", value)``."""
    new, out = {}, df
    means = [c for c, h in how.items() if h == "mean"]
    medians = [c for c, h in how.items() if h == "median"]
    if means:
        m = df.agg(*[F.avg(as_double(df, c)).alias(f"_mean_{c}") for c in means])
        out = out.crossJoin(F.broadcast(m))
        new |= {c: F.coalesce(as_double(df, c), quoted(f"_mean_{c}")) for c in means}
    if medians:
        q = exact_quantiles(df, medians, {"v": 0.5}).agg(*[
            F.max(F.when(F.col("column") == c, F.col("v"))).alias(f"_median_{c}") for c in medians])
        out = out.crossJoin(F.broadcast(q))
        new |= {c: F.coalesce(as_double(df, c), quoted(f"_median_{c}")) for c in medians}
    for c, h in how.items():
        if h == "mode":
            out = out.crossJoin(F.broadcast(mode_of(df, c).withColumnRenamed("value", f"_mode_{c}")))
            new[c] = F.coalesce(quoted(c), quoted(f"_mode_{c}"))
        elif isinstance(h, tuple):
            new[c] = F.coalesce(quoted(c), F.lit(h[1]).cast(df.schema[c].dataType))
        elif h not in ("mean", "median"):
            raise ValueError(f"unknown strategy {h!r}")
    return out.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def impute_group(df: DataFrame, col: str, by: str) -> DataFrame:
    """Fill with the median of the row's group; groups without any value stay missing."""
    q = exact_quantiles(df, [col], {"_m": 0.5}, by=[by]).drop("column")
    return df.join(q, by, "left").select(*[
        F.coalesce(as_double(df, c), F.col("_m")).alias(c) if c == col else quoted(c) for c in df.columns])


def ffill(df: DataFrame, cols: list[str], order_by: list[str], by: list[str] = (), backward: bool = False) -> DataFrame:
    """Carry the last (or next) known value along the order, per key."""
    return carry(df, list(by), list(order_by), cols, backward)


def add_null_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_null": quoted(c).isNull().cast("int") for c in cols})


def dedup(df: DataFrame, keys: list[str] | None = None, order_by: list[str] | None = None, keep: str = "first") -> DataFrame:
    """One row per key (per row without keys).

    With an order the first or last row is kept through a min/max of the row,
    which combines on the map side; ties fall to the smallest or largest row.
    """
    if keys is None:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in (order_by or []) if c not in keys]
    row = F.struct(*[quoted(c) for c in order], *[quoted(c) for c in rest if c not in order])
    pick = F.min if keep == "first" else F.max
    return df.groupBy(*[quoted(k) for k in keys]).agg(pick(row).alias("_r")).select(
        *[quoted(c) if c in keys else F.col("_r").getField(c).alias(c) for c in df.columns])


def apply_mapping(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Replace values found in ``mapping`` (value, canonical)."""
    m = mapping.select(F.col("value").alias("_from"), F.col("canonical").alias("_to"))
    return df.join(m, strip(quoted(col)) == F.col("_from"), "left").select(*[
        F.coalesce(F.col("_to"), quoted(c)).alias(c) if c == col else quoted(c) for c in df.columns])


def cast_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Safe casts: what does not convert becomes missing. ``date`` and ``timestamp`` texts try several formats."""
    new = {}
    for c, t in spec.items():
        text = c in string_columns(df)
        if text and t in ("date", "timestamp", "timestamp_ntz"):
            new[c] = parse_any(quoted(c)).cast(t)
        elif text and t in ("double", "float", "int", "bigint"):
            new[c] = text_to_number(quoted(c)).try_cast(t)
        elif text and t == "boolean":
            low = F.lower(strip(quoted(c)))
            new[c] = (F.when(low.isin("true", "t", "yes", "y", "1"), True)
                      .when(low.isin("false", "f", "no", "n", "0"), False))
        else:
            new[c] = quoted(c).try_cast(t)
    return replace(df, new)


def parse_dates(df: DataFrame, col: str, formats: list[str] | None = None) -> DataFrame:
    return replace(df, {col: parse_any(quoted(col), formats)})


def to_utc(df: DataFrame, col: str, tz: str) -> DataFrame:
    """Local wall-clock times of a zone as UTC wall-clock times."""
    return replace(df, {col: F.convert_timezone(F.lit(tz), F.lit("UTC"), quoted(col).cast("timestamp_ntz"))})


def clip_bounds(df: DataFrame, cols: list[str], method: str = "iqr", factor: float = 1.5) -> DataFrame:
    """Rows (column, lo, hi)."""
    if method == "quantile":
        return exact_quantiles(df, cols, {"lo": 0.01, "hi": 0.99})
    q = exact_quantiles(df, cols, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", (F.col("q1") - factor * iqr).alias("lo"), (F.col("q3") + factor * iqr).alias("hi"))


def clip(df: DataFrame, col: str, method: str = "iqr", factor: float = 1.5) -> DataFrame:
    """Values beyond the fences (or beyond the 1 % and 99 % quantiles) moved to the fence."""
    b = one_row(clip_bounds(df, [col], method, factor).select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "_lo", "_hi")
    x = as_double(df, col)
    return df.crossJoin(F.broadcast(b)).select(*[
        F.when(x.isNotNull(), F.greatest(F.col("_lo"), F.least(F.col("_hi"), x))).alias(c) if c == col else quoted(c)
        for c in df.columns])


def log1p(df: DataFrame, col: str) -> DataFrame:
    return replace(df, {col: F.log1p(as_double(df, col))})


def _yj(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def yeo_johnson_lambda(df: DataFrame, col: str, grid: list[float] | None = None) -> float:
    """Lambda of the grid with the highest likelihood: all candidates in one aggregate."""
    import math
    grid = grid or [i / 10 for i in range(-20, 41)]
    x = as_double(df, col)
    r = df.agg(F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"),
               *[F.var_pop(_yj(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
    score = {g: -r["n"] / 2 * math.log(r[f"v{i}"]) + (g - 1) * r["j"] for i, g in enumerate(grid)
             if r[f"v{i}"] and math.isfinite(r[f"v{i}"])}
    return max(score, key=score.get)


def yeo_johnson(df: DataFrame, col: str, lam: float | None = None) -> DataFrame:
    lam = yeo_johnson_lambda(df, col) if lam is None else lam
    return replace(df, {col: _yj(as_double(df, col), lam)})


def flag(df: DataFrame, col: str, rule: str, lo: float | None = None, hi: float | None = None, factor: float = 1.5) -> DataFrame:
    """0/1 column ``<col>_<rule>``: ``negative``, ``range`` (given bounds) or ``outlier`` (fences)."""
    x, name = as_double(df, col), f"{col}_{rule}"
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    if rule == "negative":
        return df.withColumn(name, one(x < 0))
    if rule == "range":
        return df.withColumn(name, one((x < lo) | (x > hi)))
    b = one_row(clip_bounds(df, [col], "iqr", factor).select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "_lo", "_hi")
    return df.crossJoin(F.broadcast(b)).withColumn(name, one((x < F.col("_lo")) | (x > F.col("_hi")))).drop("_lo", "_hi")


def standardize_text(df: DataFrame, cols: list[str], case: str = "lower") -> DataFrame:
    """Trim, collapse inner white space, set the case: ``lower``, ``upper``, ``title`` or ``keep``."""
    fn = {"lower": F.lower, "upper": F.upper, "title": F.initcap, "keep": lambda c: c}[case]
    return replace(df, {c: fn(F.regexp_replace(strip(quoted(c)), r"\s+", " ")) for c in cols})


def group_rare(df: DataFrame, col: str, min_share: float = 0.01, other: str = "Other") -> DataFrame:
    """Values below a share of all rows become ``other``."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    keep = (df.where(quoted(col).isNotNull()).groupBy(quoted(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
            .crossJoin(F.broadcast(total)).where(F.col("_n") / F.col("_t") >= min_share).select("_v"))
    # At most 1 / min_share values can reach the share, so this side has a fixed bound.
    return df.join(F.broadcast(keep), quoted(col) == F.col("_v"), "left").select(*[
        F.when(quoted(c).isNull() | F.col("_v").isNotNull(), quoted(c)).otherwise(other).alias(c) if c == col
        else quoted(c) for c in df.columns])


def clean_text_column(c: Column) -> Column:
    """Tags become blanks, invisible and control characters go, line breaks become blanks, ends are trimmed."""
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.regexp_replace(c, r"[\r\n]+", " ")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f​‌‍⁠‎‏﻿‪-‮]", "")
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def clean_text(df: DataFrame, col: str) -> DataFrame:
    return replace(df, {col: clean_text_column(quoted(col))})


# --- Fixed values: characters that windows-1252 has where latin-1 has controls, by code point -----
CP1252 = {"€": 0x80, "‚": 0x82, "ƒ": 0x83, "„": 0x84, "…": 0x85, "†": 0x86, "‡": 0x87, "ˆ": 0x88, "‰": 0x89, "Š": 0x8A,
          "‹": 0x8B, "Œ": 0x8C, "Ž": 0x8E, "‘": 0x91, "’": 0x92, "“": 0x93, "”": 0x94, "•": 0x95, "–": 0x96,
          "—": 0x97, "˜": 0x98, "™": 0x99, "š": 0x9A, "›": 0x9B, "œ": 0x9C, "ž": 0x9E, "Ÿ": 0x9F}
# -------------------------------------------------------------------------------------------


def fix_encoding_column(c: Column) -> Column:
    """UTF-8 that was read as latin-1 or windows-1252 read again as UTF-8; ``\\uXXXX`` escapes decoded.

    A text is re-read only when all its characters exist in the single-byte set
    and the resulting bytes are valid UTF-8; otherwise it stays as it is.
    """
    one_byte = F.translate(c, "".join(CP1252), "".join(chr(v) for v in CP1252.values()))
    safe = F.when(one_byte.rlike("^[\\x{00}-\\x{ff}]*$") & one_byte.rlike("[\\x{c2}-\\x{f4}][\\x{80}-\\x{bf}]"), one_byte)
    raw = F.encode(F.coalesce(safe, F.lit("")), "ISO-8859-1")
    text = raw.cast("string")
    fixed = F.when(safe.isNotNull() & F.is_valid_utf8(text), text).otherwise(c)
    # A surrogate pair is one character: mark it, then decode piece by piece.
    marked = F.regexp_replace(fixed, r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})", r"\\U$1$2")
    utf16 = lambda p, digits: F.concat(F.decode(F.unhex(p.substr(F.lit(3), F.lit(digits))), "UTF-16BE"),
                                       p.substr(F.lit(3 + digits), F.length(p)))
    decoded = F.array_join(F.transform(F.split(marked, r"(?=\\[uU][0-9a-fA-F]{4})"), lambda p: F.when(
        p.rlike(r"^\\U[0-9a-fA-F]{8}"), utf16(p, 8)).when(
        p.rlike(r"^\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}"), utf16(p, 4)).otherwise(p)), "")
    return F.when(fixed.rlike(r"\\u[0-9a-fA-F]{4}"), decoded).otherwise(fixed)


def fix_encoding(df: DataFrame, col: str) -> DataFrame:
    return replace(df, {col: fix_encoding_column(quoted(col))})


def snake_names(names: list[str]) -> list[str]:
    """Unique lower-case names of letters, digits and underscores."""
    out, seen = [], set()
    for n in names:
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", n)
        s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower() or "column"
        s = f"c_{s}" if s[0].isdigit() else s
        name, i = s, 2
        while name in seen:
            name, i = f"{s}_{i}", i + 1
        seen.add(name)
        out.append(name)
    return out


def snake_case(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_names(df.columns))


def split_packed(df: DataFrame, col: str, delim: str = ",", mode: str = "columns", width: int = 2,
                 values: list[str] | None = None) -> DataFrame:
    """Several values in a cell as ``columns`` (``width`` of them), ``rows``, or 0/1 ``indicators`` of ``values``."""
    parts = F.transform(F.split(quoted(col), re.escape(delim)), lambda p: F.trim(p))
    if mode == "columns":
        return df.withColumns({f"{col}_{i + 1}": F.try_element_at(parts, F.lit(i + 1)) for i in range(width)})
    if mode == "rows":
        return df.withColumn(f"{col}_item", F.explode_outer(parts))
    return df.withColumns({f"{col}_{v}": F.coalesce(F.array_contains(parts, v), F.lit(False)).cast("int") for v in values})


def melt(df: DataFrame, ids: list[str], values: list[str], names_to: str = "variable", values_to: str = "value") -> DataFrame:
    return df.unpivot(ids, values, names_to, values_to)


def expand_json(df: DataFrame, col: str, schema: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Fields of embedded JSON as columns: typed with a schema, texts with a field list."""
    if schema:
        s = F.from_json(quoted(col), schema, {"mode": "PERMISSIVE"})
        names = T._parse_datatype_string(schema).fieldNames()
        return df.withColumn("_j", s).withColumns({f"{col}_{f}": F.col("_j").getField(f) for f in names}).drop("_j")
    return df.withColumns({f"{col}_{f}": F.get_json_object(quoted(col), f"$.{f}") for f in fields})


# --- Fixed values: unit spellings and what they are in the target unit ---------------------
WEIGHT_KG = {"kg": 1.0, "kilogram": 1.0, "kilograms": 1.0, "g": 0.001, "gram": 0.001, "grams": 0.001, "lb": 0.4536,
             "lbs": 0.4536, "pound": 0.4536, "pounds": 0.4536, "oz": 0.02835}
DISTANCE_KM = {"km": 1.0, "m": 0.001, "meter": 0.001, "meters": 0.001, "cm": 0.00001, "mile": 1.6093, "miles": 1.6093,
               "ft": 0.0003048, "feet": 0.0003048, "inch": 0.0000254, "inches": 0.0000254}
AMOUNT_FACTOR = {"k": 1e3, "m": 1e6, "b": 1e9, "%": 0.01}
# -------------------------------------------------------------------------------------------


def convert_units(df: DataFrame, col: str, domain: str, out: str | None = None) -> DataFrame:
    """``12 lbs`` -> kg, ``70F`` -> Celsius, ``3 miles`` -> km; a bare number is taken as the target unit."""
    low = F.lower(strip(quoted(col)))
    pattern = r"^([-+]?\d+\.?\d*)\s*°?\s*([a-z]*)$"
    x = F.regexp_extract(low, pattern, 1).try_cast("double")
    u = F.regexp_extract(low, pattern, 2)
    if domain == "temperature":
        y = (F.when(u.isin("", "c", "celsius"), x).when(u.isin("f", "fahrenheit"), (x - 32) * 5 / 9)
             .when(u.isin("k", "kelvin"), x - 273.15))
    else:
        y = F.when(u == "", x)
        for unit, factor in (WEIGHT_KG if domain == "weight" else DISTANCE_KM).items():
            y = y.when(u == unit, x * factor)
    return df.withColumn(out or f"{col}_{domain}", y)


def parse_amount(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """``$1,234.5k`` -> 1234500.0, ``12%`` -> 0.12; what does not fit is missing."""
    low = F.lower(F.regexp_replace(quoted(col), r"[$€£¥₹,\s]", ""))
    pattern = r"^([-+]?\d+\.?\d*)([kmb%]?)$"
    x, u = F.regexp_extract(low, pattern, 1).try_cast("double"), F.regexp_extract(low, pattern, 2)
    y = F.when(u == "", x)
    for unit, factor in AMOUNT_FACTOR.items():
        y = y.when(u == unit, x * factor)
    return df.withColumn(out or f"{col}_amount", y)


def mask_column(c: Column, action: str, as_of: str | None = None) -> Column:
    if action == "hash":
        return F.sha2(c.cast("string"), 256)
    if action == "digits":  # the last seven digits
        d = F.reverse(F.split(c.cast("string"), ""))
        seen = F.aggregate(d, F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), lambda acc, ch: F.struct(
            (acc["n"] + ch.rlike("[0-9]").cast("int")).alias("n"),
            F.concat(F.when(ch.rlike("[0-9]") & (acc["n"] < 7), F.lit("*")).otherwise(ch), acc["s"]).alias("s")))
        return seen["s"]
    if action == "card":
        d = F.regexp_replace(c, r"[^0-9]", "")
        return F.concat(F.substring(d, 1, 4), F.repeat(F.lit("*"), F.greatest(F.length(d) - 8, F.lit(0))), F.substring(d, -4, 4))
    if action == "ip":
        return F.regexp_replace(c, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", "$1.0/24")
    if action == "age_bucket":
        now = F.lit(as_of).cast("date") if as_of else F.current_date()
        age = F.floor(F.months_between(now, c.cast("date")) / 12)
        return (F.when(age < 18, "0-18").when(age < 35, "18-35").when(age < 50, "35-50").when(age >= 50, "50+"))
    if action == "city":  # what follows the first comma of an address
        return F.trim(F.regexp_replace(c, r"^[^,]*,", ""))
    raise ValueError(f"unknown action {action!r}")


def mask_pii(df: DataFrame, actions: dict[str, str], as_of: str | None = None) -> DataFrame:
    return replace(df, {c: mask_column(quoted(c), a, as_of) for c, a in actions.items()})


def drop_columns(df: DataFrame, cols: list[str] | None = None, constant: bool = False) -> DataFrame:
    """Drop named columns, and with ``constant`` those holding at most one distinct value."""
    gone = list(cols or [])
    if constant:
        r = column_stats(df, df.columns, lambda c: {"same": F.coalesce(
            F.min(quoted(c).cast("string")) == F.max(quoted(c).cast("string")), F.lit(True))})
        gone += [x["column"] for x in r.where("same").collect()]
    return df.drop(*gone)


def fit_scaler(df: DataFrame, cols: list[str], kind: str = "standard") -> DataFrame:
    """Rows (column, shift, scale) learned from a training frame."""
    x = {c: (F.log1p(as_double(df, c)) if kind == "log1p_standard" else as_double(df, c)) for c in cols}
    if kind == "robust":
        q = exact_quantiles(df, cols, {"q1": 0.25, "m": 0.5, "q3": 0.75})
        return q.select("column", F.col("m").alias("shift"), (F.col("q3") - F.col("q1")).alias("scale"))
    if kind == "min_max":
        make = lambda c: {"shift": F.min(x[c]), "scale": F.max(x[c]) - F.min(x[c])}
    else:
        make = lambda c: {"shift": F.avg(x[c]), "scale": F.stddev_pop(x[c])}
    return column_stats(df, cols, make)


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str], kind: str = "standard") -> DataFrame:
    """Apply learned shifts and scales; a zero scale leaves the centred value."""
    one = scaler.agg(*[F.max(F.when(F.col("column") == c, F.col(p))).alias(f"_{p}_{c}") for c in cols
                       for p in ("shift", "scale")])
    def value(c):
        x = F.log1p(as_double(df, c)) if kind == "log1p_standard" else as_double(df, c)
        return (x - quoted(f"_shift_{c}")) / F.coalesce(F.nullif(quoted(f"_scale_{c}"), F.lit(0.0)), F.lit(1.0))
    return df.crossJoin(F.broadcast(one)).select(*[value(c).alias(c) if c in cols else quoted(c) for c in df.columns])


def resample(df: DataFrame, ts: str, freq: str, by: list[str] = (), aggs: dict[str, Column] | None = None) -> DataFrame:
    """One row per period (``hour``, ``day``, ``week``, ``month``) between the first and last of each series.

    Periods without rows appear with missing aggregates.
    """
    by = list(by)
    period = F.date_trunc(freq, quoted(ts).cast("timestamp_ntz").cast("timestamp")).cast("timestamp_ntz")
    a = df.where(quoted(ts).isNotNull()).groupBy(*by, period.alias("period")).agg(*[e.alias(n) for n, e in aggs.items()])
    step = F.expr(f"interval 1 {freq}")
    span = a.groupBy(*by).agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
    calendar = span.select(*by, F.explode(F.sequence("_a", "_b", step)).alias("period"))
    return calendar.join(a, [*by, "period"], "left")
