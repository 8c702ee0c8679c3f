"""One-pass statistics over many columns, and exact value counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .kinds import quoted

COLUMNS_PER_AGGREGATE = 25


def nothing(df: DataFrame, schema: str) -> DataFrame:
    """The empty report of an operator that finds no column to look at."""
    return df.sparkSession.createDataFrame([], schema)


def column_stats(df: DataFrame, cols: list[str], make: Callable[[str], dict[str, Column]],
                 reads: list[str] | None = None) -> DataFrame:
    """One row per column with the aggregates ``make(column)`` returns.

    All columns of a block share one aggregate, hence one scan that reads only
    that block; blocks keep generated code below the size the JIT compiles.
    ``reads`` names the columns of a costly report, whose rows are then spread
    over the cores when they are few.
    """
    if reads:
        df = spread(df.select(*[quoted(c) for c in reads]))
    parts = []
    for lo in range(0, len(cols), COLUMNS_PER_AGGREGATE):
        block = cols[lo:lo + COLUMNS_PER_AGGREGATE]
        aggs, structs = [], []
        for i, c in enumerate(block):
            made = make(c)
            aggs += [e.alias(f"_{i}_{n}") for n, e in made.items()]
            structs.append(F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{n}").alias(n) for n in made]))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def melt_numbers(df: DataFrame, cols: list[str], keep: list[str] = (), value: str = "value") -> DataFrame:
    """Rows (keep.., column, value double) without missing values."""
    from .kinds import as_double
    if not cols:
        return df.select(*[quoted(k) for k in keep], F.lit("").alias("column"), F.lit(0.0).alias(value)).limit(0)
    base = spread(df.select(*[quoted(k) for k in keep], *[as_double(df, c).alias(c) for c in cols]))
    return base.unpivot([quoted(k) for k in keep], [quoted(c) for c in cols], "column", value).where(
        F.col(value).isNotNull())


def short_key(df: DataFrame, col: str) -> Column:
    """Grouping key of bounded size: long texts are replaced by their SHA-256 digest."""
    c = quoted(col)
    dt = df.schema[col].dataType
    if isinstance(dt, T.StringType):
        return F.when(F.length(c) > 64, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None)) + F.lit(0.0)  # one zero, NaN as missing
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.sha2(F.to_json(c) if not isinstance(dt, T.ArrayType) else F.to_json(F.struct(c)), 256)
    return c


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (column, value, n): exact counts of every non-null value of every column, values as text.

    Combined on the map side, so a value that fills a third of a column costs
    one row per task in the shuffle. Whole numbers and fractions are grouped in
    their own type and turned into text only once per distinct value.
    """
    def kind(c):
        dt = df.schema[c].dataType
        return "long" if isinstance(dt, T.IntegralType) else "double" if isinstance(dt, (T.FloatType, T.DoubleType)) else "string"

    if not cols:
        return nothing(df, "column string, value string, n long")
    parts = []
    for k in ("long", "double", "string"):
        some = [c for c in cols if kind(c) == k]
        if some:
            base = spread(df.select(*[short_key(df, c).cast(k).alias(c) for c in some]))
            parts.append(base.unpivot([], [quoted(c) for c in some], "column", "value")
                         .where(F.col("value").isNotNull())
                         .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
                         .select("column", F.col("value").cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Rows (column, nunique); columns without any value are absent in exact mode."""
    if approx:
        return column_stats(df, cols, lambda c: {"nunique": F.approx_count_distinct(short_key(df, c))})
    return value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: total rows, surplus copies (keep first) and rows in groups of copies (keep none).

    Rows are grouped by a 128-bit digest, so 16 bytes of each are shuffled. Each
    value goes in with whether it is missing, since a hash skips missing values.
    """
    cols = cols or df.columns
    parts = [x for c in cols for x in (quoted(c).isNull(), short_key(df, c))]
    g = df.select(*[F.xxhash64(F.lit(seed), *parts).alias(f"_d{seed}") for seed in (1, 2)]).groupBy("_d1", "_d2").agg(
        F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("surplus"),
                 F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("long").alias("members"))


def duplicate_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (column, surplus, members) of repeated non-null values per column."""
    return value_counts(df, cols).groupBy("column").agg(
        F.sum(F.col("n") - 1).cast("long").alias("surplus"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("members"))


def column_frame(df: DataFrame, cols: list[str], facts: Callable[[str], dict]) -> DataFrame:
    """Schema facts as rows: one per column, from names and types only."""
    rows = [dict(column=c, **facts(c)) for c in cols]
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in rows[0].items())
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)
