"""Relational operators: SQL, joins, windows, pivots, sampling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.kinds import quoted, type_name
from ..functions.ordering import CHUNK, carry, chunked, dense_codes, null_safe_join, order_number
from ..functions.wide import column_stats, distinct_counts
from ..session import cut_lineage


OPEN_LEVEL = 5000  # of ranges without an end; above the exponent of any double


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None,
            limit: int | None = None) -> DataFrame:
    """Spark SQL over the given tables: all rows, or the first ``limit``."""
    for n, df in (tables or {}).items():
        df.createOrReplaceTempView(n)
    out = spark.sql(sql)
    return out if limit is None else out.limit(limit)


def filter_rows(df: DataFrame, cond: Column | str) -> DataFrame:
    return df.filter(cond)


def join_tables(a: DataFrame, b: DataFrame, on: list[str], how: str = "outer",
                suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join on shared names; other shared names get suffixes. Adaptive execution picks and splits."""
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("left_semi", "left_anti"):
        both = (set(a.columns) & set(b.columns)) - set(on)
        a = a.withColumnsRenamed({c: c + suffixes[0] for c in both})
        b = b.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, on, how)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, by: list[str] = (),
               totals: dict[str, tuple[Column, Callable]] | None = None) -> DataFrame:
    """Rows with ``low <= point < high``, joined on cells that fit each range's own length.

    A range of length up to ``2**k`` is of level ``k`` and touches at most two
    cells of that width; a point asks one cell of each level in use. So there is
    no width to guess, and a mix of short and long ranges lists each range twice
    at most. Numbers and times; a missing bound matches nothing, and ranges that
    have no end or no beginning share one cell that every point asks. ``by``
    adds equality keys.

    With ``totals`` the pairs are added up and not listed: each range that holds
    a point gets, by name, an aggregate over its points, given with the function
    that combines its partial results (``{"n": (F.count(F.lit(1)), F.sum)}``).
    """
    by = list(by)
    if totals:
        return _range_totals(points, ranges, point, low, high, by, totals)

    def cell(x: Column, level: Column) -> Column:
        # Division by a power of two is exact; beyond 2**52 cells a double is a whole number of them.
        q = x / F.pow(F.lit(2.0), level)
        return F.when(level == OPEN_LEVEL, 0.0).otherwise(F.when(F.abs(q) >= float(1 << 52), q).otherwise(F.floor(q).cast("double")))

    lo, hi = order_number(ranges, low), order_number(ranges, high)
    length = hi - lo
    rough = F.ceil(F.log2(length)).cast("int")  # may be one short by rounding
    level = F.when(length <= 0, 0).when(F.abs(length) == float("inf"), OPEN_LEVEL).otherwise(
        rough + (F.pow(F.lit(2.0), rough) < length).cast("int"))
    r = ranges.where(quoted(low) < quoted(high)).withColumn("_level", level)
    levels = [x["_level"] for x in r.select("_level").distinct().collect()]  # one row per level: the exponents of doubles bound them
    r = r.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(lo, F.col("_level")), cell(hi, F.col("_level"))))))
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.expr("CAST(array() AS array<int>)")))
    p = p.withColumn("_cell", cell(order_number(points, point), F.col("_level")))
    return (p.join(r, [*by, "_level", "_cell"]).where((quoted(point) >= quoted(low)) & (quoted(point) < quoted(high)))
            .drop("_level", "_cell"))


def _range_totals(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, by: list[str], totals: dict) -> DataFrame:
    """``range_join`` with totals, whose work follows points and ranges, not pairs.

    The bounds cut the order into steps that no range divides. Points are
    combined by step, and steps by blocks of two, four, eight and so on; a range
    is at most two blocks of each size.
    """
    r = ranges.where(quoted(low) < quoted(high))
    kind = points.select(point).limit(0).union(r.select(low).limit(0)).union(r.select(high).limit(0)).schema[point].dataType
    bounds = r.select(F.explode(F.array(quoted(low).cast(kind), quoted(high).cast(kind))).alias("_at")).distinct()
    codes = cut_lineage(dense_codes(bounds, "_at").select(F.col("value").alias("_at"), F.col("code").alias("_step")))
    combine = [f(n).alias(n) for n, (_, f) in totals.items()]
    p = points.where(quoted(point).isNotNull()).groupBy(*by, quoted(point).cast(kind).alias("_at")).agg(*[c.alias(n) for n, (c, _) in totals.items()])
    steps = asof_join(p, codes, "_at", []).where("_step IS NOT NULL").groupBy(*by, "_step").agg(*combine)
    top = codes.count().bit_length()
    blocks = steps.withColumn("_size", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_block", F.expr("shiftright(_step, _size)"))
    blocks = blocks.groupBy(*by, "_size", "_block").agg(*combine)
    first, end = (codes.select(F.col("_at").alias(f"{c}_at"), F.col("_step").alias(c)) for c in ("_first", "_end"))
    spans = r.join(first, quoted(low).cast(kind) == F.col("_first_at")).join(end, quoted(high).cast(kind) == F.col("_end_at")).drop("_first_at", "_end_at")
    # Whole blocks a to b of a size: the first is taken if odd, the last if the end is odd, the others belong to blocks of the next size.
    taken = F.expr(f"""flatten(transform(
        filter(transform(sequence(0, {top}), k -> struct(k, shiftright(_first + shiftleft(1L, k) - 1, k) AS a, shiftright(_end, k) AS b)), x -> x.a < x.b),
        x -> filter(array(if(x.a % 2 = 1, struct(x.k AS k, x.a AS c), NULL), if(x.b % 2 = 1, struct(x.k AS k, x.b - 1 AS c), NULL)), y -> y IS NOT NULL)))""")
    asked = spans.select(*by, "_first", "_end").distinct().withColumn("_x", F.explode(taken))
    asked = asked.select(*by, "_first", "_end", F.col("_x.k").alias("_size"), F.col("_x.c").alias("_block"))
    got = asked.join(blocks.hint("merge"), [*by, "_size", "_block"]).groupBy(*by, "_first", "_end").agg(*combine)
    return spans.join(got, [*by, "_first", "_end"]).select(*[quoted(c) for c in ranges.columns], *totals)


def asof_join(a: DataFrame, b: DataFrame, on: str, by: list[str], direction: str = "backward") -> DataFrame:
    """Left join to the nearest earlier (or later) row of ``b`` per key.

    Both sides are stacked and the latest right row is carried along time in
    chunks, so one busy key is spread over many tasks. Of several right rows at
    the same time the largest wins.
    """
    by = list(by)
    extra = [c for c in b.columns if c not in by and c != on]
    right = F.struct(*[quoted(c) for c in extra])
    back = direction == "backward"
    left_first = 0 if back else 1
    la = a.select(*[quoted(k) for k in by], quoted(on), F.lit(1 if back else 0).alias("_side"),
                  F.struct(*[quoted(c) for c in a.columns]).alias("_left"), F.lit(None).alias("_right"))
    # The right payload is unique per (key, time) after this aggregate.
    one = b.groupBy(*by, on).agg(F.max(right).alias("_right"))
    lb = one.select(*[quoted(k) for k in by], quoted(on), F.lit(left_first).alias("_side"),
                    F.lit(None).alias("_left"), "_right")
    both = la.unionByName(lb)
    filled = carry(both, by, [on, "_side"], ["_right"], backward=not back)
    return filled.where(F.col("_left").isNotNull()).select(
        "_left.*", *[F.col(f"_right.`{c}`").alias(c) for c in extra])


def qualify(df: DataFrame, window_cols: dict[str, Column], pred: Column) -> DataFrame:
    """Filter on window results and drop them again."""
    return df.withColumns(window_cols).where(pred).drop(*window_cols)


def top_k(df: DataFrame, by: list[Column], k: int, partition: list[str] = ()) -> DataFrame:
    """First k rows in an order, overall or per group; groups are cut to k before the shuffle."""
    if not partition:
        return df.orderBy(*by).limit(k)
    w = W.partitionBy(*partition).orderBy(*by)
    return qualify(df, {"_rn": F.row_number().over(w)}, F.col("_rn") <= k)


def sample_rows(df: DataFrame, n: int = 10, key: list[str] = (), condition: Column | str | None = None,
                seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of the key: the same rows however the data is partitioned."""
    d = df if condition is None else df.filter(condition)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(k).cast("string") for k in key]))
    return d.orderBy(h, *[quoted(k) for k in key]).limit(n)


def preview(tables: dict[str, DataFrame], order: dict[str, list[str]], n: int = 5) -> DataFrame:
    """First ``n`` rows of every table as JSON texts (table, row, record)."""
    parts = []
    for name, df in tables.items():
        top = df.orderBy(*order[name]).limit(n)
        w = W.orderBy(*order[name])  # at most n rows
        parts.append(top.select(F.lit(name).alias("table"), F.row_number().over(w).cast("long").alias("row"),
                                F.to_json(F.struct(*df.columns)).alias("record")))
    return reduce(DataFrame.unionByName, parts)


def pivot_table(df: DataFrame, by: list[str], on: str, values: list, agg: Column) -> DataFrame:
    """Given pivot values, so no extra job looks them up."""
    return df.groupBy(*by).pivot(on, values).agg(agg)


def running_total(df: DataFrame, by: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """Cumulative sum per key, in chunks so that a hot key is spread; missing only before the first value."""
    number = order_number(df, order[0])
    d = chunked(df, list(by), number)
    inner = W.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    off = d.groupBy(*by, CHUNK).agg(F.sum(col).alias("_s"), F.count(col).alias("_c")).select(
        *by, CHUNK, F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_off"), F.coalesce(F.sum("_c").over(outer), F.lit(0)).alias("_seen"))
    total = F.coalesce(F.sum(col).over(inner), F.lit(0)) + F.col("_off")
    return null_safe_join(d, off, [*by, CHUNK]).withColumn(
        out, F.when(F.count(col).over(inner) + F.col("_seen") > 0, total)).drop(CHUNK, "_off", "_seen")


def ranking(df: DataFrame, by: list[str], order: str, then: list[str] = (), descending: bool = False, lead: str | None = None) -> DataFrame:
    """Adds rank, dense_rank, percent_rank (by ``order``), row_number (ties by ``then``) and, if asked, next_<lead>, per key.

    The order is cut into chunks; ranks within a chunk are raised by the rows,
    or the distinct values, of the chunks before, and the last row of a chunk
    looks at the first one of the next. Equal values share a chunk, so ranks are
    those of one window. A busy key is spread over its chunks. Missing values
    come last.
    """
    by, then = list(by), list(then)
    number = order_number(df, order) * (-1 if descending else 1)
    d = chunked(df, by, number, F.coalesce(number, F.lit(float("inf"))))
    first = (F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last())
    inner, lined = (W.partitionBy(*by, CHUNK).orderBy(first, *x) for x in ([], then))
    steps = {"rank": F.rank().over(inner), "dense_rank": F.dense_rank().over(inner), "row_number": F.row_number().over(lined)}
    if lead:
        steps[f"next_{lead}"] = F.lead(quoted(lead)).over(lined)
    d = d.withColumns(steps)
    chunks = d.groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.max("dense_rank").alias("_values"),
                                       *([F.max(F.when(F.col("row_number") == 1, F.struct(quoted(lead).alias("v")))).alias("_head")] if lead else []))
    # One row per (key, chunk).
    line = W.partitionBy(*by).orderBy(CHUNK)
    before = lambda c: F.coalesce(F.sum(c).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select(*by, CHUNK, before("_n").alias("_rows"), before("_values").alias("_seen"), F.sum("_n").over(W.partitionBy(*by)).alias("_all"), F.col("_n").alias("_here"),
                           *([F.lead("_head").over(line).alias("_head")] if lead else []))
    j = null_safe_join(d, chunks, [*by, CHUNK])
    rank = F.col("rank") + F.col("_rows")
    out = {"rank": rank, "dense_rank": F.col("dense_rank") + F.col("_seen"), "row_number": F.col("row_number") + F.col("_rows"),
           "percent_rank": F.when(F.col("_all") > 1, (rank - 1) / (F.col("_all") - 1)).otherwise(0.0)}
    if lead:
        out[f"next_{lead}"] = F.when(F.col("row_number") == F.col("_here"), F.col("_head.v")).otherwise(F.col(f"next_{lead}"))
    return j.select(*[quoted(c) for c in df.columns], *[v.alias(k) for k, v in out.items()])


def describe_schema(df: DataFrame, order: list[str], samples: int = 2) -> DataFrame:
    """Per column: type, distinct values, share of missing, rows and the first values in the given order."""
    cols = df.columns
    base = column_stats(df, cols, lambda c: {
        "rows": F.count(F.lit(1)), "null_pct": F.round(F.avg(quoted(c).isNull().cast("double")) * 100, 1)})
    heads = df.orderBy(*order).limit(samples).select(
        *[quoted(c).cast("string").alias(c) for c in cols], F.row_number().over(W.orderBy(*order)).alias("_rn"))
    first = heads.unpivot(["_rn"], [quoted(c) for c in cols], "column", "v").groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "v"))), lambda x: x["v"]), "|")
        .alias("samples"))
    types = df.sparkSession.createDataFrame([(c, type_name(df, c)) for c in cols], "column string, dtype string")
    return (types.join(base, "column").join(distinct_counts(df, cols), "column", "left")
            .join(first, "column", "left")
            .select("column", "dtype", F.coalesce("nunique", F.lit(0)).alias("nunique"), "null_pct", "rows",
                    "samples"))


def downcast(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Integers and doubles in the smallest type that holds their range.

    Whole numbers fit by range. Doubles become floats where no value moves by more
    than ``tolerance``. Texts need no type: Parquet dictionary-encodes them.
    """
    ints = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "short")]
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    aggs = []
    for i, c in enumerate(ints):
        aggs += [F.min(quoted(c)).alias(f"lo{i}"), F.max(quoted(c)).alias(f"hi{i}")]
    for i, c in enumerate(floats):
        x = quoted(c)
        aggs.append(F.bool_and(x.isNull() | F.isnan(x) | (F.abs(x.cast("float").cast("double") - x) <= tolerance)).alias(f"ok{i}"))
    if not aggs:
        return df
    r = df.agg(*aggs).first()
    new = {}
    for i, c in enumerate(ints):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)):
            if lo is None or (-(1 << bits) <= lo and hi < (1 << bits)):
                new[c] = t
                break
    new.update({c: "float" for i, c in enumerate(floats) if r[f"ok{i}"]})
    return df.select(*[quoted(c).cast(new[c]).alias(c) if c in new else quoted(c) for c in df.columns])
