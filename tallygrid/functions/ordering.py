"""Order-dependent work without one task for a whole table or a whole key.

A few cut points of the order column (read once as an approximate sketch)
divide it into chunks of similar mass. Windows run inside (key, chunk); what
has to cross a chunk border travels in a table with one row per (key, chunk).
A key with a third of all rows is thereby spread over a third of the chunks.
Large inputs are dealt to tasks by their rows: bytes, by which adaptive execution
merges partitions, say little where columns compress well.
The cut points enter the plan as literals, so a recomputed task sees the same
chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kinds import NUMERIC_TYPES, quoted

CHUNK = "_chunk"
ROWS_PER_CHUNK = 250_000
ROWS_PER_TASK = 500_000  # what a task sorts for its windows


def micros(df: DataFrame, col: str) -> Column:
    """A time column as microseconds since the epoch (long)."""
    c = quoted(col)
    dt = df.schema[col].dataType
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(86400000000)
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    return F.unix_micros(c)


def order_number(df: DataFrame, col: str) -> Column:
    """Double that rises with the column; used only to choose a chunk."""
    if isinstance(df.schema[col].dataType, NUMERIC_TYPES):
        return quoted(col).cast("double")
    return micros(df, col).cast("double")


def cut_points(df: DataFrame, number: Column, n: int | None = None, rows: int | None = None) -> list[float]:
    """Cuts into ``n`` chunks; by default as many that a chunk has about ``ROWS_PER_CHUNK`` rows, and one per shuffle partition at least."""
    d = df.select(number.alias("_o"))
    n = max(2, n or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(d.count() if rows is None else rows) // ROWS_PER_CHUNK)))
    got = d.approxQuantile("_o", [i / n for i in range(1, n)], 0.25 / n)
    return sorted({c for c in got if abs(c) < float("inf")})


def with_chunk(df: DataFrame, number: Column, cuts: list[float]) -> DataFrame:
    if not cuts:
        return df.withColumn(CHUNK, F.lit(0))
    inf = float("inf")
    b = Bucketizer(splits=[-inf, *cuts, inf], inputCol="_o", outputCol=CHUNK, handleInvalid="keep")
    # As a whole number: windows normalise doubles, and would not see that rows are dealt by them already.
    return b.transform(df.withColumn("_o", number)).drop("_o").withColumn(CHUNK, F.col(CHUNK).cast("int"))


def dealt(d: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Chunks with their keys in as many partitions as ``rows`` need; a small input is left to adaptive execution."""
    return d if rows <= ROWS_PER_TASK else d.repartition(-(-rows // ROWS_PER_TASK), *by, CHUNK)


def chunked(df: DataFrame, by: list[str], number: Column, place: Column | None = None) -> DataFrame:
    """``df`` with its chunk by ``place`` (or ``number``, which the cuts come from), dealt by key and chunk."""
    rows = df.count()
    return dealt(with_chunk(df, number if place is None else place, cut_points(df, number, rows=rows)), by, rows)


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join where a missing key matches a missing key; the right keys are dropped."""
    b = b.select(*[quoted(k).alias(f"_k{keys.index(k)}") if k in keys else quoted(k) for k in b.columns])
    cond = reduce(lambda x, y: x & y, [quoted(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return a.join(b, cond, how).drop(*[f"_k{i}" for i in range(len(keys))])


def running_before(hist: DataFrame, value: str, weights: list[str], by: list[str] = (),
                   cuts: list[float] | None = None) -> DataFrame:
    """Adds ``before_<w>``: the sum of each weight over all smaller values (of the same key).

    ``hist`` has one row per (by.., value).
    """
    by = list(by)
    number = order_number(hist, value)
    h = chunked(hist, by, number) if cuts is None else with_chunk(hist, number, cuts)
    inner = W.partitionBy(*by, CHUNK).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    # One row per chunk (and key): without keys this window sees at most as many rows as there are cuts.
    outer = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = h.groupBy(*by, CHUNK).agg(*[F.sum(w).alias(w) for w in weights])
    offsets = offsets.select(*by, CHUNK, *[F.coalesce(F.sum(w).over(outer), F.lit(0)).alias(f"_off_{w}")
                                           for w in weights])
    joined = null_safe_join(h, offsets if by else F.broadcast(offsets), [*by, CHUNK])
    return joined.select(*hist.columns, *[
        (F.col(f"_off_{w}") + F.coalesce(F.sum(w).over(inner), F.lit(0))).alias(f"before_{w}") for w in weights])


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """Rows (value, n, rank): rank of each distinct value, ties sharing their average rank."""
    values = df.select(quoted(col).alias("value")).where(F.col("value").isNotNull())
    cuts = cut_points(values, order_number(values, "value"))
    hist = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    r = running_before(hist, "value", ["n"], cuts=cuts)
    return r.select("value", "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def time_steps(df: DataFrame, ts: str) -> DataFrame:
    """Rows (gap in seconds, n): differences between neighbouring timestamps, equal neighbours included."""
    us = df.select(micros(df, ts).alias("_t")).where(F.col("_t").isNotNull())
    number = F.col("_t").cast("double")
    cuts = cut_points(us, number)
    h = with_chunk(us.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")), number, cuts)
    ends = h.groupBy(CHUNK).agg(F.max("_t").alias("_end"))
    # One row per chunk.
    ends = ends.select(CHUNK, F.lag("_end").over(W.orderBy(CHUNK)).alias("_prev"))
    step = F.col("_t") - F.coalesce(F.lag("_t").over(W.partitionBy(CHUNK).orderBy("_t")), F.col("_prev"))
    g = null_safe_join(h, F.broadcast(ends), [CHUNK]).select(step.alias("_g"), "_n")
    return (g.select(F.inline(F.array(
        F.struct((F.col("_g") / 1e6).alias("gap"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0.0).alias("gap"), (F.col("_n") - 1).alias("n")))))
        .where(F.col("gap").isNotNull() & (F.col("n") > 0)))


def carry(df: DataFrame, by: list[str], order: list[str], cols: list[str], backward: bool = False,
          ties: list[str] = ()) -> DataFrame:
    """Last (or next) non-missing value of each column along the order, within each key.

    Returns ``df`` with the columns filled. ``order[0]`` is numeric or time.
    """
    by, ties = list(by), list(ties)
    number = order_number(df, order[0])
    d = chunked(df, by, number)
    keys = [*order, *ties]
    go = (lambda c: F.desc(c)) if backward else (lambda c: F.asc(c))
    inner = W.partitionBy(*by, CHUNK).orderBy(*[go(k) for k in keys]).rowsBetween(W.unboundedPreceding, 0)
    edge = F.min if backward else F.max
    ends = d.groupBy(*by, CHUNK).agg(*[
        edge(F.when(quoted(c).isNotNull(), F.struct(*keys, quoted(c).alias("_v"))))["_v"].alias(f"_e{i}")
        for i, c in enumerate(cols)])
    outer = W.partitionBy(*by).orderBy(go(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*by, CHUNK, *[F.last(f"_e{i}", ignorenulls=True).over(outer).alias(f"_p{i}")
                                     for i in range(len(cols))])
    j = null_safe_join(d, ends, [*by, CHUNK])
    filled = {c: F.coalesce(F.last(quoted(c), ignorenulls=True).over(inner), F.col(f"_p{i}"))
              for i, c in enumerate(cols)}
    return j.select(*[filled[c].alias(c) if c in filled else quoted(c) for c in df.columns])


def with_reach(df: DataFrame, by: list[str], order: list[str], reach: int) -> DataFrame:
    """Adds ``_chunk``, ``_pos`` and ``_body`` so that windows by (by, _chunk) can look ``reach`` rows back.

    Each chunk also receives copies of the ``reach`` rows before it; they have
    ``_body`` false and are dropped after the window is evaluated. ``_pos`` is
    the row number within the key.
    """
    by = list(by)
    number = order_number(df, order[0])
    d = chunked(df, by, number)
    outer = W.partitionBy(*by).orderBy(CHUNK)
    sizes = d.groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("_m"))
    sizes = sizes.withColumn("_start", F.coalesce(
        F.sum("_m").over(outer.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # Every later chunk of a key has at least one row, so the next ``reach`` chunks are enough.
    sizes = sizes.withColumn("_later", F.collect_list(F.struct(F.col(CHUNK).alias("c"), F.col("_start").alias("s")))
                             .over(outer.rowsBetween(1, reach))).drop("_m")
    j = null_safe_join(d, sizes, [*by, CHUNK])
    j = j.withColumn("_pos", F.row_number().over(W.partitionBy(*by, CHUNK).orderBy(*order)) + F.col("_start"))
    targets = F.concat(F.array(F.struct(F.col(CHUNK).alias("c"), F.lit(True).alias("b"))),
                       F.transform(F.filter("_later", lambda x: F.col("_pos") > x["s"] - reach),
                                   lambda x: F.struct(x["c"].alias("c"), F.lit(False).alias("b"))))
    return (j.withColumn("_to", F.explode(targets))
            .withColumn(CHUNK, F.col("_to.c")).withColumn("_body", F.col("_to.b"))
            .drop("_to", "_later", "_start"))


def row_window(by: list[str]):
    """The window to use on the frame ``with_reach`` returns."""
    return W.partitionBy(*by, CHUNK).orderBy("_pos")


def body(df: DataFrame) -> DataFrame:
    return df.where("_body").drop("_body", "_pos", CHUNK)


def dense_codes(values: DataFrame, col: str) -> DataFrame:
    """Rows (value, code): 0-based position of each distinct value in ascending order.

    ``values`` must hold distinct values. They are range-partitioned and
    checkpointed, so both passes see the same partitions.
    """
    from ..session import cut_lineage
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut_lineage(values.select(quoted(col).alias("value")).repartitionByRange(n, "value")
                    .withColumn(CHUNK, F.spark_partition_id()))
    # One row per partition.
    w = W.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    off = r.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_m")).select(
        CHUNK, F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_off"))
    inner = W.partitionBy(CHUNK).orderBy("value")
    return r.join(F.broadcast(off), CHUNK).select(
        "value", (F.row_number().over(inner) - 1 + F.col("_off")).alias("code"))
