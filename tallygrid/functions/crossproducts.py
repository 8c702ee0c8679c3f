"""Sums of products for every pair of columns, for tables with hundreds of columns.

One aggregate with an expression per pair grows with the square of the columns
and no longer compiles. Here each task multiplies blocks of rows as matrices and
emits one row of sums per pair; Spark adds the rows up by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kinds import as_double

PANEL = 512  # columns on the left side of one pass; a task holds PANEL x columns x 6 sums
VALUES = 1 << 21  # values multiplied at a time
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def centres(df: DataFrame, cols: list[str]) -> list[float]:
    """Average per column, 0 for a column without values."""
    r = df.agg(*[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [r[f"m{i}"] or 0.0 for i in range(len(cols))]


def pair_sums(df: DataFrame, cols: list[str], shift: list[float]) -> DataFrame:
    """Rows (i, j, n, sx, sy, sxx, syy, sxy) for columns i <= j, over the rows that have both.

    Values are taken less ``shift`` (the columns' centres), which keeps the sums
    from cancelling. Missing is NULL or NaN. An empty table gives no rows.
    """
    k = len(cols)
    # A plain projection: values cross to Python in columns, as they are stored.
    d = df.select(*[(as_double(df, c) - F.lit(float(s))).alias(f"x{i}") for i, (c, s) in enumerate(zip(cols, shift))])

    def panel(lo: int):
        hi = min(lo + PANEL, k)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((6, hi - lo, k - lo))
            seen = False
            for b in batches:
                step = max(1, VALUES // k)
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[lo:]])
                    m = ~np.isnan(x)
                    x, m = np.where(m, x, 0.0), m.astype(float)
                    q, w = x * x, hi - lo
                    for t, (left, right) in enumerate([(m, m), (x, m), (m, x), (q, m), (m, q), (x, x)]):
                        total[t] += left[:, :w].T @ right
                    seen = True
            if seen:
                i, j = np.nonzero(np.arange(lo, hi)[:, None] <= np.arange(lo, k)[None, :])
                for at in range(0, len(i), 1 << 16):
                    a, b2 = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(a + lo, pa.int32()), pa.array(b2 + lo, pa.int32()), *[pa.array(t[a, b2]) for t in total]],
                                                     names=["i", "j", *SUMS])
        return sums

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    parts = [d.mapInArrow(panel(lo), schema) for lo in range(0, k, PANEL)]
    return reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (i, j, r) for columns i < j: Pearson over rows that have both, NULL where a side is constant there."""
    s = pair_sums(df, cols, centres(df, cols)).where("i < j")
    n = F.nullif(F.col("n"), F.lit(0.0))

    def spread(q: str, m: str):
        v = F.col(q) - F.col(m) * F.col(m) / n
        return F.when(v > 1e-12 * F.col(q), v)  # what is left of a constant is rounding

    return s.select("i", "j", ((F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread("sxx", "sx") * spread("syy", "sy"))).alias("r"))
