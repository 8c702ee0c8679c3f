"""User code: audited transforms and registered functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import quoted
from .quality import verify


def apply_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame], may_drop_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(result, audit). The input is kept when ``fn`` raises, loses rows, or cannot be evaluated."""
    try:
        out = df.transform(fn)
        audit = verify(df, out)
        lost = audit.agg(F.min("row_delta").alias("d")).first()["d"]
        if lost is not None and lost < 0 and not may_drop_rows:
            return df, verify(df, df)
        return out, audit
    except Exception:  # user code may raise anything, while planning or on the executors
        return df, verify(df, df)


def register_udf(spark: SparkSession, name: str, fn: Callable, return_type: str):
    """Scalar function over Arrow batches: pandas Series in, Series out."""
    return spark.udf.register(name, F.pandas_udf(fn, return_type))


SALTS = 32
HELD = 50_000  # groups whose states a task holds at a time


def aggregate(df: DataFrame, by: list[str], columns: list[str], update: Callable[[pd.DataFrame], tuple], merge: Callable[[pd.DataFrame], tuple],
              finish: Callable[[pd.DataFrame], pd.Series], state: str, returns: str, out: str) -> DataFrame:
    """A user's aggregate in three functions: rows (by.., out).

    ``update`` turns some rows of a group into a state (a tuple of the columns
    named in the schema ``state``), ``merge`` several states into one, and
    ``finish`` a frame of final states into values. States are merged inside each
    task before the shuffle and in two steps after it, so a group that holds most
    rows sends no more than the others and no task reads all of it. A missing key
    is a group.
    """
    by, fields = list(by), [f.split()[0] for f in state.split(",")]
    names = [f"k{i}" for i in range(len(by))]
    d = df.select(*[quoted(k).alias(n) for n, k in zip(names, by)], F.struct(*[quoted(c) for c in columns]).alias("row"))
    d = d.select(*names, *[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(columns)])
    kinds = ", ".join(f"{n} {d.schema[n].dataType.simpleString()}" for n in names)
    states = ", ".join(f"s_{f.strip()}" for f in state.split(","))
    renamed = {f"s_{f}": f for f in fields}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def rows() -> pd.DataFrame:
            out = pd.concat(k for k, _ in held.values()).reset_index(drop=True)
            for i, f in enumerate(renamed):
                out[f] = [s[i] for _, s in held.values()]
            return out

        for b in batches:
            for _, g in b.groupby(names, dropna=False, sort=False) if names else [((), b)]:
                example = g[names].head(1)
                key = tuple(None if pd.isna(x) else x for x in example.iloc[0]) if names else ()
                new = update(g.drop(columns=names).set_axis(columns, axis=1))
                if key in held:
                    new = merge(pd.DataFrame([held[key][1], new], columns=fields))
                held[key] = (example, new)
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        s = merge(g[list(renamed)].rename(columns=renamed)) if len(g) > 1 else tuple(g[list(renamed)].iloc[0])
        one = g[names].head(1).reset_index(drop=True)
        for i, f in enumerate(renamed):
            one[f] = [s[i]]
        return one

    schema = ", ".join(x for x in (kinds, states) if x)
    p = d.mapInPandas(partial, schema).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    p = p.groupBy(*names, "salt").applyInPandas(merged, schema).groupBy(*names).applyInPandas(merged, schema)
    done = F.pandas_udf(lambda s: finish(s.rename(columns=renamed)), returns)
    return p.select(*[F.col(n).alias(k) for n, k in zip(names, by)], done(F.struct(*renamed)).alias(out))


def register_udaf(spark: SparkSession, name: str, fn: Callable, return_type: str):
    """Aggregate: pandas Series of a group in, one value out.

    Spark hands a whole group to one call, so use it in SQL where groups are
    small; ``aggregate`` combines before the shuffle.
    """
    return spark.udf.register(name, F.pandas_udf(fn, return_type))


def register_udtf(spark: SparkSession, name: str, cls: type, return_type: str):
    """Table function: one input row, any number of output rows."""
    return spark.udtf.register(name, F.udtf(cls, returnType=return_type))
