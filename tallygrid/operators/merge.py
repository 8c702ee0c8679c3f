"""Joining several tables: key discovery, merging, audits."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.kinds import NAME_KEY, name_matches, name_tokens, quoted
from ..functions.wide import nothing
from ..session import cut_lineage
from .relational import join_tables

SKETCH = 2048  # hashes kept of a column


def name_score(a: str, b: str) -> float:
    """1 for equal names; without table prefixes ``o_custkey`` and ``c_custkey`` are equal as well."""
    core = lambda n: [t for t in name_tokens(n) if len(t) > 1] or name_tokens(n)
    x, y = core(a), core(b)
    if x == y:
        return 1.0
    if x and y and (x[-1:] == y or x == y[-1:]):  # ``id`` and ``client_id``
        return 0.9
    return SequenceMatcher(None, "_".join(x), "_".join(y)).ratio()


def containment(a: DataFrame, col_a: str, b: DataFrame, col_b: str) -> DataFrame:
    """One row: distinct keys of both sides and how many of each side's keys the other has."""
    x = a.where(quoted(col_a).isNotNull()).select(quoted(col_a).cast("string").alias("k")).distinct().withColumn("a", F.lit(1))
    y = b.where(quoted(col_b).isNotNull()).select(quoted(col_b).cast("string").alias("k")).distinct().withColumn("b", F.lit(1))
    j = x.join(y, "k", "full").agg(F.count("a").alias("keys_a"), F.count("b").alias("keys_b"),
                                   F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"))
    return j.select("keys_a", "keys_b", "shared", F.round(F.col("shared") / F.nullif("keys_a", F.lit(0)), 6).alias("a_in_b"),
                    F.round(F.col("shared") / F.nullif("keys_b", F.lit(0)), 6).alias("b_in_a"))


def _stacked(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Rows (c, k): the present values, as text, of the columns, each under its number."""
    cells = [F.struct(F.lit(i).alias("c"), quoted(c).cast("string").alias("k")) for c, i in columns.items()]
    return df.select(F.inline(F.array(*cells))).where("k IS NOT NULL")


def key_sketches(tables: dict[str, DataFrame], columns: dict[str, dict[str, int]], size: int = SKETCH) -> dict[int, np.ndarray]:
    """The ``size`` least hashes of each column's distinct values, by number; one scan of each table.

    Tasks keep the least hashes they see, so a task hands on at most ``size``
    rows of a column, and as many reach the driver.
    """
    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, g in b.groupby("c", sort=False):
                held[c] = np.unique(np.concatenate([held.get(c, np.empty(0, np.int64)), g["h"].to_numpy(np.int64)]))[:size]
        for c, h in held.items():
            yield pd.DataFrame({"c": np.full(len(h), c, np.int32), "h": h})

    out: dict[int, np.ndarray] = {}
    for t, cols in columns.items():
        if cols:
            d = _stacked(tables[t], cols).select("c", F.xxhash64("k").alias("h")).mapInPandas(least, "c int, h long")
            rank = F.row_number().over(W.partitionBy("c").orderBy("h"))
            rows = d.distinct().withColumn("r", rank).where(F.col("r") <= size).select("c", "h").collect()
            for i in cols.values():
                out[i] = np.sort(np.array([r["h"] for r in rows if r["c"] == i], np.int64))
    return out


def may_contain(a: np.ndarray, b: np.ndarray, least: float, size: int = SKETCH) -> bool:
    """Whether the share of either column's values that the other has may reach ``least``, by their sketches.

    Below the lesser of the last hashes of full sketches both are complete, so
    the hashes there are a sample of each column's values. A pair is ruled out
    only if both shares stay below the bound by five standard errors.
    """
    ends = [x[-1] for x in (a, b) if len(x) == size]
    if ends:
        a, b = a[a <= min(ends)], b[b <= min(ends)]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return any(not len(x) or both / len(x) + (5 * (least * (1 - least) / len(x)) ** 0.5 if ends else 0.0) >= least for x in (a, b))


def containments(tables: dict[str, DataFrame], columns: dict[str, dict[str, int]], pairs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Rows (c, keys) and (a, b, shared) of the columns and pairs, from one scan of each table and one shuffle of distinct values."""
    keys = reduce(DataFrame.unionByName, [_stacked(tables[t], cols) for t, cols in columns.items() if cols]).distinct()
    holders = cut_lineage(keys.groupBy("k").agg(F.collect_set("c").alias("cs")))  # as many as there are columns at most
    sizes = holders.select(F.explode("cs").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("keys"))
    asked = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    met = F.filter(asked, lambda p: F.array_contains("cs", p["a"]) & F.array_contains("cs", p["b"]))
    return sizes, holders.where(F.size("cs") > 1).select(F.inline(met)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def suggest_joins(tables: dict[str, DataFrame], min_name: float = 0.8, min_containment: float = 0.5,
                  mode: str = "token", exact: bool = False) -> DataFrame:
    """Rows (table_a, col_a, table_b, col_b, name_score, containment, uniqueness): names first, values decide.

    Sketches of the columns' values rule out pairs that are far below
    ``min_containment``; the shares of all others are counted, in one go.
    ``exact`` counts every pair. Each table is read a fixed number of times,
    however many pairs there are.
    """
    names, found = list(tables), []
    for i, ta in enumerate(names):
        for tb in names[i + 1:]:
            a, b = tables[ta], tables[tb]
            for ca in a.columns:
                for cb in b.columns:
                    same_type = a.schema[ca].dataType == b.schema[cb].dataType
                    key_like = ca == cb or name_matches(ca, NAME_KEY, mode) or name_matches(cb, NAME_KEY, mode)
                    s = name_score(ca, cb)
                    if s < min_name or not same_type or not key_like:
                        continue
                    found.append((ta, ca, tb, cb, round(s, 4)))
    number = {c: i for i, c in enumerate(sorted({x for ta, ca, tb, cb, _ in found for x in ((ta, ca), (tb, cb))}))}
    held = lambda: {t: {c: i for (u, c), i in number.items() if u == t} for t in names}
    if found and not exact:
        sketch = key_sketches(tables, held())
        found = [f for f in found if may_contain(sketch[number[f[0], f[1]]], sketch[number[f[2], f[3]]], min_containment)]
        used = {x for ta, ca, tb, cb, _ in found for x in ((ta, ca), (tb, cb))}
        number = {c: i for c, i in number.items() if c in used}
    some = next(iter(tables.values()))
    if not found:
        return nothing(some, "table_a string, col_a string, table_b string, col_b string, name_score double, "
                       "a_in_b double, b_in_a double, uniqueness_a double, uniqueness_b double")
    rows = {t: tables[t].count() for t in {f[0] for f in found} | {f[2] for f in found}}
    asked = [(number[ta, ca], number[tb, cb], ta, ca, tb, cb, s, rows[ta], rows[tb]) for ta, ca, tb, cb, s in found]
    p = some.sparkSession.createDataFrame(asked, "a int, b int, table_a string, col_a string, table_b string, col_b string, name_score double, rows_a long, rows_b long")
    sizes, shared = containments(tables, held(), [x[:2] for x in asked])
    for side in "ab":
        p = p.join(sizes.select(F.col("c").alias(side), F.col("keys").alias(f"keys_{side}")), side, "left").na.fill(0, [f"keys_{side}"])
    p = p.join(shared, ["a", "b"], "left").na.fill(0, ["shared"])
    share = lambda x, y: F.round(F.col(x) / F.nullif(y, F.lit(0)), 6)
    out = p.select("table_a", "col_a", "table_b", "col_b", "name_score", share("shared", "keys_a").alias("a_in_b"), share("shared", "keys_b").alias("b_in_a"),
                   share("keys_a", "rows_a").alias("uniqueness_a"), share("keys_b", "rows_b").alias("uniqueness_b"))
    return out.where(F.greatest("a_in_b", "b_in_a") >= min_containment)


def merge_all(tables: dict[str, DataFrame], plan: list[tuple[str, list[str]]], how: str = "outer") -> DataFrame:
    """Chain of joins: the first entry starts, each further one joins on its keys; overlaps get the table name."""
    first = plan[0][0]
    out = tables[first]
    for name, on in plan[1:]:
        out = join_tables(out, tables[name], on, how, ("", f"_{name}"))
    return out


def merge_audit(result: DataFrame, allow_empty: bool = False) -> DataFrame:
    """One row (rows, cols, ok); an empty result fails unless allowed."""
    return result.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(result.columns)).cast("long").alias("cols"),
        ((F.col("rows") > 0) | F.lit(allow_empty)).alias("ok"))


def join_audit(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row: unmatched rows of both sides, largest multiplicity, rows of the inner join. Nothing is joined row by row."""
    count = lambda d, n: d.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    x, y = count(a, "na"), count(b, "nb")
    both = x.join(y, on, "full")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(
        s("na").alias("rows_left"), s("nb").alias("rows_right"),
        s(F.when(F.col("nb").isNull(), F.col("na"))).alias("unmatched_left"),
        s(F.when(F.col("na").isNull(), F.col("nb"))).alias("unmatched_right"),
        F.max("na").alias("max_multiplicity_left"), F.max("nb").alias("max_multiplicity_right"),
        s(F.col("na") * F.col("nb")).alias("inner_rows"))
