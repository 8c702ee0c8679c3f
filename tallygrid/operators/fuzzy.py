"""Near-duplicate values of one column, without comparing all pairs and without losing any.

Short values are blocked by the strings they become when a few characters are
deleted: two values within the threshold always share such a string, and the
number of values that can share one is bounded by the alphabet, not by the
data. Longer values are blocked by their rarest q-grams (prefix filter), which
keeps common prefixes such as ``Customer#0000`` from forming a block.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.kinds import quoted, strip
from ..session import cut_lineage

Q = 2
MAX_DELETIONS = 2


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _less_one(strings: Column) -> Column:
    """All strings with one character removed, for every string of an array."""
    def drop(s):
        return F.transform(F.sequence(F.lit(1), F.length(s)),
                           lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))
    return F.array_distinct(F.flatten(F.transform(F.filter(strings, lambda s: F.length(s) > 0), drop)))


def candidate_pairs(values: DataFrame, t: float, method: str) -> DataFrame:
    """Rows (a, b) with a < b: a superset of the pairs of ``values.low`` within the threshold."""
    eps = 1e-9
    # Characters a value may lose to reach the common part, and edits that may separate it from a partner.
    if method == "levenshtein":
        lost = lambda n: math.floor((1 - t) * n + eps)
        edits = lambda n: F.floor((1 - t) * n / t + eps)
    else:
        lost = lambda n: n - math.ceil(t * n / (2 - t) - eps)
        edits = lambda n: F.floor(2 * (1 - t) * n / t + eps)
    limit = max(n for n in range(1, 2000) if all(lost(m) <= MAX_DELETIONS for m in range(1, n + 1)))
    n = F.length("low")
    one = _less_one(F.array("low"))
    depth = F.element_at(F.array(*[F.lit(lost(m)) for m in range(0, limit + 1)]), n + 1)
    none = F.slice(F.array("low"), 1, 0)
    short = values.where(n <= limit).select("low", F.explode(F.array_distinct(F.concat(
        F.array("low"), F.when(depth >= 1, one).otherwise(none),
        F.when(depth >= 2, _less_one(one)).otherwise(none)))).alias("k"))
    short = short.select("low", F.xxhash64("k").alias("k"))

    # Partners of a long value are not shorter than this, so both sides of a mixed pair get q-gram keys.
    floor_len = math.floor(limit * (t if method == "levenshtein" else t / (2 - t)))
    grams = values.where(n > floor_len).select("low", F.posexplode(F.transform(
        F.sequence(F.lit(1), n - (Q - 1)), lambda i: F.substr(F.col("low"), i, F.lit(Q)))).alias("p", "g"))
    # The second occurrence of a gram in a value is a gram of its own.
    grams = grams.withColumn("o", F.row_number().over(W.partitionBy("low", "g").orderBy("p"))).drop("p")
    freq = grams.groupBy("g", "o").agg(F.count(F.lit(1)).alias("f"))
    ranked = grams.join(freq.hint("merge"), ["g", "o"])
    keep = (Q * edits(n) + 1).cast("int")
    prefix = ranked.groupBy("low").agg(F.array_sort(F.collect_list(F.struct("f", "g", "o"))).alias("gs"))
    long = prefix.select("low", F.explode(F.slice("gs", 1, keep)).alias("x")).select(
        "low", F.xxhash64(F.lit("gram"), "x.g", "x.o").alias("k"))

    keys = short.unionByName(long).withColumn("n", n)
    other = keys.select(F.col("low").alias("b"), "k", F.col("n").alias("m"))
    near = ((F.least("n", "m") >= t * F.greatest("n", "m") - eps) if method == "levenshtein"
            else (2 * F.least("n", "m") >= t * (F.col("n") + F.col("m")) - eps))
    # Before it runs, the optimizer takes an exploded column for as small as its input: it must not send the keys to the driver.
    return keys.join(other.hint("merge"), "k").where((F.col("low") < F.col("b")) & near).select(
        F.col("low").alias("a"), "b").distinct()


def fuzzy_pairs(df: DataFrame, col: str, threshold: float = 90, method: str = "levenshtein",
                limit: int | None = None) -> DataFrame:
    """Rows (value_a, value_b, similarity_pct, count_a, count_b) of similar distinct values.

    Values are compared trimmed and in lower case. ``levenshtein``: 1 - edits /
    longer length. ``ratio``: Ratcliff-Obershelp. ``limit`` cuts the
    sorted result.
    """
    t = threshold / 100
    if t < (0.7 if method == "levenshtein" else 0.85):
        raise ValueError("blocking is exact only from 70 (levenshtein) or 85 (ratio) on")
    vals = (df.where(quoted(col).isNotNull()).groupBy(strip(quoted(col).cast("string")).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).where("value <> ''").withColumn("low", F.lower("value")))
    lows = vals.select("low").distinct()
    cand = candidate_pairs(lows, t, method)
    a, b = F.col("a"), F.col("b")
    if method == "levenshtein":
        sim = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    else:
        sim = F.pandas_udf(_ratio, "double")(a, b)
    hits = cand.withColumn("sim", sim).where(F.col("sim") >= t - 1e-12)
    # Spellings that agree after lower-casing are similar at 100; others are joined back to their spellings.
    left = vals.select(F.col("low").alias("a"), F.col("value").alias("va"), F.col("n").alias("na"))
    right = vals.select(F.col("low").alias("b"), F.col("value").alias("vb"), F.col("n").alias("nb"))
    same = left.join(right.hint("merge"), (F.col("a") == F.col("b")) & (F.col("va") < F.col("vb"))).select(
        "va", "vb", "na", "nb", F.lit(1.0).alias("sim"))
    diff = hits.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("va", "vb", "na", "nb", "sim")
    out = diff.unionByName(same)
    swap = F.col("va") > F.col("vb")
    out = out.select(F.when(swap, F.col("vb")).otherwise(F.col("va")).alias("value_a"),
                     F.when(swap, F.col("va")).otherwise(F.col("vb")).alias("value_b"),
                     F.round(F.col("sim") * 100, 1).alias("similarity_pct"),
                     F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("count_a"),
                     F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("count_b"))
    return out if limit is None else out.orderBy(F.desc("similarity_pct"), "value_a", "value_b").limit(limit)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): connected components, each named by its smallest node.

    Every round takes the smallest root among a node and its neighbours and
    then follows it once more, so long chains shrink by half per round.
    """
    e = edges.select(quoted(a).alias("x"), quoted(b).alias("y"))
    e = cut_lineage(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    lab = cut_lineage(e.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select(
        "node", F.least("node", "m").alias("root")))
    while True:
        seen = e.join(lab.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("m"))
        step = lab.join(seen, "node").select("node", F.least("root", "m").alias("r1"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("r1"), F.col("r1").alias("r2"))
        new = cut_lineage(step.join(jump, "r1").select("node", F.least("r1", "r2").alias("root"),
                                                       (F.least("r1", "r2") < F.col("old")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        lab = new.drop("moved")


def canonical_mapping(pairs: DataFrame) -> DataFrame:
    """Rows (value, canonical) from fuzzy pairs: the most frequent member of each component."""
    comp = components(pairs, "value_a", "value_b")
    counts = pairs.select(F.col("value_a").alias("node"), F.col("count_a").alias("n")).unionByName(
        pairs.select(F.col("value_b").alias("node"), F.col("count_b").alias("n"))).distinct()
    c = comp.join(counts, "node")
    top = c.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), "node"))["node"].alias("canonical"))
    return c.join(top, "root").select(F.col("node").alias("value"), "canonical")
