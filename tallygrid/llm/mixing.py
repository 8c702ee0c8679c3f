"""Mixing sources to target weights.

Sizes are summed per source and targets follow from the weights by water
filling: every source gets ``weight * level``, but at most ``most`` times its own
size, with the level at which all targets add up to the wanted total. A
document is then emitted ``floor(rate)`` times, plus one copy with the rate's
fraction as probability, drawn from a hash of the document and a seed. Of
``SEEDS`` seeds each source uses the one whose draws come nearest its target, so
a few long documents do not carry a source off; reruns agree.

All of it is DataFrame expressions; a hot source only meets partial aggregates
and a join with one row per source.

Defined cases: null or empty texts have size 0 and are kept with no words
taken; a null source is a source of its own, last in order; a null ``doc_id``
draws by its text; rows repeated in id and text share their draw; an empty
table gives no rows; a source of no words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

SEEDS = 32
BITS = 28  # of each of the two numbers the draws are made of


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Rows (source, source_size, target, whole, fraction). ``sizes`` has columns source and source_size, one row per source.

    The windows see one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # In rising order of the level at which a source is full, the first k are full and the rest share what is left.
    full = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    total, all_weights = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)), F.sum("weight").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / (all_weights - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
    s = s.withColumn("level", level)
    # The first source that does not fill up at its level sets the level of all; later ones would count it as full and come out lower.
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy()))
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("fraction"))


def draws(doc_id: Column, text: Column) -> tuple[Column, Column]:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return tuple(F.conv(F.substring(digest, at, BITS // 4), 16, 10).cast("long") for at in (1, 9))


def drawn(seed: Column | int) -> Column:
    """Uniform in [0, 1) for a seed."""
    return F.pmod(F.col("_h1") + F.col("_h2") * seed, F.lit(1 << BITS)) / F.lit(float(1 << BITS))


def _drawn(docs: DataFrame, weights, share: float, most: float) -> DataFrame:
    """Columns _row (the row as it came), _size, source_size, target, _copies."""
    h1, h2 = draws(F.col("doc_id"), F.col("text"))
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("source").alias("_source"),
                    size_of(F.col("text")).alias("_size"), h1.alias("_h1"), h2.alias("_h2"))
    small = stored(d.select("_source", "_size", "_h1", "_h2"), "sizes")
    t = targets(small.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), list(weights), share, most)
    joined = small.join(t, small["_source"].eqNullSafe(t["source"]))
    sums = joined.groupBy("source").agg(F.first("target").alias("target"), *[
        F.sum(F.col("_size") * (F.col("whole") + (drawn(s) < F.col("fraction")).cast("int"))).alias(f"_{s}") for s in range(SEEDS)])
    miss = F.array(*[F.struct(F.abs(F.col(f"_{s}") - F.col("target")).alias("miss"), F.lit(s).alias("seed")) for s in range(SEEDS)])
    seeds = sums.select(F.col("source").alias("_named"), F.array_min(miss)["seed"].alias("_seed"))
    chosen = stored(t.join(seeds, t["source"].eqNullSafe(seeds["_named"])).drop("_named"), "targets")
    out = d.join(chosen, d["_source"].eqNullSafe(chosen["source"]))
    return out.withColumn("_copies", (F.col("whole") + (drawn(F.col("_seed")) < F.col("fraction")).cast("int")).cast("int"))


def copies(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row with size, source_size, target and copies."""
    needed = [c for c in docs.columns if c in {*keep, "doc_id", "text", "source"}]
    d = _drawn(docs.select(*needed), weights, share, most)
    return d.select(*[F.col("_row")[c].alias(c) for c in keep], F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: every row as often as it was drawn, with the columns it had."""
    d = _drawn(docs, weights, share, most).where("_copies > 0")
    return d.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_row.*")
