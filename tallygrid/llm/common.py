"""Pieces the text operators share: word rule, chunks in document order, written tables, connected components.

Rows are never dropped for what they hold: a null text counts as empty, a null
id sorts first, repeated rows stay repeated.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tallygrid.session import cut_lineage, shared_folder

#: A word is a maximal run of code points other than ASCII white space; ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_ROWS = 20_000


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: later jobs neither repeat its work nor depend on its tasks."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The asked columns and the whole text, null as empty."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def whole_row(df: DataFrame) -> Column:
    """All columns as one value."""
    return F.struct(*[F.col(c) for c in df.columns])


def with_result(df: DataFrame, columns: list[str], result: str, fields: tuple[str, ...]) -> DataFrame:
    """The columns of ``row`` and the fields of ``result`` under names with an underscore, which replace columns named so."""
    out = {f"_{f}": F.col(result)[f].alias(f"_{f}") for f in fields}
    return df.select(*[F.col("row")[c].alias(c) for c in columns if c not in out], *out.values())


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def chunk_number(df: DataFrame, key: str, name: str, rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """Adds ``name``: chunk of ``key``, rising with it; null keys go to chunk 0. Also returns the number of chunks.

    The number of chunks follows the rows (``rows`` in each, and at least one
    per shuffle partition), so that a chunk stays of one size on any input. The
    cuts are literals, the same in a repeated task. One distinct key is never cut.
    """
    ids = df.select(F.col(key).cast("double").alias("_key"))
    n = max(partitions(df), -(-ids.count() // rows))
    cuts = sorted(set(ids.approxQuantile("_key", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    d = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    d = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_key", outputCol=name).transform(d) if cuts else d.withColumn(name, F.lit(0.0))
    return d.withColumn(name, F.col(name).cast("int")).drop("_key"), len(cuts) + 1


def totals_before(counts: DataFrame, chunk: str, value: str, name: str) -> DataFrame:
    """Rows (chunk, name): sum of ``value`` over all smaller chunks. ``counts`` has one row per chunk."""
    return counts.select(chunk, F.coalesce(F.sum(value).over(W.orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(name))


def stars(links: DataFrame) -> bool:
    """Whether each ``u`` has one link and is no ``v``: then, as ``v`` is below ``u``, every ``v`` is the smallest of its component."""
    ends = links.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(leaf).alias("leaf")) for c, leaf in (("u", 1), ("v", 0))])))
    return not ends.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least")).where("n > 1 OR (n = 1 AND least = 0)").limit(1).count()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Rows (node, root): the smallest node reachable, for every node that has a link.

    Large-star and small-star steps in turn, each written out, until every link
    ends in the centre of a star. The number of rounds grows with the logarithm
    of the longest chain; no group is gathered.
    Hot centres are safe: the steps take minima with partial aggregates and
    joins that adaptive execution may split.
    """
    e = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    for _ in range(rounds):
        if stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Large star: larger neighbours move to the smallest one.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself move to the smallest one.
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        e = stored(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def sorted_runs(df: DataFrame, n: int, chunk: str, *order: str | Column) -> DataFrame:
    """Chunk number ``i`` in task ``i``, sorted."""
    return df.repartitionById(n, F.col(chunk)).sortWithinPartitions(chunk, *order)


__all__ = ["WORD", "chunk_number", "components", "cut_lineage", "fresh_path", "partitions", "sorted_runs", "stored", "totals_before", "whole_row", "with_result", "with_text"]
