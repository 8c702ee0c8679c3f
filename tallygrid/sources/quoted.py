"""Quoted text with values that run over lines, read by many tasks a file.

Where a record ends depends on all quotes before it. Per block of a file only
the parity of its quotes matters, so one scan counts them, a running sum over
the blocks tells which of them begin inside a quoted value, and each task then
puts together the records that begin in its blocks. The at most two pieces a
block cannot finish are joined by a shuffle of pieces alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

SENT = 200_000  # blocks whose parities are sent to every task; beyond, lines are shuffled by block
HEAD, WHOLE, TAIL = 0, 1, 2


def record_pattern(sep: str) -> re.Pattern:
    """Records whose quotes stand around whole values, quotes inside them doubled."""
    value = f'(?:"(?:[^"]|"")*+"|[^"{re.escape(sep)}]*+)'
    return re.compile(f"{value}(?:{re.escape(sep)}{value})*+")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, block, at, value): lines of a block in the order of ``at``; the bytes are untouched."""
    d = spark.read.option("lineSep", "\n").text(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), "value")


def block_starts(d: DataFrame) -> DataFrame:
    """Rows (file, block, inside): whether a block begins inside a quoted value."""
    marks = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = d.groupBy("file", "block").agg((F.sum(marks) % 2).alias("odd"))
    before = F.sum("odd").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return odd.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


def records(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """Rows (file, first, text, ok): every record of every file; ``first`` marks a file's first one.

    ``ok`` is false where a quote stands inside an unquoted value or is never
    closed: there parity says nothing and the result must not be used. Empty lines
    between records are left out, as the plain reader does.
    """
    d, starts = lines(spark, path), cut_lineage(block_starts(lines(spark, path)))
    few = starts.count() <= SENT
    d = d.join(F.broadcast(starts) if few else starts, ["file", "block"])
    if not few:  # order within a block is lost by a shuffle
        d = d.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    whole = record_pattern(sep)

    def clean(text: str) -> tuple[str, bool]:
        text = text.removesuffix("\r")
        return text, '"' not in text or whole.fullmatch(text) is not None

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, kind, inside, first = None, [], WHOLE, False, False

        def rest():
            if held:
                yield (*at, first, kind if kind == HEAD else TAIL, "\n".join(held), True)

        for b in batches:
            out = []
            for file, block, starts_inside, value in zip(b["file"], b["block"], b["inside"], b["value"]):
                if (file, block) != at:
                    out.extend(rest())
                    at, held, inside = (file, block), [], bool(starts_inside)
                    kind, first = HEAD if inside else WHOLE, block == 0
                text = bytes(value).decode(encoding)
                if first and not held:
                    text = text.removeprefix("\ufeff")
                held.append(text)
                inside ^= text.count('"') % 2 == 1
                if not inside:
                    text = "\n".join(held)
                    if kind == HEAD:
                        out.append((file, block, False, HEAD, text, True))
                    elif text.strip():
                        out.append((file, block, first, WHOLE, *clean(text)))
                        first = False
                    held, kind = [], WHOLE
            yield pd.DataFrame(out, columns=["file", "block", "first", "kind", "text", "ok"])
        yield pd.DataFrame(list(rest()), columns=["file", "block", "first", "kind", "text", "ok"])

    schema = "file string, block long, first boolean, kind int, text string, ok boolean"
    parts = d.select("file", "block", "inside", F.col("value").cast("binary").alias("value")).mapInPandas(pieces, schema)
    # A record over several blocks: the tail of one and the heads of those after it, up to the next tail.
    number = F.sum((F.col("kind") == TAIL).cast("long")).over(W.partitionBy("file").orderBy("block", "kind"))
    torn = parts.where(F.col("kind") != WHOLE).withColumn("number", number).groupBy("file", "number").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("p"))
    torn = torn.select("file", "first", F.array_join(F.col("p.text"), "\n").alias("text"))

    def mended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [clean(t) for t in b["text"]]
            yield b.assign(text=[t for t, _ in got], ok=[ok for _, ok in got])

    out = "file string, first boolean, text string, ok boolean"
    return parts.where(F.col("kind") == WHOLE).select("file", "first", "text", "ok").unionByName(torn.mapInPandas(mended, out))


def _parse(reader: DataFrameReader, d: DataFrame) -> DataFrame:
    """A table of texts, one record each, through Spark's reader; Python has no form of it without an RDD."""
    strings = getattr(d.select("text")._jdf, "as")(d.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())
    return reader._df(reader._jreader.csv(strings))


def read_quoted(spark: SparkSession, path: str, sep: str, encoding: str, infer: bool = True, schema=None) -> DataFrame | None:
    """The table, or None where some record's quotes do not stand around whole values.

    Names come from the first record of the first file by name; the first record
    of every file is taken for a header. Without a schema, types need one more scan.
    """
    r = records(spark, path, sep, encoding)
    if not r.where(~F.col("ok")).isEmpty():
        return None
    options = dict(sep=sep, quote='"', escape='"', multiLine=True)
    head = r.where("first").orderBy("file").limit(1).select("text")
    body = r.where(~F.col("first")).select("text")
    if schema is None:
        names = _parse(spark.read.options(header=True, **options), head).columns
        # A row of missing values gives the width and says nothing of the types.
        blank = spark.range(1 if infer and len(names) > 1 else 0).select(F.lit(sep * (len(names) - 1)).alias("text"))
        types = _parse(spark.read.options(header=False, inferSchema=True, **options), blank.unionByName(body)).schema.fields if infer else []
        types = [t.dataType for t in types] + [T.StringType()] * (len(names) - len(types))
        schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    return _parse(spark.read.options(header=False, **options).schema(schema), body)
