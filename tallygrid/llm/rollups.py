"""Token counts kept as additive totals that follow a feed of changes.

``Rollup`` keeps two Parquet tables below one folder. ``records`` has what each
change says about a document: its count under a tokenizer version, or that it
is gone. ``deltas`` has signed sums per (source, lang, tokenizer) of a batch.
A batch is first turned into signed rows: an insert adds, a delete takes away
what was last recorded, a revised count takes away the old and adds the new
one, under whichever source, language or version each belongs to.

Commits are idempotent. Every attempt writes under its own name and ends with
its deltas, each row of which says how many there are; an attempt counts once
all are there, and of several attempts at a batch one alone counts (the least
name). A batch repeated after a lost driver, or sent twice, changes nothing.

Changes have the columns doc_id, op ('put' or 'delete'), source, lang,
tokenizer, tokens. Defined cases: null source, lang and tokenizer are groups of
their own; null tokens count 0; several changes of one document in one batch
act as the last one by (op, tokens, ...) order, a 'put' over a 'delete'; a
delete of an unknown document does nothing; a null doc_id names one document;
an empty batch commits and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stored

GROUP = ["source", "lang", "tokenizer"]
RECORD = "doc_id long, op string, source string, lang string, tokenizer string, tokens long, batch long, attempt string"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, changes long, rows long, batch long, attempt string"


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)  # nothing was committed yet

    def committed(self) -> DataFrame:
        """Rows (batch, attempt): the attempt that counts. One row per batch."""
        whole = self._read("deltas", DELTA).groupBy("batch", "attempt").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")).where("n = rows")
        return whole.groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def current(self) -> DataFrame:
        """The last record of each document that is not gone."""
        r = self._read("records", RECORD).join(self.committed(), ["batch", "attempt"], "left_semi")
        last = r.groupBy("doc_id").agg(F.max(F.struct("batch", "op", "tokens", *GROUP)).alias("r"))
        return last.where("r.op = 'put'").select("doc_id", *[F.col("r")[c].alias(c) for c in (*GROUP, "tokens")])

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch; False if it was applied before."""
        if self.committed().where(F.col("batch") == batch).count():
            return False
        attempt = uuid.uuid4().hex
        fields = F.struct("op", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"), *GROUP)
        c = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(fields).alias("r"))
        (c.select("doc_id", "r.op", *[F.col("r")[x].cast("string").alias(x) for x in GROUP], "r.tokens", F.lit(batch).cast("long").alias("batch"), F.lit(attempt).alias("attempt"))
         .write.mode("append").parquet(f"{self.path}/records"))
        mine = self._read("records", RECORD).where(F.col("attempt") == attempt)
        old = self.current()
        # Packed columns look small on disk; as many rows as changes must not be broadcast by that measure.
        touched = old.join(mine.select(F.col("doc_id").alias("_d")).hint("merge"), old["doc_id"].eqNullSafe(F.col("_d")), "left_semi")
        signed = touched.select(*GROUP, "tokens", F.lit(-1).alias("sign")).unionByName(mine.where("op = 'put'").select(*GROUP, "tokens", F.lit(1).alias("sign")))
        # The empty group carries the batch when nothing changes.
        sums = signed.groupBy(*GROUP).agg(F.sum("sign").alias("docs"), F.sum(F.col("tokens") * F.col("sign")).alias("tokens"), F.count(F.lit(1)).alias("changes"))
        sums = stored(sums.unionByName(self.spark.createDataFrame([(None, None, None, 0, 0, 0)], sums.schema)), "deltas")
        n = F.lit(sums.count()).alias("rows")
        (sums.select(*GROUP, "docs", "tokens", "changes", n, F.lit(batch).cast("long").alias("batch"), F.lit(attempt).alias("attempt"))
         .write.mode("append").parquet(f"{self.path}/deltas"))
        return True

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer, docs, tokens) over all that count; groups without documents are left out."""
        d = self._read("deltas", DELTA).join(self.committed(), ["batch", "attempt"], "left_semi")
        return d.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letters_or_digits(text):
    return F.coalesce(F.regexp_count(text, F.lit("[A-Za-z]+|[0-9]")), F.lit(0)).cast("long")
