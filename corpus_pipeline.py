"""The text pipeline: from the table of documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before
it kept, and returns a DataFrame; all but the last return the columns of
documents. Null texts count as empty, rows are only dropped for the reason a
stage states, and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import linededup, mixing, packing, simhash, toxicity
from tallygrid.llm.common import stored
from tallygrid.llm.tokens import vocabulary_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines, and of single lines of over 50 words, are cut out of the texts; ``n_chars`` follows. Every row stays."""
    # Rows travel as one value: a column of docs may be named like a result of the operator.
    others = [c for c in docs.columns if c != "text"]
    d = linededup.dedup(docs.select(F.struct(*others).alias("row"), "doc_id", "text"), min_lines=2, long_words=50)
    changed = {"text": F.col("_kept"), "n_chars": F.when(F.col("_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return d.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 or more of their five-word shingles one stays."""
    return simhash.near_duplicates(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources weigh 3, 1, 2, repeating, in 150 % of all words, at most twice each."""
    return mixing.mix(docs, (3, 1, 2), 1.5, 2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary_path(), end_id=0, max_tokens=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
