import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC).repartition(partitions)
    return make


@pytest.fixture
def odd():
    """Nulls, empties, repeated rows, ids out of order, a long text, characters outside ASCII."""
    return [(5, "a b c\nd e f"), (5, "a b c\nd e f"), (3, None), (None, "x y z"), (None, None), (9, ""), (1, "Été 中文 ́x <|endoftext|> y"),
            (2, "word " * 30_000), (7, " \t\n ")]
