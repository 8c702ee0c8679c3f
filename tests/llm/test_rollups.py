import random
from collections import Counter

from pyspark.sql import functions as F

from check import compare, connect
from tallygrid.llm import rollups
from tallygrid.llm.common import fresh_path
from tallygrid.llm.queries import ORACLES, QUERIES

CHANGE = "doc_id long, op string, source string, lang string, tokenizer string, tokens long"


def test_query_equals_sql(spark, sf):
    message, ok = compare(spark, connect(sf), "op6_rollups", QUERIES["op6_rollups"], ORACLES["op6_rollups"], sf)
    assert ok, message


def totals(r):
    return sorted((tuple(x) for x in r.totals().collect()), key=str)


def test_equals_replay_of_the_feed(spark):
    rng = random.Random(1)
    r, state = rollups.Rollup(spark, fresh_path(spark, "r")), {}
    for batch in range(5):
        ids = rng.sample([None, *range(30)], 14)
        rows = [(i, rng.choice(["put", "put", "delete"]), rng.choice(["a", None]), rng.choice(["en", "de"]), rng.choice(["v1", "v2", None]), rng.choice([None, 0, 5, 90])) for i in ids]
        d = spark.createDataFrame(rows, CHANGE).withColumn("batch", F.lit("clash"))
        assert r.commit(batch, d)
        assert not r.commit(batch, d)
        for i, op, *group, n in rows:
            state[i] = (tuple(group), n or 0) if op == "put" else None
        docs, tokens = Counter(), Counter()
        for x in state.values():
            if x:
                docs[x[0]] += 1
                tokens[x[0]] += x[1]
        assert totals(r) == sorted(((*g, docs[g], tokens[g]) for g in docs), key=str)
    assert r.current().count() == sum(x is not None for x in state.values())


def test_unfinished_and_doubled_attempts_do_not_count(spark):
    path = fresh_path(spark, "r")
    r = rollups.Rollup(spark, path)
    assert r.totals().count() == 0
    r.commit(1, spark.createDataFrame([(1, "put", "a", "en", "v", 7), (2, "put", "b", "en", "v", 5)], CHANGE))
    d = spark.read.parquet(f"{path}/deltas")
    d.withColumn("attempt", F.lit("zz")).write.mode("append").parquet(f"{path}/deltas")  # sent twice
    d.where("source = 'a'").withColumn("attempt", F.lit("00")).withColumn("batch", F.lit(2).cast("long")).write.mode("append").parquet(f"{path}/deltas")  # broken off
    assert totals(r) == [("a", "en", "v", 1, 7), ("b", "en", "v", 1, 5)]
    assert r.commit(3, spark.createDataFrame([], CHANGE)) and not r.commit(3, spark.createDataFrame([], CHANGE))
    r.commit(2, spark.createDataFrame([(1, "delete", None, None, None, None), (77, "delete", None, None, None, None)], CHANGE))
    assert totals(r) == [("b", "en", "v", 1, 5)]
