import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from tallygrid.llm import termscan as ts
from tallygrid.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def test_query_equals_sql(spark, sf):
    message, ok = compare(spark, connect(sf), "op13_term_scan", QUERIES["op13_term_scan"], ORACLES["op13_term_scan"], sf)
    assert ok, message


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    tfs = [Counter(terms(t)) for _, t in docs]
    total, length, df = sum(bool(c) for c in tfs), sum(sum(c.values()) for c in tfs), Counter(t for c in tfs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for (doc, _), c in zip(docs, tfs):
            m = 75 + 25 * sum(c.values()) * total // length if length else 0
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, n in want.items() if c[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(i, r, None if gone else doc, -s) for r, (s, gone, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["Ab", "ab", "abc", "c", "中文", "É", "é", "x1", "2", "the", "The", "un-der", "a_b", "\u0085", " q", "tail", "😀"]
    docs = [(i * 7 % 200, rng.choice([" ", "\n", ", ", "\t("]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    items = [(i, " ".join(rng.choice(words + ["absent"]) for _ in range(rng.randint(0, 12)))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("entries", [1, 20, ts.ENTRIES])
def test_equals_brute_force(spark, frame, odd, entries):
    docs, items = corpus(entries % 7)
    docs += odd + docs[:5]
    items += [(3, "once more"), (None, "the ab x"), (90, None), (91, ""), (92, "word " * 50)]
    d = frame(docs, 5).withColumn("n", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("terms", F.lit(2)).withColumn("item_id", F.lit(3))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("mine")).withColumn("times", F.lit(1)).withColumn("doc_id", F.lit(4))
    for k in (2, 20):
        assert sorted([tuple(r) for r in ts.search(d, q, k, entries).collect()], key=repr) == brute(docs, items, k)


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ts.search(frame([(1, "a b")]), none).count() == 0
    assert ts.search(frame([]), some).count() == 0 and ts.search(frame([(1, None), (2, " .")]), some).count() == 0
    got = ts.search(frame([(1, "a b")]), none)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_best_prunes_exactly(monkeypatch):
    import numpy as np
    monkeypatch.setattr(ts, "HELD", 10)
    rng, best, rows = np.random.default_rng(1), ts.Best(4, 5), []
    for at in range(0, 400, 40):
        s, ids = rng.integers(0, 9, (40, 4)), np.arange(at, at + 40)
        gone = rng.random(40) < 0.1
        best.add(s, ids, gone)
        rows += [(i, -s[d, i], gone[d], ids[d]) for d in range(40) for i in range(4) if s[d, i] > 0]
    want = [r for i in range(4) for r in sorted(r for r in rows if r[0] == i)[:5]]
    assert [(i, -s, m, d) for i, s, m, d in zip(*best.cut())] == want
