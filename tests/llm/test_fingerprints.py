import base64
import hashlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import fingerprints as fp
from tallygrid.llm.queries import QUERIES, table


def brute_likeness(a, b):
    x, y = (Counter(xxhash.xxh64_intdigest(p) for p in fp.PART.findall(t.encode())) for t in (a, b))
    either = sum((x | y).values())
    return sum((x & y).values()) / either if either else 1.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab.,\n é", max_size=60), st.text("ab.,\n é", max_size=60)), min_size=1, max_size=8))
def test_peeling_equals_multiset_difference(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    got = fp.compare(a, b, b)
    assert np.allclose(got["near_next"], [brute_likeness(x, y) for x, y in pairs])
    assert np.allclose(got["near_edited"], got["near_next"])
    for x, y, f, g in zip(a, b, got["fingerprint"], got["edited_fingerprint"]):
        assert x != y or f == g


def test_large_differences_retry_and_peel():
    a = [f"{i}, " * n for i, n in ((1, 5), (2, 4000))] + [" ".join(f"w{i}." for i in range(20_000))]
    b = ["", "other. " * 3000, " ".join(f"w{i}." for i in range(7, 20_010))]
    got = fp.compare(a, b, b)
    assert np.allclose(got["near_next"], [brute_likeness(x, y) for x, y in zip(a, b)])
    assert len({len(f) for f in got["fingerprint"]}) == 1 and len(base64.b64decode(got["fingerprint"][0])) == 24 * 20


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for (i, t), (_, f) in zip(order, order[1:] + order[:1]):
        t, f = t or "", f or ""
        e = fp.edited(t, f)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(brute_likeness(t, e), 9), round(brute_likeness(t, f), 9)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()), key=str)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = QUERIES["op1_fingerprints"](spark, sf)
    assert rows_of(got) == expected(rows)
    x = got.agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert 0.4 < x["e"] < 0.6 and x["n"] < 0.1


def test_odd_rows(frame, odd):
    assert rows_of(fp.fingerprints(frame(odd).withColumn("extra", F.lit(1)).withColumn("fingerprint", F.lit("x")))) == expected(odd)
    assert rows_of(fp.fingerprints(frame([(4, "one. two. three.")]))) == expected([(4, "one. two. three.")])
    assert fp.fingerprints(frame([])).count() == 0
