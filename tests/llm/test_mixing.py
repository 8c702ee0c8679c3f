from collections import Counter, defaultdict

from pyspark.sql import functions as F

from check import compare, connect
from tallygrid.llm import mixing
from tallygrid.llm.queries import ORACLES, QUERIES


def test_query_equals_sql(spark, sf):
    message, ok = compare(spark, connect(sf), "op7_mixing", QUERIES["op7_mixing"], ORACLES["op7_mixing"], sf)
    assert ok, message


def water(sizes, weights, share, most):
    total, capped = share * sum(sizes.values()), {}
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, level * w[s]) for s in sizes}
        capped |= {s: most * sizes[s] for s in over}


def test_targets_and_totals(frame):
    rows = [(i, "w " * (1 + i % 37), s) for i, s in enumerate(["a"] * 900 + ["b"] * 40 + ["é"] * 300 + [None] * 200 + ["z"] * 500)]
    got = mixing.copies(frame(rows), keep=("doc_id", "source")).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = water(sizes, [3, 1, 2], 1.5, 2.0), Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sizes)


def test_odd_rows_and_clashing_names(frame, odd):
    d = frame(odd).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(7)).withColumn("target", F.lit(1))
    out = mixing.mix(d)
    assert out.columns == d.columns
    n = mixing.copies(frame(odd)).collect()
    assert len(n) == len(odd) and sorted((r["doc_id"] or -1) for r in n) == sorted((i or -1) for i, _ in odd)
    assert out.count() == sum(r["copies"] for r in n)
    assert mixing.copies(frame([])).count() == 0 and mixing.mix(frame([])).count() == 0
    assert mixing.mix(frame([(1, "", "a"), (2, None, "a")])).count() == 0
