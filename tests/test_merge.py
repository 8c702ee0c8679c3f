"""Join discovery: sketches rule out only what counting would rule out."""

import random

import numpy as np
import pytest

from tallygrid.operators import merge as M


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    out = {}
    for t in range(6):
        base = rng.randrange(0, 30_000)
        rows = [(rng.randrange(base, base + 9000), i, None if i % 9 == 0 else f"v{rng.randrange(200)}", rng.randrange(40)) for i in range(6000)]
        out[f"t{t}"] = spark.createDataFrame(rows, "acct_id long, row_id long, code_id string, kind_id int")
    out["empty"] = out["t0"].limit(0)
    out["small"] = spark.createDataFrame([(i, 900_000 + i, None, i) for i in range(30)], "acct_id long, row_id long, code_id string, kind_id int")
    return out


@pytest.mark.parametrize("least", [0.3, 0.5, 0.9])
def test_sketches_change_no_result(tables, least):
    exact = {tuple(r) for r in M.suggest_joins(tables, min_containment=least, exact=True).collect()}
    got = {tuple(r) for r in M.suggest_joins(tables, min_containment=least).collect()}
    assert got == exact and len(exact) > 15
    # The counts are those of a full outer join of the pair.
    for r in [x for x in sorted(exact, key=str) if x[1] == "acct_id"][:2]:
        c = M.containment(tables[r[0]], r[1], tables[r[2]], r[3]).first()
        assert (c["a_in_b"], c["b_in_a"]) == (r[5], r[6])


def test_sketches_rule_out_most_poor_pairs(tables, monkeypatch):
    kept = []
    plain = M.containments
    monkeypatch.setattr(M, "containments", lambda t, c, p: (kept.extend(p), plain(t, c, p))[1])
    n = M.suggest_joins(tables, min_containment=0.5).count()
    exact_pairs = 4 * len(tables) * (len(tables) - 1) // 2
    assert n <= len(kept) < exact_pairs  # counted pairs: all good ones, and fewer than there are


def test_bound_holds_on_random_sets():
    rng = np.random.default_rng(5)
    lost = 0
    for k in range(400):
        a = rng.choice(1 << 40, rng.integers(1, 4000), replace=False)
        share = rng.random()
        b = np.concatenate([rng.choice(a, int(share * len(a)), replace=False), rng.choice(1 << 40, rng.integers(1, 4000)) + (1 << 41)])
        true = max(len(np.intersect1d(a, b)) / len(a), len(np.intersect1d(a, b)) / len(np.unique(b)))
        cut = lambda x: np.unique(x * 0x9E3779B97F4A7C15 % (1 << 61))[:256]
        with np.errstate(over="ignore"):
            lost += true >= 0.5 and not M.may_contain(cut(a.astype(np.uint64)), cut(b.astype(np.uint64)), 0.5, 256)
    assert lost == 0


def test_one_read_of_each_table_for_all_pairs(tables):
    sizes, shared = M.containments(tables, {"t0": {"acct_id": 0, "row_id": 1}, "t1": {"acct_id": 2}}, [(0, 2), (1, 2)])
    assert {r["c"] for r in sizes.collect()} == {0, 1, 2} and {(r["a"], r["b"]) for r in shared.collect()} <= {(0, 2), (1, 2)}
