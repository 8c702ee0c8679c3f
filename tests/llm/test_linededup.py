import random

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from tallygrid.llm import linededup as ld
from tallygrid.llm.queries import ORACLES, QUERIES


def test_query_equals_sql(spark, sf):
    message, ok = compare(spark, connect(sf), "op9_line_dedup", QUERIES["op9_line_dedup"], ORACLES["op9_line_dedup"], sf)
    assert ok, message


def brute(rows, k):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, at = ld.split(t or "")
        gone = set()
        for a in range(len(at) - k + 1):
            w = tuple(lines[j] for j in at[a:a + k])
            if w in seen:
                gone |= set(at[a:a + k])
            seen.add(w)
        out[i, t] = (len(at), len(gone), t if not gone else "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    blocks = [[f"line {rng.randint(0, 12)}" for _ in range(rng.randint(1, 9))] for _ in range(8)]
    rows = [(None if i == 9 else i * 11 % 90, "\n".join(x for _ in range(rng.randint(0, 4)) for x in [*rng.choice(blocks), *[""] * rng.randint(0, 1)])) for i in range(89)]
    return rows + [rows[4], rows[4], (700, None), (701, ""), (702, "same\n" * 2000), (703, rows[8][1])]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_equals_brute_force(frame, k):
    rows = corpus(k)
    d = frame(rows).withColumn("line", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("tie", F.lit(2))
    out = ld.dedup(d, k)
    want = brute(rows, k)
    assert sorted(((r["doc_id"], r["text"], (r["_lines"], r["_removed"], r["_kept"])) for r in out.collect()), key=str) == sorted(((i, t, want[i, t]) for i, t in rows), key=str)
    assert set(d.columns) < set(out.columns)


def test_long_single_lines_go(frame):
    """A passage that is one line of each document has no repeated neighbour; beside it the two-line windows stay as they are."""
    long, other, short = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 51), ("b", 60), ("c", 50)))
    rows = [(4, f"p\n{long}\nq"), (2, f"r\n{long}\ns\nt"), (7, long), (None, other), (5, f"u\n{short}"), (6, f"v\n{short}"), (8, f"x\n\n{other}\ny"),
            (9, f"{other}\n{other}"), (10, f"r\n{long}\ns"), (11, other)]
    d = frame(rows)
    got = {r["doc_id"]: (r["_lines"], r["_removed"], r["_kept"]) for r in ld.dedup(d, 2, long_words=50).collect()}
    assert got == {None: (1, 0, other), 2: (4, 0, f"r\n{long}\ns\nt"), 4: (3, 1, "p\nq"), 5: (2, 0, f"u\n{short}"), 6: (2, 0, f"v\n{short}"), 7: (1, 1, ""),
                   8: (3, 1, "x\n\ny"), 9: (2, 2, ""), 10: (3, 3, ""), 11: (1, 0, other)}


def test_ranks_are_a_suffix_array(frame):
    """Equal ranks are equal prefixes of ``depth`` lines, and ranks count the suffixes before a class."""
    rows = corpus(5)
    lines = ld.line_ids(frame(rows))
    ids = {(r["doc_id"], r["tie"], r["line"]): (r["d1"], r["d2"]) for r in lines.collect()}
    got = {(r["doc_id"], r["tie"], r["line"]): r["rank"] for r in ld.suffix_ranks(lines, 4).collect()}
    prefix = {p: tuple(ids.get((*p[:2], p[2] + k)) for k in range(4)) for p in ids}
    again = {p: x for p, x in prefix.items() if None not in x and list(prefix.values()).count(x) > 1}
    assert set(got) == set(again)
    by_rank, by_prefix = sorted(got, key=lambda p: got[p]), sorted(again, key=lambda p: again[p])
    assert [again[p] for p in by_rank] == [again[p] for p in by_prefix]


def test_runs_are_maximal(frame):
    a = "\n".join(f"r{i}" for i in range(6))
    rows = [(1, "p\n" + a + "\nq"), (2, a), (3, "x\nr2\nr3\nr4\ny")]
    got = sorted((r["doc_id"], r["line"], r["lines"], r["from_doc"], r["from_line"]) for r in ld.runs(ld.repeats(frame(rows), 2), 2).collect())
    assert got == [(2, 0, 6, 1, 1), (3, 1, 3, 1, 3)]


def test_doubling_goes_past_the_longest_run(frame, monkeypatch):
    """dedup ranks suffixes until none occurs again and cuts by maximal runs, here one of 37 lines and one of 3."""
    a = [f"r{i}" for i in range(37)]
    rows = [(1, "\n".join(["p", *a, "q"])), (2, "\n".join(a)), (3, "x\nr2\nr3\nr4\ny")]
    depths, cut = [], []
    every, joined = ld.doublings, ld.runs
    monkeypatch.setattr(ld, "doublings", lambda lines: ((depths.append(at), (at, s))[1] for at, s in every(lines)))
    monkeypatch.setattr(ld, "runs", lambda found, k: (cut.append(joined(found, k)), cut[-1])[1])
    got = {r["doc_id"]: (r["_lines"], r["_removed"], r["_kept"]) for r in ld.dedup(frame(rows), 2).collect()}
    assert got == {1: (39, 0, rows[0][1]), 2: (37, 37, ""), 3: (5, 3, "x\ny")}
    assert depths == [1, 2, 4, 8, 16, 32]
    assert sorted((r["doc_id"], r["line"], r["lines"], r["from_doc"], r["from_line"]) for r in cut[0].collect()) == [(2, 0, 37, 1, 1), (3, 1, 3, 1, 3)]


def test_empty_and_bad_depth(frame):
    assert ld.dedup(frame([])).count() == 0
    with pytest.raises(ValueError):
        ld.dedup(frame([]), 3)
