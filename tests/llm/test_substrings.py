import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import substrings as ss
from tallygrid.llm.queries import QUERIES, table


def brute(rows, min_words, key=lambda r: (r[0] is not None, r[0] or 0)):
    """{(id, text): (words, removed, kept)}; ids differ, or the rows are equal."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=key):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - min_words + 1):
            k = tuple(w[a:a + min_words])
            if k in seen:
                gone[a:a + min_words] = [True] * min_words
            seen.add(k)
        out[i, t] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def result(df):
    return sorted(((r["doc_id"], r["text"], (r["_words"], r["_removed"], r["_kept"])) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=5), st.integers(1, 5))
def test_grow_finds_earlier_windows(texts, k):
    machine, seen = ss.Automaton(), set()
    for t in texts:
        got = machine.grow(t, k)
        for i in range(k - 1, len(t)):
            w = tuple(t[i - k + 1:i + 1])
            assert (got[i] >= k) == (w in seen)
            seen.add(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=20), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=30))
def test_matching_statistics(texts, doc):
    machine = ss.Automaton()
    for t in texts:
        machine.restart()
        for w in t:
            machine.extend(w)
    subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, m in enumerate(machine.matches(doc)):
        assert m == max((n for n in range(1, i + 2) if tuple(doc[i + 1 - n:i + 1]) in subs), default=0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", "the"]), min_size=1, max_size=60), st.integers(1, 9))
def test_hashes_and_anchors_follow_content(words, k):
    w = ss.Words(" \n".join(words))
    if w.n < k:
        return
    w.prepare()
    h = w.hashes(k)
    byte_words = {}
    for i in range(w.n - k + 1):
        assert byte_words.setdefault(tuple(w.words[i:i + k]), h[i]) == h[i]
    assert len(set(byte_words.values())) == len(byte_words)
    chosen = ss.anchors(h, min(3, len(h)))
    for i, c in enumerate(chosen):
        window = h[i:i + min(3, len(h))]
        assert c == i + int(window.argmin())


@pytest.mark.parametrize("seed,shard", [(1, 200_000), (2, 60)])
def test_equals_brute_force(frame, monkeypatch, seed, shard):
    monkeypatch.setattr(ss, "SHARD_WORDS", shard)
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(rng.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages)[rng.randint(0, 3):] if rng.random() < 0.6 else [rng.choice("xyz") for _ in range(rng.randint(1, 12))]
        rows.append((None if i == 50 else i * 7 % 121, rng.choice(["  ", "\n", " "]).join(w)))
    rows += [rows[3], rows[3], (500, None), (501, ""), (502, "a1 " * 3000), (503, rows[7][1])]
    got = result(ss.remove_repeats(frame(rows, 5).withColumn("key", F.lit(1)).withColumn("tie", F.lit(2)), 8))
    want = brute(rows, 8)
    assert got == sorted(((i, t, want[i, t]) for i, t in rows), key=str)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, g, k) in brute(rows, 20).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op3_substring_dedup"](spark, sf).collect()} == want


def test_reference_spans(spark, frame):
    ref = spark.createDataFrame([("a b c d e f g",), (None,), ("x y z x y z",)], "text string")
    rows = [(1, "q a b c d w"), (2, "a b c"), (3, None), (4, "g x y z x q"), (5, "c d e f g x y z")]
    got = {r["doc_id"]: (r["_removed"], r["_kept"]) for r in ss.remove_reference(frame(rows), ref, 4).collect()}
    assert got == {1: (4, "q w"), 2: (0, "a b c"), 3: (0, ""), 4: (4, "g q"), 5: (5, "x y z")}
    with pytest.raises(ValueError):
        ss.remove_reference(frame(rows), ref, 4, max_words=5)


def test_empty(frame):
    assert ss.remove_repeats(frame([]), 20).count() == 0
    assert result(ss.remove_repeats(frame([(1, "a b")]), 20)) == [(1, "a b", (2, 0, "a b"))]
