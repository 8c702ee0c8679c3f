import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from tallygrid.llm import variants as v
from tallygrid.llm.queries import ORACLES, QUERIES


def test_query_equals_sql(spark, sf):
    message, ok = compare(spark, connect(sf), "op12_spelling_variants", QUERIES["op12_spelling_variants"], ORACLES["op12_spelling_variants"], sf)
    assert ok, message


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def vocabulary(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(3, 9))) for _ in range(260)}
    words |= {"prefix" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 4))) for _ in range(90)}  # a crowded front
    words |= {"q" * 70, "q" * 71, "q" * 69 + "r", "z"}
    return {w: rng.randint(1, 400) for w in words}


@pytest.mark.parametrize("crowded, size", [(2, 3), (8, 16), (2048, 1024)])
def test_neighbours_equal_brute_force(spark, crowded, size):
    words = vocabulary(size)
    want = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-words[x], x))
            want[w] = (len(near), words[best], best)
    d = spark.createDataFrame(list(words.items()), "word string, n long")
    got = v.neighbours(d, crowded, size).collect()
    assert {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in got} == want and len(got) == len(want)
    # A word is in two cells of each of two classes, and in a bounded number more where it is crowded.
    assert v.cells(d, crowded, size).count() <= len(words) * 2 * 2 * (1 if crowded > len(words) else 16)


def test_near_matrix_limits_the_first_difference():
    words = ["abcdef", "abcdeg", "xbcdef", "abcxef", "abcdeff", "aabcdef"]
    asks, near = v.near_matrix(words, 6)
    assert [[words[j] for j in range(6) if near[i, j]] for i in range(len(asks))] == [
        ["abcdeg", "xbcdef", "abcxef", "abcdeff", "aabcdef"], ["abcdef"], ["abcdef"], ["abcdef"]]
    _, front = v.near_matrix(words, 6, 0, 3)
    assert [words[j] for j in range(6) if front[0, j]] == ["xbcdef", "aabcdef"]
    _, back = v.near_matrix(words, 6, 3, 0)
    assert [words[j] for j in range(6) if back[0, j]] == ["abcdeg", "abcxef", "abcdeff"]


def brute_groups(rows, min_chars, min_count, every, times):
    import re
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    form, near = {}, {}
    for w in n:
        found = [x for x in n if one_edit(w, x)]
        near[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= times * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], near[w], n[form[w]] if w in form else None))
    return out


def test_groups_equal_brute_force_with_odd_rows(frame, odd):
    rng = random.Random(2)
    rows = [*odd, (20, "ÉTÉABCD étéabcd Étéabcd " * 9), (21, "x" * 5000 + " " + ("y" * 6 + " ") * 9)]
    base = ["wordsmith", "kettles", "Überholen", "chains"]
    for i in range(40, 120):
        w = rng.choice(base)
        k = rng.randrange(len(w))
        bad = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("aeß") + w[k:], w[:k] + rng.choice("aeß") + w[k + 1:]])
        rows.append((i, " ".join([w] * rng.randint(1, 60) + [bad] * rng.randint(0, 6) + ["chaons"] * 2 + ["chaonss"])))
    rows.append((200, "teacher " * 400 + "teachor " * 70 + "teachorr " * 9))
    d = frame(rows + rows[-3:]).withColumn("word", F.lit("mine")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2)).withColumn("c", F.lit(3))
    got = v.groups(d, 6, 5, 7, 5)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = got.collect()
    assert {tuple(r) for r in got} == brute_groups(rows + rows[-3:], 6, 5, 7, 5) and len(got) > 20
    assert any(r["form"] and r["form"] != r["root"] for r in got)
    assert v.groups(frame([])).count() == 0 and v.groups(frame([(1, None), (2, "")])).count() == 0
