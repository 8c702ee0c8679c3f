"""Connected components against union-find."""

import random

import pytest

from tallygrid.llm import common
from tallygrid.llm.simhash import Trees


def plain(n, pairs):
    t = Trees(n)
    for a, b in pairs:
        t.join(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    return {x: t.find(x) for x in linked if t.find(x) != x}


def shapes():
    rng = random.Random(3)
    chain = list(range(70))
    rng.shuffle(chain)
    yield "none", 1, []
    yield "loops and repeated pairs", 9, [(4, 4), (1, 2), (2, 1), (1, 2), (8, 3)]
    yield "star with the largest in the centre", 40, [(39, i) for i in range(39)]
    yield "star with the smallest in the centre", 40, [(0, i) for i in range(1, 40)]
    yield "chain", 70, list(zip(chain, chain[1:]))
    yield "two centres", 30, [(0, i) for i in range(2, 20)] + [(1, i) for i in range(15, 30)]
    yield "many small", 300, [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]


@pytest.mark.parametrize("name,n,pairs", list(shapes()))
def test_components(spark, name, n, pairs):
    got = common.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in got} == plain(n, pairs) and len(got) == len(plain(n, pairs))


def test_stars(spark):
    def f(pairs):
        return common.stars(spark.createDataFrame(pairs, "u long, v long"))
    assert f([]) and f([(5, 1), (4, 1), (9, 2)])
    assert not f([(5, 1), (5, 2)]) and not f([(5, 3), (3, 1)])
