import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import simhash as sh
from tallygrid.llm.queries import QUERIES, table


def plain_fingerprint(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    hs = [xxhash.xxh64(b" ".join(w[i:i + k]), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(fps, distance):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    v = np.array([fps[i] for i in ids], np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= distance)):
        if i < j:
            a, b = find(ids[i]), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=100, deadline=None)
@given(st.text("aAbÉé \n", max_size=60), st.integers(1, 5))
def test_fingerprint(text, k):
    assert sh.fingerprint(text, k) == plain_fingerprint(text, k)


def test_query(spark, sf):
    fps = {r["doc_id"]: plain_fingerprint(r["text"], 3) for r in table(spark, sf, "documents").collect()}
    want = plain_classes(fps, 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash"](spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("distance,block", [(3, 4096), (3, 7), (6, 50), (9, 4096)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, distance, block):
    monkeypatch.setattr(sh, "BLOCK", block)
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2 * distance))) for c in centres for _ in range(30)} | {0, (1 << 64) - 1})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = sh.links(d, distance).collect()
    u = np.array([[r["a"], r["b"]] for r in got], np.int64).reshape(-1, 2).view(np.uint64)
    assert (np.bitwise_count(u[:, 0] ^ u[:, 1]) <= distance).all()
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in u.tolist():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: find(i) for i in fps} == plain_classes({f: f for f in fps}, distance)


@pytest.mark.parametrize("distance", [0, 1, 3, 7, 12])
def test_thresholds_fill_the_pigeonhole(distance):
    rng = np.random.default_rng(1)
    parts = sh.plan(rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64), 500, distance)
    bits = [b for p, _ in parts for b in p]
    assert len(bits) == len(set(bits)) and sum(t + 1 for _, t in parts) == distance + 1


def test_allocation_is_least():
    costs = [[0, 5, 9, 40], [0, 1, 20, 90], [0, 2, 3, 4]]
    best = min((a + b + c, (i - 1, j - 1, k - 1)) for i, a in enumerate(costs[0]) for j, b in enumerate(costs[1]) for k, c in enumerate(costs[2]) if i + j + k - 3 == 2)
    assert sh.allocate(costs, 2)[0] == best[0]


def near_rows():
    rng = random.Random(3)
    rows = []
    for g in range(25):
        base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
        for k in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(0 if k == 0 else rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "zz"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_near_duplicates(frame):
    rows = near_rows()
    sets = {i: {hash(tuple(t.split()[k:k + 5])) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = plain_sets(sets, 0.8)
    odd = [(900, None), (901, ""), (902, " \n"), (903, "one"), (903, "one"), (904, "one"), (None, "one"), (None, "null id alone")]
    d = frame(rows + odd)
    for c in ("root", "fp", "unit", "digest", "id", "row", "stays", "first", "same", "_md5", "set", "label"):
        d = d.withColumn(c, F.lit("mine"))
    out = sh.near_duplicates(d)
    assert out.columns == d.columns
    got = sorted((r["doc_id"] for r in out.collect()), key=lambda i: (i is None, i or 0))
    least = {*(alike[i] for i, _ in rows), 900, 903, None}
    # Nothing is merged that is not alike; candidates are found by fingerprints, so a few copies may stay.
    assert least <= set(got) and len(got) == len(set(got)) and len(set(got) - least) <= 1


def clusters(seed, near=6):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, near))) for c in centres for _ in range(25)]
    return np.array(fps + fps[:30], np.uint64), list(range(len(fps) + 30)), rng


@pytest.mark.parametrize("block", [4096, 7])
def test_pairs_are_all_there(spark, monkeypatch, block):
    """Forests and the members left open hold all pairs of different labels; no cell gives more rows than it has members."""
    monkeypatch.setattr(sh, "BLOCK", block)
    fps, names, rng = clusters(block)
    label = {n: rng.randrange(3) for n in names}
    of = dict(zip(names, fps.view(np.int64).tolist()))
    near, parts = sh.near_pairs(spark.createDataFrame(list(of.items()), "unit long, fp long"), 6, "unit")
    rows = near.collect()
    got = {frozenset((r["a"], r["b"])) for r in rows}
    members, trees = set(), {}
    for r in rows:
        key = (0, r["part"], r["value"], r["i"], r["j"])
        trees.setdefault(key, []).append({r["a"], r["b"]})
        if r["tree"] is not None:
            members |= {(*key, r["tree"], u, of[u], label[u]) for u in (r["a"], r["b"])}
    assert all(len(x) < len(set().union(*x)) for x in trees.values())
    schema = "table int, part int, value long, i int, j int, tree int, unit long, fp long, label long"
    left = sh.open_members(spark.createDataFrame(list(members), schema), [parts], 6).collect()
    cells = {}
    for r in left:
        cells.setdefault(tuple(r)[:6], []).append(r["unit"])
    got |= {frozenset((a, b)) for x in cells.values() for a in x for b in x if a != b}
    want = {frozenset((a, b)) for a in names for b in names if a < b and bin((of[a] ^ of[b]) & (1 << 64) - 1).count("1") <= 6}
    assert all(p in got for p in want if len({label[u] for u in p}) == 2)


@pytest.mark.parametrize("block,tile,similarity", [(7, 1 << 17, None), (3, 64, 0.8)])
def test_probed_parts_find_all_pairs(spark, monkeypatch, block, tile, similarity):
    """Plans that probe, as large tables get them, find the pairs that plans without probes find; sizes only leave out what they rule out."""
    monkeypatch.setattr(sh, "BLOCK", block)
    monkeypatch.setattr(sh, "TILE", tile)
    fps, names, rng = clusters(11)
    size = {n: rng.choice([0, 1, 4, 5, 8, 10, 100, 125, 126]) for n in names}
    rows = [(n, f, size[n]) for n, f in zip(names, fps.view(np.int64).tolist())]
    d = spark.createDataFrame(rows, "unit long, fp long, size long")
    alike = [(a, b) for a in names for b in names if a < b and int(fps[a] ^ fps[b]).bit_count() <= 6
             and (similarity is None or min(size[a], size[b]) >= similarity * max(size[a], size[b]) > 0)]
    plain = sh.Trees(len(names))
    for a, b in alike:
        plain.join(a, b)
    for ts in ((1, 0, 1, 1), (0,) * 7):
        monkeypatch.setattr(sh, "plan", lambda *_: [(list(range(k, 64, len(ts))), t) for k, t in enumerate(ts)])
        near, _ = sh.near_pairs(d, 6, "unit", similarity)
        mine = sh.Trees(len(names))
        for r in near.collect():
            assert tuple(sorted((r["a"], r["b"]))) in set(alike)
            mine.join(r["a"], r["b"])
        assert [mine.find(n) for n in names] == [plain.find(n) for n in names]


def test_probed_links(spark, monkeypatch):
    monkeypatch.setattr(sh, "plan", lambda *_: [(list(range(k, 64, 4)), t) for k, t in enumerate((1, 0, 1, 1))])
    fps = sorted({*clusters(5)[0].view(np.int64).tolist()})
    got = sh.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 6).collect()
    mine = sh.Trees(len(fps))
    for r in got:
        mine.join(fps.index(r["a"]), fps.index(r["b"]))
    want = plain_classes({i: f & (1 << 64) - 1 for i, f in enumerate(fps)}, 6)
    assert [mine.find(i) for i in range(len(fps))] == [want[i] for i in range(len(fps))]


@pytest.mark.parametrize("room", [1 << 20, 200])
def test_open_members_are_compared_in_blocks(spark, monkeypatch, room):
    """Links between labels connect what all pairs of alike sets connect, and are a forest in each pair of blocks."""
    monkeypatch.setattr(sh, "SET_BYTES", room)
    rng = random.Random(room)
    sets = {i: np.unique(np.array([rng.choice(range(k * 40, k * 40 + 12)) for _ in range(30)], np.uint64)) for i in range(60) for k in [i % 5]}
    schema = "table int, part int, value long, i int, j int, tree int, unit long, fp long, label long"
    m = spark.createDataFrame([(0, 0, 1, 0, 0, i % 2, u, 5, i // 2) for i, u in enumerate(sets)], schema)
    got = sh.alike_links(m, spark.createDataFrame([(u, bytearray(x.tobytes())) for u, x in sets.items()], "unit long, set binary"), [[(list(range(64)), 3)]], 3, 0.8).collect()
    tree, label = ({u: f(u) for u in sets} for f in (lambda i: i % 2, lambda i: i // 2))
    plain, mine = (sh.Trees(60) for _ in range(2))
    at = label
    for a in sets:
        for b in sets:
            if a < b and tree[a] == tree[b] and sh.resemblance(sets[a].tobytes(), sets[b].tobytes()) >= 0.8:
                plain.join(at[a], at[b])
    for r in got:
        assert tree[r["x"]] == tree[r["y"]] and sh.resemblance(sets[r["x"]].tobytes(), sets[r["y"]].tobytes()) >= 0.8
        mine.join(at[r["x"]], at[r["y"]])
    assert [plain.find(i) for i in range(30)] == [mine.find(i) for i in range(30)] and len(got) > 5


@pytest.mark.parametrize("bits", [{96: 0, 97: 0b111, 146: 0b1}, {96: 0, 97: 0, 146: 0}, {96: 0b1, 97: 0b1, 146: 0}])
def test_a_stranger_between_copies(frame, monkeypatch, bits):
    """A text that is nearer to both copies by its bits, or stands for their fingerprint, does not hide them from each other."""
    def fake(h):
        return bits[len(h)]
    monkeypatch.setattr(sh, "majority", fake)
    a = " ".join(f"w{i}" for i in range(100))
    c = a + " more"
    least = min(hashlib.md5(x.encode()).hexdigest() for x in (a, c))
    between = next(t for k in range(10_000) if hashlib.md5((t := " ".join(f"x{k}y{i}" for i in range(150))).encode()).hexdigest() < least)
    got = sh.near_duplicates(frame([(1, a), (2, between), (3, c)])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]


def test_a_repeated_phrase_does_not_hide_a_copy(frame):
    words = " ".join(f"w{i}" for i in range(100))
    got = sh.near_duplicates(frame([(1, words), (2, words + " ha" * 300)])).collect()
    assert [r["doc_id"] for r in got] == [1]


def plain_sets(sets, similarity):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_odd_rows(frame, odd):
    d = sh.classes(frame(odd).withColumn("fp", F.lit(1)), 3, 3)
    assert d.count() == len(odd)
    zero = {r["component_id"] for r in d.where("fp = 0").collect()}
    assert zero == {3}
    assert sh.classes(frame([]), 3, 3).count() == 0 and sh.near_duplicates(frame([])).count() == 0
