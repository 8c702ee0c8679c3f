"""The pipeline against plain versions of its stages on a small corpus."""

import random

import numpy as np

import corpus_pipeline as cp
from test_linededup import brute as lines_kept
from test_simhash import plain_sets
from test_token_files import check_packing

WORDS = ["idiot", "moron", "scum", "worthless"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        t = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(2, 5))]
        if i % 5 == 0:
            t[0] += " " + " ".join(rng.choice(WORDS) for _ in range(4))
        labels.append((i, int(i % 5 == 0)))
        rows.append((i, "\n".join(t), rng.choice(["a", "b", "c"])))
    for i in range(240, 300):
        _, t, s = rows[rng.randrange(240)]
        w = t.replace("\n", " ").split(" ")
        if i % 2:
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w) if i % 3 else t, s))
    return [*rows, (400, None, "a"), (401, "", None)], labels


def test_stages(spark, frame, tmp_path):
    rows, labels = corpus()
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    seen = []
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS
        seen.append(sorted((tuple(r) for r in out.collect()), key=str))
        docs = spark.createDataFrame(seen[-1], docs.schema).repartition(3)
    toxic, lined, single, mixed = seen
    assert sorted(r[0] for r in toxic) == sorted(i for i, t, _ in rows if not set((t or "").split()) & set(WORDS))
    want = lines_kept([(r[0], r[1]) for r in toxic], 2)
    assert {r[0]: r[1] for r in lined} == {i: k for (i, _), (_, _, k) in want.items()}
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in lined)
    sets = {r[0]: {tuple((r[1] or "").split()[k:k + 5]) for k in range(max(1, len((r[1] or "").split()) - 4))} for r in lined}
    classes = plain_sets(sets, 0.8)
    kept, least = {r[0] for r in single}, set(classes.values())
    assert least <= kept and len(kept - least) <= 2 and len(single) == len(kept)
    assert all(mixed.count(r) in (1, 2) for r in set(mixed)) and set(mixed) <= set(single)
    size = {s: sum(len((r[1] or "").split()) for r in single if r[3] == s) for s in ("a", "b", "c")}
    taken = {s: sum(len((r[1] or "").split()) for r in mixed if r[3] == s) for s in size}
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    check_packing(cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), [r[1] for r in mixed])


def test_long_lines_of_two_documents(spark, frame):
    long = " ".join(f"a{i}" for i in range(60))
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.drop_repeated_lines(spark, frame([(1, f"x\n{long}\ny"), (2, f"z\n{long}\nw"), (3, f"v\n{long}")]), "").collect()}
    assert out == {1: (f"x\n{long}\ny", len(long) + 4), 2: ("z\nw", 3), 3: ("v", 1)}


def test_run(spark, sf):
    rows = cp.run(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *[n for _, n in x[:-1]]]).tolist() and sum(n for _, n in x) <= 2048


def test_empty(spark, frame, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
