import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from check import compare, connect
from tallygrid.llm import chat
from tallygrid.llm.common import fresh_path
from tallygrid.llm.queries import ORACLES, QUERIES

TREE = "tree long, node long, parent long, score double, role string, text string"
FLAT = "conv_id long, turn long, role string, text string"
TEXTS = ["", "plain", r"[INST] \[INST] [\INST] [/INST]", "</s><s>", "<", "[", "[[/SYS]", r"<\\/s>", "Été\n[/TURN]", "[ROLE]x[/ROLE]", "\\"]


def test_query_equals_sql(spark, sf):
    message, ok = compare(spark, connect(sf), "op11_chat_format", QUERIES["op11_chat_format"], ORACLES["op11_chat_format"], sf)
    assert ok, message


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def brute(rows, branches, mean):
    """{(tree, rank): turns}, by walking up from every leaf."""
    trees = defaultdict(dict)
    for tree, node, parent, score, role, text in rows:
        m = (role or "", text or "", parent, 0.0 if score is None or score != score else score)
        trees[tree][node] = min(m, trees[tree].get(node, m), key=lambda x: (x[0], x[1], x[2] is not None, str(x[2]), x[3]))
    out = {}
    for tree, nodes in trees.items():
        up = {n: m[2] if m[2] in nodes and m[2] is not None else None for n, m in nodes.items()}
        for n in sorted(nodes, key=lambda n: "" if n is None else f"={n}"):  # the least of a ring is its root
            seen, x = set(), n
            while x is not None and x not in seen:
                seen.add(x)
                x = up[x]
            if x == n and x is not None:
                up[n] = None
        found = []
        for leaf in set(nodes) - {p for p in up.values() if p is not None}:
            path, x = [leaf], up[leaf]
            while x is not None:
                path.append(x)
                x = up[x]
            total = sum(nodes[x][3] for x in path)
            found.append((-(total / len(path) if mean else total), "" if leaf is None else f"={leaf}", [nodes[x][:2] for x in path[::-1]]))
        for i, (_, _, turns) in enumerate(sorted(found)[:branches], 1):
            out[tree, i] = turns
    return out


def forest(seed):
    rng = random.Random(seed)
    rows = []
    for tree in range(12):
        for n in range(rng.randint(1, 40)):
            rows.append((tree, n, rng.choice([None, 999] + list(range(n)) * 3), rng.choice([None, float("nan"), 0.5, 1.0, -2.0]), rng.choice(["user", "assistant", "system", "tool[INST]", None]), rng.choice([*TEXTS, None])))
    rows += [(50, i, i - 1 if i else None, 1.0, ["user", "assistant"][i % 2], f"t{i}") for i in range(300)]  # a long thread
    rows += [(51, 1, 3, 1.0, "user", "ring"), (51, 2, 1, 1.0, "user", "ring"), (51, 3, 2, 1.0, "user", "ring"), (51, 4, 3, 2.0, "assistant", "off the ring")]
    rows += [(52, 1, 1, 1.0, "user", "its own parent"), (None, 1, None, 1.0, "user", "no tree"), (None, None, 1, 1.0, "assistant", "no node")]
    return rows + rows[:30]  # repeated rows are one message


def test_trees_equal_brute_force(spark):
    rows = forest(3)
    d = spark.createDataFrame(rows, TREE).repartition(5).withColumn("key", F.lit("mine")).withColumn("path", F.lit(7)).withColumn("up", F.lit(1))
    for branches, mean in ((1, False), (3, True), (1000, False)):
        got = defaultdict(dict)
        for r in chat.paths(chat.messages(d), branches, mean).collect():
            got[r["tree"], r["path"]][r["position"]] = (r["role"], r["text"])
        assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == brute(rows, branches, mean)


def test_files_give_back_turns_and_mask(spark):
    rows = forest(4)
    path = fresh_path(spark, "chat")
    chat.write(chat.messages(spark.createDataFrame(rows, TREE)), path, branches=2)
    want = brute(rows, 2, False)
    got = {(r["tree"], r["path"]): r for r in chat.read(spark, path).collect()}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (
            len(turns), digest(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    parts = spark.read.parquet(path).collect()
    assert max(r["part"] for r in parts) == 299 // chat.TURNS
    for r in parts:  # no control string comes from a text, and the mask holds the assistant's texts
        assert [chat.unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss"]] == [t for x, t in chat.parse(r["formatted"]) if x == "assistant"]


def test_flat_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, "user", "last"), (2, 5, None, None), (None, 0, "user", "x"), (None, 1, "assistant", None)]
    rows += [(3, i, "user", "w" * (i % 7)) for i in range(500)] + [(4, 0, "assistant", "long " * 100_000)]
    d = spark.createDataFrame(rows, FLAT).repartition(4)
    for c in ("key", "tree", "node", "nth", "_chunk", "start"):
        d = d.withColumn(c, F.lit("mine"))
    path = fresh_path(spark, "chat")
    chat.write(chat.chained(d), path)
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r["tree"]: (r["n_turns"], r["turns_sha256"]) for r in chat.read(spark, path).collect()} == {c: (len(t), digest(t)) for c, t in want.items()}
    empty = fresh_path(spark, "chat")
    chat.write(chat.chained(spark.createDataFrame([], FLAT)), empty)
    assert chat.read(spark, empty).count() == 0
    assert chat.paths(chat.messages(spark.createDataFrame([], TREE))).count() == 0
