import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallygrid.llm import toxicity as tx
from tallygrid.llm.queries import QUERIES, table

WORDS = ["idiot", "moron", "scum", "worthless"]


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


@settings(max_examples=800, deadline=None)
@given(st.one_of(st.text("idotmrnscuwhle", max_size=10), st.sampled_from(WORDS).flatmap(
    lambda w: st.builds(lambda i, c, k: w[:i] + c + w[i + k:], st.integers(0, len(w)), st.sampled_from(["", "x", "i", "tt"]), st.integers(0, 2)))))
def test_automaton_equals_edit_distance(token):
    lex = tx.Lexicon([(w, False) for w in WORDS] + [("veju", True)])
    want = tx.EXACT if token in WORDS else tx.STEM if token.startswith("veju") else tx.MISSPELT if any(
        len(w) >= tx.FUZZY and distance_at_most_one(token, w) for w in WORDS) else 0
    assert lex.kind(token) == want


def test_quoted_and_addressed_hits_differ():
    kinds = tx.Kinds(tx.Lexicon([(w, False) for w in WORDS]))
    quoted = dict(zip(tx.FEATURES, tx.features('He said the word "idiot" was heard there', kinds)))
    abuse = dict(zip(tx.FEATURES, tx.features("you idiot and idjot", kinds)))
    assert quoted["quoted"] == 1 and quoted["reported"] == 1 and not quoted["addressed"]
    assert abuse["addressed"] == 1 and not abuse["quoted"] and abuse["misspelt"] > 0
    assert tx.features("", kinds) == tx.features("clean words only", kinds) == [0.0] * len(tx.FEATURES)


def corpus(n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aenrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(WORDS))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_and_holds_out(spark, frame):
    rows, labels = corpus()
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (10_000, 1)], "doc_id long, toxic int")
    docs = frame(rows)
    model = tx.fit(docs, lab)
    assert {w for w, _ in model.entries} <= {w[:k] for w in WORDS for k in range(4, 12)}
    odd = frame([*rows, (9001, "you 1diot, m0ron and worthles scum idlot"), (9002, None), (9003, ""), (None, "x " * 50_000), (None, None)]).withColumn("score", F.lit("mine"))
    got = {r["doc_id"]: r for r in tx.score(odd, model).collect() if r["doc_id"] is not None}
    assert all(got[i]["_predicted"] == y for i, y in labels) and got[9001]["_predicted"] == 1 and got[9002]["_predicted"] == 0
    assert got[9002]["_score"] == got[9003]["_score"] and all(0 <= r["_score"] <= 1 for r in got.values())
    kept = tx.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count() - sum(r["_predicted"] for r in got.values())


def test_learned_terms_may_be_misspelt(spark, frame):
    """Through the learned lexicon: its stems are shorter than FUZZY and come first, and must not take the full terms with them."""
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(frame(rows), lab)
    assert {("idio", True), ("idiot", False), ("moron", False), ("worthless", False)} <= set(model.entries)
    lex = tx.Lexicon(model.entries)
    assert [lex.kind(x) for x in ("idiot", "idiotic", "1diot", "m0ron", "w0rthless", "wrthless")] == [tx.EXACT, tx.STEM, *[tx.MISSPELT] * 4]
    assert [lex.kind(x) for x in ("scum", "scumbag", "5cum", "clean")] == [tx.STEM, tx.STEM, 0, 0]


def test_no_term_is_crowded_out(spark):
    """Terms beside a stem do not count against the number of entries."""
    rows = spark.createDataFrame([(f"{w} idiot moron", 1.0) for w in ["scum"] * 12] + [("clean words", 0.0)] * 200, "text string, label double")
    got = tx.learn_lexicon(rows, 3, 8, 5.0)
    assert set(got) == {("idio", True), ("idiot", False), ("moro", True), ("moron", False), ("scum", False)}


def test_held_out_labels_are_not_seen(spark, frame):
    rows, labels = corpus(300)
    held = {r[0] for r in spark.range(300).where(tx.held_out(F.col("id"))).collect()}
    a = tx.fit(frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = tx.fit(frame(rows), spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in labels], "doc_id long, toxic int"))
    assert a.entries == b.entries and np.allclose(a.coefficients, b.coefficients)


def test_misspelt_abuse_counts_and_quotation_does_not(spark, frame):
    rows, labels = corpus()
    # A clean word one letter from a term is a word of its own.
    rows = [(i, t + (" motron" if i % 5 and i % 3 else "")) for i, t in rows]
    model = tx.fit(frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(tx.FEATURES, model.coefficients))
    assert all(weight[f] >= 0 for f in tx.HITS) and weight["misspelt"] > 0 and weight["quoted"] < 0
    plain = "rain sea ten test 1diot stare m0ron tea worthles near wrthless eat"
    quoted = 'they wrote "1diot" rain, they wrote "m0ron" sea, they wrote "worthles" ten, they wrote "wrthless" tea'
    got = {r["doc_id"]: r["_score"] for r in tx.score(frame([(1, plain), (2, quoted), (3, "rain motron sea ten")]), model).collect()}
    assert got[1] > 0.7 > got[2] and got[3] < 0.1 and "motron" in model.spared


def plain_features(text, lexicon, spared):
    """Every feature by definition, with edit distances in place of the automaton."""
    low, full, stems = text.lower(), [w for w, stem in lexicon if not stem], [w for w, stem in lexicon if stem]

    def kind(x):
        if x in spared:
            return 0
        if x in full:
            return tx.EXACT
        if any(x.startswith(w) for w in stems):
            return tx.STEM
        if any(len(w) >= tx.FUZZY and distance_at_most_one(x, w) for w in full):
            return tx.MISSPELT
        # A stem of FUZZY letters or more may have its one wrong letter anywhere in it.
        return tx.MISSPELT if any(len(w) >= tx.FUZZY and any(distance_at_most_one(x[:k], w) for k in range(len(x) + 1)) for w in stems) else 0

    found = list(tx.TOKEN.finditer(low))
    tokens, kinds = [m[0] for m in found], [kind(m[0]) for m in found]
    at = [i for i, k in enumerate(kinds) if k]
    if not at:
        return [0.0] * len(tx.FEATURES)
    near = [set(tokens[max(0, i - tx.WINDOW):i + tx.WINDOW + 1]) for i in at]
    marks = [any(c and c in tx.QUOTES for c in (low[max(0, found[i].start() - 1):found[i].start()], low[found[i].end():found[i].end() + 1])) for i in at]
    close = max(sum(i <= j <= i + 2 * tx.WINDOW for j in at) for i in at)
    return [*(np.log1p(kinds.count(k)) for k in (tx.EXACT, tx.STEM, tx.MISSPELT)), np.log1p(1000 * len(at) / len(tokens)), np.log1p(close),
            sum(marks) / len(at), sum(bool(x & tx.REPORTING) for x in near) / len(at), sum(bool(x & tx.ADDRESS) for x in near) / len(at)]


def test_scores_equal_a_plain_version(spark, sf):
    """The score of every row of the table, from the fitted model's entries and weights."""
    docs = table(spark, sf, "documents")
    model = tx.fit(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    got = {r["doc_id"]: r["_score"] for r in tx.score(docs.select("doc_id", "text"), model).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        z = model.intercept + sum(a * b for a, b in zip(plain_features(r["text"] or "", model.entries, model.spared), model.coefficients))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-9


def test_without_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame([(1, "a b"), (2, None)])
    assert [r["_score"] for r in tx.score(docs, tx.fit(docs, none)).collect()] == [0.0, 0.0]
    assert tx.reject(docs, tx.fit(docs, none)).count() == 2
    assert tx.score(frame([]), tx.fit(frame([]), none)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    labels = table(spark, sf, "labels").collect()
    assert len(got) == table(spark, sf, "documents").count()
    # Labels of this table are noisy: precision is held, and most toxic rows found.
    bad = [r["doc_id"] for r in labels if r["toxic"] == 1 and got[r["doc_id"]]["held_out"]]
    good = [r["doc_id"] for r in labels if r["toxic"] == 0 and got[r["doc_id"]]["held_out"]]
    assert sum(got[i]["predicted"] for i in good) <= 0.02 * len(good)
    assert sum(got[i]["predicted"] for i in bad) >= 0.6 * len(bad)
