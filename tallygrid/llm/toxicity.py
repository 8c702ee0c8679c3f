"""Toxicity: a learned lexicon as a trie, Levenshtein automata over it, and context windows.

1. Terms and stems whose labelled rows are nearly all toxic form the lexicon.
2. The lexicon is a trie. A token runs through the trie and the Levenshtein
   automaton of one edit at the same time; the pairs (trie node, edits) reached
   by a prefix form a state, and states are made on first use and kept. Most
   tokens of clean text leave the trie after three or four letters. Only
   entries of at least ``FUZZY`` letters may be misspelt; a term of that length
   is an entry of its own also where a stem has its exact forms.
3. Around each hit a window of tokens is read: quotation marks, words that
   report, and direct address are counted, and how many hits stand close together.
4. A logistic regression over these counts gives the score.

The classifier (1 and 4) is fitted on at most about ``fit_rows`` labelled rows,
spread over all of them by a hash of the id; scoring reads every whole text.

Defined cases: null or empty texts have no tokens and score by the intercept;
a null ``doc_id`` counts as the id ''; repeated rows score alike; without both
kinds of labels all scores are 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_text

TOKEN = re.compile(r"[^\W_]+")
STEMS = range(4, 11)
FUZZY = 5
WINDOW = 12
CACHE_TOKENS = 1_000_000
EXACT, STEM, MISSPELT = 1, 2, 3
# Marks of quotation, words that report, direct address.
QUOTES = "\"'“”„«»‘’"
REPORTING = {"said", "says", "wrote", "writes", "quoted", "quote", "quotes", "called", "reported", "word", "term"}
ADDRESS = {"you", "your", "youre", "du", "dich", "dein", "tu", "toi", "ton", "usted", "tú"}


class Lexicon:
    """Trie of terms and stems with the automaton of at most one edit."""

    def __init__(self, entries: list[tuple[str, bool]]):
        """``entries``: (letters, whether anything may follow)."""
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.long: list[bool] = [False]  # an entry of at least FUZZY letters lies below
        for word, stem in entries:
            node, path = 0, [0]
            for ch in word:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append(0)
                    self.long.append(False)
                node = self.next[node][ch]
                path.append(node)
            self.ends[node] |= 2 if stem else 1
            if len(word) >= FUZZY:
                for p in path:
                    self.long[p] = True
        self.depth = [0] * len(self.next)
        for node, kids in enumerate(self.next):
            for kid in kids.values():
                self.depth[kid] = self.depth[node] + 1
        self.step: dict[tuple[int, str], int] = {}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accept: list[int] = []
        self.start = self._state({(0, 0)} | self._skipped(0))

    def _skipped(self, node: int) -> set[tuple[int, int]]:
        """One letter of the entry left out of the token."""
        return {(kid, 1) for kid in self.next[node].values() if self.long[kid]}

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        key = frozenset(pairs)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            kinds = {(e, self.ends[n]) for n, e in key if self.ends[n] and (not e or self.depth[n] >= FUZZY)}
            self.accept.append(EXACT if any(not e and k & 1 for e, k in kinds) else STEM if any(not e and k & 2 for e, k in kinds)
                               else MISSPELT if kinds else 0)
        return self.states[key]

    def _follow(self, state: int, ch: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if not edits and self.ends[node] & 2:  # past a stem anything goes
                out.add((node, 0))
            kid = self.next[node].get(ch)
            if kid is not None:
                out.add((kid, edits))
                if not edits:
                    out |= self._skipped(kid)
            if not edits and self.long[node]:
                out.add((node, 1))  # a letter too many
                out |= {(k, 1) for k in self.next[node].values() if self.long[k]}  # another letter
        return self._state(out)

    def kind(self, token: str) -> int:
        """EXACT, STEM, MISSPELT or 0."""
        state, step = self.start, self.step
        for ch in token:
            at = (state, ch)
            state = step.get(at, -1)
            if state < 0:
                state = step[at] = self._follow(at[0], ch)
            if not self.sets[state]:
                return 0
        return self.accept[state]


class Kinds(dict):
    """Kind of each token, kept; the memory is bounded by ``CACHE_TOKENS``."""

    def __init__(self, lexicon: Lexicon, spared: frozenset[str] = frozenset()):
        self.lexicon, self.spared = lexicon, spared

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        got = self[token] = 0 if token in self.spared else self.lexicon.kind(token)
        return got


FEATURES = ("exact", "stem", "misspelt", "share", "close", "quoted", "reported", "addressed")
HITS = {"exact", "stem", "misspelt", "share", "close"}


def features(text: str, kinds: Kinds) -> list[float]:
    """Counts of one text, in the order of FEATURES."""
    low = text.lower()
    tokens = TOKEN.findall(low)
    codes = np.frombuffer(bytes(map(kinds.__getitem__, tokens)), np.uint8)
    at = np.flatnonzero(codes)
    if not len(at):
        return [0.0] * len(FEATURES)
    n = np.bincount(codes[at], minlength=4)
    close = int(np.max(np.searchsorted(at, at + 2 * WINDOW, "right") - np.arange(len(at))))
    hits, quoted, reported, addressed = set(at.tolist()), 0, 0, 0
    for i, m in enumerate(TOKEN.finditer(low)):
        if i in hits:
            quoted += low[max(0, m.start() - 1):m.start()] in QUOTES and m.start() > 0 or low[m.end():m.end() + 1] in QUOTES and m.end() < len(low)
            around = set(tokens[max(0, i - WINDOW):i + WINDOW + 1])
            reported += not around.isdisjoint(REPORTING)
            addressed += not around.isdisjoint(ADDRESS)
    k = len(at)
    return [math.log1p(n[EXACT]), math.log1p(n[STEM]), math.log1p(n[MISSPELT]), math.log1p(1000 * k / len(tokens)), math.log1p(close),
            quoted / k, reported / k, addressed / k]


def misspelt_copy(text: str, kinds: Kinds) -> str:
    """The text with one letter wrong in each hit that may be misspelt; which letter and how follows from the token's hash."""
    def change(m: re.Match) -> str:
        token = m[0].lower()
        if kinds[token] in (EXACT, STEM) and len(token) >= FUZZY:
            h = zlib.crc32(token.encode())
            for k in range(len(token)):
                at = (h + k) % len(token)
                wrong = (token[:at] + token[at + 1:], token[:at] + "0" + token[at + 1:], token[:at] + token[at] + token[at:])[h // 7 % 3]
                if kinds[wrong] == MISSPELT:
                    return wrong
        return m[0]
    return TOKEN.sub(change, text)


def quoted_copy(text: str, kinds: Kinds) -> str:
    """The text with each hit between quotation marks, after a word that reports."""
    return TOKEN.sub(lambda m: f'they wrote "{m[0]}"' if kinds[m[0].lower()] else m[0], text)


@dataclass
class Model:
    entries: list[tuple[str, bool]]
    coefficients: list[float]
    intercept: float
    spared: frozenset[str] = frozenset()  # words of clean rows that are one letter from a term

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.intercept == -math.inf:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.coefficients) + self.intercept, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def learn_lexicon(rows: DataFrame, max_terms: int, least_rows: int, least_share: float) -> list[tuple[str, bool]]:
    """Terms and stems that at least ``least_rows`` toxic rows hold, and of whose rows nearly all are toxic. ``rows``: text, label."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic, clean = Counter(), Counter()
            for t, y in zip(b["text"], b["label"]):
                terms = {x for x in TOKEN.findall(t.lower()) if len(x) < 40}
                terms |= {f"{x[:n]}*" for x in terms for n in STEMS if len(x) >= n}
                (toxic if y > 0.5 else clean).update(terms)
            # A term without a toxic row in a batch still counts against others; its rows are summed over batches.
            names = list(toxic | clean)
            yield pd.DataFrame({"term": names, "toxic": [toxic[x] for x in names], "clean": [clean[x] for x in names]})

    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = ((F.col("toxic") + 0.5) / n[1.0]) / ((F.col("clean") + 0.5) / n[0.0])
    found = (rows.select("text", "label").mapInPandas(count, "term string, toxic long, clean long")
             .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") >= least_rows) & (odds >= least_share))
             .orderBy(F.desc("toxic"), F.length("term"), "term").limit(16 * max_terms).collect())
    stems: set[str] = set()
    terms: set[str] = set()
    beside: set[str] = set()  # terms that begin with a chosen stem: it has their exact forms, but only a full term may be misspelt
    for r in found:
        term, stem = (r["term"][:-1], True) if r["term"].endswith("*") else (r["term"], False)
        if not stems.isdisjoint(term[:k] for k in range(1, len(term) + 1)):
            if not stem and len(term) >= FUZZY:
                beside.add(term)
        elif len(stems | terms) < max_terms:
            (stems if stem else terms).add(term)
    short = {t for t in terms & stems if len(t) < FUZZY}  # the stem stands for it
    return sorted([*((t, True) for t in stems), *((t, False) for t in (terms - short) | beside)])


def learn_spared(rows: DataFrame, entries: list[tuple[str, bool]], least_share: float) -> frozenset[str]:
    """Tokens one letter from a term that are words of their own: clean rows hold them, and toxic ones not far more often."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = Kinds(Lexicon(entries))
        for b in batches:
            found = [(x, y > 0.5) for t, y in zip(b["text"], b["label"]) for x in set(TOKEN.findall(t.lower())) if kinds[x] == MISSPELT]
            yield pd.DataFrame({"term": pd.Series([x for x, _ in found], dtype=object), "toxic": [int(y) for _, y in found], "clean": [int(not y) for _, y in found]})

    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = ((F.col("toxic") + 0.5) / n[1.0]) / ((F.col("clean") + 0.5) / n[0.0])
    found = rows.select("text", "label").mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return frozenset(r["term"] for r in found.where((F.col("clean") > 0) & (odds < least_share)).collect())  # of the bounded sample


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, max_terms: int = 500, least_rows: int = 8, least_share: float = 20.0) -> Model:
    """Fit on rows of ``labels`` that are not held out. ``fit_rows`` bounds the sample that all steps see (about; rows fall by hash).

    Labelled rows seldom hold misspelt or quoted terms. So a share of the toxic
    rows, by the hash of their text, is also seen with its terms misspelt, still
    toxic, and another share with its terms quoted, as clean. Hits, however
    spelt, never count against toxicity: their weights are bounded at 0.
    """
    known = (labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("label")))
    n = known.count()
    share = min(1.0, fit_rows / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    text = with_text(docs, "doc_id")
    rows = stored(text.join(known, text["doc_id"] == known["doc_id"]).select("text", "label"), "labelled")
    if rows.select("label").distinct().count() < 2:
        return Model([], [0.0] * len(FEATURES), -math.inf)
    entries = learn_lexicon(rows, max_terms, least_rows, least_share)
    spared = learn_spared(rows, entries, least_share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = Kinds(Lexicon(entries), spared)
        for b in batches:
            x, y = [features(t, kinds) for t in b["text"]], b["label"].tolist()
            for t, label in zip(b["text"], b["label"]):
                turn = zlib.crc32(t.encode()) % 4 if label > 0.5 else -1
                if turn in (0, 1):
                    x.append(features((misspelt_copy, quoted_copy)[turn](t, kinds), kinds))
                    y.append(1.0 - turn)
            yield pd.DataFrame({"x": x, "label": y})

    x = stored(rows.mapInPandas(count, "x array<double>, label double"), "features")
    least = Matrices.dense(1, len(FEATURES), [0.0 if f in HITS else -1e9 for f in FEATURES])
    m = LogisticRegression(featuresCol="v", labelCol="label", family="binomial", regParam=1e-3, maxIter=60, lowerBoundsOnCoefficients=least).fit(x.withColumn("v", array_to_vector("x")))
    return Model(entries, m.coefficients.toArray().tolist(), float(m.intercept), spared)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows with columns _score and _predicted added (or replaced). No shuffle; only the text leaves the JVM."""
    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kinds = Kinds(Lexicon(model.entries), model.spared)
        for b in texts:
            yield pd.Series(model.scores(np.array([features(t, kinds) for t in b]).reshape(-1, len(FEATURES))))

    d = docs.withColumn("_score", run(F.coalesce(F.col("text"), F.lit(""))))
    return d.withColumn("_predicted", (F.col("_score") >= threshold).cast("int"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents below the threshold, as they came."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text")
    return score(rows, model, threshold).where("_predicted = 0").select("row.*")
