"""Ranked lexical search by scanning documents for the terms of all items.

The terms of the items form one Aho-Corasick automaton. Each pattern carries a
guard, a blank on both sides, and texts are read with every separator as a
blank, so a term only matches whole terms of a text. One pass over the texts
counts term frequencies and document lengths; there is no index of documents.
Outputs of the automaton map to the items that ask for the term. Once corpus
counts are known, the counted rows are scored, and each task keeps the best
documents of each item only.

Items are searched in groups whose entries (item, distinct term) stay within
``ENTRIES``; a group's automaton and lists are broadcast. An item that is larger
alone makes a group of its own.

Defined cases: null text has no terms; a null id comes after all others among
equal scores and otherwise counts like any; repeated documents rank separately;
rows of one item_id are one item, a null item_id too; items without terms and
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import stored, with_text

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRIES = 2_000_000  # (item, term) pairs of one broadcast group
HELD = 2_000_000  # postings scored, or candidates held, at a time
READ = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()  # separators as blanks, A-Z lowered
_AUTOMATA: dict[str, object] = {}


def terms_of(text: Column) -> Column:
    return F.explode(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})")))


def automaton(name: str, terms: list[str]):
    """The worker's automaton of a group's terms."""
    if name not in _AUTOMATA:
        import ahocorasick
        a = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            a.add_word(f" {t} ", i)
        if terms:
            a.make_automaton()
        _AUTOMATA.clear()  # one at a time
        _AUTOMATA[name] = a
    return _AUTOMATA[name]


def counted(text: str, a) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms of a text, and the automaton's terms in it with their counts."""
    read = text.encode().translate(READ)
    n = len(read.split())
    hits = Counter(map(itemgetter(1), a.iter(f" {read.decode()} "))) if n and len(a) else {}
    return n, np.fromiter(hits.keys(), np.int64, len(hits)), np.fromiter(hits.values(), np.int64, len(hits))


class Lists:
    """Terms of a group of items, and for each term the items that ask for it and how often."""

    def __init__(self, rows: list):
        self.items = sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i or 0))
        self.terms = sorted({r["term"] for r in rows})
        item, term = ({x: k for k, x in enumerate(xs)} for xs in (self.items, self.terms))
        rows = sorted((term[r["term"]], item[r["item_id"]], r["times"]) for r in rows)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.times = np.array([r[2] for r in rows], np.int64)
        self.start = np.searchsorted([r[0] for r in rows], np.arange(len(self.terms) + 1))


def scores(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, weight: np.ndarray, lists: Lists) -> np.ndarray:
    """Score of each document (rows) for each item (columns). ``doc``, ``term``, ``tf``: the documents' counted terms."""
    value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    n = lists.start[term + 1] - lists.start[term]
    entry = np.repeat(np.arange(len(term)), n)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + lists.start[term][entry]
    out = np.zeros(len(m) * len(lists.items), np.int64)
    np.add.at(out, doc[entry] * len(lists.items) + lists.item[at], value[entry] * lists.times[at])
    return out.reshape(len(m), -1)


class Best:
    """The best ``k`` documents of each item so far: highest score, then smallest id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor, self.held, self.n = k, np.zeros(items, np.int64), [], 0

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        d, i = np.nonzero((score > 0) & (score >= self.floor))
        self.held.append((i, score[d, i], missing[d], ids[d]))
        self.n += len(d)
        if self.n > max(HELD, 2 * self.k * len(self.floor)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        i, s, m, d = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.empty(0, np.int64),) * 4
        order = np.lexsort((d, m, -s, i))
        i, s, m, d = (x[order] for x in (i, s, m, d))
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == self.k - 1
        self.floor[i[last]] = s[last]
        keep = rank < self.k
        self.held, self.n = [(i[keep], s[keep], m[keep], d[keep])], int(keep.sum())
        return self.held[0]


def _search(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """Rows (item_id, doc_id, score) that hold the best ``k`` documents of each item of one group."""
    spark = docs.sparkSession
    lists = Lists(rows)
    sent = spark.sparkContext.broadcast(lists)
    name = f"{spark.sparkContext.applicationId}/{sent._jbroadcast.id()}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton(name, sent.value.terms)
        for b in batches:
            got = [counted(t, a) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": [g[0] for g in got],
                                "terms": [g[1].astype(np.uint32).tobytes() for g in got], "tfs": [g[2].astype(np.uint64).tobytes() for g in got]})

    d = stored(with_text(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInPandas(scan, "doc_id long, n long, terms binary, tfs binary"), "counted")

    def holding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(sent.value.terms), np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b["terms"]), np.uint32), minlength=len(n))
        yield pd.DataFrame({"term": np.flatnonzero(n), "df": n[n > 0]})

    total, length = d.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(lists.terms), np.int64)
    for r in d.select("terms").mapInPandas(holding, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row per term of the group
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = sent.value
        best = Best(len(asked.items), k)
        fan = np.diff(asked.start)
        for b in batches:
            b = b[b["n"] > 0]
            terms = [np.frombuffer(t, np.uint32) for t in b["terms"]]
            tfs = [np.frombuffer(t, np.uint64) for t in b["tfs"]]
            ids, missing = b["doc_id"].fillna(0).to_numpy(np.int64), b["doc_id"].isna().to_numpy()
            m = 75 + 25 * b["n"].to_numpy(np.int64) * total // length if len(b) else np.empty(0, np.int64)
            # Some documents at a time: bounded postings, bounded rows x items.
            cost = np.cumsum([fan[t].sum() + len(asked.items) for t in terms])
            at = 0
            while at < len(b):
                z = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + HELD, "right")))
                doc = np.repeat(np.arange(z - at), [len(t) for t in terms[at:z]])
                s = scores(doc, np.concatenate(terms[at:z]).astype(np.int64), np.concatenate(tfs[at:z]).astype(np.int64), m[at:z], weight, asked)
                best.add(s, ids[at:z], missing[at:z])
                at = z
        i, s, gone, ids = best.cut()
        yield pd.DataFrame({"item_id": pd.array([asked.items[x] for x in i.tolist()], "Int64"), "score": s, "doc_id": pd.array(np.ma.array(ids, mask=gone).tolist(), "Int64")})

    return d.mapInPandas(rank, "item_id long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, entries: int = ENTRIES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), terms_of(F.col("text")).alias("term"))
    asked = stored(asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    sizes = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, -(-asked.count() // entries))
    while True:
        part = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull()), F.lit(parts))
        worst = sizes.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if worst.where((F.col("n") > entries) & (F.col("items") > 1)).isEmpty():
            break
        parts *= 2
    found = None
    for p in range(parts):
        rows = asked.where(part == p).collect()  # at most ``entries``, or one item
        if rows:
            got = _search(docs, rows, k)
            found = got if found is None else found.unionByName(got)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, score long, doc_id long")
    w = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
