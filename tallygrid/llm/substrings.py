"""Substring dedup with suffix automata: spans of words that occur earlier are removed.

An automaton of words has a state for every class of substrings with the same
ends. Streaming a document through it yields matching statistics: at every
word the length of the longest suffix that the reference holds. Windows of
``min_words`` with a match that long make up the maximal spans to remove.

``remove_reference`` does that against a given reference: it is cut into shards
of bounded size, each shard's words are broadcast and compiled once in a
worker, and documents stream through all shards.

``remove_repeats`` takes the corpus itself as reference. Its automata grow with
it, so they cannot be broadcast; the work is brought to them instead:

1. Every window selects its anchor, the least hash among its six-word grams, so
   equal windows select equal anchors (one word in about eight is an anchor).
   Anchors that occur twice mark the candidate windows; all else is free of
   repeats and goes no further.
2. Documents are dealt into shards; a shard is read in document order, its
   automaton grows with the candidate spans, and the matching statistics
   against what is already in it find the windows that occur earlier in the
   shard. Windows new to the shard go on.
3. They meet those of other shards under their anchor; the earliest stays, all
   others are removed. A window arrives at most once per shard, so passages
   shared by a large part of the corpus make no large group.

Windows of different shards are compared by a 64-bit hash of their bytes, those
within a shard word by word. Words are kept unchanged.

Defined cases: null text has no words; null ``doc_id`` sorts first, rows of one
id are ordered by a hash of the text; rows equal in id and text are one
document and get the same result; an empty table gives no rows; other columns
are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, whole_row, with_result

GRAM = 6
SHARD_WORDS = 200_000
U = np.uint64
_P, _PINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).view(U)
_POWERS = {1: np.ones(1, U), -1: np.ones(1, U)}


def powers(n: int, sign: int) -> np.ndarray:
    """Powers 0..n-1 of the multiplier (or its inverse) modulo 2**64."""
    have = _POWERS[sign]
    while len(have) < n:
        step = U(pow(_P if sign > 0 else _PINV, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[sign] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words of a text, and hashes of runs of them."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode().split()
        self.n = len(self.words)

    def prepare(self) -> None:
        line = np.frombuffer(b" ".join(self.words), np.uint8)
        spaces = np.flatnonzero(line == 32)
        self.starts = np.concatenate([[0], spaces + 1])
        self.ends = np.concatenate([spaces, [len(line)]])
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[line] * powers(len(line), 1))])
        self.back = powers(len(line) + 1, -1)

    def hashes(self, k: int) -> np.ndarray:
        """Hash of every run of ``k`` words."""
        a, z = self.starts[:self.n - k + 1], self.ends[k - 1:]
        return mixed((self.sums[z] - self.sums[a]) * self.back[a])


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least hash among each ``width`` following ones."""
    value, place, have = grams, np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        less = value[step:] < value[:-step]
        value, place = np.where(less, value[step:], value[:-step]), np.where(less, place[step:], place[:-step])
        have += step
    return place


def anchor_runs(w: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each run of windows with the same anchor."""
    w.prepare()
    grams = w.hashes(min(GRAM, min_words))
    chosen = anchors(grams, min_words - min(GRAM, min_words) + 1)
    first = np.flatnonzero(np.concatenate([[True], np.diff(chosen) != 0]))
    return grams[chosen[first]], first, np.diff(np.concatenate([first, [len(chosen)]]))


class Automaton:
    """Suffix automaton of words, grown one word at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.last = 0

    def extend(self, word) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def restart(self) -> None:
        """What follows is a new text: no substring spans the border (a word of its own stands there)."""
        self.extend(object())

    def step(self, state: int, length: int, word) -> tuple[int, int]:
        """Longest match after one more word, from the longest match before it."""
        nxt = self.next
        while state and word not in nxt[state]:
            state = self.link[state]
            length = self.len[state]
        to = nxt[state].get(word)
        return (to, length + 1) if to is not None else (0, 0)

    def matches(self, words: list) -> list[int]:
        """Matching statistics: at each word the length of the longest match that ends there."""
        out, state, length = [], 0, 0
        for w in words:
            state, length = self.step(state, length, w)
            out.append(length)
        return out

    def grow(self, words: list, most: int) -> list[int]:
        """Matching statistics (cut at ``most``) of a text against all that came before, itself included, while it is added."""
        self.restart()
        out, state, length = [], 0, 0
        for w in words:
            state, length = self.step(state, length, w)
            out.append(length)
            self.extend(w)
            while length <= self.len[self.link[state]] and state:  # the state may have been split
                state = self.link[state]
            if length > most:  # longer matches are not asked for
                length = most
                while state and self.len[self.link[state]] >= most:
                    state = self.link[state]
        return out


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def covered(n: int, windows: list[tuple[int, int]], min_words: int) -> np.ndarray:
    """Words covered by runs of windows (first window, windows)."""
    at = np.zeros(n + 1, np.int64)
    for a, k in windows:
        at[a] += 1
        at[a + k + min_words - 1] -= 1
    return np.cumsum(at[:n]) > 0


def tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def candidate_runs(docs: DataFrame, min_words: int, buckets: int) -> DataFrame:
    """Rows (key, runs): for each document with repeated anchors its runs of candidate windows. ``docs``: key, text."""
    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs, keys, firsts, ns = [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
            for key, text in zip(b["key"], b["text"]):
                w = Words(text)
                if w.n >= min_words:
                    h, first, n = anchor_runs(w, min_words)
                    hs.append(h)
                    keys.append(np.full(len(h), key, np.int64))
                    firsts.append(first.astype(np.int32))
                    ns.append(n.astype(np.int32))
            h, key, first, n = (np.concatenate(x) for x in (hs, keys, firsts, ns))
            order = np.argsort(h, kind="stable")
            h, key, first, n = h[order], key[order], first[order], n[order]
            new = np.concatenate([[True], np.diff(h) != 0])[:len(h)]
            again = ~new | np.concatenate([~new[1:], [False]])[:len(h)]
            yield pd.DataFrame({"bucket": -1, "pack": None, "key": key[again], "first": first[again], "n": n[again]})
            # One of each anchor goes on to meet other batches.
            h, key, first, n = h[new], key[new], first[new], n[new]
            bucket = (h % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))[:len(h)]
            packs = [(int(bucket[o[0]]), b"".join(x[o].tobytes() for x in (h, key, first, n))) for o in np.split(order, cuts[1:]) if len(o)]
            yield pd.DataFrame({"bucket": [p[0] for p in packs], "pack": [p[1] for p in packs], "key": 0, "first": 0, "n": 0})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, packs in by_bucket(batches):
            cols = [[], [], [], []]
            for raw in packs:
                m = len(raw) // 24
                for c, dtype, at in zip(cols, (U, np.int64, np.int32, np.int32), (0, 8 * m, 16 * m, 20 * m)):
                    c.append(np.frombuffer(raw, dtype, m, at))
            h, key, first, n = map(np.concatenate, cols)
            order = np.argsort(h, kind="stable")
            same = np.diff(h[order]) == 0
            o = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            yield pd.DataFrame({"key": key[o], "first": first[o], "n": n[o]})

    rows = stored(docs.mapInPandas(select, "bucket long, pack binary, key long, first int, n int"), "anchors")
    far = rows.where("bucket >= 0").select("bucket", "pack").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    runs = rows.where("bucket < 0").select("key", "first", "n").unionByName(far.mapInPandas(meet, "key long, first int, n int"))
    return runs.groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("runs"))


def by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[bytes]]]:
    """Packs of one bucket after the other; the rows are sorted by bucket."""
    now, held = None, []
    for b in batches:
        for k, raw in zip(b["bucket"], b["pack"]):
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(raw)
    if held:
        yield now, held


FOUND = "bucket long, pack binary, doc_id long, tie long, first int, n int"
_UNIT = np.dtype([("null", "u1"), ("doc", "<i8"), ("tie", "<i8"), ("first", "<i4"), ("h", "<u8")])


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc_id, tie, first, n): runs of windows that occur earlier. ``docs``: doc_id, text."""
    buckets = partitions(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie(F.col("text")).alias("tie"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = d.withColumn("key", F.xxhash64("doc_id", "tie"))
    runs = stored(candidate_runs(keyed.select("key", "text"), min_words, buckets), "candidates")

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, size, before = Automaton(), 0, None
        for b in batches:
            found, units = [], []
            for d, t, text, cand in zip(b["doc_id"], b["tie"], b["text"], b["runs"]):
                doc = None if pd.isna(d) else int(d)
                if (doc, t) == before:
                    continue  # equal in id and text
                before = (doc, t)
                w = Words(text)
                wanted = np.zeros(w.n - min_words + 1, bool)
                for r in cand:
                    wanted[r["first"]:r["first"] + r["n"]] = True
                seen = np.zeros(len(wanted), bool)
                for a, k in spans_of(wanted):
                    words = w.words[a:a + k + min_words - 1]
                    if size > SHARD_WORDS:
                        machine, size = Automaton(), 0  # windows new to the next automaton go on and meet there
                    seen[a:a + k] = np.array(machine.grow(words, min_words)[min_words - 1:]) >= min_words
                    size += len(words)
                found += [(doc, t, a, k) for a, k in spans_of(seen)]
                new = np.flatnonzero(wanted & ~seen)
                if len(new):
                    h, first, n = anchor_runs(w, min_words)
                    u = np.zeros(len(new), _UNIT)
                    u["null"], u["doc"], u["tie"], u["first"] = doc is None, doc or 0, t, new
                    u["h"] = w.hashes(min_words)[new]
                    units.append((h[np.searchsorted(first, new, "right") - 1] % U(buckets), u))
            f = pd.DataFrame(found, columns=["doc_id", "tie", "first", "n"]).astype({"doc_id": "Int64"})
            f.insert(0, "pack", None)
            f.insert(0, "bucket", -1)
            yield f
            if units:
                bucket, u = (np.concatenate(x) for x in zip(*units))
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                packs = [(int(bucket[o[0]]), u[o].tobytes()) for o in np.split(order, cuts)]
                yield pd.DataFrame({"bucket": [p[0] for p in packs], "pack": [p[1] for p in packs],
                                    "doc_id": pd.array([None] * len(packs), "Int64"), "tie": 0, "first": 0, "n": 0})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, packs in by_bucket(batches):
            u = np.concatenate([np.frombuffer(p, _UNIT) for p in packs])
            u = u[np.lexsort((u["first"], u["tie"], u["doc"], 1 - u["null"], u["h"]))]
            u = u[np.concatenate([[True], u[1:] != u[:-1]])]  # rows equal in id and text may stand in several shards
            u = u[np.concatenate([[False], np.diff(u["h"]) == 0])]
            u = u[np.lexsort((u["first"], u["tie"], u["doc"], u["null"]))]
            if not len(u):
                continue
            new = np.concatenate([[True], (np.diff(u["tie"]) != 0) | (np.diff(u["doc"]) != 0) | (np.diff(u["null"].astype(int)) != 0) | (np.diff(u["first"]) != 1)])
            at = np.flatnonzero(new)
            doc = pd.array(u["doc"][at], "Int64")
            doc[u["null"][at] == 1] = None
            yield pd.DataFrame({"doc_id": doc, "tie": u["tie"][at], "first": u["first"][at], "n": np.diff(np.concatenate([at, [len(u)]]))})

    named = runs.withColumnRenamed("key", "_key")
    joined = keyed.join(named, keyed["key"] == named["_key"]).select("doc_id", "tie", "text", "runs")
    # Shards in document order; the text goes over once, with the join.
    rows = stored(joined.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").mapInPandas(shard, FOUND), "windows")
    far = rows.where("bucket >= 0").select("bucket", "pack").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    near = rows.where("bucket < 0").select("doc_id", "tie", "first", "n")
    return near.unionByName(far.mapInPandas(meet, "doc_id long, tie long, first int, n int"))


CUT = "struct<words: long, removed: long, kept: string>"


def cut_windows(text: str | None, windows, min_words: int) -> tuple[int, int, str]:
    w = Words(text)
    if windows is None or not len(windows):
        return w.n, 0, b" ".join(w.words).decode()
    gone = covered(w.n, [(r["first"], r["n"]) for r in windows], min_words)
    return w.n, int(gone.sum()), b" ".join(x for x, g in zip(w.words, gone.tolist()) if not g).decode()


PLACES = 1 << 20  # of the filter of texts with windows


def place(doc: str, tie: str) -> Column:
    return F.pmod(F.xxhash64(doc, tie), F.lit(PLACES))


def place_filter(places: DataFrame) -> DataFrame:
    """One row: a bit for each of ``PLACES`` places, set where ``places`` has it, as an array of longs. Its size does not depend on the rows."""
    words = places.groupBy(F.shiftright("place", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits"))
    dense = places.sparkSession.range(PLACES // 64).join(words, "id", "left")
    line = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return dense.agg(line.alias("line")).select(F.transform("line", lambda x: x["bits"]).alias("filter"))


def remove_repeats(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` with columns _words, _removed and _kept (the words that stay, joined by one space)."""
    found = repeated_windows(docs.select("doc_id", "text"), min_words)
    per_doc = stored(found.groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list(F.struct("first", "n")).alias("_windows")), "found")

    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, windows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_windows(t, r, min_words) for t, r in zip(texts, windows)], columns=["words", "removed", "kept"])

    # The row travels as one value, so that its names meet no others.
    d = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), tie(F.col("text")).alias("of"))
    # Texts that surely have no window stay where they are.
    d = d.crossJoin(F.broadcast(place_filter(per_doc.select(place("_doc", "_tie").alias("place")))))
    at = place("id", "of")
    maybe = F.getbit(F.element_at("filter", F.shiftright(at, 6).cast("int") + 1), F.pmod(at, F.lit(64)).cast("int")) == 1
    asked, free = (d.where(x).drop("filter") for x in (maybe, ~maybe))
    j = asked.join(per_doc, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("of") == F.col("_tie")), "left").select("row", "_windows")
    j = j.unionByName(free.select("row", F.lit(None).cast(per_doc.schema["_windows"].dataType).alias("_windows"))).select("row", cut("row.text", "_windows").alias("cut"))
    return with_result(j, docs.columns, "cut", ("words", "removed", "kept"))


def remove_reference(docs: DataFrame, reference: DataFrame, min_words: int = 20, max_words: int = 5_000_000) -> DataFrame:
    """``docs`` with _words, _removed and _kept, less the maximal spans of at least ``min_words`` that a ``reference`` text holds.

    The reference (column text) is broadcast; more than ``max_words`` words raise.
    """
    size = reference.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if size > max_words:
        raise ValueError(f"the reference has {size} words; at most {max_words} are broadcast")
    shards, held = [[]], 0
    for r in reference.select("text").where("text IS NOT NULL").toLocalIterator():
        words = r["text"].encode().split()
        if held + len(words) > SHARD_WORDS and shards[-1]:
            shards.append([])
            held = 0
        shards[-1].append(words)
        held += len(words)
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    @F.pandas_udf(CUT)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machines = []
        for shard in sent.value:
            machines.append(Automaton())
            for words in shard:
                machines[-1].restart()
                for x in words:
                    machines[-1].extend(x)
        for texts in batches:
            rows = []
            for text in texts:
                words = Words(text).words
                hit = np.zeros(max(0, len(words) - min_words + 1), bool)
                if len(hit):
                    for m in machines:
                        hit |= np.array(m.matches(words)[min_words - 1:]) >= min_words
                rows.append(cut_windows(text, [{"first": a, "n": n} for a, n in spans_of(hit)], min_words))
            yield pd.DataFrame(rows, columns=["words", "removed", "kept"])

    return with_result(docs.select(whole_row(docs).alias("row"), cut("text").alias("cut")), docs.columns, "cut", ("words", "removed", "kept"))
