"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph parts.

A text is cut at line ends and, inside a line, at clause marks (long clauses
into parts of 48 bytes), so that a short text differs by parts too. Every part
becomes a 64-bit digest; the k-th repeat of a part gets a digest of its own.
A digest goes into one cell of each of three sub-tables; a cell holds a count,
the xor of its digests and the xor of their check hashes. The fingerprint is
the base-size table.

Two versions are compared by subtracting cells: what they share cancels.
Peeling then takes out digests that stand alone in a cell until none is left.
If cells remain, the difference was too large for the table, and both versions
are sketched again, large enough for all their parts, then twice that, and so
on until it peels. Likeness is shared parts over all parts (1 for two empty
texts). Tables of many pairs are peeled together as arrays.

Defined cases: null text is empty, with the empty fingerprint; null ``doc_id``
comes last in the order, rows of one id are ordered by text; of one row alone
the next document is the row itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_number, sorted_runs, with_text

PART = re.compile(rb"[^\n.,;:!?]{1,48}[\n.,;:!?]*|[\n.,;:!?]+")
SUB = 8  # cells of each of the three sub-tables of a fingerprint
BATCH_PARTS = 300_000
U = np.uint64


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of 64-bit values."""
    x = x + U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Parts:
    """Digests of many texts, one array with the row of each."""

    def __init__(self, texts: list[str]):
        found = [[xxhash.xxh64_intdigest(p) for p in PART.findall(t.encode())] for t in texts]
        self.n = np.array([len(f) for f in found], np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.n)
        key = np.fromiter((k for f in found for k in f), U, int(self.n.sum()))
        order = np.lexsort((key, self.row))
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(self.row[order]) != 0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        repeat = np.empty(len(key), U)
        repeat[order] = (np.arange(len(key)) - start).astype(U)
        self.key = np.where(repeat > 0, mix(key, 7) + repeat, key)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, digest) of the parts of these rows."""
        starts = np.concatenate([[0], np.cumsum(self.n)])[rows]
        n = self.n[rows]
        place = np.repeat(np.arange(len(rows)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return place, self.key[np.repeat(starts, n) + within]


class Tables:
    """Sketches of many rows; row ``i`` has three sub-tables of ``sub[i]`` cells."""

    def __init__(self, sub: np.ndarray):
        self.sub = np.asarray(sub, np.int64)
        self.at = np.concatenate([[0], np.cumsum(3 * self.sub)])
        size = int(self.at[-1])
        self.count, self.keys, self.checks = np.zeros(size, np.int32), np.zeros(size, U), np.zeros(size, U)

    def add(self, row: np.ndarray, key: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        check, sub, at = mix(key, 99), self.sub[row], self.at[row]
        cells = [at + i * sub + (mix(key, i + 1) % sub.astype(U)).astype(np.int64) for i in range(3)]
        for c in cells:
            np.add.at(self.count, c, sign)
            np.bitwise_xor.at(self.keys, c, key)
            np.bitwise_xor.at(self.checks, c, check)
        return np.unique(np.concatenate(cells))

    def minus(self, other: Tables) -> Tables:
        t = Tables.__new__(Tables)
        t.sub, t.at = self.sub, self.at
        t.count, t.keys, t.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return t

    def take(self, rows: np.ndarray) -> Tables:
        """Tables of some rows; all must be of one size."""
        t = Tables.__new__(Tables)
        width = 3 * int(self.sub[0]) if len(self.sub) else 0
        t.sub, t.at = self.sub[rows], np.arange(len(rows) + 1) * width
        t.count, t.keys, t.checks = (x.reshape(-1, width)[rows].ravel() for x in (self.count, self.keys, self.checks))
        return t

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign) of what was recovered, and whether each row came out whole. Empties the tables."""
        owner = np.repeat(np.arange(len(self.sub)), 3 * self.sub)
        rows, keys, signs = [], [], []
        open_cells = np.flatnonzero(np.abs(self.count) == 1)
        while len(open_cells):
            c = open_cells[mix(self.keys[open_cells], 99) == self.checks[open_cells]]
            c = c[np.abs(self.count[c]) == 1]
            if not len(c):
                break
            r, k, s = owner[c], self.keys[c], self.count[c]
            order = np.lexsort((k, r))
            first = np.ones(len(c), bool)
            first[1:] = (np.diff(k[order]) != 0) | (np.diff(r[order]) != 0)
            one = order[first]
            r, k, s = r[one], k[one], s[one]
            rows.append(r)
            keys.append(k)
            signs.append(s)
            touched = self.add(r, k, -s)
            open_cells = touched[np.abs(self.count[touched]) == 1]
        left = (self.count != 0) | (self.keys != 0)
        whole = np.bincount(owner[left], minlength=len(self.sub)) == 0
        empty = np.empty(0, np.int64)
        return (np.concatenate(rows) if rows else empty, np.concatenate(keys) if keys else empty.astype(U),
                np.concatenate(signs) if signs else empty, whole)

    def text(self) -> list[str]:
        """Each row's table in base64; all must be of one size."""
        width = 3 * int(self.sub[0]) if len(self.sub) else 1
        raw = np.concatenate([x.reshape(-1, width).view(np.uint8) for x in (self.count, self.keys, self.checks)], 1)
        return [base64.b64encode(r.tobytes()).decode() for r in raw]


def base_tables(parts: Parts) -> Tables:
    t = Tables(np.full(len(parts.n), SUB))
    t.add(parts.row, parts.key, 1)
    return t


def differences(a: Parts, rows_a: np.ndarray, base_a: Tables, b: Parts, rows_b: np.ndarray, base_b: Tables) -> np.ndarray:
    """Number of differing digests of each pair (rows_a[i], rows_b[i]), recovered by peeling."""
    out = np.zeros(len(rows_a), np.int64)
    todo, sub = np.arange(len(rows_a)), None
    while len(todo):
        if sub is None:
            left, right = base_a.take(rows_a[todo]), base_b.take(rows_b[todo])
            sub = np.full(len(rows_a), SUB)
        else:
            all_parts = a.n[rows_a[todo]] + b.n[rows_b[todo]]
            sub[todo] = np.maximum(2 * sub[todo], (all_parts + 1) // 2 + SUB)
            left, right = Tables(sub[todo]), Tables(sub[todo])
            left.add(*a.of(rows_a[todo]), 1)
            right.add(*b.of(rows_b[todo]), 1)
        row, _, _, whole = left.minus(right).peel()
        found = np.bincount(row, minlength=len(todo))
        out[todo[whole]] = found[whole]
        todo = todo[~whole]
    return out


def likeness(n_a: np.ndarray, n_b: np.ndarray, different: np.ndarray) -> np.ndarray:
    both = n_a + n_b
    return np.where(both + different > 0, (both - different) / np.maximum(both + different, 1), 1.0)


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def compare(texts: list[str], following: list[str], edits: list[str]) -> pd.DataFrame:
    """Fingerprints of texts and edits, and the two likenesses."""
    a, e = Parts(texts), Parts(edits)
    # What follows a text is the next text; only the last one is sketched apart.
    f = Parts(following)
    base_a, base_e, base_f = base_tables(a), base_tables(e), base_tables(f)
    rows = np.arange(len(texts))
    return pd.DataFrame({
        "fingerprint": base_a.text(), "edited_fingerprint": base_e.text(),
        "near_edited": likeness(a.n, e.n, differences(a, rows, base_a, e, rows, base_e)),
        "near_next": likeness(a.n, f.n, differences(a, rows, base_a, f, rows, base_f))})


def with_next(docs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over (doc_id, text, text of the next document), in descending ``doc_id``, the first following the last.

    The texts are shuffled once, in chunks of the order. Only the first document
    of each chunk travels twice: its id is found from the ids alone, one for each chunk.
    """
    d, n = chunk_number(with_text(docs, F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "chunk")
    heads = d.groupBy("chunk").agg(F.max("doc_id").alias("head")).orderBy("chunk").collect()  # one row per chunk
    moves = [(r["chunk"], r["head"], heads[(i + 1) % len(heads)]["chunk"]) for i, r in enumerate(heads)]
    spark = docs.sparkSession
    to = spark.createDataFrame(moves, "_chunk int, _head long, _to int")
    d = d.join(F.broadcast(to), d["chunk"] == to["_chunk"], "left")
    copy = F.struct(F.col("_to").alias("chunk"), F.lit(True).alias("extra"))
    here = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("extra"))
    d = d.select("doc_id", "text", F.inline(F.when(F.col("doc_id").eqNullSafe(F.col("_head")), F.array(here, copy)).otherwise(F.array(here))))
    runs = sorted_runs(d.select("chunk", "extra", "doc_id", "text"), n, "chunk", "extra", F.desc_nulls_last("doc_id"), F.desc("text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size, over = [], [], 0, None

        def done(k: int):
            """The first ``k`` held rows, each followed by the next."""
            return fn(ids[:k], texts[:k], texts[1:k + 1])

        for b in batches:
            for c, extra, i, t in zip(b["chunk"], b["extra"], b["doc_id"], b["text"]):
                if over == c:
                    continue  # further copies of what follows the chunk
                ids.append(i)
                texts.append(t)
                size += len(t)
                if extra:
                    over = c
                    yield done(len(ids) - 1)
                    ids, texts, size = [], [], 0
                elif size > 30 * BATCH_PARTS and len(ids) > 1:
                    yield done(len(ids) - 1)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)

    return runs.mapInPandas(work, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    def rows(ids, texts, following):
        edits = [edited(t, f) for t, f in zip(texts, following)]
        out = compare(texts, following, edits)
        out.insert(0, "doc_id", pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"))
        out.insert(1, "n_chars", [len(t) for t in texts])
        out.insert(2, "edited_sha256", [hashlib.sha256(e.encode()).hexdigest() for e in edits])
        return out
    return with_next(docs, rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double")
