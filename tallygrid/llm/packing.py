"""Vector best-fit packing of token pieces into sequences.

A piece asks for a vector of capacities: its tokens, one document slot, and
its attention cost (tokens squared). The vector follows from the length alone,
so the decision needs no more than the number of pieces of each length - at
most ``max_tokens`` counts, whatever the corpus. ``plan`` places lengths in
falling order; among the open bins that fit under every constraint it takes
the best by the weighted dot product of demand and residual, or by the norm of
the residual that would be left. Bins in the same state are handled together.
Spark then numbers the pieces of each length and gives number ``k`` the ``k``-th
place of its length.

Defined cases: null text is empty (one piece, the end id alone); null
``doc_id`` is kept as null; an empty table gives no rows; repeated rows are
packed as often as they come; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import stored, with_text
from .tokens import encoder, with_end

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ord long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, max_tokens: int) -> DataFrame:
    """Every whole text as pieces of at most ``max_tokens`` ids; ``ord`` counts the pieces of a length within the task ``part``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, np.int64)
        for b in batches:
            row = 0
            for counts, ids in enc.encode_column(b.column("text")):
                bounds, ids = with_end(counts, ids, end_id)
                ids = ids.astype("<u4")
                many = -(-np.diff(bounds) // max_tokens)
                doc = np.repeat(np.arange(len(many)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * max_tokens
                at = bounds[doc] + start
                length = np.minimum(bounds[doc + 1] - at, max_tokens)
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * i:4 * k]) for i, k in zip(at.tolist(), (at + length).tolist())]
                order, of = np.argsort(length, kind="stable"), np.bincount(length, minlength=max_tokens + 1)
                number = np.empty(len(doc), np.int64)
                number[order] = np.arange(len(doc)) - np.repeat(np.cumsum(of) - of - seen, of)
                seen += of
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row + doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                     pa.array(np.full(len(doc), part), pa.int32()), pa.array(number)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "ord"])
                row += len(counts)
    return with_text(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(cut, PIECE)


def plan(counts: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, weights: tuple[float, float, float],
         rule: str) -> list[tuple[int, int, int, int, int, int]]:
    """Places (length, first number, end number, first bin, pieces a bin, offset).

    Number ``k`` of a length goes to bin ``first bin + (k - first number) // pieces a bin``
    at ``offset + (k - first number) % pieces a bin * length``. ``weights`` belong to
    (tokens, documents, cost), each taken as a share of its capacity.
    """
    cap, w = np.array([max_tokens, max_docs, max_cost], np.int64), np.array(weights)
    residual, first, many = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)  # open bins, by ranges
    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        need, left, at = np.array([length, 1, length * length]), counts[length], 0
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits in no bin")
        fit = (residual // need).min(1)
        after = (residual - need) / cap
        # "norm": least residual norm afterwards; "dot": residual that exceeds the demand least along its direction.
        score = (w * after ** 2).sum(1) if rule == "norm" else (w * (need / cap) * (residual / cap)).sum(1)
        order = np.lexsort((first, score))
        changed, new = set(), []
        for i in [*order[fit[order] > 0].tolist(), -1]:
            if not left:
                break
            if i < 0:  # no open bin is left that fits
                k = int((cap // need).min())
                r, a, n = cap, bins, -(-left // k)
                bins += n
            else:
                k, r, a, n = int(fit[i]), residual[i], int(first[i]), int(many[i])
                changed.add(i)
            full, rest = (n, 0) if left >= n * k else divmod(left, k)
            offset = max_tokens - int(r[0])
            for start, size, each in ((a, full, k), (a + full, 1, rest)):
                if size and each:
                    out.append((length, at, at + size * each, start, each, offset))
                    new.append((r - each * need, start, size))
                    at, left = at + size * each, left - size * each
            used = full + (rest > 0)
            if used < n:
                new.append((r, a + used, n - used))
        keep = np.array([i not in changed for i in range(len(first))], bool)
        new = [x for x in new if x[0].min() > 0]
        residual = np.concatenate([residual[keep], np.array([x[0] for x in new], np.int64).reshape(-1, 3)])
        first = np.concatenate([first[keep], np.array([x[1] for x in new], np.int64)])
        many = np.concatenate([many[keep], np.array([x[2] for x in new], np.int64)])
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, max_tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None,
         weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Among the bins that fit, ``weights`` of tokens, documents and attention cost
    decide; they change which pieces meet, not whether a new bin is opened.
    ``max_docs`` and ``max_cost`` default to values that any ``max_tokens``
    tokens meet. The driver sees the count of each length and the places made
    of them, bounded by ``max_tokens``; the pieces stay in Spark.
    """
    max_docs, max_cost = max_docs or max_tokens, max_cost or max_tokens ** 2
    p = stored(pieces(docs, vocabulary, end_id, max_tokens), "pieces")
    by_part = p.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(counts, max_tokens, max_docs, max_cost, weights, rule)
    table = np.array(places, np.int64).reshape(-1, 6)
    key = table[:, 0] << 40 | table[:, 1]
    order = np.argsort(key)
    key, table = key[order], table[order]
    before = by_part.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            number = (b["before"] + b["ord"]).to_numpy()
            t = table[np.searchsorted(key, b["length"].to_numpy() << 40 | number, "right") - 1]
            k = number - t[:, 1]
            b["sequence_id"], b["offset"] = t[:, 3] + k // t[:, 4], t[:, 5] + k % t[:, 4] * t[:, 0]
            yield b[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return p.join(before, ["length", "part"]).mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
