"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are integers. The index of a block of vectors holds its postings as
planes of falling quantised impact: plane 0 has the components of the largest
magnitudes, the last plane the smallest. A block of queries is scored plane by
plane. After each plane a candidate's score is known up to what is left, which
by Cauchy-Schwarz is at most the norm of the query times the norm of the
candidate's components still to come. Planes are processed until no candidate
outside a query's current best k can still enter (its upper bound is below the
k-th lower bound, or equal and later in order), or all planes are done; the
candidates that may be members are then rescored exactly in integers.

Blocks have a fixed number of vectors. Every query block meets every candidate
block once (the query set is stated; this is that join, in blocks), each
meeting gives at most k rows per query, and a rank by query keeps k of them.

Defined cases: vectors that are null or hold null or non-finite components take
no part, as query or candidate; a null id takes no part; vectors of unequal
length meet as if filled up with zeros; repeated ids are different rows, a query
skips every candidate of its own id; a table of fewer candidates gives fewer rows.
Components of 2**53 or more lose digits, and a score is cut to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import partitions, stored

BLOCK = 4096
QUERY_BLOCK = 512
PLANES = 3
OUT = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, vec_id: str, vector: str, scale: float = 64.0) -> DataFrame:
    """Rows (vec_id, v): floor(scale * x) of each component; rows with anything missing or not finite are left out."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    whole = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.col(vec_id).isNotNull() & whole).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def blocks(vectors: DataFrame, rows: int, width: int) -> DataFrame:
    """Rows (ids, values): packed int64 ids and float64 components of up to ``rows`` vectors."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, values = [], []

        def close():
            m = np.zeros((len(ids), width))
            for i, v in enumerate(values):
                m[i, :len(v)] = v
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            return pd.DataFrame({"ids": [np.array(ids, np.int64)[order].tobytes()], "values": [m[order].tobytes()]})

        for b in batches:
            for i, v in zip(b["vec_id"], b["v"]):
                ids.append(i)
                values.append(v)
                if len(ids) == rows:
                    yield close()
                    ids, values = [], []
        if ids:
            yield close()

    return vectors.mapInPandas(pack, "ids binary, values binary")


def planes_of(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Planes of falling impact, each with only its postings, and the norms left after each plane."""
    top = max(float(np.abs(x).max(initial=0.0)), 1.0)
    cuts = [top / 2 ** k for k in range(1, PLANES)]
    edges = [np.inf, *cuts, -1.0]
    size = np.abs(x)
    planes, left, rest = [], [], x.copy()
    for hi, lo in zip(edges, edges[1:]):
        p = np.where((size <= hi) & (size > lo), x, 0.0)
        rest = rest - p
        planes.append(p)
        left.append(np.sqrt((rest ** 2).sum(1)))
    return planes, np.array(left)


def _integers(x: np.ndarray, whole: type) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], whole).reshape(x.shape)


def best(queries: np.ndarray, query_ids: np.ndarray, planes: list[np.ndarray], left: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (its row repeated, ids, exact scores) of the members of this block's best ``k``. ``ids`` ascend."""
    out = []
    norm = np.sqrt((queries ** 2).sum(1)) * (1 + 1e-12)
    score = np.zeros((len(queries), len(ids)))
    full = np.sum(planes, 0)
    largest = float(np.abs(full).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(full.shape[1], 1)
    whole = np.int64 if largest < 2 ** 62 else object  # Python's own integers where 64 bits could overflow
    left = left + (0.0 if largest < 2 ** 52 else 1e-12 * np.sqrt((full ** 2).sum(1)))  # sums of doubles are exact below
    own = query_ids[:, None] == ids[None, :]
    open_rows = np.arange(len(queries))
    for n, plane in enumerate(planes):
        score[open_rows] += queries[open_rows] @ plane.T
        still = []
        for q in open_rows:
            s = np.where(own[q], -np.inf, score[q])
            slack = norm[q] * left[n]
            low = s - slack
            kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            member = np.flatnonzero((s + slack >= kth) & ~own[q])
            # Proof: whatever is left cannot lift another candidate in. More planes only help while many are open.
            if n == len(planes) - 1 or len(member) <= 4 * k:
                exact = np.array([min(max(int(s), -2 ** 63), 2 ** 63 - 1) for s in _integers(full[member], whole) @ _integers(queries[q], whole)], np.int64) if (
                    whole is object) else full[member].astype(np.int64) @ queries[q].astype(np.int64)
                order = np.lexsort((ids[member], ~exact))[:k]
                out.append((np.full(len(order), query_ids[q]), ids[member][order], exact[order]))
            else:
                still.append(q)
        open_rows = np.array(still, np.int64)
        if not len(open_rows):
            break
    return out


def search(table: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` highest scores of each query among all other rows, ties to the smaller id."""
    v = stored(integer_vectors(table, vec_id, vector, scale), "vectors")
    width = v.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    groups = partitions(table)
    # Candidate blocks are dealt to as many groups as there are partitions; every query block goes to every group.
    index = stored(blocks(v.repartition(max(1, -(-v.count() // BLOCK))), BLOCK, width), "index").select("ids", "values", F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("g"))
    asked = (blocks(v.where(is_query).repartition(max(1, -(-v.where(is_query).count() // QUERY_BLOCK))), QUERY_BLOCK, width)
             .select(F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, made = None, None
        for b in batches:
            for raw, values, q_raw, q_values in zip(b["ids"], b["values"], b["q_ids"], b["q_values"]):
                ids, q_ids = np.frombuffer(raw, np.int64), np.frombuffer(q_raw, np.int64)
                if raw != held:
                    held, made = raw, planes_of(np.frombuffer(values).reshape(len(ids), width))
                got = best(np.frombuffer(q_values).reshape(len(q_ids), width), q_ids, *made, ids, k)
                if got:
                    q, i, s = (np.concatenate(x) for x in zip(*got))
                    yield pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    met = index.join(asked, "g").select("ids", "values", "q_ids", "q_values").mapInPandas(meet, OUT)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
