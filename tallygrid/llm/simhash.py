"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text has a 64-bit fingerprint: a bit is set if it is set in over half the
hashes of its word shingles. Equal fingerprints are merged first. The bits are
then grouped into parts, correlated bits together, and part ``i`` gets a
threshold ``t_i >= -1`` with ``sum(t_i) = distance - parts + 1``: two
fingerprints within ``distance`` differ in at most ``t_i`` bits of some part
``i``. A dynamic programme over the parts takes the thresholds (and the best
number of parts) with the least estimated cost, from the spread of a bounded
sample of fingerprints; -1 leaves a part out. The choice changes the work only:
any of them finds every link.

Probes are the values within ``t_i`` bits in part ``i``; they meet the
fingerprints that have such a value, and each meeting is verified by the full
distance. Large buckets are cut into blocks that meet pairwise, and of a
bucket's links only a spanning forest leaves the task, so a bucket of many
near copies emits a row for each, not each pair. Where sets are compared
afterwards, a cell's rows are sorted by the size of their sets, and rows whose
sizes alone rule the similarity out do not meet.

Defined cases: null text is empty; texts without words have fingerprint 0 and
are linked like any other; a null ``doc_id`` is never the smallest unless all
are null; repeated rows are in one class; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import components, stored, with_text

SEED = 42
BITS = 64
SAMPLE = 20_000  # fingerprints from which costs are estimated
BLOCK = 4096  # fingerprints of one bucket that meet in one task at a time
SIZED = 4  # times as many where sizes let only some of a block's rows meet
TILE = 1 << 17  # fingerprints compared at a time
MEET_COST, PROBE_COST = 1.0, 4000.0  # of comparing two fingerprints, of dealing one row (about 9 us as measured; a comparison is put at 2 ns)
U = np.uint64
_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle of the text in lower case (A-Z only), repeats included."""
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, U)
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], U)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:z], SEED) for a, z in zip(starts.tolist(), ends[words - 1:].tolist())), U, len(starts))


def fingerprint(text: str, words: int) -> int:
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    if not len(h):
        return 0
    lanes = h.view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(lanes[:, j], minlength=256) for j in range(8)]) @ _TABLE
    return int.from_bytes(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, fp); fp is signed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"]], U).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})
    return with_text(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInPandas(run, "doc_id long, fp long")


def bit_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits grouped by correlation into parts of nearly equal width. ``bits``: sample x 64 of 0 and 1."""
    x = bits - bits.mean(0)
    sd = np.maximum(x.std(0), 1e-9)
    corr = np.abs(x.T @ x / max(len(x), 1) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for i in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - i)
        free = sorted(left)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        left.discard(part[0])
        while len(part) < width:
            free = sorted(left)
            part.append(free[int(corr[np.ix_(free, part)].sum(1).argmax())])
            left.discard(part[-1])
        out.append(sorted(part))
    return out


def near_shares(bits: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs within 0, 1, .. ``most`` bits in the part."""
    p = bits[:, part].mean(0)
    q = np.array([1.0])
    for d in 2 * p * (1 - p):  # as if bits were independent
        q = np.convolve(q, [1 - d, d])
    free = np.cumsum(q)[:most + 1]
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, len(bits), (2, 100_000))
    part_bits = np.ascontiguousarray(bits[:, part]).astype(np.uint8)
    seen = (part_bits[a] != part_bits[b]).sum(1)[a != b]
    return np.maximum(free, [(seen <= t).mean() if len(seen) else 0 for t in range(most + 1)])


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1) that add up to ``total`` at least cost. ``costs[i][t + 1]`` is part ``i``'s cost at ``t``."""
    best = {0: (0.0, [])}
    for row in costs:
        nxt = {}
        for s, (c, ts) in best.items():
            for t, extra in enumerate(row, -1):
                if s + t not in nxt or c + extra < nxt[s + t][0]:
                    nxt[s + t] = (c + extra, [*ts, t])
        best = nxt
    return best[total]


def plan(sample: np.ndarray, n: int, distance: int, meeting: float = 1.0, block: int = BLOCK) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that are probed, for ``n`` fingerprints. ``meeting``: share of the pairs of a cell that are compared."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    found = None
    for parts in range(1, distance + 2):
        most = min(distance, 3)
        if distance - parts + 1 > most * parts:
            continue
        groups = bit_parts(bits, parts)
        costs = []
        for g in groups:
            share = near_shares(bits, g, most)
            row, probes = [0.0], 0.0
            for t in range(most + 1):
                probes += float(np.prod([(len(g) - k) / (k + 1) for k in range(t)])) if t else 1.0
                # A row goes to each block that its own block meets.
                index, asked = max(1.0, n * share[0] * probes / block), (probes if t else 0) * max(1.0, n * share[0] / block)
                row.append(n * (index + asked) * PROBE_COST + n * n * share[t] / 2 * (2 if t else 1) * meeting * MEET_COST)
            costs.append(row)
        cost, ts = allocate(costs, distance - parts + 1)
        if found is None or cost < found[0]:
            found = (cost, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return found[1]


def masks(part: list[int], t: int) -> list[int]:
    """Signed xor masks of up to ``t`` bits of the part."""
    out = [0]
    for r in range(1, t + 1):
        out += [sum(1 << b for b in c) for c in combinations(part, r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the links (a[i], b[i]) that join what was not joined yet."""
    root: dict[int, int] = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append(i)
    return out


def meet(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (left, right) within ``distance`` and not equal, nearest pairs first."""
    def thin(a, b):
        order = np.argsort(np.bitwise_count(a ^ b), kind="stable")
        keep = order[forest(a[order], b[order])]
        return a[keep], b[keep]

    found_a, found_b = [], []
    for at in range(0, len(left), 256):
        x = left[at:at + 256, None] ^ right[None, :]
        i, j = np.nonzero((np.bitwise_count(x) <= distance) & (x != 0))
        found_a.append(left[at + i])
        found_b.append(right[j])
        if sum(map(len, found_a)) > 1 << 20:  # keep what is held small
            a, b = thin(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [a], [b]
    return thin(np.concatenate(found_a), np.concatenate(found_b))


def meeting_share(sizes: np.ndarray, similarity: float) -> float:
    """Share of pairs of a sample whose sizes allow the similarity."""
    x = np.sort(sizes)
    return float((np.searchsorted(x, x / similarity, "right") - np.arange(len(x))).sum() * 2 / max(len(x) ** 2, 1)) if similarity > 0 else 1.0


def cells(fps: DataFrame, distance: int, unit: str = "fp", similarity: float | None = None) -> tuple[DataFrame | None, list[tuple[list[int], int]]]:
    """Rows (unit, fp, part, value, side, own, i, j): fingerprints dealt to cells so that all within ``distance`` meet in one; None if there are none. And the parts.

    ``unit`` names the column that tells rows apart. With a ``similarity`` rows
    have the ``size`` of their set as well.

    A cell (part, value, i, j) is a block of a bucket's probes beside a block of its
    index (``side`` 1 and 0), or two blocks of an unprobed bucket (``side`` 2).
    Only the buckets of more than one block are looked up, and those are fewer
    than the rows by the size of a block.
    """
    n = fps.count()
    share = min(1.0, SAMPLE / max(n, 1))
    block, more = (BLOCK, []) if similarity is None else (SIZED * BLOCK, ["size"])
    names = list(dict.fromkeys([unit, "fp", *more]))
    seen = fps.select("fp", *more).where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).collect()
    sample = np.array([r["fp"] for r in seen], np.int64)
    meeting = 1.0 if similarity is None else meeting_share(np.array([r["size"] for r in seen], np.int64), similarity)
    parts = plan(sample.view(U), n, distance, meeting, block) if n else []
    rows = []
    for k, (bits, t) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        value = F.col("fp").bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))

        def row(value: Column, side: int) -> Column:
            return F.struct(F.lit(k).alias("part"), value.alias("value"), F.lit(side).alias("side"))  # all named alike: an array holds one type

        rows.append(row(value, 0 if t else 2))
        if t:
            rows += [row(value.bitwiseXOR(F.lit(m).cast("long")), 1) for m in masks(bits, t)]
    if not rows:
        return None, parts
    keys = ["part", "value"]
    sig = fps.select(*names, F.inline(F.array(*rows)))
    probe = F.col("side") == 1
    full = sig.groupBy(*keys).agg(F.count_if(~probe).alias("n"), F.count_if(probe).alias("p")).where((F.col("n") > block) | (F.col("p") > block))
    full = full.select(F.col("part").alias("_part"), F.col("value").alias("_value"), *[F.ceil(F.greatest(c, F.lit(1)) / block).cast("int").alias(f"{c}b") for c in "np"])
    j = sig.join(F.broadcast(full), (F.col("part") == F.col("_part")) & (F.col("value") == F.col("_value")), "left")
    nb, pb = F.coalesce("nb", F.lit(1)), F.coalesce("pb", F.lit(1))
    own = F.pmod(F.xxhash64(unit), F.when(probe, pb).otherwise(nb)).cast("int")
    # A probe block meets every index block; where nothing is probed, index blocks meet each other once.
    others = F.when(F.col("side") == 0, pb).otherwise(nb)
    blocks = F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.when(probe, F.struct(own.alias("i"), o.alias("j"))).when(
        F.col("side") == 0, F.struct(o.alias("i"), own.alias("j"))).otherwise(F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"))))
    # In an unprobed bucket a fingerprint says which of the two blocks it is of.
    return j.select(*names, *keys, "side", own.alias("own"), F.inline(blocks)), parts


CELL = ["part", "value", "i", "j"]


def by_cell(dealt: DataFrame, close: Callable[[tuple, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, by: list[str] = CELL) -> DataFrame:
    """``close`` of each cell of more than one row, whole cells at a time."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def whole():
            if sum(map(len, held)) > 1:
                yield from close(key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])

        for batch in batches:
            for k, d in batch.groupby(by, sort=False):
                if k != key:
                    yield from whole()
                    held = []
                key = k
                held.append(d)
        yield from whole()

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInPandas(compare, schema)


def sides(key: tuple, d: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the rows of a cell that meet each other."""
    side, own = d["side"].to_numpy(), d["own"].to_numpy()
    return (own == key[2], own == key[3]) if side[0] == 2 else (side == 1, side == 0)


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Rows (a, b) of distinct fingerprints that connect all that lie within ``distance``. ``fps``: distinct fp."""
    dealt, _ = cells(fps, distance)
    if dealt is None:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)

    def close(key: tuple, d: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp = d["fp"].to_numpy().view(U)
        x, y = sides(key, d)
        if x.any() and y.any():
            a, b = meet(fp[x], fp[y], distance)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return by_cell(dealt, close, "a long, b long")


class Trees:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def own_pairs(x: np.ndarray, part: int, parts: list[tuple[list[int], int]]) -> np.ndarray:
    """Which of the differences belong to a cell of ``part``: those that no part before it lets meet."""
    out = np.ones(len(x), bool)
    for bits, t in parts[:part]:
        out &= np.bitwise_count(x & U(sum(1 << b for b in bits))) > t
    return out


def near_in_cell(key: tuple, d: pd.DataFrame, distance: int, similarity: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of a cell that meet, lie within ``distance`` and, with a ``similarity``, have sizes that allow it; a tile of comparisons at a time."""
    fp = d["fp"].to_numpy().view(U)
    left, right = map(np.flatnonzero, sides(key, d))
    # Two blocks of one bucket, and probes and index, are two lists; a block by itself meets the rows after each.
    alone = d["side"].iloc[0] == 2 and key[2] == key[3]
    if similarity is not None:
        size = d["size"].to_numpy()
        left, right = (x[np.argsort(size[x], kind="stable")] for x in (left, right))
        low, high = np.searchsorted(size[right], similarity * size[left] * (1 - 1e-9)), np.searchsorted(size[right], size[left] / max(similarity, 1e-300) * (1 + 1e-9), "right")
    at = 0
    while at < len(left):
        first, last = (0, len(right)) if similarity is None else (low[at], high[at])
        if alone:
            first = max(first, at)
        end = min(len(left), at + max(8, TILE // max(last - first, 1)))
        if similarity is not None:  # later rows look further
            while end > at + 8 and (end - at) * (high[end - 1] - first) > 2 * TILE:
                end = (at + end) // 2
            last = high[end - 1]
        l, r = left[at:end], right[first:last]
        i, j = np.nonzero(np.bitwise_count(fp[l, None] ^ fp[None, r]) <= distance)
        if alone:
            later = first + j > at + i
            i, j = i[later], j[later]
        i, j = l[i], r[j]
        if similarity is not None:  # as exact as the test of the sets: neither can round past the other
            fits = np.minimum(size[i], size[j]) / np.maximum(np.maximum(size[i], size[j]), 1) >= similarity
            i, j = i[fits], j[fits]
        yield i, j
        at = end


def near_pairs(fps: DataFrame, distance: int, unit: str, similarity: float | None = None) -> tuple[DataFrame, list[tuple[list[int], int]]]:
    """Rows (a, b, a_fp, b_fp, part, value, i, j, tree) of units whose fingerprints lie within ``distance``, and the parts they met by.

    Each pair belongs to one cell, and a cell gives a spanning forest of its
    pairs, nearest first: at most a row for each member. ``tree`` is null where
    the forest holds all pairs of its tree; elsewhere pairs are left to
    ``open_members``. With a ``similarity``, which asks for a column ``size``
    (of a unit's set), pairs whose sizes rule it out are not meant.
    """
    dealt, parts = cells(fps, distance, unit, similarity)
    schema = "a long, b long, a_fp long, b_fp long, part int, value long, i int, j int, tree int"
    if dealt is None:
        return fps.sparkSession.createDataFrame([], schema), parts

    def close(key: tuple, d: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, name = d["fp"].to_numpy().view(U), d[unit].to_numpy()
        # Probes and index see a pair from both of its ends.
        twice = d["side"].iloc[0] != 2
        held, left_out, rank = [], set(), None

        def thin():
            a, b, far = (np.concatenate(x) for x in zip(*held))
            trees, keep = Trees(len(rank)), []
            order = np.argsort(far, kind="stable")
            for k, x, y in zip(order.tolist(), rank[a[order]].tolist(), rank[b[order]].tolist()):
                if trees.join(x, y):
                    keep.append(k)
                else:
                    left_out.add(x)
            held[:] = [(a[keep], b[keep], far[keep])]
            return trees

        for i, j in near_in_cell(key, d, distance, similarity):
            if not len(i):
                continue
            if rank is None:
                rank = np.unique(name, return_inverse=True)[1]
            x = fp[i] ^ fp[j]
            mine = own_pairs(x, key[0], parts) & (rank[i] < rank[j] if twice else rank[i] != rank[j])
            i, j = i[mine], j[mine]
            held.append((i, j, np.bitwise_count(x[mine])))
            if sum(len(h[0]) for h in held) > 1 << 20:  # keep what is held small
                thin()
        if held and any(len(h[0]) for h in held):
            trees = thin()
            a, b, _ = held[0]
            dense = {trees.find(x) for x in left_out}
            tree = [t if t in dense else None for t in map(trees.find, rank[a].tolist())]
            out = pd.DataFrame({"a": name[a], "b": name[b], "a_fp": fp[a].view(np.int64), "b_fp": fp[b].view(np.int64)})
            for column, v in zip(CELL, key):
                out[column] = v
            out["tree"] = pd.array(tree, "Int32")
            yield out

    return stored(by_cell(dealt, close, schema), "near"), parts


TREE = ["table", *CELL, "tree"]
SET_BYTES = 32 << 20  # of shingle sets in one block of a tree; a task holds two blocks


def open_members(members: DataFrame, parts: list, distance: int) -> DataFrame:
    """Those rows (table, part, value, i, j, tree, unit, fp, label) that lie within ``distance`` of another label in their tree."""
    def close(key: tuple, d: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, label = d["fp"].to_numpy().view(U), np.unique(d["label"].to_numpy(), return_inverse=True)[1]
        hit = np.zeros(len(d), bool)
        for at in range(0, len(d), 256):
            x = fp[at:at + 256, None] ^ fp[None, :]
            i, j = np.nonzero((np.bitwise_count(x) <= distance) & (label[at:at + 256, None] != label[None, :]))
            mine = own_pairs(x[i, j], key[1], parts[key[0]])
            hit[at + i[mine]] = True
            hit[j[mine]] = True
        if hit.any():
            yield d[hit]

    labels = members.groupBy(*TREE).agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select(*TREE)
    return by_cell(members.join(labels, TREE, "left_semi"), close, members.schema.simpleString()[7:-1].replace(":", " "), TREE)


def alike_links(members: DataFrame, sets: DataFrame, parts: list, distance: int, similarity: float) -> DataFrame:
    """Rows (x, y): a spanning forest, in each tree, of the links between labels that the exact similarity of shingle sets bears out.

    Sets travel to their trees, in blocks of bounded size of which each two meet
    once, and pairs are compared where they meet: what leaves a task is at most
    one link for each label.
    """
    size = sets.select("unit", F.octet_length("set").cast("long").alias("size"))
    seen = F.sum("size").over(W.partitionBy(*TREE).orderBy("unit").rowsBetween(W.unboundedPreceding, 0))
    m = members.join(size, "unit").withColumn("own", F.floor(seen / SET_BYTES).cast("int"))
    m = m.withColumn("last", F.max("own").over(W.partitionBy(*TREE)))
    meets = F.transform(F.sequence(F.lit(0), "last"), lambda o: F.struct(F.least("own", o).alias("bi"), F.greatest("own", o).alias("bj")))
    m = m.select(*TREE, "unit", "fp", "label", "own", F.inline(meets))

    def close(key: tuple, d: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, label, own = d["fp"].to_numpy().view(U), np.unique(d["label"].to_numpy(), return_inverse=True)[1], d["own"].to_numpy()
        unit, held = d["unit"].to_numpy(), d["set"].to_numpy(object)
        left, right = np.flatnonzero(own == key[-2]), np.flatnonzero(own == key[-1])
        trees, out = Trees(len(d)), []
        for at in range(0, len(left), 256):
            l = left[at:at + 256]
            x = fp[l, None] ^ fp[None, right]
            i, j = np.nonzero((np.bitwise_count(x) <= distance) & (label[l, None] != label[None, right]) & ((l[:, None] < right[None, :]) | (key[-2] != key[-1])))
            mine = own_pairs(x[i, j], key[1], parts[key[0]])
            i, j = i[mine], j[mine]
            near = np.argsort(np.bitwise_count(x[i, j]), kind="stable")
            for a, b in zip(l[i[near]].tolist(), right[j[near]].tolist()):
                if trees.find(label[a]) != trees.find(label[b]) and resemblance(held[a], held[b]) >= similarity:
                    trees.join(label[a], label[b])
                    out.append((unit[a], unit[b]))
        if out:
            yield pd.DataFrame(out, columns=["x", "y"])

    return by_cell(m.join(sets, "unit"), close, "x long, y long", [*TREE, "bi", "bj"])


def classes(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    d = stored(fingerprints(docs, words), "fingerprints")
    fps = stored(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(fps.select("fp"), distance), "a", "b")
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return d.join(named, d["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def shingle_set(texts: pd.Series, words: int) -> pd.Series:
    """Sorted distinct shingle hashes of each text, as bytes."""
    return pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in texts])


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets; 1 for two empty ones."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


TABLES = 3


def rehashed(h: np.ndarray, table: int) -> np.ndarray:
    """Hashes as if of another seed; table 0 has them as they are."""
    if not table:
        return h
    x = (h ^ U(table * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> U(31))) * U(0x94D049BB133111EB)


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 10, similarity: float = 0.8) -> DataFrame:
    """``docs`` less all but one document of each group of near copies: the one of the smallest doc_id stays.

    Texts of one shingle set are one unit. A unit has ``TABLES`` fingerprints of
    differently seeded hashes, since one of 64 bits alone strays too far at this
    similarity; they are of the distinct shingles, as the similarity is.
    Candidates are the pairs of units within ``distance`` in some table whose
    numbers of shingles allow the similarity; a link holds if the exact Jaccard
    similarity of the two sets is at least ``similarity``. No candidate is passed over: a first round verifies the
    forests that cells give; where a forest left pairs out and verified links
    have not made its tree one group, the members that still lie near another
    group get their sets sent to the tree and are compared there. Equal texts are
    always one group. Rows equal in id and text leave one row.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    names = [f"fp{t}" for t in range(TABLES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x, words)) for x in b["text"]]
            fps = np.array([[majority(rehashed(h, t)) for t in range(TABLES)] for h in sets], U).view(np.int64).reshape(-1, TABLES)
            same = pd.Series([hashlib.md5(h.tobytes()).hexdigest() for h in sets], index=b.index, dtype=object)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "digest": b["digest"], "same": same, "size": [len(h) for h in sets], **{n: fps[:, t] for t, n in enumerate(names)}})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = stored(rows.mapInPandas(run, "doc_id long, digest string, same string, size long, " + ", ".join(f"{n} long" for n in names)), "fingerprints")
    of_set = [*names, "size"]
    texts = stored(d.groupBy("digest").agg(F.min("same").alias("same"), *[F.min(n).alias(n) for n in of_set], F.min("doc_id").alias("first")), "texts")
    units = texts.groupBy("same").agg(F.min("digest").alias("digest"), *[F.min(n).alias(n) for n in of_set])
    units = stored(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    # One text of each digest; copies of a text fall away before they are shuffled.
    once = rows.groupBy("digest").agg(F.first("text").alias("text"))
    as_set = F.pandas_udf(lambda t: shingle_set(t, words), "binary")
    alike = F.pandas_udf(lambda p, q: pd.Series([resemblance(i, j) for i, j in zip(p, q)]), "double")

    def sets_of(asked: DataFrame) -> DataFrame:
        wanted = units.join(asked.distinct(), "unit").select("unit", "digest")
        return stored(once.join(wanted, "digest").select("unit", as_set("text").alias("set")), "sets")

    near = [near_pairs(units.select("unit", F.col(n).alias("fp"), "size"), distance, "unit", similarity) for n in names]
    parts = [p for _, p in near]
    pairs = reduce(DataFrame.unionByName, [f.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")) for f, _ in near])
    pairs = stored(pairs.distinct(), "candidates")
    sets = sets_of(pairs.select(F.col("x").alias("unit")).union(pairs.select("y")))
    left, right = (sets.select(F.col("unit").alias(k), F.col("set").alias(f"set_{k}")) for k in "xy")
    good = stored(pairs.join(left, "x").join(right, "y").where(alike("set_x", "set_y") >= similarity).select("x", "y"), "alike")
    roots = components(good, "x", "y")

    ends = [f.where("tree IS NOT NULL").select(F.lit(t).alias("table"), *CELL, "tree", F.col(e).alias("unit"), F.col(f"{e}_fp").alias("fp")) for t, (f, _) in enumerate(near) for e in "ab"]
    dense = reduce(DataFrame.unionByName, ends).distinct()
    named = dense.join(roots, dense["unit"] == roots["node"], "left").select(*dense.columns, F.coalesce("root", "unit").alias("label"))
    left_open = stored(open_members(stored(named, "named"), parts, distance), "open")
    if not left_open.isEmpty():
        more = alike_links(left_open, sets_of(left_open.select("unit")), parts, distance, similarity)
        roots = components(good.unionByName(stored(more, "alike")), "x", "y")
    rooted = units.select("same", "unit").join(roots, F.col("unit") == F.col("node"), "left").select("same", F.coalesce("root", "unit").alias("root"))
    rooted = texts.join(rooted, "same").select("digest", "first", "root")
    order = F.struct(F.col("first").isNull().alias("missing"), "first", "digest")
    stay = rooted.groupBy("root").agg(F.min(order).alias("s")).select(F.col("s.digest").alias("stays"), F.col("s.first").alias("first"))
    carried = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), digest.alias("digest"), F.col("doc_id").cast("long").alias("id"))
    kept = carried.join(stay, (F.col("digest") == F.col("stays")) & F.col("id").eqNullSafe(F.col("first")))
    if d.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():  # rows equal in id and text
        kept = kept.dropDuplicates(["stays"])
    return kept.select("row.*")
