"""Exact neighbourhoods: kNN imputation, local outlier factor, DBSCAN.

Space is cut into leaves of about equal mass by a k-d tree. Its top comes from
a sample of fixed size and goes to every task; leaves that are still too full
are split again, round by round, by small trees that Spark grows from a sample
of each leaf and that stay a table, joined by leaf. The points are shuffled by
leaf. A point visits every leaf its search radius reaches, so results do not
depend on the cuts. Equal points are merged into one with a
weight before, because copies are the one thing no cut can separate. Inside a
leaf numpy compares visitors with owners in blocks; only neighbours leave it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.kinds import as_double, quoted
from ..functions.ordering import dense_codes
from ..session import cut_lineage
from .fuzzy import components

LEAF_POINTS = 4000
NEAREST_LEAF_POINTS = 1000  # a few neighbours lie close by: smaller leaves save comparisons and cost few visits
TOP_LEAVES = 1 << 14  # leaves of the part the driver holds
SUB_DEPTH = 6  # levels by which a round splits a leaf
ROUNDS = 8  # 14 + 8 * 6 bits number a leaf
SAMPLE_PER_LEAF = 20
BLOCK = 512
BLOCK_CELLS = 1 << 20  # distances a task holds at a time, however many points visit a leaf
POINT = "array<double>"


@dataclass
class Tree:
    """Complete binary tree in heap order: node i splits on ``dim[i]`` at ``cut[i]``.

    ``splits`` has a table (leaf, depth, dim, cut) per later round; a leaf l becomes l * 2^SUB_DEPTH + its place there.
    """
    depth: int
    dim: np.ndarray
    cut: np.ndarray
    splits: list[DataFrame] = field(default_factory=list)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.dim[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def reached(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf a point's radius may touch."""
        rows, out = [], []
        todo = [(0, np.arange(len(x)))]
        first = (1 << self.depth) - 1
        while todo:
            node, idx = todo.pop()
            if len(idx) == 0:
                continue
            if node >= first:
                rows.append(idx)
                out.append(np.full(len(idx), node - first))
                continue
            c = x[idx, self.dim[node]] - self.cut[node]
            todo.append((2 * node + 1, idx[c - radius[idx] < 0]))
            todo.append((2 * node + 2, idx[c + radius[idx] >= 0]))
        return np.concatenate(rows), np.concatenate(out)


def grow(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits in heap order; both sides of a cut hold sample points as long as there are two."""
    size = (1 << depth) - 1
    dim, cut = np.zeros(size, dtype=np.int64), np.zeros(size)
    todo = [(0, sample)] if size else []
    while todo:
        node, s = todo.pop()
        if node >= size:
            continue
        d = int(np.argmax(s.std(axis=0))) if len(s) else 0
        v = np.sort(s[:, d]) if len(s) else np.zeros(1)
        c = float(v[len(v) // 2])
        if c == v[0] and v[-1] > c:  # half the values are the least one
            c = float(v[v > c][0])
        dim[node], cut[node] = d, c
        todo += [(2 * node + 1, s[s[:, d] < c]), (2 * node + 2, s[s[:, d] >= c])]
    return dim, cut


def plant(points: DataFrame, leaf_points: int = LEAF_POINTS, top_leaves: int = TOP_LEAVES) -> Tree:
    """A tree whose leaves hold at most about twice ``leaf_points`` of the distinct points.

    The driver sees a sample bounded by ``top_leaves``, never by the data; what is
    too full beneath is split by Spark, a group of bounded size per leaf.
    """
    n = points.count()
    depth = 0
    while n / (1 << depth) > leaf_points and (1 << depth) < top_leaves:
        depth += 1
    take = SAMPLE_PER_LEAF << depth
    got = points.select("x").orderBy(F.xxhash64("x")).limit(take).collect() if depth else []
    tree = Tree(depth, *grow(np.array([r["x"] for r in got], dtype=float), depth))
    wanted = SAMPLE_PER_LEAF << SUB_DEPTH

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        share = pdf["n"].iloc[0] / leaf_points
        levels = min(SUB_DEPTH, max(1, int(np.ceil(np.log2(share)))))
        dim, cut = grow(_matrix(pdf["x"]), levels)
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "depth": [levels], "dim": [dim.tolist()], "cut": [cut.tolist()]})

    while len(tree.splits) < ROUNDS:
        here = with_leaf(points.select("x"), tree)
        full = cut_lineage(here.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * leaf_points))
        if full.isEmpty():
            break
        # Twice the wanted sample by hash, so that chance leaves enough; the seed changes with the round.
        luck = F.pmod(F.xxhash64("x", F.lit(len(tree.splits))), F.lit(1 << 30)) / float(1 << 30)
        drawn = here.join(full, "leaf").where(luck < 2.0 * wanted / F.col("n"))
        tree.splits.append(cut_lineage(drawn.groupBy("leaf").applyInPandas(split, "leaf long, depth int, dim array<long>, cut array<double>")))
    return tree


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=float).reshape(len(col), -1)


def _by_split(leaf: pd.Series, depth: pd.Series, dim: pd.Series, cut: pd.Series):
    """(rows, tree) per leaf of a batch; without a split the tree has one leaf."""
    for _, at in leaf.groupby(leaf, sort=False).indices.items():
        i = at[0]
        if pd.isna(depth.iloc[i]):
            yield at, Tree(0, np.zeros(0, dtype=np.int64), np.zeros(0))
        else:
            yield at, Tree(int(depth.iloc[i]), np.asarray(dim.iloc[i], dtype=np.int64), np.asarray(cut.iloc[i], dtype=float))


def _lists(n: int, rows: np.ndarray, leaves: np.ndarray) -> list[list[int]]:
    order = np.argsort(rows, kind="stable")
    return [p.tolist() for p in np.split(leaves[order], np.cumsum(np.bincount(rows, minlength=n))[:-1])]


def with_leaf(points: DataFrame, tree: Tree) -> DataFrame:
    top = Tree(tree.depth, tree.dim, tree.cut)  # tables do not travel

    @F.pandas_udf("long")
    def leaf(x: pd.Series) -> pd.Series:
        return pd.Series(top.leaves(_matrix(x)))

    @F.pandas_udf("long")
    def deeper(x: pd.Series, leaf: pd.Series, depth: pd.Series, dim: pd.Series, cut: pd.Series) -> pd.Series:
        out, m = np.zeros(len(x), dtype=np.int64), _matrix(x)
        for at, t in _by_split(leaf, depth, dim, cut):
            out[at] = t.leaves(m[at])
        return pd.Series((leaf.to_numpy(np.int64) << SUB_DEPTH) + out)

    out = points.withColumn("leaf", leaf("x"))
    for s in tree.splits:
        out = out.join(s, "leaf", "left").select(*[quoted(c).alias(c) for c in points.columns], deeper("x", "leaf", "depth", "dim", "cut").alias("leaf"))
    return out


def visiting(queries: DataFrame, tree: Tree) -> DataFrame:
    """Rows of ``queries`` (x, radius, ..) once per leaf they reach."""
    top = Tree(tree.depth, tree.dim, tree.cut)

    @F.pandas_udf("array<long>")
    def reach(x: pd.Series, radius: pd.Series) -> pd.Series:
        return pd.Series(_lists(len(x), *top.reached(_matrix(x), radius.to_numpy(float))))

    @F.pandas_udf("array<long>")
    def deeper(x: pd.Series, radius: pd.Series, leaf: pd.Series, depth: pd.Series, dim: pd.Series, cut: pd.Series) -> pd.Series:
        m, r, whole, rows, leaves = _matrix(x), radius.to_numpy(float), leaf.to_numpy(np.int64), [], []
        for at, t in _by_split(leaf, depth, dim, cut):
            i, to = t.reached(m[at], r[at])
            rows.append(at[i])
            leaves.append((whole[at[i]] << SUB_DEPTH) + to)
        return pd.Series(_lists(len(x), np.concatenate(rows), np.concatenate(leaves)))

    out = queries.withColumn("leaf", F.explode(reach("x", "radius")))
    for s in tree.splits:
        out = out.join(s, "leaf", "left").select(*[quoted(c).alias(c) for c in queries.columns], F.explode(deeper("x", "radius", "leaf", "depth", "dim", "cut")).alias("leaf"))
    return out


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = np.zeros((len(q), len(p)))
    for i in range(p.shape[1]):
        d += (q[:, i, None] - p[None, :, i]) ** 2
    return np.sqrt(d, out=d)


def _blocks(q: np.ndarray, p: np.ndarray):
    step = max(1, min(BLOCK, BLOCK_CELLS // max(1, len(p))))
    for lo in range(0, len(q), step):
        yield lo, _distances(q[lo:lo + step], p)


def _least(d: np.ndarray, m: int) -> np.ndarray:
    """Places of the ``m`` least numbers of each row, ascending."""
    o = np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    return np.take_along_axis(o, np.argsort(np.take_along_axis(d, o, 1), axis=1, kind="stable"), 1)


def _reachable(c: np.ndarray, eps: float) -> np.ndarray:
    """Component of each point under steps of at most ``eps``, numbered by their first points.

    Only points without a component are compared, so a dense crowd leaves at the first look.
    """
    comp, todo, n = np.full(len(c), -1), np.ones(len(c), bool), 0
    while todo.any():
        front = np.array([int(np.argmax(todo))])
        comp[front], todo[front] = n, False
        while len(front):
            found = []
            for lo in range(0, len(front), 64):
                rest = np.flatnonzero(todo)
                for at in range(0, len(rest), BLOCK_CELLS // 64):
                    part = rest[at:at + BLOCK_CELLS // 64]
                    hit = part[(_distances(c[front[lo:lo + 64]], c[part]) <= eps).any(axis=0)]
                    comp[hit], todo[hit] = n, False
                    found.append(hit)
                if not len(rest):
                    break
            front = np.concatenate(found) if found else front[:0]
        n += 1
    return comp


def standardised(df: DataFrame, cols: list[str]) -> Column:
    """The columns as one array of z-scores; NULL where one of them is missing."""
    x = [as_double(df, c) for c in cols]
    r = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    z = F.array(*[(c - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"] or 1.0) for i, c in enumerate(x)])
    return F.when(~F.exists(z, lambda v: v.isNull()), z)


def nearest(queries: DataFrame, points: DataFrame, tree: Tree, k: int, exclude_self: bool = False) -> DataFrame:
    """Rows (q, x, w, dist): the nearest points of each query up to total weight k, ties at the end included.

    ``queries`` has distinct ``x``; ``points`` distinct ``x`` with weight ``w``.
    With ``exclude_self`` a query does not count itself, only its copies.
    """
    owned = with_leaf(points, tree)

    def weights(q, p, w):
        return w - (q == p).all(axis=-1) if exclude_self else w

    def bound(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        q = _matrix(qs["x"]) if len(qs) else np.zeros((0, 1))
        radius = np.full(len(q), np.inf)
        if len(q) and len(ps):
            p, w = _matrix(ps["x"]), ps["w"].to_numpy(float)
            for lo, d in _blocks(q, p):
                o = _least(d, k + exclude_self)  # each weighs 1 at least, but for the query itself
                enough = np.cumsum(weights(q[lo:lo + len(d), None, :], p[o], w[o]), axis=1) >= k
                hit = enough.any(axis=1)
                at = np.take_along_axis(d, o, 1)[np.arange(len(d)), enough.argmax(axis=1)]
                radius[lo:lo + len(d)][hit] = at[hit]
        return pd.DataFrame({"x": qs["x"], "radius": radius})

    def collect(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(ps):
            q, p, w = _matrix(qs["x"]), _matrix(ps["x"]), ps["w"].to_numpy(float)
            radius = qs["radius"].to_numpy(float)
            for lo, d in _blocks(q, p):
                i, j = np.nonzero(d <= radius[lo:lo + len(d), None])
                ww, dist = weights(q[lo + i], p[j], w[j]), d[i, j]
                order = np.lexsort((dist, i))
                order = order[ww[order] > 0]
                i, j, ww, dist = i[order], j[order], ww[order], dist[order]
                # Weight before each neighbour of its query; ties of the last needed one are kept.
                total = np.cumsum(ww) - ww
                before = total - total[np.searchsorted(i, i)] if len(i) else total
                last = np.zeros(len(d))
                np.maximum.at(last, i[before < k], dist[before < k])
                keep = dist <= last[i]
                out.append(pd.DataFrame({"q": list(q[lo + i[keep]]), "x": list(p[j[keep]]), "w": ww[keep], "dist": dist[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "x": [], "w": [], "dist": []})

    by_leaf = lambda d: d.groupBy("leaf")
    home = by_leaf(with_leaf(queries.select("x"), tree)).cogroup(by_leaf(owned)).applyInPandas(bound, f"x {POINT}, radius double")
    found = by_leaf(visiting(home, tree)).cogroup(by_leaf(owned)).applyInPandas(collect, f"q {POINT}, x {POINT}, w double, dist double")
    w = W.partitionBy("q").orderBy("dist").rangeBetween(W.unboundedPreceding, W.currentRow)
    level = F.sum("w").over(w)
    tied = F.sum("w").over(W.partitionBy("q", "dist"))
    return found.withColumn("_before", level - tied).where(F.col("_before") < k).drop("_before")


def impute_knn(df: DataFrame, col: str, features: list[str], k: int = 5, leaf_points: int = NEAREST_LEAF_POINTS) -> DataFrame:
    """Missing values filled with the mean of the k nearest rows that have one (standardised features).

    Rows tied with the k-th count as well. Rows without all features stay as they are.
    """
    d = df.withColumn("_z", standardised(df, features))
    v = as_double(df, col)
    donors = cut_lineage(d.where(v.isNotNull() & F.col("_z").isNotNull()).groupBy(F.col("_z").alias("x")).agg(
        F.count(F.lit(1)).alias("w"), F.sum(v).alias("s")))
    asked = d.where(v.isNull() & F.col("_z").isNotNull()).select(F.col("_z").alias("x")).distinct()
    near = nearest(asked, donors.select("x", "w"), plant(donors, leaf_points), k)
    fill = near.select("q", "x").join(donors, "x").groupBy("q").agg((F.sum("s") / F.sum("w")).alias("_fill"))
    return d.join(fill, F.col("_z") == F.col("q"), "left").select(*[
        F.coalesce(v, F.col("_fill")).alias(c) if c == col else quoted(c) for c in df.columns])


def lof(df: DataFrame, cols: list[str], k: int = 20, leaf_points: int = NEAREST_LEAF_POINTS) -> DataFrame:
    """``df`` with ``lof``: density of the k nearest rows over the row's own; about 1 inside a cluster."""
    d = df.withColumn("_z", standardised(df, cols))
    points = cut_lineage(d.where(F.col("_z").isNotNull()).groupBy(F.col("_z").alias("x")).agg(F.count(F.lit(1)).alias("w")))
    near = cut_lineage(nearest(points, points, plant(points, leaf_points), k, exclude_self=True))
    kdist = near.groupBy(F.col("q").alias("x")).agg(F.max("dist").alias("kdist"))
    reach = near.join(kdist, "x").withColumn("r", F.greatest("dist", "kdist"))
    # The small constant keeps the density of points with k copies finite.
    lrd = reach.groupBy("q").agg((1 / (F.sum(F.col("w") * F.col("r")) / F.sum("w") + 1e-10)).alias("lrd"))
    other = lrd.select(F.col("q").alias("x"), F.col("lrd").alias("other"))
    score = near.join(other, "x").groupBy("q").agg((F.sum(F.col("w") * F.col("other")) / F.sum("w")).alias("m")).join(lrd, "q")
    score = score.select("q", (F.col("m") / F.col("lrd")).alias("lof"))
    return d.join(score, F.col("_z") == F.col("q"), "left").drop("_z", "q")


def dbscan(df: DataFrame, cols: list[str], eps: float, min_pts: int, standardise: bool = True, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """``df`` with ``cluster``: 0.. in the order of the clusters' smallest points, -1 for noise, NULL without all columns.

    Core points (``min_pts`` rows within ``eps``, itself included) are counted
    over every leaf they reach. Each leaf then joins its core points and those
    visiting it; a core point seen in two leaves links their local clusters.
    A border point goes to its nearest core point.
    """
    z = standardised(df, cols) if standardise else F.when(
        ~F.exists(F.array(*[as_double(df, c) for c in cols]), lambda v: v.isNull()), F.array(*[as_double(df, c) for c in cols]))
    d = df.withColumn("_z", z)
    points = cut_lineage(d.where(F.col("_z").isNotNull()).groupBy(F.col("_z").alias("x")).agg(F.count(F.lit(1)).alias("w")))
    tree = plant(points, leaf_points)
    guests = visiting(points.withColumn("radius", F.lit(float(eps))), tree)

    def count(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        q, out = qs["x"], np.zeros(len(qs))
        if len(qs) and len(ps):
            w = ps["w"].to_numpy(float)
            for lo, dist in _blocks(_matrix(q), _matrix(ps["x"])):
                out[lo:lo + len(dist)] = (dist <= eps) @ w
        return pd.DataFrame({"x": q, "n": out})

    counted = guests.groupBy("leaf").cogroup(with_leaf(points, tree).groupBy("leaf")).applyInPandas(count, f"x {POINT}, n double")
    flags = cut_lineage(counted.groupBy("x").agg((F.sum("n") >= min_pts).alias("core")))
    rows = with_leaf(visiting(flags.withColumn("radius", F.lit(float(eps))), tree).withColumnRenamed("leaf", "at"), tree)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["at"].iloc[0])
        x, core = _matrix(pdf["x"]), pdf["core"].to_numpy(bool)
        own = (pdf["leaf"] == pdf["at"]).to_numpy()
        c = x[core]
        comp = _reachable(c, eps)
        label = np.array([None] * len(x), dtype=object)
        label[core] = [f"{leaf}:{i}" for i in comp]
        border = np.flatnonzero(own & ~core)
        if len(c) and len(border):
            order = np.lexsort(c.T[::-1])  # ties go to the smallest core point
            for lo, dist in _blocks(x[border], c[order]):
                best = dist.argmin(axis=1)
                for i, j in enumerate(best):
                    if dist[i, j] <= eps:
                        label[border[lo + i]] = f"{leaf}:{comp[order[j]]}"
        keep = own | core
        return pd.DataFrame({"x": pdf["x"][keep], "own": own[keep], "core": core[keep], "label": label[keep]})

    placed = cut_lineage(rows.groupBy("at").applyInPandas(local, f"x {POINT}, own boolean, core boolean, label string"))
    shared = placed.where("core").groupBy("x").agg(F.min("label").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = placed.where("core").join(shared, "x").where("label <> a").select("a", F.col("label").alias("b")).distinct()
    root = components(links, "a", "b").select(F.col("node").alias("label"), "root")
    members = placed.where("own").join(root, "label", "left").select("x", F.coalesce("root", "label").alias("root"))
    first = members.where("root is not null").groupBy("root").agg(F.min("x").alias("first"))
    codes = dense_codes(first.select("first"), "first")
    named = first.join(codes, F.col("first") == F.col("value")).select("root", "code")
    final = members.join(named, "root", "left").select(F.col("x").alias("_x"), F.coalesce("code", F.lit(-1)).cast("long").alias("cluster"))
    return d.join(final, F.col("_z") == F.col("_x"), "left").drop("_z", "_x")
