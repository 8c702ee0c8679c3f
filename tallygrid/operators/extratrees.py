"""Extremely randomised trees, grown level by level from partial sums.

Each open node draws one threshold per feature, uniform between the least and
the largest value its rows have. A level takes two passes over the rows: the
first finds those ranges, the second the label sums left of each threshold. A
task adds up its rows in arrays of (node, feature) and hands on one row for each;
these are summed by a shuffle and the driver picks the best split of each node.
What is held at a time is bounded by ``SLOTS``, whatever the rows: a wider level
takes more passes. Rows are never moved, and no candidate thresholds are sorted.

Draws depend on (seed, tree, node) alone, so a tree does not depend on how rows
are spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SLOTS = 400_000  # (node, feature) pairs of one pass
LEAST_GAIN = 1e-12


def draws(seed: int, tree: int, node: int, features: int, tried: int) -> tuple[np.ndarray, np.ndarray]:
    """Uniform numbers for the thresholds of a node, and the features it may split on."""
    rng = np.random.default_rng([seed & 0xFFFFFFFF, tree, node])
    return rng.random(features), np.sort(rng.permutation(features)[:tried])


def descend(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row in one tree; the children of node i are 2i and 2i + 1, the root is 1."""
    node = np.ones(len(x), np.int64)
    at = np.arange(len(x))
    for _ in range(levels):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + (x[at, np.maximum(f, 0)] > threshold[node]), node)
    return node


def gain(left: np.ndarray, total: np.ndarray, classes: int) -> float:
    """Fall of the squared error (or of the Gini impurity times rows) by a split; -1 if a side is empty.

    Sums are (rows, y, y squared), or rows by class.
    """
    right = total - left
    rows = (lambda s: s.sum()) if classes else (lambda s: s[0])
    if rows(left) < 1 or rows(right) < 1:
        return -1.0
    kept = (lambda s: float((s ** 2).sum() / s.sum())) if classes else (lambda s: float(s[1] ** 2 / s[0]))
    return kept(left) + kept(right) - kept(total)


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    grown = Param(Params._dummy(), "grown", "the grown trees as JSON", TypeConverters.toString)


class ExtraTrees(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Regression tries every feature at a node, classification the square root of their number."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", numTrees: int = 150, maxDepth: int = 10, classes: int = 0, seed: int = 42):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol="prediction", numTrees=numTrees, maxDepth=maxDepth, classes=classes, seed=seed)

    def _fit(self, df: DataFrame) -> ExtraTreesModel:
        trees, depth, classes, seed = (self.getOrDefault(p) for p in ("numTrees", "maxDepth", "classes", "seed"))
        d = cut_lineage(df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).where("y IS NOT NULL"))
        first = d.first()
        width = len(first["x"]) if first else 0
        # Tasks get a column of numbers per feature: a list per row costs more than the sums.
        d = d.select(*[F.col("x")[f].alias(f"x{f}") for f in range(width)], "y")
        tried = max(1, int(np.sqrt(width))) if classes else width
        kinds = classes or 3
        feature = np.full((trees, 2 << depth), -1, np.int32)
        threshold = np.zeros((trees, 2 << depth))
        value = np.zeros((trees, 2 << depth, classes or 1))
        weight = np.zeros((trees, max(width, 1)))
        open_ = [(t, 1) for t in range(trees)] if width else []
        for level in range(depth):
            ahead = []
            for at in range(0, len(open_), max(1, SLOTS // max(width, 1))):
                group = open_[at:at + max(1, SLOTS // width)]
                lo, hi = self._ranges(d, group, feature, threshold, level, width)
                drawn = [draws(seed, t, n, width, tried) for t, n in group]
                cut = np.array([l + u * (h - l) for (u, _), l, h in zip(drawn, lo, hi)])
                left, total = self._sums(d, group, feature, threshold, level, cut, classes, kinds)
                for i, (t, n) in enumerate(group):
                    if level == 0:
                        value[t, n] = _value(total[i], classes)
                    best = max(((gain(left[i, f], total[i], classes), -f) for f in drawn[i][1] if hi[i, f] > lo[i, f]), default=(-1.0, 0))
                    if best[0] > LEAST_GAIN * max(1.0, abs(total[i]).max()):
                        f = -best[1]
                        feature[t, n], threshold[t, n] = f, cut[i, f]
                        weight[t, f] += best[0]
                        for child, s in ((2 * n, left[i, f]), (2 * n + 1, total[i] - left[i, f])):
                            value[t, child] = _value(s, classes)
                            ahead.append((t, child))
            open_ = ahead
            if not open_:
                break
        share = weight / np.maximum(weight.sum(1, keepdims=True), 1e-300)
        # Nodes of all trees, without the places that no tree uses.
        used = [np.flatnonzero(np.abs(value[t]).sum(1) + (feature[t] >= 0) > 0).tolist() for t in range(trees)]
        grown = {"depth": depth, "importance": share.mean(0)[:width].tolist(), "nodes": used, "feature": [feature[t, u].tolist() for t, u in enumerate(used)],
                 "threshold": [threshold[t, u].tolist() for t, u in enumerate(used)], "value": [value[t, u].tolist() for t, u in enumerate(used)]}
        model = ExtraTreesModel()
        return self._copyValues(model)._set(grown=json.dumps(grown))

    @staticmethod
    def _slots(group: list, size: int) -> dict:
        """For each tree of the group: its open nodes' places, by node number."""
        out: dict[int, np.ndarray] = {}
        for i, (t, n) in enumerate(group):
            out.setdefault(t, np.full(size, -1, np.int64))[n] = i
        return out

    def _ranges(self, d: DataFrame, group, feature, threshold, level, width):
        slots = self._slots(group, feature.shape[1])
        n = len(group)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lo, hi = np.full((width, n), np.inf), np.full((width, n), -np.inf)  # a row per feature: numpy is fast along one axis
            for b in batches:
                x = _features(b, width)
                for t, place in slots.items():
                    s = place[descend(x, feature[t], threshold[t], level)]
                    at = np.flatnonzero(s >= 0)
                    k = s[at]
                    for f in range(width):
                        v = x[at, f]
                        np.minimum.at(lo[f], k, v)
                        np.maximum.at(hi[f], k, v)
            f, i = np.nonzero(lo <= hi)
            yield pd.DataFrame({"i": i, "f": f, "lo": lo[f, i], "hi": hi[f, i]})

        lo, hi = np.zeros((2, n, width))
        for r in d.mapInPandas(run, "i long, f long, lo double, hi double").groupBy("i", "f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # at most SLOTS rows
            lo[r["i"], r["f"]], hi[r["i"], r["f"]] = r["lo"], r["hi"]
        return lo, hi

    def _sums(self, d: DataFrame, group, feature, threshold, level, cut, classes, kinds):
        slots = self._slots(group, feature.shape[1])
        n, width = cut.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            left, total = np.zeros((width, kinds, n)), np.zeros((kinds, n))
            for b in batches:
                x, y = _features(b, width), b["y"].to_numpy()
                stats = np.eye(kinds)[y.astype(int)].T.copy() if classes else np.stack([np.ones(len(y)), y, y * y])
                for t, place in slots.items():
                    s = place[descend(x, feature[t], threshold[t], level)]
                    at = np.flatnonzero(s >= 0)
                    s, here = s[at], stats[:, at]
                    for c in range(kinds):
                        np.add.at(total[c], s, here[c])
                    for f in range(width):
                        below = np.flatnonzero(~(x[at, f] > cut[s, f]))
                        k = s[below]
                        for c in range(kinds):
                            np.add.at(left[f, c], k, here[c, below])
            i = np.flatnonzero((total.sum(0) if classes else total[0]) > 0)
            for f in range(width):
                yield pd.DataFrame({"i": i, "f": f, **{f"s{k}": left[f, k, i] for k in range(kinds)}})
            yield pd.DataFrame({"i": i, "f": -1, **{f"s{k}": total[k, i] for k in range(kinds)}})

        names = [f"s{k}" for k in range(kinds)]
        left, total = np.zeros((n, width, kinds)), np.zeros((n, kinds))
        got = d.mapInPandas(run, "i long, f long, " + ", ".join(f"{s} double" for s in names)).groupBy("i", "f").agg(*[F.sum(s).alias(s) for s in names])
        for r in got.collect():  # at most SLOTS rows and one for each node
            (total[r["i"]] if r["f"] < 0 else left[r["i"], r["f"]])[:] = [r[s] for s in names]
        return left, total


def _features(b: pd.DataFrame, width: int) -> np.ndarray:
    return np.stack([b[f"x{f}"].to_numpy(float) for f in range(width)], 1)


def _value(s: np.ndarray, classes: int) -> np.ndarray:
    """Shares of the classes, or the mean."""
    return s / max(s.sum(), 1.0) if classes else np.array([s[1] / max(s[0], 1.0)])


class ExtraTreesModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """The mean over trees of a leaf's mean, or the class with the highest mean share."""

    def _arrays(self) -> tuple:
        g = json.loads(self.getOrDefault("grown"))
        size = 2 << g["depth"]
        out = []
        for nodes, f, c, v in zip(g["nodes"], g["feature"], g["threshold"], g["value"]):
            feature, threshold, value = np.full(size, -1, np.int32), np.zeros(size), np.zeros((size, max(1, self.getOrDefault("classes"))))
            if nodes:
                feature[nodes], threshold[nodes], value[nodes] = f, c, v
            out.append((feature, threshold, value))
        return out, g["depth"]

    @property
    def featureImportances(self):
        return Vectors.dense(json.loads(self.getOrDefault("grown"))["importance"])

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, depth = self._arrays()
        classes = self.getOrDefault("classes")

        def predict(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype="float64")
            x = np.stack(rows.to_numpy())
            total = sum(value[descend(x, feature, threshold, depth)] for feature, threshold, value in trees) / len(trees)
            return pd.Series(total.argmax(1).astype(float) if classes else total[:, 0])

        return df.withColumn(self.getPredictionCol(), F.pandas_udf(predict, "double")(vector_to_array(self.getFeaturesCol())))
