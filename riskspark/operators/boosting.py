"""Boosted trees on binned rows: training, losses per round and scores.

The algorithm is that of Spark's ``GBTClassifier`` with log loss (variance gain on pseudo-residuals, leaf means, first
tree with weight 1) and the result is a ``GBTClassificationModel``.  Spark runs a job per tree level, in which every row
walks the tree and adds to a histogram of megabytes at random.  Here the training rows are cut into bins (64 per feature)
and lie as bytes, with their margins and places, in mapped files on the disk of the executor that counts them.  A job per
level moves each row one level down and counts feature by feature; of two siblings only the one with fewer rows is counted.
The driver adds up the tasks' histograms and finds the splits.

Gradients are rounded to a common power of two per round, so that their sums are exact: the trees do not depend on the
number of tasks or on the order of rows.  Candidate splits come from all rows.  Files are state that can be lost: a task
that does not find its rows at the step before says so, and they are laid down again and brought up to the trees so far.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path
from ..sources import folders

# the steps travel to the workers as they are, so that they need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a task's summary of a feature, and how many it holds before it thins them out.
POINTS, HELD = 512, 16_384
#: Rows that are counted at once.
CHUNK = 1 << 16
#: Tasks of a fit at most: the driver gets the histograms of all, 1.3 MB each at the eighth level.
MOST_TASKS = 64
#: Times that a level is counted anew after rows were lost.
MOST_TRIES = 4


# ------------------------------------------------------------------ candidate splits
def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their counts."""
    v, at = np.unique(np.concatenate(values), return_inverse=True)
    return v, np.bincount(at, weights=np.concatenate(counts), minlength=len(v)).astype(np.int64)


def thinned(v: np.ndarray, c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``most`` of the values, each standing for an equal share of rows: those up to it, after the one before."""
    if len(v) <= most:
        return v, c
    total = np.cumsum(c)
    keep = np.flatnonzero(np.diff(total * most // total[-1], append=most + 1))
    return v[keep], np.diff(total[keep], prepend=0)


def summaries(n_features: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's values of each feature with their counts, thinned out where they are many; the label comes after the features."""
    n_features += 1

    def run(batches):
        values, counts, held = [[] for _ in range(n_features)], [[] for _ in range(n_features)], [0] * n_features
        for b in batches:
            for j in range(n_features):
                x = b.column(j).to_numpy(zero_copy_only=False)
                if j == n_features - 1 and not np.isin(x, (0.0, 1.0)).all():
                    raise ValueError("a label is neither 0 nor 1")
                if not np.isfinite(x).all():
                    raise ValueError("a feature is not a finite number")  # as Spark's trainer does
                v, c = np.unique(x + 0.0, return_counts=True)
                values[j].append(v)
                counts[j].append(c)
                held[j] += len(v)
                if held[j] > HELD:
                    v, c = thinned(*merged(values[j], counts[j]), HELD // 2)
                    values[j], counts[j], held[j] = [v], [c], len(v)
        for j in range(n_features):
            if values[j]:
                v, c = thinned(*merged(values[j], counts[j]), POINTS)
                yield pa.RecordBatch.from_pydict({"feature": pa.array([j], pa.int32()), "vals": [v.tobytes()], "counts": [c.astype(np.int64).tobytes()]})
    return run


def cuts_of(v: np.ndarray, c: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between values: between all if these are few, else at equal shares of the rows."""
    if len(v) <= bins:
        at = np.arange(len(v) - 1)
    else:
        total = np.cumsum(c)
        at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, bins) / bins))
        at = at[at < len(v) - 1]
    with np.errstate(all="ignore"):
        middle = v[at] + (v[at + 1] - v[at]) / 2
    return np.where((middle >= v[at]) & (middle < v[at + 1]), middle, v[at])


# ------------------------------------------------------------------ binned rows
def binned_rows(cuts: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as bytes: bin numbers feature by feature, and labels.  A row goes left of ``cuts[j]`` if its bin is at most j."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                label = b.column(len(cuts)).to_numpy(zero_copy_only=False)
                bins = [np.searchsorted(c, b.column(j).to_numpy(zero_copy_only=False)).astype(np.uint8) for j, c in enumerate(cuts)]
                yield pa.RecordBatch.from_pydict({"bins": [np.concatenate(bins).tobytes()], "label": [label.astype(np.uint8).tobytes()]})
    return run


def folder_of(fit: str, part: int) -> str:
    """Where a task's rows lie on its executor's disk."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return os.path.join(local if os.path.isdir(local) else tempfile.gettempdir(), f"boosting-{fit}-{part}")


class Rows:
    """The rows of a task in chunks: bins, labels, gradients, margins after an even and an odd number of trees, and places in
    the tree that grows (heap numbers).  ``trees`` and ``level`` say how far these are; steps can be run again."""

    KINDS = {"bins": np.uint8, "positive": np.uint8, "margin0": np.float64, "margin1": np.float64, "gradient": np.float64, "at": np.int16}

    def __init__(self, folder: str, n_features: int):
        self.folder, self.n_features = folder, n_features
        with open(f"{folder}/state") as f:
            self.trees, self.level = json.load(f)
        with open(f"{folder}/chunks") as f:
            self.chunks = json.load(f)
        for name, kind in self.KINDS.items():
            path = f"{folder}/{name}"
            setattr(self, name, np.memmap(path, kind, "r+") if os.path.getsize(path) else np.zeros(0, kind))
        self.margin = (self.margin0, self.margin1)

    @classmethod
    def put(cls, folder: str, blobs: Iterator, n_features: int) -> None:
        shutil.rmtree(folder, ignore_errors=True)
        os.makedirs(folder)
        chunks, pending, n, start = [], [], 0, 0
        with open(f"{folder}/bins", "wb") as bins, open(f"{folder}/positive", "wb") as positive:
            for x, label in blobs:
                pending.append(np.frombuffer(x, np.uint8).reshape(n_features, -1))
                positive.write(label)
                n += len(label)
                if n >= CHUNK:
                    bins.write(np.concatenate(pending, axis=1).tobytes())
                    chunks.append((start, n))
                    pending, start, n = [], start + n, 0
            if n:
                bins.write(np.concatenate(pending, axis=1).tobytes())
                chunks.append((start, n))
        for name in ("margin0", "margin1", "gradient", "at"):
            with open(f"{folder}/{name}", "wb") as f:
                f.truncate((start + n) * np.dtype(cls.KINDS[name]).itemsize)
        for name, x in (("chunks", chunks), ("state", (0, -1))):
            with open(f"{folder}/{name}", "w") as f:
                json.dump(x, f)

    def now(self, trees: int, level: int) -> None:
        with open(f"{self.folder}/state.new", "w") as f:
            json.dump((trees, level), f)
        os.replace(f"{self.folder}/state.new", f"{self.folder}/state")
        self.trees, self.level = trees, level

    def parts(self) -> Iterator[tuple[slice, np.ndarray]]:
        for start, m in self.chunks:
            yield slice(start, start + m), np.asarray(self.bins[start * self.n_features:(start + m) * self.n_features]).reshape(self.n_features, m)

    def descend(self, tree: dict, level: int) -> None:
        """Rows at nodes of ``level`` that were split move to their children; those that have moved stay."""
        every = np.arange(len(tree["feature"]))
        split = (tree["feature"] >= 0) & (every >> level == 1)
        if level and not split.any():
            return
        child, of, limit = np.where(split, 2 * every, every), np.where(split, tree["feature"], 0).astype(np.int64), np.where(split, tree["cut"], 255)
        for part, x in self.parts():
            if level:
                a = self.at[part].astype(np.int64)
                self.at[part] = child[a] + (x.ravel()[of[a] * x.shape[1] + np.arange(x.shape[1])] > limit[a])
            else:
                self.at[part] = child[1] + (x[of[1]] > limit[1])

    def slopes(self, k: int, step: float, weight: float, part: slice) -> np.ndarray:
        """Weighted gradients after ``k`` trees as multiples of ``step``."""
        positive = self.positive[part]
        y = positive * 2.0 - 1.0
        if k:
            with np.errstate(over="ignore"):
                y = 4.0 * y / (1.0 + np.exp(2.0 * y * self.margin[k % 2][part]))
        return np.rint(y * np.where(positive, weight, 1.0) / step) * step

    def slope(self, k: int, step: float, weight: float) -> None:
        for part, _ in self.parts():
            self.gradient[part] = self.slopes(k, step, weight, part)

    def add(self, k: int, value: np.ndarray) -> None:
        """The margins after tree ``k``, in which all rows have their place."""
        for part, _ in self.parts():
            self.margin[(k + 1) % 2][part] = self.margin[k % 2][part] + value[self.at[part]]

    def squares(self, k: int, step: float, weight: float, size: int) -> np.ndarray:
        out = np.zeros(size)
        if weight > 0:
            for part, _ in self.parts():
                out += np.bincount(self.at[part], weights=self.slopes(k, step, weight, part) ** 2 / np.where(self.positive[part], weight, 1.0), minlength=size)
        return out

    def count(self, nodes: np.ndarray, size: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by (feature, node, label, bin) and gradients by (feature, node, bin); node 1 has all rows."""
        slot, width = np.full(size, -1), len(nodes) * 2 * bins
        slot[nodes] = np.arange(len(nodes)) * 2 * bins
        n, total = np.zeros((self.n_features, width), np.int64), np.zeros((self.n_features, width))
        for part, x in self.parts():
            g, first = np.asarray(self.gradient[part]), self.positive[part].astype(np.int64) * bins
            chosen = slice(None)
            if nodes[0] != 1:
                k = slot[self.at[part]]
                chosen = np.flatnonzero(k >= 0)
                g, first = g[chosen], (first + k)[chosen]
            if len(g):
                for j in range(self.n_features):
                    key = first + x[j][chosen]
                    n[j] += np.bincount(key, minlength=width)
                    total[j] += np.bincount(key, weights=g, minlength=width)
        shape = (self.n_features, len(nodes), 2, bins)
        return n.reshape(shape).astype(np.int32), total.reshape(shape).sum(axis=2)


# ------------------------------------------------------------------ training
def best_splits(n: np.ndarray, g: np.ndarray, weight: float) -> tuple[np.ndarray, ...]:
    """For each node: gain, feature, bin, and its left rows by label and left gradient; gain 0 where nothing is gained.

    ``n`` by (feature, node, label, bin), ``g`` by (feature, node, bin); positives weigh ``weight``.  The first of equal gains wins."""
    n, g = np.cumsum(n, axis=-1), np.cumsum(g, axis=-1)
    w, rows = n[:, :, 0] + weight * n[:, :, 1], n.sum(axis=2)
    all_w, all_g, all_rows = w[:, :, -1:], g[:, :, -1:], rows[:, :, -1:]
    with np.errstate(all="ignore"):
        whole = all_g ** 2 / all_w
        gain = g ** 2 / w + (all_g - g) ** 2 / (all_w - w) - whole
        good = (rows > 0) & (rows < all_rows) & (w > 0) & (all_w - w > 0) & (gain > 1e-12 * whole)
        gain = np.where(good, gain / all_w, 0.0)
    k, bins = gain.shape[1], gain.shape[2]
    best = gain.transpose(1, 0, 2).reshape(k, len(gain) * bins).argmax(axis=1)
    j, b, i = best // bins, best % bins, np.arange(k)
    return gain[j, i, b], j, b, n[j, i, :, b], g[j, i, b]


def leaf_values(tree: dict[str, np.ndarray], weight: float) -> np.ndarray:
    w = tree["n"][:, 0] + weight * tree["n"][:, 1]
    return np.divide(tree["g"], w, out=np.zeros(len(w)), where=w > 0)


class Training:
    """Grows the trees on the driver; ``pins`` has the number of a task's rows as its one element and is kept where these rows lie."""

    def __init__(self, blobs, n_features: int, bins: int, depth: int, rate: float, weight: float):
        self.blobs, self.n_features, self.bins, self.depth, self.rate, self.weight = blobs, n_features, bins, depth, rate, weight
        self.trees: list[dict] = []
        self.steps: list[float] = []
        self.pins = None
        self.lay()

    def lay(self) -> None:
        """The rows on the executors' disks, as they are before the first tree."""
        self.clear()
        self.fit, fit, k = (made := uuid.uuid4().hex), made, self.n_features

        def put(part, blobs):
            Rows.put(folder_of(fit, part), blobs, k)
            yield part

        self.pins = self.blobs.mapPartitionsWithIndex(put).persist(StorageLevel.MEMORY_AND_DISK)

    def clear(self) -> None:
        if self.pins is not None:
            fit = self.fit
            self.pins.foreach(lambda part: shutil.rmtree(folder_of(fit, part), ignore_errors=True))
            self.pins.unpersist(blocking=True)

    def job(self, level: int, step: Callable[[Rows], tuple]) -> list[np.ndarray]:
        """The sums of what ``step`` gives for the rows of each task; these are at this level of this tree, or one step before it."""
        fit, k, n = self.fit, self.n_features, len(self.trees)
        before = (n, level - 1) if level or not n else (n - 1, self.depth - 1)

        def run(parts):
            for part in parts:
                folder = folder_of(fit, part)
                rows = Rows(folder, k) if os.path.exists(f"{folder}/state") else None
                yield step(rows) if rows and (rows.trees, rows.level) in (before, (n, level)) else None

        for _ in range(MOST_TRIES):
            got = self.pins.mapPartitions(run).collect()
            if all(x is not None for x in got):
                return [sum(x[1:], x[0].astype(np.int64) if x[0].dtype == np.int32 else x[0]) for x in zip(*got)]
            self.lay()  # an executor is gone, or a task ran on another one
            fit = self.fit
            self.catch_up(before)
        raise RuntimeError("the training rows were lost again and again")

    def catch_up(self, to: tuple[int, int]) -> None:
        fit, k, trees, steps, weight = self.fit, self.n_features, [*self.trees, self.tree], self.steps, self.weight
        values, depth = [self.value(i) for i in range(len(self.trees))], self.depth

        def run(part):
            rows = Rows(folder_of(fit, part), k)
            for i in range(to[0]):
                for level in range(depth):
                    rows.descend(trees[i], level)
                rows.add(i, values[i])
            if to[1] >= 0:
                rows.slope(to[0], steps[to[0]], weight)
                for level in range(to[1]):
                    rows.descend(trees[to[0]], level)
            rows.now(*to)

        self.pins.foreach(run)

    def value(self, i: int) -> np.ndarray:
        return leaf_values(self.trees[i], self.weight) * (self.rate if i else 1.0)

    def finish(self, rounds: int) -> None:
        """Tree after tree; a level is one job."""
        size, depth, weight, bins = 2 << self.depth, self.depth, self.weight, self.bins
        total = None
        for k in range(rounds):
            self.tree = tree = {"feature": np.full(size, -1, np.int16), "cut": np.zeros(size, np.uint8), "gain": np.full(size, -1.0),
                                "n": np.zeros((size, 2), np.int64), "g": np.zeros(size)}
            last = ({x: self.trees[-1][x] for x in ("feature", "cut")}, self.value(k - 1), self.steps[-1]) if k else None
            if not k:
                bound = self.rows[0] + weight * self.rows[1]
            else:  # a gradient grows by this factor at most; after the first tree it is 4 at most
                bound = 4.0 * bound if k == 1 else total * float(np.exp(2.0 * np.abs(last[1]).max()))
            step = 2.0 ** (np.ceil(np.log2(bound)) - 51) if bound > 0 else 1.0
            self.steps.append(step)

            def begin(rows, k=k, last=last, step=step):
                squares = np.zeros(size)
                if k and (rows.trees, rows.level) != (k, 0):
                    for level in range(depth - 1, depth) if rows.level == depth - 1 else range(depth):
                        rows.descend(last[0], level)
                if k:
                    squares = rows.squares(k - 1, last[2], weight, size)
                    rows.add(k - 1, last[1])
                rows.slope(k, step, weight)
                rows.now(k, 0)
                return *rows.count(np.array([1]), size, bins), squares, np.abs(rows.gradient).sum()

            n, g, squares, total = self.job(0, begin)
            if k:
                self.squared(self.trees[-1], squares)
            nodes = np.array([1])
            tree["n"][1], tree["g"][1] = n[0, 0].sum(axis=-1), g[0, 0].sum()
            for level in range(depth):
                gain, j, b, left_n, left_g = best_splits(n, g, weight)
                split = np.flatnonzero(gain > 0)
                at = nodes[split]
                tree["feature"][at], tree["cut"][at], tree["gain"][at] = j[split], b[split], gain[split]
                tree["n"][2 * at], tree["g"][2 * at] = left_n[split], left_g[split]
                tree["n"][2 * at + 1], tree["g"][2 * at + 1] = tree["n"][at] - left_n[split], tree["g"][at] - left_g[split]
                if level + 1 == depth:
                    break
                few = 2 * at + (tree["n"][2 * at].sum(axis=1) > tree["n"][2 * at + 1].sum(axis=1))
                here = {x: tree[x].copy() for x in ("feature", "cut")}

                def deeper(rows, k=k, level=level, few=few, here=here):
                    rows.descend(here, level)
                    rows.now(k, level + 1)
                    return rows.count(few, size, bins) if len(few) else (np.zeros(1), np.zeros(1))

                few_n, few_g = self.job(level + 1, deeper)
                if not len(split):
                    few_n, few_g = n[:, :0], g[:, :0]
                nodes = np.concatenate([few, few ^ 1])
                n = np.concatenate([few_n, n[:, split] - few_n], axis=1)
                g = np.concatenate([few_g, g[:, split] - few_g], axis=1)
            self.trees.append(tree)
        fit, k, step, here = self.fit, self.n_features, self.steps[-1], {x: tree[x] for x in ("feature", "cut")}

        def end(part):
            rows = Rows(folder_of(fit, part), k)
            rows.descend(here, depth - 1)
            return rows.squares(rounds - 1, step, weight, size)

        self.squared(tree, sum(self.pins.map(end).collect()))

    @staticmethod
    def squared(tree: dict, squares: np.ndarray) -> None:
        """Squared gradients of the leaves, and so of all nodes."""
        for i in range(len(squares) - 1, 1, -1):
            squares[i >> 1] += squares[i]
        tree["squares"] = squares


class BoostedTrees(Estimator):
    """``gbt`` fitted on the columns ``inputs`` (doubles without nulls) and ``label`` (0 or 1), positives weighing ``weight``, in
    ``tasks`` tasks.  The model reads the features column that ``gbt`` names."""

    def __init__(self, gbt: GBTClassifier, inputs: Sequence[str], label: str, weight: float, tasks: int):
        super().__init__()
        self.gbt, self.inputs, self.label, self.weight, self.tasks = gbt, list(inputs), label, weight, max(1, min(tasks, MOST_TASKS))

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        gbt, k = self.gbt, len(self.inputs)
        d = dataset.select(*self.inputs, self.label)
        found: list[tuple[list, list]] = [([], []) for _ in range(k)]
        labels = np.zeros(2, np.int64)
        for r in d.mapInArrow(summaries(k), "feature int, vals binary, counts binary").collect():
            if r["feature"] == k:
                labels += np.bincount(np.frombuffer(r["vals"]).astype(np.int64), np.frombuffer(r["counts"], np.int64), 2).astype(np.int64)
            else:
                found[r["feature"]][0].append(np.frombuffer(r["vals"]))
                found[r["feature"]][1].append(np.frombuffer(r["counts"], np.int64))
        if not labels.sum():
            raise ValueError("there are no rows to train on")
        bins = min(gbt.getMaxBins(), 255)
        cuts = [cuts_of(*merged(v, c), bins) for v, c in found]
        blobs = d.mapInArrow(binned_rows(cuts), "bins binary, label binary").repartition(self.tasks).rdd
        training = Training(blobs, k, bins, gbt.getMaxDepth(), gbt.getStepSize(), self.weight)
        training.rows = labels
        try:
            training.finish(gbt.getMaxIter())
        finally:
            training.clear()
        return spark_model(dataset.sparkSession, gbt, training.trees, cuts, self.weight)


def node_rows(tree: dict[str, np.ndarray], cuts: list[np.ndarray], weight: float) -> list[tuple]:
    """The tree as rows of Spark's ``NodeData``, numbered in preorder."""
    out, value, w = [], leaf_values(tree, weight), tree["n"][:, 0] + weight * tree["n"][:, 1]

    def put(i: int) -> int:
        k, j = len(out), int(tree["feature"][i])
        stats = [float(w[i]), float(tree["g"][i]), float(tree["squares"][i])]
        impurity = max(0.0, stats[2] / stats[0] - float(value[i]) ** 2) if stats[0] > 0 else 0.0
        node = (k, float(value[i]), impurity, stats, int(tree["n"][i].sum()))
        out.append(None)
        if j < 0:
            out[k] = (*node, -1.0, -1, -1, (-1, [], -1))
        else:
            out[k] = (*node, float(tree["gain"][i]), put(2 * i), put(2 * i + 1), (j, [float(cuts[j][tree["cut"][i]])], -1))
        return k

    put(1)
    return out


NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def spark_model(spark: SparkSession, gbt: GBTClassifier, trees: list[dict], cuts: list[np.ndarray], weight: float) -> GBTClassificationModel:
    """The trees as Spark's model, through the format in which Spark stores models: a call for each node would take far longer."""
    params = {p.name: v for p, v in gbt._paramMap.items()} | {"impurity": "variance"}
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "defaultParamMap": {}}
    model = head | {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": gbt.uid, "paramMap": params,
                    "numFeatures": len(cuts), "numTrees": len(trees)}
    tree = head | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel",
                   "paramMap": {k: params[k] for k in ("maxBins", "maxDepth", "seed", "impurity") if k in params}}
    path = checkpoint_path(spark, "models", f"trained-{uuid.uuid4().hex}")
    try:
        spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        meta = [(i, json.dumps(tree | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), gbt.getStepSize() if i else 1.0) for i in range(len(trees))]
        spark.createDataFrame(meta, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        nodes = [(i, node) for i, t in enumerate(trees) for node in node_rows(t, cuts, weight)]
        spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{path}/data")
        return GBTClassificationModel.load(path)
    finally:
        folders.remove(spark, path)


# ------------------------------------------------------------------ scores
def trees_of(model: GBTClassificationModel) -> dict:
    """All trees in flat arrays: a row at ``i`` goes to ``child[i]``, or the place after it if its bin is over ``cut[i]``; leaves lead to
    themselves.  Bins are places among the thresholds that the model has for a feature."""
    feature, limit, child, value, roots, depths, weights = [], [], [], [], [], [], []
    stack: list[tuple[int, int]] = []

    def new(depth: int) -> tuple[int, int]:
        for xs, x in ((feature, -1), (limit, 0.0), (child, len(feature)), (value, 0.0)):
            xs.append(x)
        return len(feature) - 1, depth

    line = re.compile(r"\s*(?:If \(feature (\d+) <= (\S+)\)|Predict: (\S+)|Tree \d+ \(weight (\S+)\):|(Else )|(GBTClassificationModel))")
    for text in model.toDebugString.splitlines():
        if not text.strip():
            continue
        m = line.match(text)
        if m is None:
            raise ValueError(f"not a split of a number: {text.strip()}")
        if m[4]:
            stack = [new(0)]
            roots.append(stack[0][0])
            depths.append(0)
            weights.append(float(m[4]))
        elif m[1]:
            i, depth = stack.pop()
            left, right = new(depth + 1), new(depth + 1)
            feature[i], limit[i], child[i] = int(m[1]), float(m[2]), left[0]
            depths[-1] = max(depths[-1], depth + 1)
            stack += [right, left]
        elif m[3]:
            value[stack.pop()[0]] = float(m[3])
    feature, limit = np.array(feature, np.int64), np.array(limit)
    cuts = [np.unique(limit[feature == j]) for j in range(model.numFeatures)]
    cut = np.full(len(feature), 1 << 30, np.int32)
    for j, c in enumerate(cuts):
        cut[feature == j] = np.searchsorted(c, limit[feature == j])
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.int32
    return {"feature": np.maximum(feature, 0), "cut": cut, "child": np.array(child, np.int64), "value": np.array(value), "roots": roots,
            "depths": depths, "weights": weights, "cuts": cuts, "kind": kind}


def margins(trees: dict, inputs: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
    """The rows' margin after each tree (one array, added to)."""
    m = len(inputs[0])
    x = np.concatenate([np.searchsorted(c, v).astype(trees["kind"]) for c, v in zip(trees["cuts"], inputs)])
    total, each = np.zeros(m), np.arange(m)
    place, cut, child, value = trees["feature"] * m, trees["cut"], trees["child"], trees["value"]
    for root, depth, weight in zip(trees["roots"], trees["depths"], trees["weights"]):
        at = np.full(m, root)
        for _ in range(depth):
            at = child[at] + (x[place[at] + each] > cut[at])
        total += weight * value[at]
        yield total


def probability(model: GBTClassificationModel) -> Callable[..., Column]:
    """A function of the input columns: the probability of label 1."""
    trees = trees_of(model)

    def scores(*inputs: pd.Series) -> pd.Series:
        x, out = [c.to_numpy() for c in inputs], np.zeros(len(inputs[0]))
        for out in margins(trees, x):
            pass
        with np.errstate(over="ignore"):
            return pd.Series(1.0 / (1.0 + np.exp(-2.0 * out)))

    return F.pandas_udf(scores, "double")


def losses(model: GBTClassificationModel, rows: DataFrame) -> list[float]:
    """Mean log loss after each tree; the last column of ``rows`` is the label, the others are the inputs (empty without rows)."""
    trees = trees_of(model)

    def run(batches):
        total, n = np.zeros(len(trees["roots"])), 0
        for b in batches:
            if b.num_rows:
                *x, label = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                y, n = 2.0 * label - 1.0, n + b.num_rows
                total += [2.0 * np.logaddexp(0.0, -2.0 * y * m).sum() for m in margins(trees, x)]
        if n:
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tolist()], pa.list_(pa.float64())), "n": [n]})

    parts = rows.mapInArrow(run, "total array<double>, n bigint").collect()
    n = sum(r["n"] for r in parts)
    return (np.sum([r["total"] for r in parts], axis=0) / n).tolist() if n else []
