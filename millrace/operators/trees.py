"""Random forests and boosted trees, grown level by level from histograms.

Features are cut into bins once. A level is one pass over the rows: every task walks its rows down the trees that grow and sums the rows that reach open
nodes per node, feature and bin; Spark adds these up, and the best cut of every node is found by running sums over at most ``max_bins`` rows. So a
pass shuffles one row per node, feature and bin of a task, whatever the rows, and all trees of a forest grow in the same passes. The driver holds the model,
which has as many nodes as ``max_depth``, ``min_samples_split`` and ``min_samples_leaf`` let it have, and one row per open node.

Rows carry weights (drawn by a hash of key and tree, so they do not depend on the partitioning) and weighted sums; a cut gains the sum of ``s * s / (w + reg_lambda)``
over both sides. With a row's target as sum that is the drop of the squared error, with one sum per class the drop of the Gini impurity, and
with gradients and curvatures of the loss the gain of a boosting step. Gains that agree in single precision are equal; the first feature and the lowest cut win.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.ranking import HASH_TOP, seeded_hash
from millrace.session import cut_lineage

ROWS = 200_000  # walked down together in a task
WORTH_SPREADING = 20_000  # rows
FIXED_ROUNDS = 8  # boosting rounds after which the rows' predictions are fixed in a table
GOLDEN = 0x9E3779B97F4A7C15
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def scrambled(x: np.ndarray, tree: int) -> np.ndarray:
    """A number in [0, 1) per row and tree, from the rows' hashes."""
    x = x.astype(np.uint64) ^ np.uint64((tree + 1) * GOLDEN % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


@dataclass
class Tree:
    """Node ``i`` sends rows whose bin of ``feature[i]`` is at most ``cut[i]`` to ``left[i]``; leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[list[float]] = field(default_factory=list)

    def add(self, value: list[float]) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, values: tuple[list[float], list[float]]) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = self.add(values[0]), self.add(values[1])
        return self.left[node], self.right[node]

    def leaves(self, rows: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
        """The node each row comes to rest in. ``rows`` are bins, or values if ``cuts`` gives each node's largest value to the left."""
        feature, left, right = (np.array(c, np.int64) for c in (self.feature, self.left, self.right))
        cut = np.array(self.cut) if cuts is None else cuts
        at = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows)) if feature[0] >= 0 else np.empty(0, np.int64)
        while len(live):
            node = at[live]
            at[live] = np.where(rows[live, feature[node]] <= cut[node], left[node], right[node])
            live = live[feature[at[live]] >= 0]
        return at


@dataclass
class Settings:
    """How trees are grown. ``loss`` is None for forests, else ``squared`` or ``logistic``; ``classes`` 0 is regression."""

    loss: str | None = None
    classes: int = 0
    trees: int = 100
    max_depth: int | None = 10
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    learning_rate: float = 0.1
    subsample: float = 1.0
    share_per_tree: float = 1.0
    all_features: bool = True
    reg_lambda: float = 0.0
    max_bins: int = 64
    seed: int = 42
    keys: list[str] = field(default_factory=list)

    def features(self, tree: int, node: int, n: int) -> np.ndarray:
        """Which of ``n`` features a node may be cut by."""
        allowed = np.ones(n, bool)
        for share, salt in ((min(n, max(1, round(n * self.share_per_tree))), tree), (n if self.all_features else math.ceil(math.sqrt(n)), tree * 1_000_003 + node + 7)):
            if share < n:
                order = np.argsort(scrambled(np.arange(n) + 31 * self.seed, salt), kind="stable")
                allowed[order[share:]] = False
        return allowed if allowed.any() else np.ones(n, bool)


def cut_points(rows: DataFrame, n: int, max_bins: int) -> list[np.ndarray]:
    """Ascending upper ends of the bins of each feature, without the last: every distinct value of a feature with up to ``max_bins``, else quantiles."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * n
        for batch in batches:
            x = _matrix(batch.column(0), n)
            seen = [np.unique(np.concatenate((s, x[:, i])))[: max_bins + 1] for i, s in enumerate(seen)]
        number = np.repeat(np.arange(n), [len(s) for s in seen])
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(np.concatenate([np.empty(0), *seen]))], ["feature", "value"])

    found = rows.select("x").mapInArrow(distinct, "feature int, value double").distinct()
    ranked = found.withColumn("at", F.row_number().over(Window.partitionBy("feature").orderBy("value"))).where(F.col("at") <= max_bins + 1)
    values: dict[int, list[float]] = {i: [] for i in range(n)}
    for r in ranked.orderBy("feature", "value").collect():  # at most max_bins + 1 a feature
        values[r["feature"]].append(r["value"])
    many = [i for i in range(n) if len(values[i]) > max_bins]
    if many:
        shares = [k / max_bins for k in range(1, max_bins)]
        grids = rows.agg(*[F.percentile_approx(F.col("x")[i], shares, 100 * max_bins).alias(f"q{i}") for i in many]).first()
        for i in many:
            values[i] = [*sorted(set(grids[f"q{i}"])), math.inf]
    return [np.array(values[i][:-1]) for i in range(n)]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


def binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``hash``, ``y``, ``bins`` (two bytes per feature) and ``fixed`` (predictions so far, eight bytes each), as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype("<u2")
            packed = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed, pa.array([b""] * len(bins), pa.binary())], ["hash", "y", "bins", "fixed"])

    out = cut_lineage(rows.select("hash", "y", "x").mapInArrow(run, "hash long, y double, bins binary, fixed binary"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(out.inputFiles()) < cores and out.count() > WORTH_SPREADING:  # a few files; every level reads them again
        out = cut_lineage(out.repartition(cores))
    return out


def _packed(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of equally long packed numbers."""
    parts = []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(parts).view(kind).reshape(len(column), -1)


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


class Grower:
    """Grows trees over binned rows. ``sums`` is the number of weighted sums of a row in a tree, ``outputs`` that of a prediction."""

    def __init__(self, rows: DataFrame, cuts: list[np.ndarray], settings: Settings):
        self.rows, self.cuts, self.settings = rows, cuts, settings
        self.sums = settings.classes if settings.loss is None and settings.classes else 1
        several = settings.loss == "logistic" and settings.classes > 2
        self.outputs = settings.classes if several else self.sums
        self.trees: list[Tree] = []
        self.fixed = 0  # trees whose predictions the rows carry
        self.base = 0.0
        if not settings.classes:
            self.base = float(rows.agg(F.avg("y")).first()[0] or 0.0)

    # ---- what a row counts for ----

    def _walk(self, table: pa.Table, trees: list[Tree], fixed: int) -> tuple[np.ndarray, ...]:
        bins = _packed(table["bins"], "<u2")
        return table["hash"].to_numpy(), table["y"].to_numpy(), bins, self._so_far(table, bins, trees, fixed)

    def _so_far(self, table: pa.Table, bins: np.ndarray, trees: list[Tree], fixed: int) -> np.ndarray:
        """What boosting predicts from the trees grown so far."""
        if self.settings.loss is None:
            return np.empty((len(bins), 0))
        made = np.full((len(bins), self.outputs), self.base)
        if fixed:
            made = _packed(table["fixed"], "<f8").copy()
        for t in range(fixed, len(trees)):
            value = np.array(trees[t].value)[:, 0]
            made[:, t % self.outputs] += self.settings.learning_rate * value[trees[t].leaves(bins)]
        return made

    def _weights(self, hashed: np.ndarray, y: np.ndarray, made: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Weight and weighted sums of each row in a tree; weight 0 leaves it out."""
        s = self.settings
        if s.loss is None:
            w = np.searchsorted(POISSON, scrambled(hashed, tree), "right").astype(float)
            return w, w[:, None] * ((y[:, None] == np.arange(s.classes)) if s.classes else (y - self.base)[:, None])
        drawn = scrambled(hashed, tree // self.outputs) < s.subsample if s.subsample < 1 else np.ones(len(y), bool)
        if s.loss == "squared":
            return drawn.astype(float), np.where(drawn, y - made[:, 0], 0)[:, None]
        if self.outputs == 1:
            p, hit = 1 / (1 + np.exp(-made[:, 0])), y == 1
        else:
            e = np.exp(made - made.max(axis=1, keepdims=True))
            p, hit = (e / e.sum(axis=1, keepdims=True))[:, tree % self.outputs], y == tree % self.outputs
        return np.where(drawn, np.maximum(p * (1 - p), 1e-12), 0), np.where(drawn, hit - p, 0)[:, None]

    # ---- one level ----

    def _histograms(self, growing: dict[int, Tree], open_nodes: dict[int, list[int]]) -> DataFrame:
        n = len(self.cuts)
        grown, fixed = list(self.trees), self.fixed
        allowed = {t: np.stack([self.settings.features(t, node, n) for node in nodes]) for t, nodes in open_nodes.items()}
        shared = self.rows.sparkSession.sparkContext.broadcast((grown, growing, open_nodes, allowed))  # the model and its open nodes
        rows, self.rows = self.rows, None  # the tasks get this object without the frame
        names = ["tree", "node", "feature", "bin", "n", "w", *[f"s{i}" for i in range(self.sums)]]
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grown, growing, open_nodes, allowed = shared.value
            for table in _large(batches):
                hashed, y, bins, made = me._walk(table, grown, fixed)
                for t, tree in growing.items():
                    slot = np.full(len(tree.feature), -1)
                    slot[open_nodes[t]] = np.arange(len(open_nodes[t]))
                    place = slot[tree.leaves(bins)]
                    w, sums = me._weights(hashed, y, made, t)
                    in_use = np.flatnonzero((place >= 0) & (w > 0))
                    for f in range(n):
                        at = in_use[allowed[t][place[in_use], f]]
                        if not len(at):
                            continue
                        cell = place[at] * (len(me.cuts[f]) + 1) + bins[at, f]
                        if len(open_nodes[t]) * (len(me.cuts[f]) + 1) > 4 * len(at):
                            cells, cell = np.unique(cell, return_inverse=True)
                        else:
                            cells = None
                        columns = [np.bincount(cell), np.bincount(cell, w[at]), *[np.bincount(cell, sums[at, i]) for i in range(me.sums)]]
                        if cells is None:
                            cells = np.flatnonzero(columns[0])
                            columns = [c[cells] for c in columns]
                        node = np.array(open_nodes[t])[cells // (len(me.cuts[f]) + 1)]
                        keys = [np.full(len(cells), t), node, np.full(len(cells), f), cells % (len(me.cuts[f]) + 1)]
                        arrays = [pa.array(k, pa.int32()) for k in keys] + [pa.array(columns[0], pa.int64())] + [pa.array(c) for c in columns[1:]]
                        yield pa.RecordBatch.from_arrays(arrays, names)

        kinds = "tree int, node int, feature int, bin int, n long, w double, " + ", ".join(f"s{i} double" for i in range(self.sums))
        out = rows.mapInArrow(run, kinds)
        totals = [F.sum(c).alias(c) for c in names[4:]]
        out = out.groupBy(*names[:4]).agg(*totals)
        self.rows = rows
        return out

    def _best(self, histograms: DataFrame) -> list:
        """Per open node its totals, and the best cut with the sums to its left, or null."""
        s = self.settings
        part = Window.partitionBy("tree", "node", "feature")
        upto = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        names = ["n", "w", *[f"s{i}" for i in range(self.sums)]]
        seen = histograms.select("tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l_{c}") for c in names], *[F.sum(c).over(part).alias(c) for c in names])

        def worth(total, weight):
            return F.coalesce(F.try_divide(total * total, weight + F.lit(s.reg_lambda)), F.lit(0.0))

        gain = sum(worth(F.col(f"l_{c}"), F.col("l_w")) + worth(F.col(c) - F.col(f"l_{c}"), F.col("w") - F.col("l_w")) - worth(F.col(c), F.col("w")) for c in names[2:])
        least = max(1, s.min_samples_leaf)
        fits = (F.col("l_n") >= least) & (F.col("n") - F.col("l_n") >= least)
        own = sum(worth(F.col(c), F.col("w")) for c in names[2:])
        seen = seen.withColumn("gain", F.when(fits & (gain > 1e-9 * own + 1e-12), gain.cast("float")))
        rank = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
        cut = F.max(F.when(F.col("gain").isNotNull(), F.struct(rank.alias("rank"), "feature", "bin", *[f"l_{c}" for c in names])))
        return seen.groupBy("tree", "node").agg(cut.alias("cut"), *[F.max_by(c, F.struct("feature", "bin")).alias(c) for c in names]).collect()  # a row per open node

    def grow(self, numbers: list[int]) -> dict[int, Tree]:
        """New trees with these numbers, grown together."""
        s = self.settings
        growing = {t: Tree() for t in numbers}
        for tree in growing.values():
            tree.add([0.0] * self.sums)
        open_nodes = {t: [0] for t in numbers}
        depth = 0
        while open_nodes:
            found = self._best(self._histograms({t: growing[t] for t in open_nodes}, open_nodes))
            after: dict[int, list[int]] = {}
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                tree, sums = growing[r["tree"]], [r[f"s{i}"] for i in range(self.sums)]
                if r["node"] == 0:
                    tree.value[0] = [x / (r["w"] + s.reg_lambda) for x in sums]
                cut = r["cut"]
                if cut is None or r["n"] < s.min_samples_split or (s.max_depth is not None and depth >= s.max_depth):
                    continue
                sides = []
                for sign in (1, -1):
                    w = cut["l_w"] if sign > 0 else r["w"] - cut["l_w"]
                    left = [cut[f"l_s{i}"] for i in range(self.sums)]
                    sides.append([(x if sign > 0 else a - x) / (w + s.reg_lambda) for x, a in zip(left, sums)])
                counts = (cut["l_n"], r["n"] - cut["l_n"])
                for child, n in zip(tree.split(r["node"], cut["feature"], cut["bin"], (sides[0], sides[1])), counts):
                    if n >= max(s.min_samples_split, 2 * s.min_samples_leaf, 2) and (s.max_depth is None or depth + 1 < s.max_depth):
                        after.setdefault(r["tree"], []).append(child)
            open_nodes, depth = after, depth + 1
        return growing

    def _fix(self) -> None:
        """The rows with their predictions so far, as a table."""
        shared = self.rows.sparkSession.sparkContext.broadcast(list(self.trees))
        rows, self.rows, fixed, me = self.rows, None, self.fixed, self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = me._walk(pa.Table.from_batches([batch]), shared.value, fixed)[3]
                packed = pa.array([r.astype("<f8").tobytes() for r in made], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["hash", "y", "bins", "fixed"])

        out = cut_lineage(rows.mapInArrow(run, rows.schema))
        self.rows, self.fixed = out, len(self.trees)

    def fit(self) -> list[Tree]:
        s = self.settings
        if s.loss is None:
            self.trees = list(self.grow(list(range(s.trees))).values())
            return self.trees
        for step in range(s.trees):
            if step and step % FIXED_ROUNDS == 0:
                self._fix()
            self.trees += self.grow([step * self.outputs + i for i in range(self.outputs)]).values()
        return self.trees


class TreesEstimator(Estimator):
    """Fits ``features`` (vector) and ``label``; the rows also carry the key columns of the settings."""

    def __init__(self, settings: Settings | None = None):
        super().__init__()
        self.settings = settings or Settings()

    def _fit(self, dataset: DataFrame) -> TreesModel:
        s = self.settings
        hashed = seeded_hash(s.seed, *s.keys) if s.keys else F.pmod(F.xxhash64(F.lit(s.seed), "features", "label"), F.lit(HASH_TOP))
        rows = dataset.select(hashed.alias("hash"), F.col("label").cast("double").alias("y"), vector_to_array("features").alias("x"))
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            raise ValueError("there are no rows to fit")
        cuts = cut_points(rows, first["n"], s.max_bins)
        grower = Grower(binned(rows, cuts), cuts, s)
        trees = grower.fit()
        made = [
            {"feature": t.feature, "left": t.left, "right": t.right, "value": t.value, "most": [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)]}
            for t in trees
        ]
        model = {"trees": made, "base": grower.base, "outputs": grower.outputs, "loss": s.loss, "classes": s.classes, "rate": s.learning_rate}
        return TreesModel(json.dumps(model))


class TreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``, and ``probability`` for classes. Saved and loaded like any Spark model."""

    trees = Param(Params._dummy(), "trees", "the trees, as JSON", TypeConverters.toString)

    def __init__(self, trees: str | None = None):
        super().__init__()
        if trees is not None:
            self._set(trees=trees)

    def described(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self.described())  # the model

        @F.pandas_udf("array<double>")
        def made(x: pd.Series) -> pd.Series:
            return pd.Series(list(_predict(shared.value, np.stack(x.to_numpy()).astype(float))) if len(x) else [])

        model = self.described()
        out = dataset.withColumn("_made", made(vector_to_array("features")))
        if not model["classes"]:
            return out.withColumn("prediction", F.col("_made")[0]).drop("_made")
        best = F.array_position("_made", F.array_max("_made")) - 1
        return out.withColumn("probability", array_to_vector("_made")).withColumn("prediction", best.cast("double")).drop("_made")


def _predict(model: dict, x: np.ndarray) -> np.ndarray:
    """One row of outputs per row: the value, or a probability per class."""
    trees = model["trees"]
    values = []
    for t in trees:
        tree = Tree(t["feature"], [], t["left"], t["right"], t["value"])
        values.append(np.array(t["value"])[tree.leaves(x, np.array(t["most"]))])
    if model["loss"] is None:
        mean = np.mean(values, axis=0)
        if not model["classes"]:
            return mean + model["base"]
        total = mean.sum(axis=1, keepdims=True)
        return np.divide(mean, total, out=np.full_like(mean, 1 / mean.shape[1]), where=total > 0)
    made = np.full((len(x), model["outputs"]), model["base"])
    for i, v in enumerate(values):
        made[:, i % model["outputs"]] += model["rate"] * v[:, 0]
    if model["loss"] == "squared":
        return made
    if model["outputs"] == 1:
        p = 1 / (1 + np.exp(-made[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(made - made.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
