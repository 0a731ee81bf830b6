"""Single classification trees of many settings and folds at once, with the best or with random cuts.

An extremely random tree draws one cut a feature and node, evenly between the least and the largest value that
the node holds, and takes the best of the drawn ones: a level is a pass for the ranges and one for the class
counts on both sides. A tree of best cuts counts classes by bin in one pass. Draws are hashes of (seed, node,
feature), so a tree does not depend on the partitioning. Copies of small tables and passes over large ones are
those of the boosted trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators import boosted
from tablelens.operators.boosted import Held, Spread, cuts_of
from tablelens.session import importable


@dataclass(frozen=True)
class TreePlan:
    impurity: str = "gini"  # or "entropy"
    subset: str = "all"  # "sqrt" or "log2" of the features a node looks at
    splitter: str = "best"  # or "random"
    depth: int = 5
    seed: int = 42
    fold: int = -1


@dataclass
class ClassTree:
    """A full binary tree by levels: values up to the cut go left, so do missing ones; feature -1 sends all left."""

    plan: TreePlan
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))  # of the last level: (nodes, classes)
    score: float | None = None


@dataclass
class Block:
    """x: (features, rows) of values; bins: how many cuts of the feature lie under each."""

    x: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray


def draws(seed: int, nodes: np.ndarray, features: int, use: int) -> np.ndarray:
    """(nodes, features) numbers from 0 to 1, each a hash of (seed, node, feature, use) by the splitmix64 steps."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(use)
        z = z + nodes.astype(np.uint64)[:, None] * np.uint64(0xBF58476D1CE4E5B9) + np.arange(1, features + 1, dtype=np.uint64)[None, :] * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / (1 << 53)


def looked_at(subset: str, features: int) -> int:
    return {"all": features, "sqrt": ceil(sqrt(features)), "log2": max(1, ceil(log2(features)))}[subset]


def _allowed(plan: TreePlan, varies: np.ndarray) -> np.ndarray:
    """Which features each node of a level looks at: the first in a drawn order that are not constant there."""
    nodes, features = varies.shape
    drawn = draws(plan.seed, np.arange(nodes) + nodes, features, 1)
    place = np.argsort(np.argsort(np.where(varies, drawn, 2.0), axis=1, kind="stable"), axis=1, kind="stable")
    return varies & (place < looked_at(plan.subset, features))


def impurity(counts: np.ndarray, kind: str) -> np.ndarray:
    """Of the last axis, times the number of rows."""
    n = counts.sum(axis=-1)
    share = np.divide(counts, n[..., None], out=np.zeros_like(counts, float), where=n[..., None] > 0)
    if kind == "gini":
        return n * (1 - (share * share).sum(axis=-1))
    logs = np.log2(share, out=np.zeros_like(share), where=share > 0)
    return -n * (share * logs).sum(axis=-1)


def node_of(tree: ClassTree, x: np.ndarray) -> np.ndarray:
    node, at = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    for _ in range((len(tree.feature) + 1).bit_length() - 1):
        feature = tree.feature[node]
        node = 2 * node + 1 + ((x[feature, at] > tree.cut[node]) & (feature >= 0))
    return node - len(tree.feature)


def _gathered(held: Spread | Held, trees: dict[int, ClassTree], each, combine, size: int) -> dict[int, np.ndarray]:
    def run(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        for b in blocks:
            for m, tree in trees.items():
                learned = b.fold != tree.plan.fold
                x = b.x[:, learned]
                yield m, each(m, tree, x, b.bins[:, learned], b.y[learned], node_of(tree, x))

    return held.gathered(run, combine=combine, size=size) if trees else {}


def _ranges(m: int, tree: ClassTree, x: np.ndarray, bins: np.ndarray, y: np.ndarray, node: np.ndarray) -> np.ndarray:
    """(2, nodes, features): the least value, negated, and the largest one."""
    out = np.full((2, len(tree.feature) + 1, len(x)), -np.inf)
    order = np.argsort(node, kind="stable")
    if len(order):
        starts = np.flatnonzero(np.diff(node[order], prepend=-1))
        for f, own in enumerate(np.where(np.isnan(x), np.inf, x)[:, order]):
            out[0, node[order][starts], f] = np.maximum.reduceat(-own, starts)
        for f, own in enumerate(np.where(np.isnan(x), -np.inf, x)[:, order]):
            out[1, node[order][starts], f] = np.maximum.reduceat(own, starts)
    return out


def _best_of(left: np.ndarray, right: np.ndarray, allowed: np.ndarray, plan: TreePlan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the best of its (features, cuts) by class counts on both sides, and what it gains."""
    both = left + right
    gain = impurity(both, plan.impurity) - impurity(left, plan.impurity) - impurity(right, plan.impurity)
    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0) & allowed[:, :, None], gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = np.argmax(flat, axis=1)
    feature, cut = np.unravel_index(best, gain.shape[1:])
    return feature, cut, flat[np.arange(len(flat)), best]


def _grow(held: Spread | Held, trees: dict[int, ClassTree], cuts: list[np.ndarray], classes: int) -> None:
    """One level more for all trees."""
    features = len(cuts)
    wide = max((len(c) for c in cuts), default=0) + 1
    drawn = {m: t for m, t in trees.items() if t.plan.splitter == "random"}
    exact = {m: t for m, t in trees.items() if t.plan.splitter != "random"}
    width = max(len(t.feature) + 1 for t in trees.values()) * features

    def counted(m: int, tree: ClassTree, x: np.ndarray, bins: np.ndarray, y: np.ndarray, node: np.ndarray) -> np.ndarray:
        size = (len(tree.feature) + 1) * features * wide * classes
        key = ((node * features + np.arange(features)[:, None]) * wide + bins) * classes + y
        return np.bincount(key.ravel(), minlength=size).reshape(-1, features, wide, classes)

    levels: dict[int, tuple] = {}
    for m, counts in _gathered(held, exact, counted, np.add, len(exact) * width * wide * classes * 8).items():
        plan = trees[m].plan
        left = np.cumsum(counts, axis=2)
        allowed = _allowed(plan, (counts.sum(axis=3) > 0).sum(axis=2) > 1)
        feature, cut, gain = _best_of(left, left[:, :, -1:] - left, allowed, plan)
        at = np.arange(len(left))
        value = np.array([cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(feature, cut, strict=True)])
        levels[m] = (feature, value, gain, left[at, feature, cut], left[at, feature, -1] - left[at, feature, cut], counts[:, 0].sum(axis=1))

    ranges = _gathered(held, drawn, _ranges, np.maximum, len(drawn) * width * 16)
    drawn_cuts = {}
    for m, (low, high) in ranges.items():
        low = -low
        share = draws(trees[m].plan.seed, np.arange(len(low)) + len(low), features, 2)
        with np.errstate(invalid="ignore"):
            cut = low + share * (high - low)
        # rounding may reach the largest value, which must stay on the right
        drawn_cuts[m] = np.where(low < high, np.where(cut >= high, low, cut), np.inf)

    def sided(m: int, tree: ClassTree, x: np.ndarray, bins: np.ndarray, y: np.ndarray, node: np.ndarray) -> np.ndarray:
        right = x > drawn_cuts[m][node].T
        key = ((node * features + np.arange(features)[:, None]) * 2 + right) * classes + y
        return np.bincount(key.ravel(), minlength=(len(tree.feature) + 1) * features * 2 * classes).reshape(-1, features, 2, classes)

    for m, counts in _gathered(held, {m: drawn[m] for m in ranges}, sided, np.add, len(drawn) * width * 2 * classes * 8).items():
        plan, (low, high) = trees[m].plan, ranges[m]
        feature, _, gain = _best_of(counts[:, :, :1], counts[:, :, 1:], _allowed(plan, -low < high), plan)
        at = np.arange(len(counts))
        levels[m] = (feature, drawn_cuts[m][at, feature], gain, counts[at, feature, 0], counts[at, feature, 1], counts[:, 0].sum(axis=1))

    for m, (feature, cut, gain, left, right, all_) in levels.items():
        none = ~(gain > 1e-12)
        left, right = np.where(none[:, None], all_, left), np.where(none[:, None], 0, right)
        tree = trees[m]
        tree.feature, tree.cut = np.append(tree.feature, np.where(none, -1, feature)), np.append(tree.cut, np.where(none, np.inf, cut))
        tree.counts = np.stack([left, right], axis=1).reshape(-1, classes)


def weighted_f1(confusion: np.ndarray) -> float:
    """Of (label, prediction) counts: the mean of the classes' F1, weighted by their labels."""
    hit, asked, said = np.diag(confusion), confusion.sum(axis=1), confusion.sum(axis=0)
    f1 = np.divide(2 * hit, asked + said, out=np.zeros(len(hit)), where=asked + said > 0)
    return float((f1 * asked).sum() / asked.sum()) if asked.sum() else 0.0


def _train_all(held: Spread | Held, trees: list[ClassTree], cuts: list[np.ndarray], classes: int) -> None:
    for level in range(max((t.plan.depth for t in trees), default=0)):
        _grow(held, {m: t for m, t in enumerate(trees) if level < t.plan.depth}, cuts, classes)

    def confused(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        for b in blocks:
            for m, tree in enumerate(trees):
                if tree.plan.fold >= 0:
                    own = b.fold == tree.plan.fold
                    said = np.argmax(tree.counts, axis=1)[node_of(tree, b.x[:, own])]
                    yield m, np.bincount(b.y[own] * classes + said, minlength=classes * classes).reshape(classes, classes)

    for m, confusion in held.gathered(confused).items():
        trees[m].score = weighted_f1(confusion)


def train(rows: DataFrame, plans: list[TreePlan], bins: int = boosted.BINS, cuts: list[np.ndarray] | None = None, copied: int | None = None) -> list[ClassTree]:
    """Train all plans on (features, label, and fold if there is one); labels are class numbers from 0.

    Rows without a label are left out. Without rows a tree says class 0. Trees with a fold are scored on it.
    """
    if max((p.depth for p in plans), default=0) > 15:
        raise ValueError("trees of this kind have 15 levels at most")
    spark = rows.sparkSession
    importable(spark)
    context = spark.sparkContext
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(-2)
    known = rows.filter("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"), fold.alias("fold"))
    facts = known.agg(F.count("*").alias("n"), F.max("label").alias("last")).first()
    trees = [ClassTree(p) for p in plans]
    if not facts["n"]:
        return trees
    cuts, classes = cuts_of(known, bins) if cuts is None else cuts, facts["last"] + 1
    if not cuts:
        raise ValueError("there are no features")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.ascontiguousarray(np.stack(batch["x"]).astype(float).T)
            made = [x, np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x, strict=True)]).astype(np.int16)]
            made += [batch["label"].to_numpy(np.int64), batch["fold"].to_numpy(np.int16)]
            yield pd.DataFrame([[c.tobytes() for c in made]], columns=["x", "bins", "y", "fold"])

    def unpacked(r) -> Block:
        y, shape = np.frombuffer(r["y"], np.int64), (len(cuts), -1)
        return Block(np.frombuffer(r["x"]).reshape(shape), np.frombuffer(r["bins"], np.int16).reshape(shape), y, np.frombuffer(r["fold"], np.int16))

    schema = "x binary, bins binary, y binary, fold binary"
    # ten bytes a value and ten a row
    if facts["n"] * 10 * (len(cuts) + 1) <= (boosted.COPIED if copied is None else copied):
        copy = context.broadcast([unpacked(r) for r in known.mapInPandas(run, schema).collect()])

        def alone(tree: ClassTree) -> ClassTree:
            _train_all(Held(copy.value), [tree], cuts, classes)
            return tree

        done = context.parallelize(list(enumerate(trees)), len(trees)).mapValues(alone).collect()
        copy.destroy()
        return [t for _, t in sorted(done, key=lambda x: x[0])]
    if known.rdd.getNumPartitions() < context.defaultParallelism:
        known = known.repartition(context.defaultParallelism, F.xxhash64("x", "label"))
    held = Spread(known.mapInPandas(run, schema).rdd.map(unpacked))
    try:
        _train_all(held, trees, cuts, classes)
    finally:
        held.drop()
    return trees


class ClassTreeModel(Model):
    """The most frequent class of the leaf; of equally frequent ones the first."""

    def __init__(self, tree: ClassTree):
        super().__init__()
        self.tree = tree

    def _transform(self, dataset: DataFrame) -> DataFrame:
        importable(dataset.sparkSession)
        tree = self.tree

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            said = np.argmax(tree.counts, axis=1).astype(float)
            for x in batches:
                yield pd.Series(said[node_of(tree, np.stack(x).astype(float).T)] if len(x) else np.zeros(0))

        return dataset.withColumn("prediction", F.pandas_udf(run, "double")(vector_to_array("features")))


class ClassTreeClassifier(Estimator):
    """One plan as an estimator over (features, label)."""

    def __init__(self, plan: TreePlan):
        super().__init__()
        self.plan = plan

    def _fit(self, dataset: DataFrame) -> ClassTreeModel:
        return ClassTreeModel(train(dataset, [self.plan])[0])


def tune(rows: DataFrame, plans: list[TreePlan], folds: int) -> tuple[ClassTreeModel, int, float | None]:
    """The plan with the best mean F1 over the folds: its tree on all rows, its place, its score."""
    wanted = [-1] if len(plans) == 1 else [*range(folds), -1]
    trees = train(rows, [replace(p, fold=fold) for p in plans for fold in wanted])
    own = [trees[i : i + len(wanted)] for i in range(0, len(trees), len(wanted))]
    scores = [float(np.mean([t.score or 0.0 for t in group[:-1]])) if len(group) > 1 else None for group in own]
    best = 0 if len(plans) == 1 else scores.index(max(scores))
    return ClassTreeModel(own[best][-1]), best, scores[best]
