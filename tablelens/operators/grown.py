"""Single trees, random forests and gradient-boosted trees of whole grids, grown from cells.

Rows that are equal in all bins and in their fold are added up in Spark as one cell: how many of each class, or
how many with which sum and sum of squares of their labels. Trees over bins need no more than that, so their work
depends on the combinations of bins that occur and no longer on the rows. If all cells are small by their counted
bytes, tasks get a copy and grow a tree or a chain of trees each; else the caller trains row by row (`tune` gives None).

A tree of less depth is the beginning of a deeper one, so are fewer trees of a forest and fewer rounds: each
is grown once for all of them. Forests draw how often each row of a cell is taken: for classes a Poisson number around
the count, which is what single rows drawn so add up to; for numbers also a normal sum of labels with the mean and
variance that so many drawn rows have. Boosting is that of MLlib: a first tree on the labels, then `rate` times
trees on the negative gradients, for two classes of the log loss, for numbers of the squared error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.boosted import cuts_of
from tablelens.operators.classtrees import draws, weighted_f1
from tablelens.session import importable

#: Bytes of all cells up to which tasks get a copy of them.
COPIED = 1 << 27
#: Rows added up at a time, and numbers in the histograms of the nodes that are cut at a time.
ROWS, CHUNK = 1 << 20, 1 << 23
#: Cells whose predictions are added up at a time.
SCORED = 1 << 16


@dataclass(frozen=True)
class GrownPlan:
    """How one model is grown: on all rows but those of one fold. No classes: the label is a number."""

    kind: str = "tree"  # or "forest", "boosted"
    classes: int = 0
    depth: int = 5
    trees: int = 1
    bins: int = 32
    impurity: str = "gini"  # or "entropy"
    subset: str = "all"  # "sqrt", "log2", "onethird" or "all" of the features a node looks at
    rate: float = 0.1
    seed: int = 42

    @property
    def family(self) -> GrownPlan:
        """What models have in common of which one is the beginning of the other."""
        return replace(self, depth=self.depth if self.kind == "boosted" else 0, trees=0)


@dataclass
class GrownTree:
    """Nodes from the root on: left is the first of two children, or -1; values are class counts, or (n, sum)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray


@dataclass
class Cells:
    """bins: (features, cells); stats: (classes, cells) counts, or n, sum and squares of labels less their mean."""

    bins: np.ndarray
    fold: np.ndarray
    stats: np.ndarray
    wide: int


def looked_at(subset: str, features: int) -> int:
    share = {"all": features, "sqrt": ceil(sqrt(features)), "log2": ceil(log2(features)), "onethird": ceil(features / 3)}
    return max(1, share[subset])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(features, rows): how many cuts lie under the value; missing values come last."""
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]).astype(np.uint8)


def _worth(stats: np.ndarray, plan: GrownPlan) -> np.ndarray:
    """Less the impurity of the last axis, times the rows, but for what all cuts of a node have in common."""
    if not plan.classes:
        n, s = stats[..., 0], stats[..., 1]
        return np.divide(s * s, n, out=np.zeros_like(s), where=n > 0)
    n = stats.sum(axis=-1)
    if plan.impurity == "gini":
        return np.divide((stats * stats).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0)
    share = np.divide(stats, n[..., None], out=np.ones_like(stats), where=(n[..., None] > 0) & (stats > 0))
    return (stats * np.log2(share)).sum(axis=-1)


def _rows_of(stats: np.ndarray, plan: GrownPlan) -> np.ndarray:
    return stats.sum(axis=-1) if plan.classes else stats[..., 0]


def _best_cuts(hist: np.ndarray, heap: np.ndarray, plan: GrownPlan) -> tuple[np.ndarray, ...]:
    """For (nodes, features, bins, stats): feature (-1 if no cut gains), cut, and stats on both sides."""
    nodes, features, wide, _ = hist.shape
    left = np.cumsum(hist, axis=2)
    total, left = left[:, 0, -1], left[:, :, :-1]
    right = total[:, None, None] - left
    both = _worth(left, plan) + _worth(right, plan)
    gain = both - _worth(total, plan)[:, None, None]
    fits = (_rows_of(left, plan) > 0) & (_rows_of(right, plan) > 0) & (gain > 1e-12 * np.maximum(np.abs(both), 1e-300))
    looked = looked_at(plan.subset, features)
    if looked < features:
        order = np.argsort(draws(plan.seed, heap, features, 1), axis=1, kind="stable")
        fits &= (np.argsort(order, axis=1, kind="stable") < looked)[:, :, None]
    flat = np.where(fits, gain, -np.inf).reshape(nodes, -1)
    best, at = np.argmax(flat, axis=1), np.arange(nodes)
    feature, cut = np.unravel_index(best, (features, wide - 1))
    return np.where(np.isfinite(flat[at, best]), feature, -1), cut, left[at, feature, cut], right[at, feature, cut]


def grow(bins: np.ndarray, stats: np.ndarray, wide: int, plan: GrownPlan) -> GrownTree:
    """One tree of (features, cells) and (stats, cells), level by level; only nodes that were cut go on."""
    features = len(bins)
    values, feature, cut, left = [stats.sum(axis=1)[None]], [], [], []
    alive = np.flatnonzero(_rows_of(stats.T, plan) > 0)
    bins, stats = bins[:, alive], stats[:, alive]
    node, heap, made = np.zeros(len(alive), np.int64), np.ones(1, np.int64), 1
    step = max(1, CHUNK // (features * wide * len(stats)))
    for _ in range(plan.depth if wide > 1 else 0):
        if not len(node):
            break
        if len(heap) > step:
            order = np.argsort(node, kind="stable")
            bins, stats, node = bins[:, order], stats[:, order], node[order]
        found = []
        for low in range(0, len(heap), step):
            own = slice(*np.searchsorted(node, [low, low + step])) if len(heap) > step else slice(None)
            nodes = min(step, len(heap) - low)
            key, hist = (node[own] - low) * wide, np.empty((nodes, features, wide, len(stats)))
            for f in range(features):
                place = key + bins[f, own]
                for s in range(len(stats)):
                    hist[:, f, :, s] = np.bincount(place, stats[s, own], nodes * wide).reshape(nodes, wide)
            found.append(_best_cuts(hist, heap[low : low + step], plan))
        by, at, lower, upper = (np.concatenate(x) for x in zip(*found, strict=True))
        split = by >= 0
        rank = np.cumsum(split) - 1
        feature.append(by)
        cut.append(at)
        left.append(np.where(split, made + 2 * rank, -1))
        values.append(np.stack([lower[split], upper[split]], axis=1).reshape(-1, len(stats)))
        made += 2 * int(split.sum())
        heap = np.stack([2 * heap[split], 2 * heap[split] + 1], axis=1).ravel()
        stay = np.flatnonzero(split[node])
        bins, stats, node = bins[:, stay], stats[:, stay], node[stay]
        node = 2 * rank[node] + (bins[by[node], np.arange(len(node))] > at[node])
    ends = made - sum(map(len, feature))
    nothing = np.full(ends, -1)
    whole = [np.concatenate([*x, nothing]) for x in (feature, cut, left)]
    return GrownTree(whole[0].astype(np.int16), whole[1].astype(np.int16), whole[2].astype(np.int32), np.concatenate(values))


def node_of(tree: GrownTree, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of each column after so many levels."""
    node, at = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(depth):
        left = tree.left[node]
        if not (left >= 0).any():
            break
        node = np.where(left >= 0, left + (bins[tree.feature[node], at] > tree.cut[node]), node)
    return node


def _said(tree: GrownTree, plan: GrownPlan) -> np.ndarray:
    """What each node says: shares of the classes, or the mean label."""
    n = np.maximum(_rows_of(tree.value, plan), 1e-300)
    return tree.value / n[:, None] if plan.classes else tree.value[:, 1] / n


def _numbers(plan: GrownPlan) -> GrownPlan:
    """As trees of boosting are grown: on numbers, whatever the label."""
    return replace(plan, classes=0, subset="all")


def prediction(plan: GrownPlan, trees: list[GrownTree], bins: np.ndarray, counts: list[int], depth: int) -> np.ndarray:
    """(counts, columns): what the first so many trees say, cut at a depth."""
    inner = _numbers(plan) if plan.kind == "boosted" else plan
    total = np.zeros((bins.shape[1], plan.classes) if inner.classes else bins.shape[1])
    out = np.zeros((len(counts), bins.shape[1]))
    for i, tree in enumerate(trees, 1):
        own = _said(tree, inner)[node_of(tree, bins, depth)]
        total = total + own * (plan.rate if plan.kind == "boosted" and i > 1 else 1.0)
        for k in (k for k, n in enumerate(counts) if n == i):
            if plan.kind == "boosted":
                out[k] = total > 0 if plan.classes else total
            else:
                out[k] = np.argmax(total, axis=1) if plan.classes else total / i
    return out


def _errors(plan: GrownPlan, said: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Of cells, for each row of said: counts by (class, prediction), or the squared error and the rows."""
    if plan.classes:
        k = plan.classes
        by_class = [[np.bincount(own.astype(np.int64), stats[c], k) for c in range(k)] for own in said]
        return np.array(by_class).reshape(len(said), k * k)
    n, s, squares = stats
    return np.stack([(n * said * said - 2 * said * s + squares).sum(axis=1), np.full(len(said), n.sum())], axis=1)


def _score(plan: GrownPlan, errors: np.ndarray) -> float:
    """Weighted F1, or the root mean squared error."""
    if plan.classes:
        return weighted_f1(errors.reshape(plan.classes, plan.classes))
    return sqrt(max(errors[0], 0.0) / errors[1]) if errors[1] else 0.0


def _bag(stats: np.ndarray, plan: GrownPlan, tree: int) -> np.ndarray:
    """What a draw of as many rows with replacement takes of each cell."""
    rng = np.random.default_rng([plan.seed, tree])
    if plan.classes:
        return rng.poisson(stats).astype(float)
    n, s, squares = stats
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    variance = np.maximum(np.divide(squares, n, out=np.zeros_like(s), where=n > 0) - mean * mean, 0.0)
    taken = rng.poisson(n).astype(float)
    return np.stack([taken, taken * mean + np.sqrt(taken * variance) * rng.standard_normal(len(n))])


def _targets(stats: np.ndarray, plan: GrownPlan, state: np.ndarray, first: bool) -> np.ndarray:
    """(n, sum) of what the next tree of a chain is grown on."""
    if not plan.classes:
        n, s = stats[0], stats[1]
        return np.stack([n, s if first else 2 * (s - n * state)])
    no, yes = stats[0], stats[1]
    if first:
        return np.stack([no + yes, yes - no])
    with np.errstate(over="ignore"):
        return np.stack([no + yes, 4 * yes / (1 + np.exp(2 * state)) - 4 * no / (1 + np.exp(-2 * state))])


def _chain(cells: Cells, plan: GrownPlan, fold: int, rounds: list[int]) -> tuple[list[GrownTree], np.ndarray | None]:
    """Boosted trees of one plan, and their errors on the fold after so many rounds."""
    inner, learned = _numbers(plan), cells.fold != fold
    bins, stats, state, trees = cells.bins[:, learned], cells.stats[:, learned], np.zeros(learned.sum()), []
    for i in range(plan.trees):
        tree = grow(bins, _targets(stats, plan, state, not i), cells.wide, inner)
        state = state + (plan.rate if i else 1.0) * _said(tree, inner)[node_of(tree, bins, plan.depth)]
        trees.append(tree)
    return trees, _fold_errors(cells, plan, trees, fold, {plan.depth: rounds})[plan.depth] if fold >= 0 else None


def _fold_errors(cells: Cells, plan: GrownPlan, trees: list[GrownTree], fold: int, asked: dict[int, list[int]], part: int = 0, of: int = 1) -> dict[int, np.ndarray]:
    """For each depth the errors of the first so many trees, on one part of the cells of a fold."""
    own = np.flatnonzero(cells.fold == fold)[part::of]
    out = {}
    for depth, counts in asked.items():
        out[depth] = sum(
            (_errors(plan, prediction(plan, trees, cells.bins[:, at], counts, depth), cells.stats[:, at]) for at in np.array_split(own, max(1, len(own) // SCORED))),
            start=np.zeros((len(counts), plan.classes**2 or 2)),
        )
    return out


def cells_of(rows: DataFrame, cuts: list[np.ndarray], classes: int, folds: int, centre: float = 0.0) -> DataFrame:
    """(code, s0, s1, ...) of (x, label, fold): one row for each combination of bins and fold; fold -2 is for rows without."""
    wide = [len(c) + 1 for c in cuts]

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code, y = (np.concatenate(x) for x in zip(*held, strict=True))
        own, at = np.unique(code, return_inverse=True)
        if classes:
            stats = np.bincount(at * classes + y.astype(np.int64), minlength=len(own) * classes).reshape(-1, classes).T
        else:
            y = y - centre
            stats = np.stack([np.bincount(at), np.bincount(at, y), np.bincount(at, y * y)])
        return pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(s.astype(float)) for s in stats)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(wide))
            code = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + 2
            for size, own in zip(wide, binned(x, cuts), strict=True):
                code = code * size + own
            held.append((code, batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= ROWS:
                yield merged(held)
                held, n = [], 0
        if held:
            yield merged(held)

    names = ["code", *(f"s{i}" for i in range(classes or 3))]
    found = rows.select("x", "label", "fold").mapInArrow(run, ", ".join(["code long", *(f"{c} double" for c in names[1:])]))
    return found.groupBy("code").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _decoded(table: pa.Table, cuts: list[np.ndarray]) -> Cells:
    code = table.column("code").to_numpy()
    order = np.argsort(code)
    code, stats = code[order], np.stack([table.column(c).to_numpy()[order] for c in table.column_names[1:]])
    bins = []
    for c in reversed(cuts):
        code, own = np.divmod(code, len(c) + 1)
        bins.append(own.astype(np.uint8))
    return Cells(np.stack(bins[::-1]), (code - 2).astype(np.int16), stats, max(len(c) for c in cuts) + 1)


class GrownModel(Model):
    """Predicts by the trees of a plan; `like` is the estimator whose setting it was grown for."""

    def __init__(self, cuts: list[np.ndarray], plan: GrownPlan, trees: list[GrownTree], centre: float, like: Estimator | None = None):
        super().__init__()
        self.cuts, self.plan, self.trees, self.centre, self.like = cuts, plan, trees, centre, like

    def _transform(self, dataset: DataFrame) -> DataFrame:
        importable(dataset.sparkSession)
        cuts, plan, trees, centre = self.cuts, self.plan, self.trees, self.centre

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                if not len(x):
                    yield pd.Series(np.zeros(0))
                    continue
                bins = binned(np.stack(x).astype(float), cuts)
                yield pd.Series(prediction(plan, trees, bins, [len(trees)], plan.depth)[0] + centre)

        return dataset.withColumn("prediction", F.pandas_udf(run, "double")(vector_to_array("features")))


def tune(rows: DataFrame, plans: list[GrownPlan], folds: int, copied: int | None = None) -> tuple[GrownModel, int, float | None] | None:
    """The best plan by its mean score over the folds: its model on all rows, its place, its score.

    rows: (features, label, and fold if there are more plans than one). Rows without a label are left out; missing
    values lie above all others. None if the cells take more than `copied` bytes, or if there is nothing to learn from.
    """
    spark = rows.sparkSession
    importable(spark)
    fold = F.col("fold").cast("int") if len(plans) > 1 else F.lit(-2)
    known = rows.filter("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), fold.alias("fold"))
    facts = known.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()
    if not facts["n"]:
        return None
    centre = 0.0 if plans[0].classes else float(facts["mean"])
    wanted = [-1] if len(plans) == 1 else [*range(folds), -1]
    scores: dict[GrownPlan, float] = {}
    models: dict[GrownPlan, tuple] = {}
    for bins in sorted({p.bins for p in plans}):
        cuts = cuts_of(known, bins)
        own = [p for p in plans if p.bins == bins]
        # codes are longs
        if not cuts or sum(log2(len(c) + 1) for c in cuts) + log2(folds + 2) > 62:
            return None
        merged = cells_of(known, cuts, plans[0].classes, folds, centre).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if merged.count() * (len(cuts) + 2 + 8 * (plans[0].classes or 3)) > (COPIED if copied is None else copied):
                return None
            cells = _decoded(merged.toArrow(), cuts)
        finally:
            merged.unpersist()
        copy = spark.sparkContext.broadcast(cells)
        try:
            for family in dict.fromkeys(p.family for p in own):
                group = [p for p in own if p.family == family]
                trees, found = _grown_family(spark, copy, group, wanted)
                for p in group:
                    scores[p] = float(np.mean([found[p, f] for f in wanted[:-1]])) if len(wanted) > 1 else 0.0
                    models[p] = (cuts, trees)
        finally:
            copy.destroy()
    told = [scores[p] for p in plans]
    best = told.index(max(told) if plans[0].classes else min(told))
    cuts, trees = models[plans[best]]
    return GrownModel(cuts, plans[best], trees[: plans[best].trees], centre), best, told[best] if len(plans) > 1 else None


def _grown_family(spark, copy, group: list[GrownPlan], wanted: list[int]) -> tuple[list[GrownTree], dict[tuple[GrownPlan, int], float]]:
    """The trees of the largest plan on all rows, and the score of each plan on each fold."""
    context = spark.sparkContext
    whole = replace(group[0], depth=max(p.depth for p in group), trees=max(p.trees for p in group))
    asked = {d: sorted({p.trees for p in group if p.depth == d}) for d in sorted({p.depth for p in group})}
    # 1. trees
    if whole.kind == "boosted":

        def chain(fold: int):
            trees, errors = _chain(copy.value, whole, fold, asked[whole.depth])
            return (fold, trees if fold < 0 else [], {whole.depth: errors})

        done = context.parallelize(wanted, len(wanted)).map(chain).collect()
        trees, errors = next(t for f, t, _ in done if f < 0), {f: e for f, _, e in done if f >= 0}
    elif whole.trees == 1:

        def alone(fold: int):
            cells = copy.value
            learned = cells.fold != fold
            stats = cells.stats[:, learned] if whole.classes else cells.stats[:2, learned]
            own = [_one(cells.bins[:, learned], stats, cells.wide, whole, 0)]
            return (fold, own, {}) if fold < 0 else (fold, [], _fold_errors(cells, whole, own, fold, asked))

        done = context.parallelize(wanted, len(wanted)).map(alone).collect()
        trees, errors = next(t for f, t, _ in done if f < 0), {f: e for f, _, e in done if f >= 0}
    else:
        jobs = [(f, i) for f in wanted for i in range(whole.trees)]

        def one(job: tuple[int, int]):
            cells, (fold, i) = copy.value, job
            learned = cells.fold != fold
            bagged = _bag(cells.stats[:, learned], whole, i)
            return job, _one(cells.bins[:, learned], bagged, cells.wide, whole, i)

        grown = dict(context.parallelize(jobs, len(jobs)).map(one).collect())
        forests = {f: [grown[f, i] for i in range(whole.trees)] for f in wanted}
        trees, errors = forests[-1], {}
        if len(wanted) > 1:
            # 2. what a forest says of a part of its fold
            parts, sent = 8, context.broadcast({f: forests[f] for f in wanted[:-1]})

            def scored(job: tuple[int, int]):
                return job[0], _fold_errors(copy.value, whole, sent.value[job[0]], job[0], asked, job[1], parts)

            for fold, own in context.parallelize([(f, k) for f in wanted[:-1] for k in range(parts)], parts * len(wanted[:-1])).map(scored).collect():
                before = errors.setdefault(fold, {d: 0 for d in asked})
                errors[fold] = {d: before[d] + own[d] for d in asked}
            sent.destroy()
    return trees, {(p, f): _score(p, errors[f][p.depth][asked[p.depth].index(p.trees)]) for p in group for f in wanted[:-1]}


def _one(bins: np.ndarray, stats: np.ndarray, wide: int, plan: GrownPlan, number: int) -> GrownTree:
    return grow(bins, stats, wide, replace(plan, seed=plan.seed * 1_000_003 + number))
