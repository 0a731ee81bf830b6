"""Cross-validation of logistic regression for two classes, all penalties and folds in the same passes.

Rows are kept as blocks of numbers. A pass adds up, for each model, loss, gradient and curvature over the
rows outside its fold; the driver sees these sums and takes a Newton step with the penalty in it, by coordinates
where it holds absolute values, and halves a step that does not lower the loss. What is minimized is what MLlib minimizes:
the mean log loss plus the penalty of coefficients of features with variance one, the intercept free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.classtrees import weighted_f1
from tablelens.operators.gramians import Penalty
from tablelens.session import importable

#: Rows of a block, features up to which curvatures are added up, passes at most, and the fall of the loss that ends them.
BLOCK, WIDEST, PASSES, ENOUGH = 1 << 14, 64, 100, 1e-10


def _blocks(rows: DataFrame) -> DataFrame:
    """(x, y, fold) of many rows each, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(batch.column(0).flatten().to_numpy(zero_copy_only=False))
                y, fold = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int16) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (x, y, fold)], names=["x", "y", "fold"])

    return rows.select("x", "label", "fold").mapInArrow(run, "x binary, y binary, fold binary")


def _unpacked(row, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["x"]).reshape(-1, features), np.frombuffer(row["y"], np.int16), np.frombuffer(row["fold"], np.int16)


def _step(w: np.ndarray, g: np.ndarray, h: np.ndarray, flat: np.ndarray, square: np.ndarray) -> np.ndarray:
    """The step that minimizes g d + d h d / 2 + |flat (w + d)| + square (w + d)^2 / 2."""
    if not flat.any():
        return -np.linalg.lstsq(h + np.diag(square), g + square * w, rcond=None)[0]
    d, curve = np.zeros_like(w), np.diag(h) + square
    for _ in range(1000):
        moved = 0.0
        for j in np.flatnonzero(curve > 1e-12):
            pull = g[j] + h[j] @ d + square[j] * (w[j] + d[j])
            free = w[j] + d[j] - pull / curve[j]
            new = np.sign(free) * max(abs(free) - flat[j] / curve[j], 0.0) - w[j]
            moved, d[j] = max(moved, abs(new - d[j])), new
        if moved < 1e-12:
            break
    return d


def cross_validated(rows: DataFrame, penalties: list[Penalty], folds: int) -> list[float] | None:
    """The mean F1 over the folds for each penalty; rows: (features, label 0 or 1, fold).

    None if it is left to MLlib: other labels, a fold whose rows or whose others are of one class, missing
    values, or too many features. Rows without a label are left out; a constant feature has no say.
    """
    spark = rows.sparkSession
    importable(spark)
    known = rows.filter("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))
    first = known.first()
    features = len(first["x"]) if first else 0
    if not 0 < features <= WIDEST or known.filter("label not in (0, 1)").limit(1).count():
        return None
    held = _blocks(known).rdd.map(lambda r: _unpacked(r, features)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _scores(held, penalties, folds, features)
    finally:
        held.unpersist()


def _moments(blocks) -> Iterator[dict[int, np.ndarray]]:
    """By fold: rows, ones, and the sum of each feature."""
    for x, y, fold in blocks:
        yield {int(f): np.concatenate([[(fold == f).sum(), y[fold == f].sum()], x[fold == f].sum(axis=0)]) for f in np.unique(fold)}


def _around(blocks, centre: np.ndarray) -> Iterator[dict[int, np.ndarray]]:
    """By fold: sums of features less the centre, and of their squares."""
    for x, _, fold in blocks:
        off = x - centre
        yield {int(f): np.stack([off[fold == f].sum(axis=0), (off[fold == f] ** 2).sum(axis=0)]) for f in np.unique(fold)}


def _added(a, b):
    return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}


def _scores(held, penalties: list[Penalty], folds: int, features: int) -> list[float] | None:
    tasks = max(1, held.getNumPartitions())
    sums = held.mapPartitions(_moments).treeReduce(_added, 2 if tasks > 64 else 1)
    by_fold = [sums.get(f, np.zeros(2 + features)) for f in range(folds)]
    whole = sum(sums.values())
    others = [whole - s for s in by_fold]
    if not np.isfinite(whole).all() or any(not 0 < s[1] < s[0] for s in [*by_fold, *others]):
        return None
    centre = whole[2:] / whole[0]
    around = held.mapPartitions(lambda blocks: _around(blocks, centre)).treeReduce(_added, 2 if tasks > 64 else 1)
    total = sum(around.values())

    def deviation(s: np.ndarray, n: float) -> np.ndarray:
        return np.sqrt(np.maximum(s[1] - s[0] ** 2 / n, 0.0) / max(n - 1, 1))

    scale = deviation(total, whole[0])
    used = scale > 1e-12 * np.maximum(np.abs(centre), 1e-300)
    wide, models = int(used.sum()) + 1, [(p, f) for p in penalties for f in range(folds)]
    own = [deviation(total - around.get(f, 0), others[f][0])[used] / scale[used] for f in range(folds)]
    flat, square = np.zeros((len(models), wide)), np.zeros((len(models), wide))
    for m, (p, f) in enumerate(models):
        flat[m, 1:], square[m, 1:] = p.amount * p.absolute * own[f], p.amount * (1 - p.absolute) * own[f] ** 2
    fold_of, n = np.array([f for _, f in models]), np.array([others[f][0] for _, f in models])
    pairs = np.triu_indices(wide)

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), ((x - centre) / np.where(used, scale, 1.0))[:, used]])

    def passed(w: np.ndarray):
        def run(blocks) -> Iterator[np.ndarray]:
            out = np.zeros((len(models), 1 + wide + len(pairs[0])))
            for whole_x, whole_y, whole_fold in blocks:
                for at in range(0, len(whole_y), BLOCK):
                    x, y = scaled(whole_x[at : at + BLOCK]), whole_y[at : at + BLOCK, None]
                    there = whole_fold[at : at + BLOCK, None] != fold_of
                    z = x @ w.T
                    out[:, 0] += (there * (np.logaddexp(0, z) - y * z)).sum(axis=0)
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    out[:, 1 : 1 + wide] += (there * (p - y)).T @ x
                    out[:, 1 + wide :] += (there * (p * (1 - p))).T @ (x[:, pairs[0]] * x[:, pairs[1]])
            yield out

        return held.mapPartitions(run).treeReduce(np.add, 2 if tasks > 64 else 1) / n[:, None]

    w, d = np.zeros((len(models), wide)), np.zeros((len(models), wide))
    size, before, open_ = np.ones(len(models)), np.full(len(models), np.inf), np.ones(len(models), bool)
    for _ in range(PASSES):
        tried = w + size[:, None] * d
        found = passed(tried)
        loss = found[:, 0] + (flat * np.abs(tried)).sum(axis=1) + (square * tried**2).sum(axis=1) / 2
        for m in np.flatnonzero(open_):
            if loss[m] > before[m] + 1e-14 * abs(before[m]):
                size[m] /= 2
                open_[m] = size[m] > 1e-6
                continue
            open_[m] = not before[m] - loss[m] <= ENOUGH * abs(loss[m])
            w[m], before[m], size[m] = tried[m], loss[m], 1.0
            h = np.zeros((wide, wide))
            h[pairs] = found[m, 1 + wide :]
            d[m] = _step(w[m], found[m, 1 : 1 + wide], h + np.triu(h, 1).T, flat[m], square[m]) if open_[m] else 0.0
        d[~open_] = 0.0
        if not open_.any():
            break

    def confused(blocks) -> Iterator[np.ndarray]:
        out = np.zeros((len(models), 4))
        for x, y, fold in blocks:
            said = scaled(x) @ w.T > 0
            for m, f in enumerate(fold_of):
                at = fold == f
                out[m] += np.bincount(2 * y[at] + said[at, m], minlength=4)
        yield out

    counts = held.mapPartitions(confused).treeReduce(np.add, 2 if tasks > 64 else 1)
    scores = np.array([weighted_f1(c.reshape(2, 2)) for c in counts]).reshape(len(penalties), folds)
    return [float(x) for x in scores.mean(axis=1)]
