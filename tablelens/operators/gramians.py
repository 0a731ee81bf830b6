"""Linear models of many settings and folds from sums of products by fold.

One scan adds up, for each fold, the number of rows, sums, and sums of products of features and label, taken
from the means so that large values cancel nothing. A training set is the total less one fold, and the squared
error on the fold follows from the fold's own sums: settings and folds cost small systems of equations in the
driver, whose size is the number of features, and no further scan.

The penalty is MLlib's: on coefficients of features of unit variance, or as they are, with the squares
divided by the deviation of the label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.session import importable

#: Coordinate descent ends when no coefficient moves by this share of the label's deviation.
TOLERANCE, SWEEPS = 1e-12, 100_000


@dataclass(frozen=True)
class Penalty:
    amount: float = 0.0
    absolute: float = 0.0  # the share of the penalty on absolute values; the rest is on squares
    standard: bool = True


def fold_moments(rows: DataFrame) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Means of (features, label), and by fold the products of (features - means, label - mean, 1) with themselves.

    rows: (features, label, fold). Rows without a label or a fold are left out; a missing feature makes all
    that depends on it missing.
    """
    importable(rows.sparkSession)
    known = rows.filter("label is not null and fold is not null")
    known = known.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))
    first = known.select(F.size("x").alias("n")).first()
    if first is None:
        return np.zeros(0), {}
    size = first["n"]
    means = np.array(known.agg(*(F.avg(F.col("x")[i]) for i in range(size)), F.avg("label")).first(), float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.stack(batch["x"]).reshape(len(batch), size), batch["label"]]) - means
            x = np.column_stack([x, np.ones(len(x))])
            for fold, at in batch.groupby("fold").indices.items():
                sums[fold] = sums.get(fold, 0.0) + x[at].T @ x[at]
        for fold, own in sums.items():
            yield pd.DataFrame({"fold": fold, "place": np.arange(own.size), "value": own.ravel()})

    found = known.mapInPandas(run, "fold int, place int, value double").groupBy("fold", "place").agg(F.sum("value").alias("value"))
    moments: dict[int, np.ndarray] = {}
    for r in found.collect():
        moments.setdefault(r["fold"], np.zeros((size + 2) ** 2))[r["place"]] = r["value"]
    return means, {fold: own.reshape(size + 2, size + 2) for fold, own in moments.items()}


def _shrunk(value: float, by: float) -> float:
    return np.sign(value) * max(abs(value) - by, 0.0)


def solve(moments: np.ndarray, penalty: Penalty) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of features and label less their means; constant features get 0."""
    n = moments[-1, -1]
    size = len(moments) - 2
    coefficients = np.zeros(size)
    if not n:
        return coefficients, 0.0
    mean = moments[:-1, -1] / n
    spread = moments[:-1, :-1] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(spread), 0.0))
    # what rounding leaves of a constant
    used = np.flatnonzero(deviation[:size] > 1e-12 * (1 + np.abs(mean[:size])))
    label = deviation[size]
    if len(used) and label > 0:
        scale = deviation[used]
        gram = spread[np.ix_(used, used)] / np.outer(scale, scale)
        along = spread[used, size] / (scale * label)
        weight = np.ones(len(used)) if penalty.standard else 1 / scale
        amount = penalty.amount / label
        squares = amount * (1 - penalty.absolute) * weight**2
        absolute = amount * penalty.absolute * weight
        if absolute.any():
            found = _descend(gram, along, squares, absolute)
        else:
            found = np.linalg.lstsq(gram + np.diag(squares), along, rcond=None)[0]
        coefficients[used] = found * label / scale
    return coefficients, float(mean[size] - coefficients @ mean[:size])


def _descend(gram: np.ndarray, along: np.ndarray, squares: np.ndarray, absolute: np.ndarray) -> np.ndarray:
    """The minimum by coordinates; a sweep over the ones that are not zero is repeated until they rest."""
    b = np.zeros(len(along))
    for sweep in range(SWEEPS):
        every = sweep % 10 == 0
        moved = 0.0
        for j in range(len(b)) if every else np.flatnonzero(b):
            new = _shrunk(along[j] - gram[j] @ b + gram[j, j] * b[j], absolute[j]) / (gram[j, j] + squares[j])
            moved, b[j] = max(moved, abs(new - b[j])), new
        if every and moved < TOLERANCE:
            break
    return b


def squared_error(moments: np.ndarray, coefficients: np.ndarray, intercept: float) -> float:
    """Mean squared error over the rows of the moments."""
    direction = np.concatenate([-coefficients, [1.0, -intercept]])
    return max(0.0, float(direction @ moments @ direction)) / moments[-1, -1] if moments[-1, -1] else 0.0


def cross_validated(rows: DataFrame, penalties: list[Penalty], folds: int) -> list[float]:
    """For each penalty the mean over the folds of the root mean squared error on the fold left out."""
    means, moments = fold_moments(rows)
    if not moments:
        return [0.0] * len(penalties)
    empty = np.zeros((len(means) + 1,) * 2)
    total = sum(moments.values(), empty)
    scores = []
    for penalty in penalties:
        errors = []
        for fold in range(folds):
            own = moments.get(fold, empty)
            errors.append(sqrt(squared_error(own, *solve(total - own, penalty))))
        scores.append(float(np.mean(errors)))
    return scores
