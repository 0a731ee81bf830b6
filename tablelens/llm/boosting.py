"""Boosted regression trees of two levels for a yes-or-no target, small enough to read.

Rows count by their codes: how many cuts of each feature lie below. Rows equal in all codes and the target are one cell,
and trees grow from sums over cells by node, feature and code, so cells may lie in as many places as there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

ROUNDS, RATE, CUTS, LEAST, PENALTY = 60, 0.2, 16, 5, 1.0
#: Shares of the rows at which features are cut.
SHARES = np.linspace(0, 1, CUTS + 1)[:-1]
#: Codes of a feature; a cut at the last one parts nothing.
CODES = CUTS + 1


@dataclass(frozen=True)
class Trees:
    """Each tree: (feature, cut) of the root and of its two branches, and four leaf values."""

    start: float
    splits: np.ndarray  # trees x 3 x 2
    leaves: np.ndarray  # trees x 4

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for split, leaves in zip(self.splits, self.leaves, strict=True):
            z += leaves[_leaf(split, x)]
        return z

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass(frozen=True)
class Cells:
    """Codes (cells x features), targets, and how many rows each cell stands for."""

    codes: np.ndarray
    y: np.ndarray
    n: np.ndarray


#: A model on the way: its trees, by codes, and the root of the next one if that is known.
Grown = tuple[Trees, tuple[int, int] | None]


def _leaf(split: np.ndarray, x: np.ndarray) -> np.ndarray:
    right = x[:, int(split[0, 0])] > split[0, 1]
    below = np.where(right, x[:, int(split[2, 0])] > split[2, 1], x[:, int(split[1, 0])] > split[1, 1])
    return 2 * right + below


def codes_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts of its feature lie below each value."""
    return np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)


def sums_of(cells: Cells, grown: Grown) -> np.ndarray:
    """Gradients, weights and rows by node of the next tree (one, or two if its root is known), feature and code."""
    trees, root = grown
    p = 1 / (1 + np.exp(-trees.margin(cells.codes)))
    node = np.zeros(len(p), np.int64) if root is None else (cells.codes[:, root[0]] > root[1]).astype(np.int64)
    features = cells.codes.shape[1]
    at = ((node[:, None] * features + np.arange(features)) * CODES + cells.codes).ravel()
    told = (cells.n * (cells.y - p), cells.n * p * (1 - p), cells.n)
    wide = 2 * features * CODES
    return np.stack([np.bincount(at, np.repeat(v, features), wide) for v in told]).reshape(3, 2, features, CODES)


def _split(sums: np.ndarray) -> tuple[int, int]:
    """The feature and code beyond which to part with the largest gain, the first of equal ones; (0, CODES) if there is none."""
    below = sums.cumsum(axis=2)
    whole = below[:, :1, -1:]
    g, h, n = whole - below
    (total, mass, rows), best, choice = whole[:, 0, 0], 1e-9, (0, CODES)
    gains = g**2 / (h + PENALTY) + (total - g) ** 2 / (mass - h + PENALTY) - total**2 / (mass + PENALTY)
    gains = np.where((n >= LEAST) & (n <= rows - LEAST), gains, 0.0)
    for f, b in zip(*np.nonzero(gains > best), strict=True):
        if gains[f, b] > best * (1 + 1e-9):
            best, choice = gains[f, b], (int(f), int(b))
    return choice


def _leaves(sums: np.ndarray, sides: list[tuple[int, int]]) -> np.ndarray:
    """Values of the four leaves from the sums of both nodes and where these are parted."""
    values = []
    for side, (f, b) in enumerate(sides):
        g, h = sums[:2, side, f]
        values += [RATE * x.sum() / (w.sum() + PENALTY) for x, w in ((g[: b + 1], h[: b + 1]), (g[b + 1 :], h[b + 1 :]))]
    return np.array(values)


def grow(counts: dict[str, tuple[float, float]], passed: Callable[[dict[str, Grown]], dict[str, np.ndarray]]) -> dict[str, Trees]:
    """Trees by codes for each name with its numbers of rows and of rows with target 1.

    `passed` adds up `sums_of` for the models it is given, all names in one pass. Without rows trees say one half.
    """
    models = {}
    for name, (rows, ones) in counts.items():
        share = (ones + 0.5) / (rows + 1)
        models[name] = Trees(float(np.log(share / (1 - share))), np.zeros((0, 3, 2)), np.zeros((0, 4)))
    able = [k for k, (rows, ones) in counts.items() if rows >= 2 * LEAST and 0 < ones < rows]
    for _ in range(ROUNDS if able else 0):
        first = passed({k: (models[k], None) for k in able})
        roots = {k: _split(first[k][:, 0]) for k in able}
        second = passed({k: (models[k], roots[k]) for k in able})
        for k in able:
            sides = [_split(second[k][:, side]) for side in (0, 1)]
            split, old = np.array([roots[k], *sides], float), models[k]
            models[k] = Trees(old.start, np.append(old.splits, [split], 0), np.append(old.leaves, [_leaves(second[k], sides)], 0))
    return models


def valued(trees: Trees, cuts: list[np.ndarray]) -> Trees:
    """The same trees over values instead of codes."""
    splits = trees.splits.copy()
    for tree in splits:
        for node in tree:
            own = cuts[int(node[0])]
            node[1] = own[int(node[1])] if node[1] < len(own) else np.inf
    return Trees(trees.start, splits, trees.leaves)


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for (rows x features) and 0/1 targets; without rows they say one half."""
    cuts = [np.unique(np.quantile(column, SHARES)) for column in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
    cells = Cells(codes_of(x, cuts), np.asarray(y, float), np.ones(len(x)))
    grown = grow({"": (len(y), float(np.sum(y)))}, lambda models: {k: sums_of(cells, m) for k, m in models.items()})
    return valued(grown[""], cuts)


def added(parts: Iterable[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums by name, added up."""
    out: dict[str, np.ndarray] = {}
    for part in parts:
        for k, v in part.items():
            out[k] = out[k] + v if k in out else v
    return out
