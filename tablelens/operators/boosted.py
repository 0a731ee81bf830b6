"""Boosted regression trees of many settings and folds at once.

Rows are binned once and kept in blocks. If all blocks are small by their measured bytes, each task gets a copy
and trains models of its own. Beyond that the blocks stay spread over partitions, with a number a model: its
prediction so far, or the weight of the row, and all models grow their trees in step. A level is then one
pass in which each task adds up histograms of gradient and curvature by (model, node, feature, bin); only sums
leave the tasks, and where they are large they are added up and cut by Spark, model by model, so that the
driver sees the cuts alone. The number of passes depends on rounds and depth, not on the number of models.
Both ways run the same steps and give the same trees. A model of fewer rounds is the beginning of one
of more, so one run scores all of them.

Models differ in what a row adds: boosted trees its residual and one, AdaBoost.R2 (Drucker 1997) its weighted
label and weight. Its rows are sorted by fold and cell (rows equal in all bins): trees are grown from the sums of
cells, and a round goes through the rows twice, for the loss and for the new weights. A leaf is the sum of gradients over the sum of curvatures plus a penalty; a cut is worth what
it adds to the squares of the former over the latter, must reach a least gain, and sends missing values
to the side where that is better. Ordered boosting chooses its cuts by residuals of forerunners: rows are put in
parts of doubling size by a hash, and a forerunner with the same cuts has seen the parts before alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.session import importable, shared_dir

#: Bins of a feature besides the one of missing values, and rows of a block.
BINS, BLOCK = 64, 1 << 16
#: Rounds after which the rows are written to the shared folder, so that no lineage is longer.
ROUNDS_PER_CUT = 32
#: Bytes of histograms of all tasks up to which they are added up in the driver, else by Spark; and bytes of all
#: blocks up to which tasks get a copy of them.
GATHERED, COPIED = 1 << 25, 1 << 25
#: Rows whose weighted medians are taken at a time.
SORTED = 1 << 13
#: Rows of a piece, few enough for a core's cache, and of a partition of pieces.
PIECE, PIECES = 1 << 15, 1 << 17


@dataclass(frozen=True)
class Plan:
    """How one model is trained: on all rows but those of one fold."""

    kind: str = "gradient"  # or "adaboost"
    depth: int = 3
    rounds: int = 100
    rate: float = 0.1
    loss: str = "linear"  # of AdaBoost: linear, square or exponential
    penalty: float = 0.0
    least_gain: float = 0.0
    least_weight: float = 0.0
    alike: bool = False  # one cut for all nodes of a level
    ordered: bool = False  # cuts by residuals of models that have not seen the row
    fold: int = -1


@dataclass
class Tree:
    """A full binary tree over bins: nodes by level; feature -1 sends all rows left."""

    feature: np.ndarray
    cut: np.ndarray
    missing_right: np.ndarray
    value: np.ndarray


@dataclass
class Fitted:
    """What a plan has come to: trees, their say (AdaBoost), and mean squared errors on the held-out fold.

    errors: after each round; scores: after the rounds that were asked for.
    """

    plan: Plan
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    says: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    scores: dict[int, float] = field(default_factory=dict)
    open: bool = True


@dataclass
class Block:
    """Rows: bins (features, rows), labels, folds, parts of the permutation, and a number for each model.

    before: for each ordered model (PARTS + 1, rows), what its forerunners say; forerunner b has seen the parts under b.
    """

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    part: np.ndarray
    state: np.ndarray
    before: dict[int, np.ndarray] = field(default_factory=dict)
    #: Of cells, whose labels are means: their rows, and the squares of labels around the mean.
    n: np.ndarray | None = None
    around: np.ndarray | None = None


@dataclass
class Piece:
    """Rows of one fold sorted by cell, for AdaBoost: labels and weights by row, the rest by cell.

    ends: the smallest and largest label; sums, by model: weighted labels and weights; weighing, by model: ends of the
    rows that weigh something, if some weigh nothing any more; leaves and losses, by model: of cells and rows in the last
    tree, while at hand.
    """

    bins: np.ndarray
    n: np.ndarray
    y: np.ndarray
    fold: int
    ends: np.ndarray
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    sums: dict[int, np.ndarray] = field(default_factory=dict)
    weighing: dict[int, np.ndarray] = field(default_factory=dict)
    leaves: dict[int, np.ndarray] = field(default_factory=dict)
    losses: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n


def cuts_of(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """For each feature the values after which it may be cut: quantiles of what is there."""
    first = rows.select(F.size("x").alias("n")).first()
    names = [f"x{i}" for i in range(first["n"] if first else 0)]
    split = rows.select(*(F.col("x")[i].alias(n) for i, n in enumerate(names)))
    found = split.approxQuantile(names, [k / bins for k in range(1, bins)], 1 / (4 * bins)) if names else []
    return [np.unique(np.array(q, float)) for q in found]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(features, rows): 0 where missing, else one more than the cuts that lie under the value."""
    out = np.zeros((len(cuts), len(x)), np.uint8)
    for i, own in enumerate(cuts):
        known = ~np.isnan(x[:, i])
        out[i, known] = 1 + np.searchsorted(own, x[known, i], side="left")
    return out


#: Parts of the permutation of ordered boosting: each is as large as all before it.
PARTS = 8


def _part() -> Column:
    """0 with a chance of 1/128, then 1 with 1/128, 2 with 1/64 and so on."""
    share = F.pmod(F.col("draw"), F.lit(1 << (PARTS - 1)))
    return F.when(share == 0, 0).otherwise(F.floor(F.log2(share.cast("double"))) + 1).cast("int")


def _packed(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of (x, label, fold, draw) as bytes; draw decides the part of a row, from the first on: 1/128, 1/128, 1/64, ... 1/2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    def pack(held: list[pd.DataFrame]) -> pd.DataFrame:
        part = pd.concat(held)
        x = np.stack(part["x"]).astype(float).reshape(len(part), len(cuts))
        columns = [_binned(x, cuts), part["label"].to_numpy(float), part["fold"].to_numpy(np.int16), part["draw"].to_numpy(np.int16)]
        return pd.DataFrame([[c.tobytes() for c in columns]], columns=["bins", "y", "fold", "part"])

    return rows.withColumn("draw", _part()).mapInPandas(run, "bins binary, y binary, fold binary, part binary")


def _cells(rows: DataFrame, cuts: list[np.ndarray], ordered: bool, centre: float) -> DataFrame:
    """(key, n, sum, squares): rows equal in all bins, fold and, for ordered boosting, part, as one; labels less `centre`.

    Gradients, curvatures and squared errors of such rows follow from these sums. There are no more cells than
    rows, and never more than combinations of bins, folds and parts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"]).astype(float).reshape(len(batch), len(cuts))
            sides = [batch[c].to_numpy(np.int16)[:, None].view(np.uint8) for c in ("fold", "draw")]
            key = np.ascontiguousarray(np.hstack([_binned(x, cuts).T, *sides]))
            own, at = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_inverse=True)
            y = batch["label"].to_numpy(float) - centre
            sums = {"n": np.bincount(at), "sum": np.bincount(at, y), "squares": np.bincount(at, y * y)}
            yield pd.DataFrame({"key": [k.tobytes() for k in own], **sums})

    found = rows.withColumn("draw", _part() if ordered else F.lit(0)).mapInPandas(run, "key binary, n long, sum double, squares double")
    return found.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "sum", "squares")))


def _packed_cells(cells: DataFrame, features: int, centre: float) -> DataFrame:
    """Blocks of cells as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            key = np.frombuffer(b"".join(batch["key"]), np.uint8).reshape(len(batch), -1)
            n, mean = batch["n"].to_numpy(float), (batch["sum"] / batch["n"]).to_numpy(float)
            around = np.maximum(batch["squares"].to_numpy(float) - n * mean * mean, 0.0)
            fold, part = (np.ascontiguousarray(key[:, i : i + 2]) for i in (features, features + 2))
            columns = [np.ascontiguousarray(key[:, :features].T), mean + centre, fold, part, n, around]
            yield pd.DataFrame([[c.tobytes() for c in columns]], columns=["bins", "y", "fold", "part", "n", "around"])

    return cells.mapInPandas(run, "bins binary, y binary, fold binary, part binary, n binary, around binary")


def _unpacked(row, features: int) -> Block:
    y = np.frombuffer(row["y"])
    bins = np.frombuffer(row["bins"], np.uint8).reshape(features, len(y))
    cells = {c: np.frombuffer(row[c]) for c in ("n", "around") if c in row}
    return Block(bins, y, np.frombuffer(row["fold"], np.int16), np.frombuffer(row["part"], np.int16), np.zeros((0, len(y))), **cells)


def _joined(blocks: list[Block]) -> list[Block]:
    """The same cells as one block."""
    if len(blocks) < 2 or blocks[0].n is None:
        return blocks
    whole = {c: np.concatenate([getattr(b, c) for b in blocks]) for c in ("y", "fold", "part", "n", "around")}
    return [Block(bins=np.hstack([b.bins for b in blocks]), state=np.zeros((0, len(whole["y"]))), **whole)]


def _sorted_pieces(rows: DataFrame, cuts: list[np.ndarray], partitions: int) -> DataFrame:
    """(fold, bins, n, y) of pieces: rows sorted by fold and bins, many rows each, as bytes.

    Ranges are of (cell, label, partition before), so neither a large cell nor equal rows make a large partition.
    """
    width = 2 + len(cuts)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            # the smaller byte last: folds stand together
            fold = batch.column(1).to_numpy(zero_copy_only=False).astype(">i2")[:, None].view(np.uint8)
            key = np.ascontiguousarray(np.hstack([fold, _binned(x, cuts).T]))
            at = pa.array(np.arange(0, key.size + 1, width, dtype=np.int32))
            made = pa.Array.from_buffers(pa.binary(), len(key), [None, at.buffers()[1], pa.py_buffer(key)])
            yield pa.RecordBatch.from_arrays([made, batch.column(2), batch.column(3)], names=["key", "label", "piece"])

    def pack(key: np.ndarray, y: np.ndarray) -> Iterator[dict]:
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        own, n = key[new], np.diff(np.append(new, len(key)))
        fold = own[:, :2].copy().view(">i2").ravel()
        for f in np.unique(fold):
            at = fold == f
            bins = np.ascontiguousarray(own[at, 2:].T)
            yield {"fold": int(f), "bins": bins.tobytes(), "n": n[at].astype(np.int32).tobytes(), "y": y[np.repeat(at, n)].tobytes()}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, held = [], [], 0
        schema = pa.schema([("fold", pa.int32()), ("bins", pa.binary()), ("n", pa.binary()), ("y", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0).cast(pa.binary())
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            keys.append(np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, width))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= PIECE:
                yield pa.RecordBatch.from_pylist([*pack(np.vstack(keys), np.concatenate(labels))], schema)
                keys, labels, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([*pack(np.vstack(keys), np.concatenate(labels))], schema)

    keys = rows.select("x", "fold", "label", F.spark_partition_id().alias("piece")).mapInArrow(keyed, "key binary, label double, piece int")
    spread = keys.repartitionByRange(partitions, "key", "label", "piece").select("key", "label").sortWithinPartitions("key", "label")
    return spread.mapInArrow(packed, "fold int, bins binary, n binary, y binary")


def _piece(row, features: int) -> Piece:
    n, y = np.frombuffer(row["n"], np.int32).astype(np.int64), np.frombuffer(row["y"])
    starts = np.cumsum(n) - n
    ends = np.stack([np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)])
    return Piece(np.frombuffer(row["bins"], np.uint8).reshape(features, len(n)), n, y, row["fold"], ends)


def _cells_of(piece: Piece) -> Piece:
    """The piece without its rows."""
    return replace(piece, y=piece.y[:0], weights={})


class Spread:
    """Blocks in the partitions of an RDD; what a smaller view of them serves is kept beside them."""

    def __init__(self, rdd: RDD, view=None):
        self.before, self.rounds, self.view = [], 0, view
        self.kept = self._keep(rdd)

    def _keep(self, rdd: RDD) -> list[RDD]:
        """The blocks, and last what views are taken from."""
        kept = [rdd.persist(StorageLevel.MEMORY_AND_DISK)]
        return kept if self.view is None else [*kept, kept[0].map(self.view).persist(StorageLevel.MEMORY_AND_DISK)]

    @property
    def rdd(self) -> RDD:
        return self.kept[0]

    def place(self, trees: dict[int, Tree]) -> None:
        """Pieces find the leaves of their cells themselves."""

    def gathered(self, step, combine=np.add, size: int = 0, finish=lambda key, value: value, whole: bool = False) -> dict:
        """What `step` yields over the blocks, or their views unless `whole`, as (key, array), combined by key, then finished.

        size: bytes a task yields.
        """
        found = self.kept[0 if whole else -1].mapPartitions(step)
        if size * self.rdd.getNumPartitions() > GATHERED:
            return dict(found.reduceByKey(combine, self.rdd.context.defaultParallelism).map(lambda x: (x[0], finish(*x))).collect())
        return _combined(found.collect(), combine, finish)

    def change(self, step) -> None:
        """Replace each block; the blocks before can go after a pass over the new ones."""
        self.settle()
        self.before, self.kept = self.kept, self._keep(self.rdd.map(step))
        self.rounds += 1
        if self.rounds % ROUNDS_PER_CUT == 0:
            self.rdd.checkpoint()

    def settle(self) -> None:
        for gone in self.before:
            gone.unpersist()
        self.before = []

    def drop(self) -> None:
        self.settle()
        for gone in self.kept:
            gone.unpersist()


class Held:
    """Blocks in one task."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    def gathered(self, step, combine=np.add, size: int = 0, finish=lambda key, value: value, whole: bool = False) -> dict:
        return _combined((x for b in self.blocks for x in step(iter([b]))), combine, finish)

    def change(self, step) -> None:
        self.blocks = [step(b) for b in self.blocks]

    def settle(self) -> None:
        pass

    drop = settle


class HeldPieces(Held):
    """Pieces in one task, for one model: its cells as one, those of all folds and pieces that are equal in bins."""

    def __init__(self, blocks: list[Piece], model: int):
        super().__init__(blocks)
        own = [b for b in blocks if model in b.weights]
        self.model, self.cells, self.at = model, [], []
        if own:
            bins, ends = (np.concatenate([getattr(b, c) for b in own], axis=1) for c in ("bins", "ends"))
            key = np.ascontiguousarray(bins.T)
            _, first, at = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True)
            self.at, self.size = np.split(at, np.cumsum([len(b.n) for b in own])[:-1]), len(first)
            self.cells = [Piece(np.ascontiguousarray(bins[:, first]), first, np.zeros(0), -1, self._ends(ends))]
            self._add_up(own)

    def _ends(self, ends: np.ndarray) -> np.ndarray:
        out, at = np.stack([np.full(self.size, np.inf), np.full(self.size, -np.inf)]), np.concatenate(self.at)
        np.minimum.at(out[0], at, ends[0])
        np.maximum.at(out[1], at, ends[1])
        return out

    def _add_up(self, own: list[Piece]) -> None:
        at, (cells,) = np.concatenate(self.at), self.cells
        sums = np.concatenate([b.sums[self.model] for b in own], axis=1)
        cells.sums[self.model] = np.stack([np.bincount(at, x, self.size) for x in sums])
        if any(self.model in b.weighing for b in own):
            cells.weighing[self.model] = self._ends(np.concatenate([b.weighing.get(self.model, b.ends) for b in own], axis=1))

    def place(self, trees: dict[int, Tree]) -> None:
        own = [b for b in self.blocks if self.model in b.weights]
        for m, tree in trees.items():
            leaf = leaf_of(tree, self.cells[0].bins)
            for b, at in zip(own, self.at, strict=True):
                b.leaves[m] = leaf[at]

    def gathered(self, step, combine=np.add, size: int = 0, finish=lambda key, value: value, whole: bool = False) -> dict:
        return _combined((x for b in (self.blocks if whole else self.cells) for x in step(iter([b]))), combine, finish)

    def change(self, step) -> None:
        super().change(step)
        own = [b for b in self.blocks if self.model in b.weights]
        if own:
            self._add_up(own)


def _combined(found, combine, finish) -> dict:
    out: dict = {}
    for key, own in found:
        out[key] = combine(out[key], own) if key in out else own
    return {key: finish(key, own) for key, own in out.items()}


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row; of a tree that is not whole yet, the node of its last level."""
    node, at = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range((len(tree.feature) + 1).bit_length() - 1):
        feature = tree.feature[node]
        own = bins[feature, at]
        right = np.where(own == 0, tree.missing_right[node], own > tree.cut[node]) & (feature >= 0)
        node = 2 * node + 1 + right
    return node - len(tree.feature)


def _sums_of(block: Block | Piece, plan: Plan, model: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each row, or of each cell."""
    if isinstance(block, Piece):
        return block.sums[model]
    there = (block.fold != plan.fold) * (1.0 if block.n is None else block.n)
    return (block.y - block.state[model]) * there, there


def _histograms(blocks: Iterator[Block | Piece], active: dict[int, tuple[Plan, Tree]], wide: int) -> Iterator[tuple[int, np.ndarray]]:
    """(model, (nodes, features, bins, 2)) of a task, and under -1 - model the squared error on the held-out fold."""
    found: dict[int, np.ndarray] = {}
    for b in blocks:
        features, n = b.bins.shape
        place = b.bins.astype(np.int64) + (np.arange(features) * wide)[:, None]
        for m, (plan, tree) in active.items():
            if isinstance(b, Piece) and m not in b.sums:
                continue
            g, h = _sums_of(b, plan, m)
            nodes = len(tree.feature) + 1
            key = (place + leaf_of(tree, b.bins) * (features * wide)).ravel()
            size = nodes * features * wide
            made = np.stack([np.bincount(key, np.tile(x, features), size) for x in (g, h)], axis=-1).reshape(nodes, features, wide, 2)
            found[m] = found[m] + made if m in found else made
            if nodes == 1 and plan.fold >= 0 and isinstance(b, Block):
                held = b.fold == plan.fold
                error, n = (b.y - b.state[m])[held] ** 2, np.ones(held.sum()) if b.n is None else b.n[held]
                rest = 0.0 if b.around is None else b.around[held].sum()
                found[-1 - m] = found.get(-1 - m, 0) + np.array([(error * n).sum() + rest, n.sum()])
    yield from found.items()


def _worth(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    below = h + penalty
    return np.divide(g * g, below, out=np.zeros_like(g), where=below > 0)


def best_cuts(histogram: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """For each node: feature, cut, whether missing values go right, and (gradient, curvature) of both children."""
    nodes, features, wide, _ = histogram.shape
    g, h = histogram[..., 0], histogram[..., 1]
    total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    left = np.cumsum(histogram[:, :, 1:], axis=2)
    left = np.stack([left + histogram[:, :, :1], left], axis=3)  # missing values left, or right
    left_g, left_h = left[..., 0], left[..., 1]
    right_g, right_h = total_g[:, None, None, None] - left_g, total_h[:, None, None, None] - left_h
    # what is left of a sum by rounding is no row
    dust = 1e-9 * total_h[:, None, None, None]
    gain = _worth(left_g, left_h, plan.penalty) + _worth(right_g, right_h, plan.penalty) - _worth(total_g, total_h, plan.penalty)[:, None, None, None]
    if plan.alike:
        gain = np.broadcast_to(gain.sum(axis=0), gain.shape)
    else:
        least = np.maximum(plan.least_weight, dust)
        gain = np.where((left_h > dust) & (right_h > dust) & (left_h >= least) & (right_h >= least), gain, -np.inf)
    flat = gain.reshape(nodes, -1)
    if plan.kind == "adaboost":
        # cuts that part the same rows differ by rounding, which depends on the order of pieces: the first of them
        flat_best = flat.max(axis=1, keepdims=True)
        best = np.argmax(flat >= flat_best - 1e-12 * _worth(total_g, total_h, plan.penalty)[:, None], axis=1)
    else:
        best = np.argmax(flat, axis=1)
    feature, cut, way = np.unravel_index(best, (features, wide - 1, 2))
    at = np.arange(nodes)
    sums = np.stack([left_g[at, feature, cut, way], left_h[at, feature, cut, way], right_g[at, feature, cut, way], right_h[at, feature, cut, way]])
    none = ~(flat[at, best] > max(plan.least_gain, 1e-12))
    sums[:, none] = np.stack([total_g, total_h, 0 * total_g, 0 * total_h])[:, none]
    return np.where(none, -1, feature), cut + 1, (way == 1) & ~none, sums


def _cut(held: Spread | Held, active: dict[int, tuple[Plan, Tree]], wide: int, features: int) -> tuple[dict[int, tuple], dict[int, float]]:
    """The best cuts of each model, and errors on held-out folds where the trees begin."""
    size = sum(len(t.feature) + 1 for _, t in active.values()) * features * wide * 16

    def finish(m: int, added: np.ndarray):
        return best_cuts(added, active[m][0]) if m >= 0 else float(added[0] / added[1]) if added[1] else 0.0

    found = held.gathered(lambda blocks: _histograms(blocks, active, wide), size=size, finish=finish)
    return {m: own for m, own in found.items() if m >= 0}, {-1 - m: own for m, own in found.items() if m < 0}


def _grown(tree: Tree, cuts: tuple, plan: Plan) -> Tree:
    """The tree with a level more; its values are those of the new leaves."""
    feature, cut, way, (left_g, left_h, right_g, right_h) = cuts
    g, h = np.stack([left_g, right_g], axis=1).ravel(), np.stack([left_h, right_h], axis=1).ravel()
    below = h + plan.penalty
    value = np.divide(g, below, out=np.zeros_like(g), where=(below > 0) & (h > 0))
    return Tree(np.append(tree.feature, feature).astype(np.int64), np.append(tree.cut, cut), np.append(tree.missing_right, way), value)


def _empty() -> Tree:
    return Tree(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(1))


def _losses(share: np.ndarray, kind: str) -> np.ndarray:
    if kind == "linear":
        return share
    if kind == "square":
        return share * share
    if kind == "exponential":
        return 1 - np.exp(-share)
    raise ValueError(f"unknown loss: {kind}")


def _worst(held: Spread | HeldPieces, trees: dict[int, Tree]) -> dict[int, float]:
    """The largest error of each model over rows that weigh something: that of an end of some cell."""

    def run(cells: Iterator[Piece]) -> Iterator[tuple[int, float]]:
        for p in cells:
            for m, tree in trees.items():
                if m in p.sums:
                    low, high = p.weighing.get(m, p.ends)
                    said = tree.value[leaf_of(tree, p.bins)]
                    error = np.maximum(np.abs(low - said), np.abs(high - said))[~(low > high)]
                    yield m, float(error.max(initial=0.0))

    return held.gathered(run, combine=max) if trees else {}


def _losses_of(piece: Piece, model: int, tree: Tree, worst: float, kind: str) -> np.ndarray:
    leaf = piece.leaves[model] if model in piece.leaves else leaf_of(tree, piece.bins)
    share = np.repeat(tree.value[leaf], piece.n)
    np.subtract(piece.y, share, out=share)
    np.abs(share, out=share)
    share /= worst
    if model in piece.weighing:
        # rows that weigh nothing may err by more than the worst
        np.minimum(share, 1.0, out=share)
    return _losses(share, kind)


def _lost(held: Spread | HeldPieces, trees: dict[int, Tree], plans: dict[int, Plan], worst: dict[int, float]) -> dict[int, np.ndarray]:
    """Weighted loss, weight and rows of each model."""

    def run(pieces: Iterator[Piece]) -> Iterator[tuple[int, np.ndarray]]:
        for p in pieces:
            for m, tree in trees.items():
                if m in p.weights:
                    w = p.weights[m]
                    p.losses[m] = _losses_of(p, m, tree, worst[m], plans[m].loss)
                    yield m, np.array([w @ p.losses[m], p.sums[m][1].sum(), np.count_nonzero(w) if m in p.weighing else len(w)])

    held.place(trees)
    return held.gathered(run, whole=True) if trees else {}


def _weighed(piece: Piece, model: int, w: np.ndarray) -> None:
    """Give the rows of a piece their weights."""
    starts = piece.starts
    piece.weights[model] = w
    piece.sums[model] = np.stack([np.add.reduceat(w * piece.y, starts), np.add.reduceat(w, starts)])
    if not w.min() > 0:
        ends = [low.reduceat(np.where(w > 0, piece.y, none), starts) for low, none in ((np.minimum, np.inf), (np.maximum, -np.inf))]
        piece.weighing[model] = np.stack(ends)


def _forerunner_sums(held: Spread | Held, trees: dict[int, Tree], plans: dict[int, Plan]) -> dict[int, np.ndarray]:
    """(2, PARTS + 1, leaves): gradient and curvature of the rows that each forerunner has seen, by its own residuals."""

    def run(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        for b in blocks:
            for m, tree in trees.items():
                leaf, size, made = leaf_of(tree, b.bins), len(tree.value), np.zeros((2, PARTS + 1, len(tree.value)))
                for k in range(1, PARTS + 1):
                    seen = (b.part < k) & (b.fold != plans[m].fold)
                    n = np.ones(seen.sum()) if b.n is None else b.n[seen]
                    made[0, k] = np.bincount(leaf[seen], (b.y - b.before[m][k])[seen] * n, size)
                    made[1, k] = np.bincount(leaf[seen], n, size)
                yield m, made

    return held.gathered(run, size=sum(len(t.value) for t in trees.values()) * (PARTS + 1) * 16) if trees else {}


def train(
    rows: DataFrame,
    plans: list[Plan],
    bins: int = BINS,
    cuts: list[np.ndarray] | None = None,
    score_at: tuple[int, ...] = (),
    copied: int | None = None,
    by_cells: bool = True,
) -> tuple[list[np.ndarray], list[Fitted]]:
    """Train all plans on (features, label, and fold if there is one) -> cuts of the features, what came out.

    Rows without a label are left out; missing values of features are NaN. Without rows every model predicts 0.
    Models with a fold are scored on it after the rounds of `score_at`. AdaBoost models are trained apart; boosted
    trees beside them learn from rows, not cells. The parts of ordered boosting follow
    from a hash of the row, so nothing depends on the partitioning but the order in which doubles are added.
    """
    if not 2 <= bins <= 250:
        raise ValueError("a feature has 2 to 250 bins")
    spark = rows.sparkSession
    importable(spark)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(-2)
    known = rows.filter("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), fold.alias("fold"))
    known = known.withColumn("draw", F.xxhash64("x", "label"))
    cuts = cuts_of(known, bins) if cuts is None else cuts
    alone = [[i for i, p in enumerate(plans) if (p.kind == "adaboost") == ada] for ada in (False, True)]
    if all(alone):
        found = {}
        for own in alone:
            found |= dict(zip(own, train(rows, [plans[i] for i in own], bins, cuts, score_at, copied, by_cells=False)[1], strict=True))
        return cuts, [found[i] for i in range(len(plans))]
    wide, features = max((len(c) for c in cuts), default=0) + 2, len(cuts)
    fitted = [Fitted(p) for p in plans]
    if not features:
        return cuts, fitted

    start = known.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("sum")).collect()
    for f in fitted:
        n = sum(r["n"] for r in start if r["fold"] != f.plan.fold)
        f.base = sum(r["sum"] for r in start if r["fold"] != f.plan.fold) / n if n and f.plan.kind == "gradient" else 0.0
        f.open = n > 0

    def begun(b: Block, models: list[Fitted]) -> Block:
        state = [np.full(len(b.y), f.base) for f in models]
        before = {m: np.full((PARTS + 1, len(b.y)), f.base) for m, f in enumerate(models) if f.plan.ordered}
        return replace(b, state=np.stack(state), before=before)

    rows_known = sum(r["n"] for r in start)
    if alone[1]:
        _reweighted(known, cuts, fitted, rows_known, wide, score_at, COPIED if copied is None else copied)
        return cuts, fitted
    if rows_known and by_cells:
        centre = float(sum(r["sum"] for r in start) / rows_known)
        cells = _cells(known, cuts, any(p.ordered for p in plans), centre).persist(StorageLevel.MEMORY_AND_DISK)
        kept, size = [cells], cells.count() * (features + 28)
        packed = _packed_cells(cells, features, centre)
    else:
        # no more than the bytes just counted: 8 of the label, 2 of fold and part, one of each feature
        cells, kept, packed, size = None, [], _packed(known, cuts), rows_known * (features + 12)
    held = None
    try:
        if size <= (COPIED if copied is None else copied):
            copy = context.broadcast(_joined([_unpacked(r, features) for r in packed.collect()]))

            def alone(f: Fitted) -> Fitted:
                _in_step(Held([begun(b, [f]) for b in copy.value]), [f], wide, features, score_at)
                return f

            done = context.parallelize(list(enumerate(fitted)), len(fitted)).mapValues(alone).collect()
            copy.destroy()
            return cuts, [f for _, f in sorted(done, key=lambda x: x[0])]
        if packed.rdd.getNumPartitions() < context.defaultParallelism:
            if cells is None:
                packed = _packed(known.repartition(context.defaultParallelism, "draw"), cuts)
            else:
                packed = _packed_cells(cells.repartition(context.defaultParallelism, "key"), features, centre)
        held = Spread(packed.rdd.map(lambda r: begun(_unpacked(r, features), fitted)))
        _in_step(held, fitted, wide, features, score_at)
    finally:
        if held:
            held.drop()
        for cached in kept:
            cached.unpersist()
    return cuts, fitted


def _in_step(held: Spread | Held, fitted: list[Fitted], wide: int, features: int, score_at: tuple[int, ...]) -> None:
    """Train models over blocks that hold their states."""
    for step in range(max((f.plan.rounds for f in fitted), default=0) + 1):
        trees = {m: _empty() for m, f in enumerate(fitted) if f.open and step <= f.plan.rounds}
        for level in range(max((fitted[m].plan.depth for m in trees), default=0)):
            active = {m: (fitted[m].plan, t) for m, t in trees.items() if level < fitted[m].plan.depth}
            if not level:
                # a model that has all its trees is only scored
                active = {m: x for m, x in active.items() if step < x[0].rounds or x[0].fold >= 0}
            found, errors = _cut(held, active, wide, features) if active else ({}, {})
            if not level:
                for m, error in errors.items():
                    fitted[m].errors += [error] if step else []
                trees = {m: t for m, t in trees.items() if step < fitted[m].plan.rounds}
                held.settle()
            trees |= {m: _grown(trees[m], own, fitted[m].plan) for m, own in found.items() if m in trees}
        if not trees:
            break
        held.change(_boost(held, trees, fitted))
    for f in fitted:
        if f.errors:
            f.scores = {k: f.errors[min(k, len(f.errors)) - 1] for k in score_at}


def _boost(held: Spread | Held, trees: dict[int, Tree], fitted: list[Fitted]):
    """Take the trees into the models; returns the change of a block's state."""
    plans = {m: fitted[m].plan for m in trees}
    ordered = {}
    for m, (g, h) in _forerunner_sums(held, {m: trees[m] for m in trees if plans[m].ordered}, plans).items():
        ordered[m] = np.divide(g, h + plans[m].penalty, out=np.zeros_like(g), where=h > 0)
        trees[m] = replace(trees[m], value=ordered[m][PARTS])
    for m, tree in trees.items():
        fitted[m].trees.append(tree)

    def change(b: Block) -> Block:
        state, before = b.state.copy(), dict(b.before)
        for m, tree in trees.items():
            plan, leaf = plans[m], leaf_of(tree, b.bins)
            if m in ordered:
                before[m] = before[m] + plan.rate * ordered[m][:, leaf]
                # rows held out see the whole model, as new rows do
                state[m] = before[m][np.where(b.fold == plan.fold, PARTS, b.part), np.arange(len(b.y))]
            else:
                state[m] += plan.rate * tree.value[leaf]
        return replace(b, state=state, before=before)

    return change


def _reweighted(
    known: DataFrame, cuts: list[np.ndarray], fitted: list[Fitted], rows: int, wide: int, score_at: tuple[int, ...], copied: int
) -> None:
    """Train AdaBoost models: in tasks of their own on copies of all pieces, or in step over pieces in partitions."""
    context, features = known.sparkSession.sparkContext, len(cuts)
    if not rows:
        for f in fitted:
            f.open = False
        return

    def begun(p: Piece, models: dict[int, Plan]) -> Piece:
        p = replace(p, weights={}, sums={}, weighing={}, leaves={}, losses={})
        for m, plan in models.items():
            if plan.fold != p.fold:
                _weighed(p, m, np.ones(len(p.y)))
        return p

    packed = _sorted_pieces(known, cuts, max(context.defaultParallelism, -(-rows // PIECES))).persist(StorageLevel.MEMORY_AND_DISK)
    held = None
    try:
        size = packed.agg(F.sum(sum((F.length(c) for c in ("bins", "n", "y")), F.lit(0))).alias("size")).first()["size"]
        if size <= copied:
            copy = context.broadcast([_piece(r, features) for r in packed.collect()])

            def alone(f: Fitted) -> Fitted:
                _reweigh_in_step(HeldPieces([begun(p, {0: f.plan}) for p in copy.value], 0), [f], wide, features, score_at)
                return f

            done = dict(context.parallelize(list(enumerate(fitted)), len(fitted)).mapValues(alone).collect())
            copy.destroy()
            fitted[:] = [done[m] for m in range(len(fitted))]
            return
        plans = {m: f.plan for m, f in enumerate(fitted)}
        held = Spread(packed.rdd.map(lambda r: begun(_piece(r, features), plans)), _cells_of)
        _reweigh_in_step(held, fitted, wide, features, score_at)
    finally:
        if held:
            held.drop()
        packed.unpersist()


def _reweigh_in_step(held: Spread | HeldPieces, fitted: list[Fitted], wide: int, features: int, score_at: tuple[int, ...]) -> None:
    """Train AdaBoost models over pieces that hold their weights."""
    for step in range(max((f.plan.rounds for f in fitted), default=0)):
        trees = {m: _empty() for m, f in enumerate(fitted) if f.open and step < f.plan.rounds}
        if not trees:
            break
        for level in range(max(fitted[m].plan.depth for m in trees)):
            active = {m: (fitted[m].plan, t) for m, t in trees.items() if level < fitted[m].plan.depth}
            found, _ = _cut(held, active, wide, features)
            trees |= {m: _grown(trees[m], own, fitted[m].plan) for m, own in found.items()}
            held.settle()
        held.change(_reweigh(held, trees, fitted))
    scored = {m: f for m, f in enumerate(fitted) if f.plan.fold >= 0 and f.trees}
    if scored and score_at:
        for m, own in held.gathered(lambda pieces: _fold_errors(pieces, scored, list(score_at)), whole=True).items():
            fitted[m].scores = {k: float(e / own[-1]) if own[-1] else 0.0 for k, e in zip(score_at, own, strict=False)}


def _reweigh(held: Spread | HeldPieces, trees: dict[int, Tree], fitted: list[Fitted]):
    """Take the trees into the models; returns the change of a piece's weights."""
    plans = {m: fitted[m].plan for m in trees}
    worst = _worst(held, trees)
    lost = _lost(held, {m: t for m, t in trees.items() if worst[m] > 0}, plans, worst)
    shrink: dict[int, tuple[float, float]] = {}
    for m, tree in trees.items():
        f = fitted[m]
        loss, weight, n = lost.get(m, (0.0, 1.0, 1.0))
        average = loss / weight if weight else 0.0
        if not average or average >= 0.5:
            # no error, or no better than chance: kept if it is without error or the first tree
            if not average or not f.trees:
                f.trees.append(tree)
                f.says.append(1.0)
            f.open = False
            continue
        beta = average / (1 - average)
        f.trees.append(tree)
        f.says.append(f.plan.rate * log(1 / beta))
        shrink[m] = (f.plan.rate * log(beta), log(weight / n))

    def change(p: Piece) -> Piece:
        new = replace(p, weights={}, sums={}, weighing={}, leaves={}, losses={})
        for m in [m for m in shrink if m in p.weights]:
            full, mean = shrink[m]
            # beta ** ((1 - loss) * rate) / mean
            loss = p.losses[m] if m in p.losses else _losses_of(p, m, trees[m], worst[m], plans[m].loss)
            w = np.multiply(loss, -full)
            w += full - mean
            _weighed(new, m, np.multiply(np.exp(w, out=w), p.weights[m], out=w))
        return new

    return change


def _medians(values: np.ndarray, says: np.ndarray, prefixes: list[int]) -> np.ndarray:
    """(prefixes, rows): weighted medians of the first so many of (trees, rows)."""
    order = np.argsort(values, axis=0, kind="stable")
    ordered = np.take_along_axis(values, order, axis=0)
    out = []
    for k in prefixes:
        said = np.where(order < k, says[order], 0.0)
        run = np.cumsum(said, axis=0)
        at = np.argmax((run >= 0.5 * says[:k].sum()) & (said > 0), axis=0)
        out.append(ordered[at, np.arange(values.shape[1])])
    return np.array(out)


def _predicted(fitted: Fitted, rounds: list[int], bins: np.ndarray) -> np.ndarray:
    """(rounds, rows): what a model of so many rounds says, by whole leaves."""
    if not fitted.trees:
        return np.full((len(rounds), bins.shape[1]), fitted.base)
    values = np.stack([t.value[leaf_of(t, bins)] for t in fitted.trees])
    if fitted.plan.kind == "adaboost":
        return _medians(values, np.array(fitted.says), [min(k, len(values)) for k in rounds])
    return np.stack([fitted.base + fitted.plan.rate * values[:k].sum(axis=0) for k in rounds])


def _fold_errors(pieces: Iterator[Piece], fitted: dict[int, Fitted], rounds: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(model, squared errors on its fold after so many rounds, rows of the fold)."""
    for p in pieces:
        for m, f in fitted.items():
            if p.fold != f.plan.fold:
                continue
            ends = np.append(0, np.cumsum(p.n))
            for start in range(0, len(p.n), SORTED):
                n = p.n[start : start + SORTED]
                y = p.y[ends[start] : ends[start + len(n)]]
                error = np.repeat(_predicted(f, rounds, p.bins[:, start : start + SORTED]), n, axis=1) - y
                yield m, np.append((error * error).sum(axis=1), len(y))


class BoostedModel(Model):
    """Predicts by the first `rounds` trees of a fitted plan."""

    def __init__(self, cuts: list[np.ndarray], fitted: Fitted, rounds: int):
        super().__init__()
        self.cuts, self.rounds = cuts, min(rounds, len(fitted.trees))
        self.fitted = replace(fitted, trees=fitted.trees[: self.rounds], says=fitted.says[: self.rounds])
        self.trees, self.says = self.fitted.trees, self.fitted.says

    def _transform(self, dataset: DataFrame) -> DataFrame:
        importable(dataset.sparkSession)
        cuts, fitted, rounds = self.cuts, self.fitted, self.rounds

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                if not len(x) or not cuts:
                    yield pd.Series(np.full(len(x), fitted.base))
                    continue
                bins = _binned(np.stack(x).astype(float), cuts)
                yield pd.Series(np.concatenate([_predicted(fitted, [rounds], bins[:, i : i + SORTED])[0] for i in range(0, len(x), SORTED)]))

        return dataset.withColumn("prediction", F.pandas_udf(run, "double")(vector_to_array("features")))


class BoostedRegressor(Estimator):
    """One plan as an estimator over (features, label)."""

    def __init__(self, plan: Plan):
        super().__init__()
        self.plan = plan

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        cuts, (fitted,) = train(dataset, [self.plan])
        return BoostedModel(cuts, fitted, self.plan.rounds)


def tune(rows: DataFrame, plans: list[Plan], folds: int) -> tuple[BoostedModel, int, float | None]:
    """The best plan by the mean root mean squared error over the folds: its model on all rows, its place, its score.

    Plans that differ in their rounds alone are trained once. The models of all folds and those of
    all rows are trained in the same passes.
    """
    fits: dict[Plan, int] = {}
    for p in plans:
        key = replace(p, rounds=0)
        fits[key] = max(fits.get(key, 0), p.rounds)
    wanted = [-1] if len(plans) == 1 else [*range(folds), -1]
    runs = [replace(key, rounds=rounds, fold=fold) for key, rounds in fits.items() for fold in wanted]
    rounds = sorted({p.rounds for p in plans})
    cuts, fitted = train(rows, runs, score_at=tuple(rounds))
    by_run = {f.plan: f for f in fitted}

    def run_of(p: Plan, fold: int) -> Plan:
        return replace(p, rounds=fits[replace(p, rounds=0)], fold=fold)

    if len(plans) == 1:
        return BoostedModel(cuts, by_run[run_of(plans[0], -1)], plans[0].rounds), 0, None
    scores = [float(np.mean([sqrt(by_run[run_of(p, fold)].scores.get(p.rounds, 0.0)) for fold in range(folds)])) for p in plans]
    best = scores.index(min(scores))
    return BoostedModel(cuts, by_run[run_of(plans[best], -1)], plans[best].rounds), best, scores[best]
