"""Quality by a byte-level convolutional network in numpy.

The bytes of a text are cut into overlapping chunks that cover all of it. Each filter looks at eight
bytes in a row, every second byte on, and at whether what stands there stood a few bytes before; its best
match in each chunk is kept (max-pooling). Over the chunks the greatest and the mean of each are taken and
combined into one probability. The filters are learned from all chunks of a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk and of its overlap with the next; bytes that a filter sees, its step, and filters.
CHUNK, OVERLAP, WIDTH, STEP, FILTERS = 512, 32, 8, 2, 16
#: Distances at which bytes are compared with earlier ones, four at a time.
LAGS = range(3, 33)
#: Chunks scored at a time.
BATCH = 256
#: Bounds of learning: rows, bytes of their texts together, passes, rows a step, and step size.
ROWS, BYTES, PASSES, STEP_ROWS, RATE = 3_000, 64 << 20, 8, 32, 0.01
PLACES = (CHUNK - WIDTH) // STEP + 1


def recurrences(raw: np.ndarray) -> np.ndarray:
    """For each byte, whether it and the three after it stand a few bytes before too."""
    same = np.zeros(len(raw), bool)
    padded = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32)
    four = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
    for lag in LAGS:
        if lag < len(raw):
            same[lag:] |= four[lag:] == four[:-lag]
    return same


def chunks(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All chunks of a text, in groups of bounded size: bytes, padded with zeros, and recurrences."""
    stride = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // stride))
    for first in range(0, n, BATCH):
        start, count = first * stride, min(BATCH, n - first)
        held = max(0, start - max(LAGS))
        part = np.frombuffer(raw, np.uint8)[held : start + count * stride + OVERLAP]
        both = np.zeros((2, start - held + count * stride + OVERLAP), np.uint8)
        both[0, : len(part)], both[1, : len(part)] = part, recurrences(part)
        cut = np.lib.stride_tricks.sliding_window_view(both[:, start - held :], CHUNK, axis=1)[:, ::stride]
        yield cut[0][:count], cut[1][:count]


@dataclass(frozen=True)
class Network:
    """Filters as what each byte adds at each of the places they see, and the weights that combine them."""

    tables: np.ndarray  # WIDTH x 256 x FILTERS
    repeats: np.ndarray  # WIDTH x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: of the greatest, of the means
    offset: float

    def pooled(self, rows: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, FILTERS): best match of each filter, at least 0, and where it is."""
        out = np.broadcast_to(self.bias, (len(rows), PLACES, FILTERS)).copy()
        for k in range(WIDTH):
            at = slice(k, k + STEP * PLACES, STEP)
            out += self.tables[k][rows[:, at]]
            out += same[:, at, None] * self.repeats[k]
        where = out.argmax(axis=1)
        best = np.take_along_axis(out, where[:, None, :], axis=1)[:, 0]
        return np.maximum(best, 0), where

    def score(self, text: str | None) -> float:
        raw, top, total, n = (text or "").encode(), np.zeros(FILTERS), np.zeros(FILTERS), 0
        for rows, same in chunks(raw):
            best, _ = self.pooled(rows, same)
            top, total, n = np.maximum(top, best.max(axis=0)), total + best.sum(axis=0), n + len(rows)
        z = float(np.concatenate([top, total / n]) @ self.weights + self.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sample(rows: DataFrame, most: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Chunks, recurrences and label of each row, in the order of a hash of doc_id, a partition at a time.

    A row whose text would bring the bytes taken over `most` is left out of the sample.
    """
    ordered = rows.select("label", "text").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "label", "text")
    texts, same, labels, taken = [], [], [], 0
    for row in ordered.toLocalIterator():
        raw = (row["text"] or "").encode()
        if taken + len(raw) <= most:
            taken += len(raw)
            cut = list(chunks(raw))
            texts.append(np.concatenate([r for r, _ in cut]))
            same.append(np.concatenate([s for _, s in cut]))
            labels.append(row["label"] > 0)
    return texts, same, np.array(labels, np.float32)


def learn(rows: DataFrame, seed: int = 7, most: int = BYTES) -> Network:
    """A network from whole texts, (doc_id, text, label) of a bounded sample; without both labels it gives their share always.

    Rows are those of `learning_labels`, so at most about ROWS; of their texts `most` bytes at most are taken. A null text
    counts as empty, a row without label as 0; repeated rows count as often as they stand there.
    """
    texts, same, labels = _sample(rows.withColumn("label", F.coalesce("label", F.lit(0))), most)
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
        rng.normal(0, 0.1, (WIDTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Network(net.tables, net.repeats, net.bias, 0 * net.weights, float(np.log(share / (1 - share))))
    values = {"tables": net.tables, "repeats": net.repeats, "bias": net.bias, "weights": net.weights, "offset": np.zeros(1, np.float32)}
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    # the rarer label counts as much as the other, up to four times
    rare = np.where(labels == 1, *(np.clip(0.5 / share, 0.5, 4.0) for share in (labels.mean(), 1 - labels.mean())))
    step = 0
    for _ in range(PASSES):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), STEP_ROWS):
            step += 1
            gradients = _gradients(values, order[start : start + STEP_ROWS], texts, same, labels, rare)
            for k, g in gradients.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                rate = RATE / (1 - 0.9**step)
                values[k] -= rate * first[k] / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Network(values["tables"], values["repeats"], values["bias"], values["weights"], float(values["offset"][0]))


def _gradients(values: dict, rows: np.ndarray, texts: list, same: list, labels: np.ndarray, rare: np.ndarray) -> dict:
    """Of the weighted logistic loss over some rows."""
    net = Network(values["tables"], values["repeats"], values["bias"], values["weights"], float(values["offset"][0]))
    parts, marks = np.concatenate([texts[i] for i in rows]), np.concatenate([same[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), [len(texts[i]) for i in rows])
    groups = [net.pooled(parts[i : i + BATCH], marks[i : i + BATCH]) for i in range(0, len(parts), BATCH)]
    best, where = (np.concatenate(x) for x in zip(*groups, strict=True))
    starts = np.searchsorted(owner, np.arange(len(rows)))
    counts = np.bincount(owner)[:, None]
    top, mean = np.maximum.reduceat(best, starts), np.add.reduceat(best, starts) / counts
    features = np.concatenate([top, mean], axis=1)
    p = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30)))
    error = ((p - labels[rows]) * rare[rows] / len(rows)).astype(np.float32)
    out = {k: np.zeros_like(v) for k, v in values.items()}
    out["weights"][:] = features.T @ error + 1e-4 * net.weights
    out["offset"][:] = error.sum()
    pull = error[:, None] * net.weights[None, :]
    is_top = (best == top[owner]) & (best > 0)
    back = is_top * pull[owner, :FILTERS] + pull[owner, FILTERS:] / counts[owner]
    back = np.where(best > 0, back, 0).astype(np.float32)
    chunk, kernel = np.nonzero(back)
    g = back[chunk, kernel]
    np.add.at(out["bias"], kernel, g)
    for k in range(WIDTH):
        at = where[chunk, kernel] * STEP + k
        np.add.at(out["tables"][k], (parts[chunk, at], kernel), g)
        np.add.at(out["repeats"][k], kernel, g * marks[chunk, at])
    return out


def quality(text: Column, net: Network) -> Column:
    """Probability of label 1 for a whole text of any length; null counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([net.score(t) for t in texts], index=texts.index, dtype="float64")

    return F.pandas_udf(run, "double")(text)
