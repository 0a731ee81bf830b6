"""Pearson correlations, pairwise complete: a row counts for a pair if both values are present."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import number, numeric_columns, per_column, require_columns

# With many more pairs per aggregate the generated code is too large for the JVM to compile.
PAIRS_PER_SCAN = 10


def corr_adjacent(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlation of each numeric column with the next one; empty for fewer than two columns."""
    chosen = columns or numeric_columns(df)
    if len(chosen) < 2:
        return _no_pairs(df)
    return _by_aggregate(df, list(zip(chosen, chosen[1:])))


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full matrix in long form (x, y, r), both triangles and the diagonal, for any number of columns.

    All pairs are listed. r is null if one of the two is constant or infinite over the rows where both are
    present, or if there are none; else it is 1 on the diagonal. Two scans: means, then products.
    """
    chosen = columns or numeric_columns(df)
    require_columns(df, chosen)
    return _by_block_products(df, chosen) if chosen else _no_pairs(df)


def _pearson(df: DataFrame, x: str, y: str) -> Column:
    """Correlation over the rows where both are present; null if one of them is constant there."""
    a, b = number(df, x), number(df, y)
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def _by_aggregate(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        chunk = pairs[start : start + PAIRS_PER_SCAN]
        wide = df.agg(*[_pearson(df, x, y).alias(f"r{i}") for i, (x, y) in enumerate(chunk)])
        rows = [
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r"))
            for i, (x, y) in enumerate(chunk)
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def _by_block_products(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each task multiplies its batches of rows and gives one row with all sums; these are added in two steps.

    Values are centred on the column means first, so that the sums of squares do not cancel.
    """
    means = per_column(df, columns, lambda c: {"mean": F.avg(number(df, c))}).orderBy("position").collect()
    centre = np.array([m["mean"] if m["mean"] is not None else 0.0 for m in means])
    centred = df.select(*[(number(df, c) - F.lit(float(m))).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, centre))])
    k = len(columns)

    # Defined here, so that tasks need not import this package.
    def packed(sums: np.ndarray) -> pa.RecordBatch:
        flat = pa.ListArray.from_arrays(pa.array([0, sums.size], pa.int32()), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([flat], names=["sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros(4 * k * k)
        for batch in batches:
            sums += batch.column(0).flatten().to_numpy().reshape(-1, sums.size).sum(axis=0)
        return sums.reshape(4, k, k)

    def coefficients(sums: np.ndarray) -> np.ndarray:
        """Correlations from counts and sums over the rows of each pair; NaN where there is none."""
        n, sx, sxx, sxy = sums
        with np.errstate(all="ignore"):
            spread = n * sxx - sx * sx
            # what rounding leaves of a constant column is no spread
            spread = np.where(spread > (1e-12 * n * centre[:, None]) ** 2, spread, np.nan)
            r = (n * sxy - sx * sx.T) / (np.sqrt(spread) * np.sqrt(spread.T))
        r[np.diag_indices(len(r))] = np.where(np.isfinite(np.diag(r)), 1.0, np.nan)
        return np.where(np.isfinite(r), np.clip(r, -1.0, 1.0), np.nan)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            seen = here.astype(float)
            sums += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
        yield packed(sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(total(batches))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = coefficients(total(batches))
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(columns)[i.ravel()]), pa.array(np.array(columns)[j.ravel()]), pa.array(r.ravel(), from_pandas=True)],
            names=["x", "y", "r"],
        )

    kind = "sums array<double>"
    nothing = df.sparkSession.range(1).select(F.array_repeat(F.lit(0.0), 4 * k * k).alias("sums"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = centred.mapInArrow(products, kind).repartition(tasks).mapInArrow(added, kind)
    return partial.union(nothing).repartition(1).mapInArrow(finished, "x string, y string, r double")


def _no_pairs(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "x string, y string, r double")
