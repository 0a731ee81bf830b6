"""The aggregates behind the usual charts. Each result is small or stays distributed."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import number, present, quoted, require_columns
from tablelens.operators.correlate import corr_matrix
from tablelens.operators.profile import QUARTILES
from tablelens.operators.ranks import (
    SINGLE_TASK_ROWS,
    hot_key_salts,
    join_per_key_stats,
    quantiles,
    running_totals,
)
from tablelens.session import importable

HISTOGRAM_BINS = 30
DENSITY_BINS = 512
DENSITY_POINTS = 200
PIE_LEVELS = 10
CONFIDENCE_Z = 1.96


def bar_chart(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y per x with a normal 95% interval: (x, n, mean, low, high)."""
    require_columns(df, [x, y])
    grouped = (
        df.select(present(df, x).alias("x"), number(df, y).alias("y"))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("x")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))
    )
    half = F.lit(CONFIDENCE_Z) * F.col("std") / F.sqrt("n")
    return grouped.select("x", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def line_chart(df: DataFrame, x: str, y: str) -> DataFrame:
    """The bar chart's values in the order of x."""
    return bar_chart(df, x, y).orderBy("x")


# How often a Poisson number of mean 1 is at most 0, 1, 2, ..., in 65,536ths as four hex digits, written down
# from the distribution: a draw of four digits is 0 below the first, 1 below the second and so on.
_POISSON = [f"{int(65536 * sum(exp(-1) / factorial(k) for k in range(n + 1))):04x}" for n in range(7)]
_DRAWS = 8


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, draws) -> for each x and part of a batch how often its rows count in each replicate, and the sums of y so counted.

    A draw is two bytes of a hash, the four digits that it is written with; a part is the draws of one hash.
    """
    bounds = np.array([int(b, 16) for b in _POISSON])
    times = np.searchsorted(bounds, np.arange(65536), side="right").astype(float)
    for batch in batches:
        if not batch.num_rows:
            continue
        group, first = _numbered(batch.column(0))
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        y = batch.column(1).to_numpy(zero_copy_only=False)[order]
        often = times[np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(len(y), -1)[order]]
        parts = often.shape[1] // _DRAWS
        n, s = np.add.reduceat(often, starts, axis=0), np.add.reduceat(often * y[:, None], starts, axis=0)
        own = batch.column(0).take(pa.array(np.repeat(first, parts)))
        columns = [own, pa.array(np.tile(np.arange(parts, dtype=np.int32), len(first)))]
        for i in range(_DRAWS):
            columns += [pa.array(n[:, i::_DRAWS].ravel().astype(np.int64)), pa.array(s[:, i::_DRAWS].ravel())]
        names = ["x", "part", *(f"{c}{i}" for i in range(_DRAWS) for c in "ns")]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _numbered(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct values of an array from 0, and where each stands first."""
    try:
        group = values.dictionary_encode().indices.to_numpy()
    except pa.ArrowNotImplementedError:  # nested ones
        seen: dict[str, int] = {}
        group = np.array([seen.setdefault(repr(v), len(seen)) for v in values.to_pylist()])
    return group, np.unique(group, return_index=True)[1]


def resampled_means(df: DataFrame, x: str, y: str, keys: list[str], replicates: int = 200, percent: float = 95.0) -> DataFrame:
    """Mean of y per x with a bootstrap interval: (x, n, mean, low, high).

    Each row counts a Poisson number of times in each replicate, from a hash of its keys and the number of
    the replicate, so one scan adds up all of them, combined before the shuffle, and a row counts the same
    whatever the partitioning. Rows with equal keys are drawn together. The bounds are quantiles of the
    replicates' means; a replicate in which a group has no row gives it none. `replicates` is rounded up to
    a multiple of 8, the draws of one hash.
    """
    require_columns(df, [x, y, *keys])
    key = F.concat_ws(":", *(F.coalesce(quoted(k).cast("string"), F.lit("")) for k in keys))
    known = df.select(present(df, x).alias("x"), number(df, y).alias("y"), key.alias("key"))
    known = known.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    importable(df.sparkSession)
    sums = [f"{c}{i}" for i in range(_DRAWS) for c in "ns"]
    schema = T.StructType([known.schema["x"], T.StructField("part", T.IntegerType())])
    for c in sums:
        schema = schema.add(c, T.LongType() if c[0] == "n" else T.DoubleType())
    n_parts = -(-replicates // _DRAWS)
    draws = F.concat(*(F.unhex(F.md5(F.concat_ws(":", "key", F.lit(str(i))).cast("binary"))) for i in range(n_parts)))
    drawn = known.select("x", F.col("y").cast("double").alias("y"), draws.alias("draws")).mapInArrow(_drawn, schema)
    parts = drawn.groupBy("x", "part").agg(*(F.sum(c).alias(c) for c in sums))
    means = parts.select("x", F.explode(F.array(*(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")) for i in range(_DRAWS)))).alias("mean"))
    tail = (100.0 - percent) / 200.0
    bounds = means.groupBy("x").agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("bounds"))
    whole = known.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    return whole.join(bounds, "x").select("x", "n", "mean", F.col("bounds")[0].alias("low"), F.col("bounds")[1].alias("high"))


def bar_chart_resampled(df: DataFrame, x: str, y: str, keys: list[str], **how) -> DataFrame:
    """The bar chart with bootstrap intervals."""
    return resampled_means(df, x, y, keys, **how)


def line_chart_resampled(df: DataFrame, x: str, y: str, keys: list[str], **how) -> DataFrame:
    """The same in the order of x."""
    return resampled_means(df, x, y, keys, **how).orderBy("x")


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """All complete (x, y) pairs."""
    require_columns(df, [x, y])
    points = df.select(present(df, x).alias("x"), present(df, y).alias("y"))
    return points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def _ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float] | None]:
    """Smallest and largest value per column, in one scan; None for a column without values."""
    require_columns(df, columns)
    row = df.agg(
        *[F.min(number(df, c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(number(df, c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: None if row[f"lo{i}"] is None else (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)
    }


def bin_of(value: Column, span: tuple[float, float], bins: int) -> Column:
    """Equal-width bin number; the largest value falls into the last bin. One bin if all are equal.

    Null stays null, which `least` alone would not keep.
    """
    low, high = span
    if high == low:
        return F.when(value.isNotNull(), F.lit(0).cast("bigint"))
    position = F.floor((value - F.lit(low)) / F.lit((high - low) / bins))
    return F.when(value.isNotNull(), F.least(position, F.lit(bins - 1).cast("bigint")))


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts on a grid over the complete pairs: (x_bin, y_bin, n)."""
    complete = df.filter(number(df, x).isNotNull() & number(df, y).isNotNull())
    spans = _ranges(complete, [x, y])
    if None in spans.values():
        return df.sparkSession.createDataFrame([], "x_bin bigint, y_bin bigint, n bigint")
    return (
        complete.groupBy(
            bin_of(number(df, x), spans[x], bins).alias("x_bin"), bin_of(number(df, y), spans[y], bins).alias("y_bin")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins, empty ones included: (bin, bin_start, bin_end, n)."""
    span = _ranges(df, [column])[column]
    if span is None:
        return df.sparkSession.createDataFrame([], "bin bigint, bin_start double, bin_end double, n bigint")
    low, high = span
    counted = (
        df.select(bin_of(number(df, column), span, bins).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    used = bins if high > low else 1
    width = (high - low) / used
    every = df.sparkSession.range(used).withColumnRenamed("id", "bin")
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def _density(binned: DataFrame, keys: list[str], span: tuple[float, float], bins: int, points: int) -> DataFrame:
    """Gaussian density on a grid from rows (keys, bin, n, total, bandwidth).

    There are at most `bins` rows per key, so each is spread over the grid and summed.
    """
    low, high = span
    centre = F.lit(low) + (F.col("bin") + F.lit(0.5)) * F.lit((high - low) / bins)
    step = (high - low) / (points - 1)
    at = F.lit(low) + F.col("point") * F.lit(step)
    z = (at - centre) / F.col("bandwidth")
    kernel = F.exp(F.lit(-0.5) * z * z) / F.sqrt(F.lit(2.0) * F.pi())
    return (
        binned.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(*keys, "point")
        .agg(F.sum(F.col("n") * kernel / (F.col("total") * F.col("bandwidth"))).alias("density"))
        .select(*keys, "point", at.alias("value"), "density")
    )


def kde_curve(df: DataFrame, column: str, bins: int = DENSITY_BINS, points: int = DENSITY_POINTS) -> DataFrame:
    """Density curve over binned values with Scott's bandwidth: (point, value, density)."""
    value = number(df, column)
    row = df.agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    ).first()
    if row["n"] < 2 or row["low"] == row["high"]:
        return df.sparkSession.createDataFrame([], "point int, value double, density double")
    span = (row["low"], row["high"])
    binned = (
        df.select(bin_of(value, span, bins).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("total", F.lit(row["n"]))
        .withColumn("bandwidth", F.lit(row["std"] * row["n"] ** -0.2))
    )
    return _density(binned, [], span, bins, points)


def violin_stats(
    df: DataFrame, x: str, y: str, bins: int = DENSITY_BINS, points: int = DENSITY_POINTS
) -> DataFrame:
    """A density curve of y per group x, on one grid for all groups: (x, point, value, density).

    A group needs two different values for a curve.
    """
    rows = df.select(present(df, x).alias("x"), number(df, y).alias("y")).filter("x is not null and y is not null")
    span = _ranges(rows, ["y"])["y"]
    if span is None or span[0] == span[1]:
        return rows.select("x", F.lit(0).alias("point"), F.lit(0.0).alias("value"), F.lit(0.0).alias("density")).limit(0)
    # Sums per (group, bin) first: what follows has at most `bins` rows per group.
    cells = rows.groupBy("x", bin_of(F.col("y"), span, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = rows.groupBy("x").agg(F.count(F.lit(1)).alias("total"), F.stddev_samp("y").alias("std"))
    binned = (
        cells.join(groups.filter("std > 0"), "x")
        .withColumn("bandwidth", F.col("std") * F.pow("total", F.lit(-0.2)))
    )
    return _density(binned, ["x"], span, bins, points)


def _box(rows: DataFrame, keys: list[str], row_bound: int, single_task_rows: int) -> tuple[DataFrame, DataFrame]:
    """Quartiles with fences per key, and the frequency rows (keys, value, n) joined to them."""
    counted = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counted, keys, [F.col("value")], ["n"], row_bound, single_task_rows)
    reach = F.lit(1.5) * (F.col("p75") - F.col("p25"))
    cuts = (
        quantiles(totals, keys, "value", QUARTILES)
        .withColumn("low_fence", F.col("p25") - reach)
        .withColumn("high_fence", F.col("p75") + reach)
    )
    salts = hot_key_salts(row_bound, single_task_rows)
    return cuts, join_per_key_stats(counted, cuts, keys, "value", salts)


def _box_rows(df: DataFrame, y: str, x: str | None) -> tuple[DataFrame, list[str]]:
    require_columns(df, [y] + ([x] if x else []))
    group = present(df, x) if x else F.lit(0)
    rows = df.select(group.alias("x"), number(df, y).alias("value"))
    return rows.filter(F.col("x").isNotNull() & F.col("value").isNotNull()), ["x"]


def _summarize_box(fenced: DataFrame, keys: list[str]) -> DataFrame:
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    return fenced.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.first(c).alias(c) for c in QUARTILES],
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers"),
    )


def box_stats(df: DataFrame, y: str, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Exact quartiles, the extreme values within 1.5 IQR, and the number of values outside."""
    rows, keys = _box_rows(df, y, None)
    return _summarize_box(_box(rows, keys, df.count(), single_task_rows)[1], keys).drop("x")


def box_stats_grouped(df: DataFrame, x: str, y: str, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """The box of y per group x."""
    rows, keys = _box_rows(df, y, x)
    return _summarize_box(_box(rows, keys, df.count(), single_task_rows)[1], keys)


def box_stats_many(
    df: DataFrame, boxes: list[tuple[int, str | None, str]], single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Boxes of several columns from one frequency table: (chart, x, n, p25, ...) for each (chart, x, y); x is text, '' if none."""
    require_columns(df, [c for _, x, y in boxes for c in (x, y) if c is not None])
    cells = []
    for chart, x, y in boxes:
        group, value = present(df, x).cast("string") if x else F.lit(""), number(df, y)
        cell = F.struct(F.lit(chart).alias("chart"), group.alias("x"), value.alias("value"))
        cells.append(F.when(group.isNotNull() & value.isNotNull(), cell))
    rows = df.select(F.inline(F.array_compact(F.array(*cells))))
    keys = ["chart", "x"]
    return _summarize_box(_box(rows, keys, df.count(), single_task_rows)[1], keys)


def box_outliers(df: DataFrame, y: str, x: str | None = None, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """The values outside the fences with their counts: (x, value, n)."""
    rows, keys = _box_rows(df, y, x)
    fenced = _box(rows, keys, df.count(), single_task_rows)[1]
    outside = fenced.filter(~F.col("value").between(F.col("low_fence"), F.col("high_fence")))
    return outside.select(*(["x"] if x else []), "value", "n")


def heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Correlations of all numeric columns, or of the listed ones."""
    return corr_matrix(df, columns)


def pie_chart(df: DataFrame, column: str, levels: int = PIE_LEVELS) -> DataFrame:
    """The most frequent levels as text and their share of what is shown: (level, n, share).

    A missing value is a level of its own, 'nan'.
    """
    require_columns(df, [column])
    level = F.coalesce(present(df, column).cast("string"), F.lit("nan"))
    top = (
        df.groupBy(level.alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("level"))
        .limit(levels)
    )
    # At most `levels` rows reach this window.
    return top.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def pair_grid(df: DataFrame, columns: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts on a grid for each pair of columns, and on the diagonal each column's histogram.

    Rows (x_col, y_col, x_bin, y_bin, n) with n > 0, for both orders of a pair. All pairs share one
    scan and are counted before the shuffle.
    """
    spans = _ranges(df, columns)
    used = [c for c in columns if spans[c] is not None]
    if not used:
        return df.sparkSession.createDataFrame([], "x_col string, y_col string, x_bin bigint, y_bin bigint, n bigint")
    binned = df.select(*[bin_of(number(df, c), spans[c], bins).alias(f"b{i}") for i, c in enumerate(used)])

    def cell(i: int, j: int) -> Column:
        return F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"b{i}").alias("x_bin"), F.col(f"b{j}").alias("y_bin")
        )

    pairs = [(i, i) for i in range(len(used))] + list(combinations(range(len(used)), 2))
    counted = (
        binned.select(F.inline(F.array(*[cell(i, j) for i, j in pairs])))
        .filter("x_bin is not null and y_bin is not null")
        .groupBy("i", "j", "x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    mirrored = F.struct(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("y_bin").alias("x_bin"), F.col("x_bin").alias("y_bin"), "n"
    )
    names = F.array(*[F.lit(c) for c in used])
    both = F.array(F.struct("i", "j", "x_bin", "y_bin", "n"), F.when(F.col("i") != F.col("j"), mirrored))
    return counted.select(F.inline(F.array_compact(both))).select(
        F.element_at(names, F.col("i") + 1).alias("x_col"),
        F.element_at(names, F.col("j") + 1).alias("y_col"),
        "x_bin",
        "y_bin",
        "n",
    )
