"""Running totals over ordered values and exact quantiles, without a single-task sort.

Input tables here are frequency tables: one row per distinct (keys, value) with a count, so a hot
value is one row. Up to `SINGLE_TASK_ROWS` rows per key a plain window is used. Beyond that the rows
are range-partitioned over (keys, value), which spreads one hot key over many partitions; each range
gets a running sum of its own and the sum of the ranges before it is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.joins import join_keeping_nulls, join_per_key_stats
from tablelens.session import cut_lineage

SINGLE_TASK_ROWS = 2_000_000
HOT_KEY_SALTS = 32
ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 100_000


def running_totals(
    rows: DataFrame,
    keys: list[str],
    order: list[Column],
    measures: list[str],
    row_bound: int,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Add `run_<m>` (inclusive running sum) and `all_<m>` (total of the key) for each measure.

    `rows` holds one row per (keys, order); `row_bound` is an upper bound of the rows of one key.
    """
    if row_bound <= single_task_rows:
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(
            "*",
            *[F.sum(m).over(upto).alias(f"run_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
        )

    # A row must fall into the same range in both uses below, so the ranges are written once.
    by = [F.col(k) for k in keys] + order
    ranged = cut_lineage(
        rows.repartitionByRange(_ranges(rows, row_bound), *by).withColumn("_range", F.spark_partition_id())
    )
    # One row per (range, key): few per key, whatever the size of the key.
    sums = ranged.groupBy("_range", *keys).agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_range",
        *keys,
        *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(of_key).alias(f"all_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy("_range", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return join_keeping_nulls(ranged, offsets, ["_range", *keys]).select(
        *rows.columns,
        *[(F.col(f"_before_{m}") + F.sum(m).over(inside)).alias(f"run_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def _ranges(rows: DataFrame, row_bound: int) -> int:
    """As many ranges as a shuffle has partitions, more if one key alone would overfill them."""
    shuffle = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, min(MAX_RANGES, row_bound // ROWS_PER_RANGE))


def quantiles(totals: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key from running counts (`n`, `run_n`, `all_n`).

    `probabilities` maps result column to probability. One row per key.
    """
    found, picked = [], []
    for name, p in probabilities.items():
        position = (F.col("all_n") - 1) * F.lit(float(p))
        below, above = F.floor(position), F.ceil(position)
        first, last = F.col("run_n") - F.col("n"), F.col("run_n") - 1
        found += [
            F.max(F.when(below.between(first, last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(above.between(first, last), F.col(value))).alias(f"_hi_{name}"),
            F.max(position - below).alias(f"_part_{name}"),
        ]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        picked.append((low + (high - low) * F.col(f"_part_{name}")).alias(name))
    return totals.groupBy(*keys).agg(*found).select(*keys, *picked)


def hot_key_salts(row_bound: int, single_task_rows: int = SINGLE_TASK_ROWS) -> int:
    return 1 if row_bound <= single_task_rows else HOT_KEY_SALTS


__all__ = ["running_totals", "quantiles", "hot_key_salts", "join_per_key_stats", "SINGLE_TASK_ROWS"]
