"""Equi joins that keep null keys and stay balanced when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keeping_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` where null meets null; the keys appear once in the result."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def join_per_key_stats(
    rows: DataFrame, stats: DataFrame, keys: list[str], spread_by: str, salts: int
) -> DataFrame:
    """Attach one stats row per key to many rows per key.

    With `salts` > 1 the rows of one key are spread over that many join partitions by a hash of
    `spread_by`, and the stats row is repeated once for each of them.
    """
    if salts <= 1:
        return join_keeping_nulls(rows, stats, keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_keeping_nulls(salted, repeated, [*keys, "_salt"]).drop("_salt")
