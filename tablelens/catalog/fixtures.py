"""Tables derived from the given ones, each in Spark and as the SQL text of the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round some columns, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def orders_gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with nulls and NaN in the price, nulls in the priority and an empty column."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(key % 7 == 0, None)
        .when(key % 11 == 0, F.lit(float("nan")))
        .otherwise(F.col("o_totalprice"))
        .alias("o_totalprice"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.lit(None).cast("string").alias("empty_col"),
    )


# `gappy` as above, and `known` with NaN as null.
GAPPY_SQL = """
gappy AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE)
              ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority,
         CAST(NULL AS VARCHAR) AS empty_col
  FROM orders),
known AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN NOT isnan(o_totalprice) THEN o_totalprice END AS o_totalprice,
         o_orderpriority, empty_col
  FROM gappy)
"""

GAPPY_COLUMNS = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderpriority", "string"),
    ("empty_col", "string"),
]


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
