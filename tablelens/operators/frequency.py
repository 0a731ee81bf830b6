"""Frequency tables: how often each distinct value occurs in each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import present, quoted, type_of

_SLOTS = ("whole", "real", "text")


def _slots(df: DataFrame, name: str) -> Column:
    """One value in the slot of its kind (a decimal in two); the other slots are null.

    The row width stays the same however many columns the table has.
    """
    kind = type_of(df, name)
    value = present(df, name)
    if isinstance(kind, T.IntegralType):
        filled = {"whole": value.cast("bigint")}
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        filled = {"real": value.cast("double")}
    elif isinstance(kind, T.DecimalType):
        # ordered as a number, told apart and shown by its exact digits
        filled = {"real": value.cast("double"), "text": value.cast("string")}
    else:
        filled = {"text": value.cast("string")}
    types = {"whole": "bigint", "real": "double", "text": "string"}
    return F.struct(*[filled.get(s, F.lit(None).cast(types[s])).alias(s) for s in _SLOTS])


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (position, whole, real, text, n): one per distinct value of each column.

    A missing value is the row with all three slots null. All columns share one scan and one
    shuffle, counted before the shuffle, so frequent values travel as one row per task.
    """
    cells = df.select(*[_slots(df, name).alias(str(i)) for i, name in enumerate(columns)])
    long_form = cells.unpivot([], [quoted(str(i)) for i in range(len(columns))], "position", "value")
    return (
        long_form.groupBy(
            F.col("position").cast("int").alias("position"),
            *[F.col(f"value.{s}").alias(s) for s in _SLOTS],
        ).agg(F.count(F.lit(1)).alias("n"))
    )


def is_present() -> Column:
    return F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()


def value_text() -> Column:
    return F.coalesce(F.col("whole").cast("string"), F.col("text"), F.col("real").cast("string"))


def frequency_summary(frequencies: DataFrame) -> DataFrame:
    """Per column: distinct values, the most frequent one (smallest on a tie) and its count."""
    first = F.min(F.struct((-F.col("n")).alias("rarity"), *_SLOTS))
    return (
        frequencies.filter(F.when(is_present(), F.col("n")) > 0)
        .groupBy("position")
        .agg(F.count(F.lit(1)).alias("n_distinct"), first.alias("first"))
        .select("position", "n_distinct", "first.*")
        .select(
            "position",
            "n_distinct",
            value_text().alias("top"),
            (-F.col("rarity")).alias("top_freq"),
        )
    )


def numeric_frequencies(frequencies: DataFrame) -> DataFrame:
    """Rows (position, value DOUBLE, n) of the numeric slots."""
    # The condition names the count, so it stays above the shuffle that other readers share.
    value = F.coalesce(F.col("real"), F.col("whole").cast("double"))
    return frequencies.select("position", value.alias("value"), "n").filter(
        F.when(F.col("value").isNotNull(), F.col("n")) > 0
    )
