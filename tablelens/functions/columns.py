"""Column helpers shared by all operators: kinds, missing values, long-form results."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.NumericType)


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into null so that both count as missing."""
    value = quoted(name)
    return F.when(~F.isnan(value), value) if is_floating(df, name) else value


def missing(df: DataFrame, name: str) -> Column:
    value = quoted(name)
    return value.isNull() | F.isnan(value) if is_floating(df, name) else value.isNull()


def number(df: DataFrame, name: str) -> Column:
    """The value as double, null where missing."""
    return present(df, name).cast("double")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")


FIELDS_PER_AGGREGATE = 60


def per_column(
    df: DataFrame,
    columns: list[str],
    stats: Callable[[str], dict[str, Column]],
    fields_per_stat: int = 1,
) -> DataFrame:
    """Aggregates of every column, returned as one row per column.

    Neighbouring columns share one aggregate over the table, laid out in long form afterwards. An
    aggregate holds at most FIELDS_PER_AGGREGATE buffer fields, which keeps it inside whole-stage
    code generation; a wider table becomes several aggregates, each reading its own columns only,
    so that a columnar source is still read once. `fields_per_stat` is the average number of buffer
    fields of a statistic (a moment needs several).
    """
    parts: list[DataFrame] = []
    aggregates: list[Column] = []
    rows: list[Column] = []

    def flush() -> None:
        if rows:
            parts.append(df.agg(*aggregates).select(F.inline(F.array(*rows))))
            aggregates.clear()
            rows.clear()

    for position, name in enumerate(columns):
        expressions = stats(name)
        if (len(aggregates) + len(expressions)) * fields_per_stat > FIELDS_PER_AGGREGATE:
            flush()
        fields = [F.lit(position).alias("position"), F.lit(name).alias("column_name")]
        for stat, expression in expressions.items():
            key = f"{stat}_{position}"
            aggregates.append(expression.alias(key))
            fields.append(F.col(key).alias(stat))
        rows.append(F.struct(*fields))
    flush()
    if not parts:
        return df.sparkSession.createDataFrame([], "position int, column_name string")
    return reduce(DataFrame.unionByName, parts)
