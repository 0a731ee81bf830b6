"""Cleaning: dropping, imputing and scaling columns.

Fitting collects one row of statistics per column; applying is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import (
    is_numeric,
    missing,
    number,
    numeric_columns,
    per_column,
    quoted,
    string_columns,
)
from tablelens.operators.profile import column_modes

FILL_TEXT = "missing"


@dataclass(frozen=True)
class ColumnFit:
    """What the cleaning steps need to know of one column."""

    n_rows: int
    n_missing: int
    mean: float | None
    squares: float  # sum of squared deviations from the mean, over present values

    @property
    def missing_share(self) -> float:
        return self.n_missing / self.n_rows if self.n_rows else 0.0

    def deviation(self, ddof: int) -> float:
        """Standard deviation of the present values."""
        n = self.n_rows - self.n_missing - ddof
        return sqrt(self.squares / n) if n > 0 else 0.0

    def filled(self) -> ColumnFit:
        """The same column after filling with its mean: filled cells deviate by nothing."""
        return ColumnFit(self.n_rows, 0, self.mean, self.squares)


def fit_columns(df: DataFrame, columns: list[str] | None = None) -> dict[str, ColumnFit]:
    chosen = df.columns if columns is None else columns
    if not chosen:
        return {}

    def stats(c: str) -> dict[str, Column]:
        value = number(df, c) if is_numeric(df, c) else F.lit(None).cast("double")
        return {
            "n_rows": F.count(F.lit(1)),
            "n_missing": F.count(F.when(missing(df, c), F.lit(1))),
            "mean": F.avg(value),
            "squares": F.var_pop(value) * F.count(value),
        }

    rows = per_column(df, chosen, stats, fields_per_stat=2).collect()
    return {r["column_name"]: ColumnFit(r["n_rows"], r["n_missing"], r["mean"], r["squares"] or 0.0) for r in rows}


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """The same columns in the same order, some with a new value."""
    return df.select(*[changed[c].alias(c) if c in changed else quoted(c) for c in df.columns])


def drop_index_column(df: DataFrame, name: str = "_c0") -> DataFrame:
    return df.drop(name)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the listed columns; unknown names are ignored."""
    listed = set(columns)
    return df.select(*[quoted(c) for c in df.columns if c not in listed])


def drop_empty_columns(
    df: DataFrame, threshold: float = 1.0, fit: dict[str, ColumnFit] | None = None
) -> DataFrame:
    """Drop columns whose missing share reaches the threshold; an empty table keeps them all."""
    fitted = fit or fit_columns(df)
    return drop_columns(df, [c for c in df.columns if fitted[c].n_rows and fitted[c].missing_share >= threshold])


def impute_mean(df: DataFrame, fit: dict[str, ColumnFit] | None = None) -> DataFrame:
    """Fill numeric columns with their mean; they become double."""
    columns = numeric_columns(df)
    fitted = fit or fit_columns(df, columns)
    return _replace(
        df, {c: F.coalesce(number(df, c), F.lit(fitted[c].mean).cast("double")) for c in columns}
    )


def impute_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill string columns with their most frequent value, or a fixed text if there is none."""
    chosen = string_columns(df) if columns is None else columns
    if not chosen:
        return df
    modes = {r["column_name"]: r["mode"] for r in column_modes(df, chosen).collect()}
    return _replace(df, {c: F.coalesce(quoted(c), F.lit(modes[c] if modes[c] is not None else FILL_TEXT)) for c in chosen})


def fill_constant(df: DataFrame, columns: list[str], text: str = FILL_TEXT) -> DataFrame:
    known = [c for c in columns if c in string_columns(df)]
    return _replace(df, {c: F.coalesce(quoted(c), F.lit(text)) for c in known})


def scale(
    df: DataFrame,
    columns: list[str] | None = None,
    center: bool = True,
    ddof: int = 0,
    fit: dict[str, ColumnFit] | None = None,
) -> DataFrame:
    """Divide by the standard deviation, after taking off the mean if `center`.

    The default is the z-score with the population deviation. A constant column becomes 0.
    """
    chosen = numeric_columns(df) if columns is None else columns
    fitted = fit or fit_columns(df, chosen)

    def scaled(c: str) -> Column:
        deviation = fitted[c].deviation(ddof)
        if deviation == 0.0:
            return F.when(number(df, c).isNotNull(), F.lit(0.0))
        shifted = number(df, c) - F.lit(fitted[c].mean) if center else number(df, c)
        return shifted / F.lit(deviation)

    return _replace(df, {c: scaled(c) for c in chosen})


def wants_scaling(instructions: dict[str, list[str]]) -> bool:
    return _first(instructions, "standard_scalar", "no").lower() == "yes"


def _first(instructions: dict[str, list[str]], key: str, default: str | None) -> str | None:
    """The first item of a list that may be absent or empty."""
    values = instructions.get(key) or []
    return values[0] if values else default


def columns_to_scale(
    df: DataFrame, instructions: dict[str, list[str]], exclude_target: bool = False
) -> list[str]:
    """Numeric columns; a classification target is left out, a regression target only on request."""
    problem = _first(instructions, "problem_type", "regression").lower()
    target = _first(instructions, "target_column", None)
    skip = [target] if target and (problem == "classification" or exclude_target) else []
    return numeric_columns(df, exclude=skip)


def scale_gated(
    df: DataFrame,
    instructions: dict[str, list[str]],
    center: bool = True,
    ddof: int = 0,
    exclude_target: bool = False,
    fit: dict[str, ColumnFit] | None = None,
) -> DataFrame:
    """Scale only if the instructions ask for it."""
    if not wants_scaling(instructions):
        return df
    return scale(df, columns_to_scale(df, instructions, exclude_target), center, ddof, fit)
