"""The whole clean: drop, drop empty, impute, scale."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablelens.functions.columns import string_columns
from tablelens.operators.clean import (
    drop_columns,
    drop_empty_columns,
    fit_columns,
    impute_mean,
    impute_mode,
    scale_gated,
)


def clean_table(
    df: DataFrame,
    instructions: dict[str, list[str]],
    center: bool = True,
    ddof: int = 0,
    exclude_target: bool = False,
) -> DataFrame:
    """Clean by an instruction record of string lists.

    One aggregate fits everything numeric: filling with the mean leaves the mean and the sum of
    squared deviations as they are, so the scaling needs no second pass. A second job counts string
    values, for string columns with gaps only.
    """
    kept = drop_columns(df, instructions.get("drop_columns") or [])
    fit = fit_columns(kept)
    kept = drop_empty_columns(kept, fit=fit)
    gappy = [c for c in string_columns(kept) if fit[c].n_missing]
    filled = impute_mean(impute_mode(kept, gappy), fit=fit)
    after_fill = {c: f.filled() for c, f in fit.items()}
    return scale_gated(filled, instructions, center, ddof, exclude_target, fit=after_fill)
