"""Profiling: table info, per-column statistics, duplicates, samples and alerts.

Every function returns a long table with one row per column (or per value), computed in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import (
    is_floating,
    is_numeric,
    missing,
    number,
    numeric_columns,
    per_column,
    present,
    quoted,
    require_columns,
    type_of,
)
from tablelens.operators.frequency import (
    frequency_summary,
    is_present,
    numeric_frequencies,
    value_frequencies,
    value_text,
)
from tablelens.operators.ranks import SINGLE_TASK_ROWS, quantiles, running_totals


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _count_missing(df: DataFrame, name: str) -> Column:
    return F.count(F.when(missing(df, name), F.lit(1)))


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, number of columns, and each column's name, type and missing count."""
    return per_column(
        df,
        df.columns,
        lambda c: {
            "data_type": F.first(F.lit(type_of(df, c).simpleString())),
            "n_missing": _count_missing(df, c),
            "n_rows": F.count(F.lit(1)),
        },
    ).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def memory_estimate(df: DataFrame) -> DataFrame:
    """Bytes of values per column: fixed width per row, or the summed length of strings."""

    def size(c: str) -> Column:
        kind = type_of(df, c)
        if isinstance(kind, T.StringType):
            return F.coalesce(F.sum(F.octet_length(quoted(c))), F.lit(0)).cast("bigint")
        if isinstance(kind, T.BinaryType):
            return F.coalesce(F.sum(F.length(quoted(c))), F.lit(0)).cast("bigint")
        if isinstance(kind, T.ArrayType):
            width = F.lit(_WIDTHS.get(type(kind.elementType), 8))
            return F.coalesce(F.sum(F.size(quoted(c)) * width), F.lit(0)).cast("bigint")
        return (F.count(F.lit(1)) * F.lit(_WIDTHS.get(type(kind), 8))).cast("bigint")

    return per_column(df, df.columns, lambda c: {"n_bytes": size(c)}).withColumn(
        "megabytes", F.col("n_bytes") / F.lit(1024.0 * 1024.0)
    )


_WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def missing_counts(df: DataFrame) -> DataFrame:
    return per_column(df, df.columns, lambda c: {"n_missing": _count_missing(df, c)})


def schema_info(df: DataFrame) -> DataFrame:
    return per_column(
        df,
        df.columns,
        lambda c: {
            "data_type": F.first(F.lit(type_of(df, c).simpleString())),
            "n_present": F.count(present(df, c)),
        },
    )


def filter_missing(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value in `column` is missing."""
    require_columns(df, [column])
    return df.filter(missing(df, column))


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df)])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one; missing equals missing.

    A row hash is counted first, so that only rows whose hash repeats are compared in full. The
    wide rows of a table with few duplicates are not shuffled when the repeating hashes are few
    enough for the optimizer to broadcast them.
    """
    names = df.columns
    # Adding 0.0 turns -0.0 into 0.0, which grouping treats as equal but a hash does not.
    keys = [present(df, c) + F.lit(0.0) if is_floating(df, c) else quoted(c) for c in names]
    hashed = df.select(*[present(df, c).alias(f"v{i}") for i, c in enumerate(names)], F.xxhash64(*keys).alias("h"))
    repeated = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    groups = (
        hashed.join(repeated, "h", "left_semi")
        .groupBy(*[f"v{i}" for i in range(len(names))])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def _text_value(df: DataFrame, name: str) -> Column:
    return _null("string") if is_numeric(df, name) else quoted(name).cast("string")


def _number_value(df: DataFrame, name: str) -> Column:
    return number(df, name) if is_numeric(df, name) else _null("double")


def describe_basic(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, smallest and largest value of numeric and string columns."""
    kinds = (T.NumericType, T.StringType)
    chosen = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return per_column(
        df,
        chosen,
        lambda c: {
            "n": F.count(present(df, c)),
            "mean": F.avg(_number_value(df, c)),
            "std": F.stddev_samp(_number_value(df, c)),
            "min_number": F.min(_number_value(df, c)),
            "max_number": F.max(_number_value(df, c)),
            "min_text": F.min(_text_value(df, c)),
            "max_text": F.max(_text_value(df, c)),
        },
        fields_per_stat=2,
    )


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
PROFILE_QUANTILES = {"p5": 0.05, **QUARTILES, "p95": 0.95}


def column_quantiles(
    df: DataFrame,
    frequencies: DataFrame,
    probabilities: dict[str, float],
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Exact quantiles of the numeric columns of a frequency table of `df`."""
    totals = running_totals(
        numeric_frequencies(frequencies), ["position"], [F.col("value")], ["n"], df.count(), single_task_rows
    )
    return quantiles(totals, ["position"], "value", probabilities)


def describe_full(df: DataFrame, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Count, unique, top and its frequency for non-numeric columns; moments and quartiles for numeric."""
    basic = describe_basic(df, df.columns).select("position", "column_name", "n", "mean", "std", "min_number", "max_number")
    frequencies = value_frequencies(df, df.columns)
    text_positions = [i for i, c in enumerate(df.columns) if not is_numeric(df, c)]
    summary = frequency_summary(frequencies.filter(F.col("position").isin(text_positions)))
    return (
        basic.join(summary, "position", "left")
        .join(column_quantiles(df, frequencies, QUARTILES, single_task_rows), "position", "left")
        .withColumnRenamed("n_distinct", "n_unique")
    )


def distinct_counts(df: DataFrame, include_null: bool = False) -> DataFrame:
    """Exact distinct values per column; with `include_null` a missing value counts as one more."""
    frequencies = value_frequencies(df, df.columns)
    counted = frequencies if include_null else frequencies.filter(is_present())
    found = counted.groupBy("position").agg(F.count(F.lit(1)).alias("n_distinct"))
    return _all_columns(df).join(found, "position", "left").select(
        "position", "column_name", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct")
    )


def approx_distinct(df: DataFrame, rsd: float = 0.05) -> DataFrame:
    return per_column(df, df.columns, lambda c: {"n_distinct": F.approx_count_distinct(present(df, c), rsd)})


def column_means(df: DataFrame) -> DataFrame:
    """Means of the numeric columns; no rows if there are none."""
    columns = numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "position int, column_name string, mean double")
    return per_column(df, columns, lambda c: {"mean": F.avg(number(df, c))})


def column_modes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The most frequent present value per column, as text; the smallest one on a tie."""
    chosen = columns or df.columns
    found = frequency_summary(value_frequencies(df, chosen)).select(
        "position", F.col("top").alias("mode"), F.col("top_freq").alias("n")
    )
    return _all_columns(df, chosen).join(found, "position", "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n) for the present values of one column."""
    require_columns(df, [column])
    return df.groupBy(present(df, column).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("value is not null")


def _all_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (position, column_name): the schema as a table."""
    rows = list(enumerate(columns or df.columns))
    return df.sparkSession.createDataFrame(rows, "position int, column_name string")


def sample_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first `n` rows in a stated order."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n)


def top_value(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value of one column and its count; the smallest value on a tie."""
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(1)


def _profile_stats(df: DataFrame, c: str) -> dict[str, Column]:
    value = _number_value(df, c)
    is_text = isinstance(type_of(df, c), T.StringType)
    length = F.length(quoted(c)) if is_text else _null("int")
    return {
        "data_type": F.first(F.lit(type_of(df, c).simpleString())),
        "n_rows": F.count(F.lit(1)),
        "n_missing": _count_missing(df, c),
        "n_zeros": F.count(F.when(value == 0, F.lit(1))),
        "n_negative": F.count(F.when(value < 0, F.lit(1))),
        "min_number": F.min(value),
        "max_number": F.max(value),
        "std": F.stddev_samp(value),
        "skewness": F.skewness(value),
        "kurtosis": F.kurtosis(value),
        "total": F.sum(value),
        "min_length": F.min(length),
        "mean_length": F.avg(length),
        "max_length": F.max(length),
    }


QUANTILE_ACCURACY = 10_000
DISTINCT_LOG_SIZE = 14  # a standard error below one percent


def _sketch_stats(df: DataFrame, c: str) -> dict[str, Column]:
    value = present(df, c)
    cuts = F.array(*[F.lit(p) for p in PROFILE_QUANTILES.values()])
    # A sketch keeps its state in one binary field, while approx_count_distinct spreads it over hundreds.
    hashed = F.when(value.isNotNull(), F.xxhash64(value))
    return {
        "n_distinct": F.hll_sketch_estimate(F.hll_sketch_agg(hashed, DISTINCT_LOG_SIZE)),
        "cuts": F.percentile_approx(_number_value(df, c), cuts, QUANTILE_ACCURACY),
    }


def column_profile(df: DataFrame, approx: bool = False, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """The full profile, one row per column.

    A wide aggregate gives the counts and moments. One frequency table, shuffled once and used
    twice, gives distinct counts, the top value and exact quantiles. With `approx` sketches take its
    place: nothing but a few sketches per task is shuffled, and the top value is left out.
    """
    if approx:
        sketched = per_column(df, df.columns, lambda c: _sketch_stats(df, c), fields_per_stat=2).select(
            "position",
            "n_distinct",
            _null("string").alias("top"),
            _null("bigint").alias("top_freq"),
            *[F.get("cuts", F.lit(i)).alias(p) for i, p in enumerate(PROFILE_QUANTILES)],
        )
        joined = per_column(df, df.columns, lambda c: _profile_stats(df, c), fields_per_stat=2).join(
            F.broadcast(sketched), "position", "left"
        )
    else:
        frequencies = value_frequencies(df, df.columns).filter(is_present())
        summary = frequency_summary(frequencies)
        cuts = column_quantiles(df, frequencies, PROFILE_QUANTILES, single_task_rows)
        # One row per column on each side.
        joined = (
            per_column(df, df.columns, lambda c: _profile_stats(df, c), fields_per_stat=2)
            .join(F.broadcast(summary), "position", "left")
            .join(F.broadcast(cuts), "position", "left")
        )
    n_present = F.col("n_rows") - F.col("n_missing")
    n_distinct = F.coalesce("n_distinct", F.lit(0)).cast("bigint")
    return (
        joined.withColumn("n_distinct", n_distinct)
        .withColumn("mean", F.when(n_present > 0, F.col("total") / n_present))
        .withColumn("variance", F.col("std") * F.col("std"))
        .withColumn("missing_share", _share("n_missing", F.col("n_rows")))
        .withColumn("distinct_share", _share("n_distinct", n_present))
        .withColumn("is_unique", (n_present > 0) & (F.col("n_distinct") == n_present))
        .withColumn("is_constant", F.col("n_distinct") == 1)
        .withColumn("iqr", F.col("p75") - F.col("p25"))
    )


def _share(part: str, whole: Column) -> Column:
    return F.when(whole > 0, F.col(part) / whole).otherwise(F.lit(0.0))


def profile_alerts(
    profile: DataFrame,
    high_missing: float = 0.05,
    high_zeros: float = 0.1,
    high_cardinality: int = 50,
) -> DataFrame:
    """Rows (position, column_name, alert), derived from the result of `column_profile`."""
    is_text = F.col("data_type") == "string"
    n_present = F.col("n_rows") - F.col("n_missing")
    rules = {
        "constant": F.col("is_constant"),
        "unique": F.col("is_unique"),
        "high_missing": F.col("missing_share") > high_missing,
        "high_zeros": F.col("n_zeros") > n_present * F.lit(high_zeros),
        "high_cardinality": is_text & (F.col("n_distinct") > high_cardinality),
    }
    raised = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return profile.select("position", "column_name", F.explode(F.array_compact(raised)).alias("alert"))
