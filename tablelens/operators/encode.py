"""Label encoding, feature vectors, and splits that do not depend on the partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import is_numeric, present, quoted, require_columns
from tablelens.operators.ranks import SINGLE_TASK_ROWS, running_totals

#: Bytes of a label that count as a row where labels are sorted in one task: long ones are sorted by ranges.
BYTES_PER_ROW = 32
#: Bytes of labels, as counted, up to which all tasks get them; and parts that rows without a label are dealt to.
SENT, SPREAD = 8 << 20, 4096


@dataclass
class LabelTable:
    """Rows (label, n, code) of one column, their number, the rows that have one, and the bytes of the labels if counted."""

    rows: DataFrame
    n_labels: int
    n_rows: int
    n_bytes: int | None = None


def _label_text(df: DataFrame, column: str, missing_text: str | None) -> Column:
    text = present(df, column).cast("string")
    return text if missing_text is None else F.coalesce(text, F.lit(missing_text))


def fit_labels(
    df: DataFrame,
    column: str,
    order: str = "frequency",
    missing_text: str | None = None,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> LabelTable:
    """Number the distinct values of a column from 0, most frequent first or in sorted order.

    Ties in frequency are broken by the value. Without `missing_text` missing values get no code.
    """
    counted = (
        df.groupBy(_label_text(df, column, missing_text).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("label").isNotNull())
    )
    size = counted.agg(
        F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows"), F.sum(F.octet_length("label") + BYTES_PER_ROW).alias("bytes")
    ).first()
    n_bytes = size["bytes"] or 0
    orders = {"frequency": [F.desc("n"), F.asc("label")], "sorted": [F.asc("label")]}
    ranked = running_totals(
        counted.withColumn("one", F.lit(1).cast("bigint")), [], orders[order], ["one"], n_bytes // BYTES_PER_ROW, single_task_rows
    )
    codes = ranked.select("label", "n", (F.col("run_one") - 1).alias("code"))
    return LabelTable(codes, size["labels"], size["rows"] or 0, n_bytes)


def attach_codes(df: DataFrame, column: str, labels: LabelTable, missing_text: str | None = None) -> DataFrame:
    """Replace a column by its codes; a value without a code gets the next free one.

    One join of all rows. Labels that are small by their counted bytes are sent to all tasks, so that the rows
    stay where they are; otherwise rows without a label are dealt to many parts by their hash, and Spark
    splits the partitions of hot labels at run time.
    """
    keyed = df.withColumn("_label", _label_text(df, column, missing_text))
    codes = labels.rows.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
    if labels.n_bytes is not None and labels.n_bytes <= SENT:
        joined = keyed.join(F.broadcast(codes), "_label", "left")
    else:
        part = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(SPREAD)) + 1
        keyed = keyed.withColumn("_label_part", F.when(F.col("_label").isNull(), part).otherwise(0))
        joined = keyed.join(codes.withColumn("_label_part", F.lit(0).cast("bigint")), ["_label", "_label_part"], "left")
    code = F.coalesce(F.col("_code"), F.lit(labels.n_labels).cast("bigint"))
    return joined.select(*[code.alias(c) if c == column else quoted(c) for c in df.columns])


def label_encode(
    df: DataFrame, columns: list[str], order: str = "frequency", missing_text: str | None = None
) -> DataFrame:
    """Encode the listed columns in place; unknown names are ignored.

    Every column is fitted on the table as given, so the plan grows by one scan a column.
    """
    fitted = {c: fit_labels(df, c, order, missing_text) for c in columns if c in df.columns}
    for column, labels in fitted.items():
        df = attach_codes(df, column, labels, missing_text)
    return df


def features_target(df: DataFrame, target: str, problem_type: str) -> tuple[list[str], str]:
    """Feature names and target name; an unknown target or problem type is an error."""
    if not target or target not in df.columns:
        raise ValueError("the target column is not given or not in the table")
    if problem_type not in ("classification", "regression"):
        raise ValueError("the problem type must be 'classification' or 'regression'")
    return [c for c in df.columns if c != target], target


def assemble_features(df: DataFrame, columns: list[str], output: str = "features", invalid: str = "error") -> DataFrame:
    """Add a vector of the numeric columns; anything else is an error up front."""
    require_columns(df, columns)
    wrong = [c for c in columns if not is_numeric(df, c)]
    if wrong:
        raise ValueError(f"columns are not numeric: {wrong}")
    return VectorAssembler(inputCols=columns, outputCol=output, handleInvalid=invalid).transform(df)


def label_index(df: DataFrame, target: str, output: str = "label") -> DataFrame:
    """Add the class number of the target, most frequent first; rows without a target are left out."""
    known = df.filter(present(df, target).isNotNull())
    numbered = attach_codes(known.withColumn(output, quoted(target)), output, fit_labels(known, target))
    return numbered.withColumn(output, F.col(f"`{output}`").cast("double"))


def _bucket(columns: list[str], seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[quoted(c) for c in columns], F.lit(seed)), F.lit(buckets))


def train_test_split(
    df: DataFrame, keys: list[str], train_percent: int = 80, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by a hash of the keys: the same rows whatever the partitioning."""
    require_columns(df, keys)
    in_train = _bucket(keys, seed, 100) < train_percent
    return df.filter(in_train), df.filter(~in_train)


def with_fold(df: DataFrame, keys: list[str], folds: int = 3, seed: int = 42, output: str = "fold") -> DataFrame:
    """Add a fold number for cross-validation by a hash of the keys."""
    require_columns(df, keys)
    return df.withColumn(output, _bucket(keys, seed + 1, folds).cast("int"))
