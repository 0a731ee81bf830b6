"""What the operators share: reading tables, learning samples, binding a value inside an expression."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def whole_text(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def learning_labels(labels: DataFrame, label: str, folds: int, kept_out: int, rows: int) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: about `rows` of them at most.

    A row may be learned from if crc32(doc_id as text) mod `folds` is not `kept_out`. The sample is
    taken by a hash of doc_id, so it is the same in every run. Of a repeated doc_id the largest label
    counts; rows without doc_id or label give nothing.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .filter(~held_out(folds, kept_out))
    )
    share = min(1.0, rows / max(1, usable.count()))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    return drawn.groupBy("doc_id").agg(F.max("label").alias("label"))


def held_out(folds: int, kept_out: int) -> Column:
    """Whether a row is kept out of learning; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == kept_out


#: Rows that a Python worker gets at a time, as texts can be long.
BATCH_ROWS = 500


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, and give them small batches of rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
