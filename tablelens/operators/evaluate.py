"""Evaluation of predictions: confusion matrix, ROC, classification and regression metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import number, present, quoted, require_columns
from tablelens.operators.ranks import SINGLE_TASK_ROWS, running_totals


def _counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    require_columns(df, [label, prediction])
    return (
        df.groupBy(present(df, label).alias("label"), present(df, prediction).alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("label is not null and prediction is not null")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, labels: list | None = None) -> DataFrame:
    """Rows (label, prediction, n) for all combinations of the labels, zero counts included.

    Without a label list the labels are those that occur, however many. The table of labels stays
    distributed; the driver sees their number.
    """
    counted = _counts(df, label, prediction)
    kind = counted.schema["label"].dataType
    if labels is None:
        named = counted.select(F.explode(F.array("label", "prediction")).alias("v")).distinct()
    else:
        named = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in labels])).alias("v"))
    size = named.count()
    if not size:
        return counted
    one = named.withColumn("one", F.lit(1).cast("bigint"))
    numbered = running_totals(one, [], [F.asc("v")], ["one"], size).select("v", F.col("run_one").alias("i"))
    each = numbered.select(F.col("v").alias("label"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(size).cast("bigint"))).alias("i"))
    every = each.join(numbered, "i").select("label", F.col("v").alias("prediction"))
    return every.join(counted, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def roc_curve(
    df: DataFrame, label: Column, score: str, single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """One point per distinct score, highest first: (score, tp, fp, tpr, fpr), and the origin.

    `label` is a boolean column. A rate is null if its class does not occur.
    """
    rows = df.select(label.cast("boolean").alias("positive"), number(df, score).alias("score"))
    counted = (
        rows.filter("positive is not null and score is not null")
        .groupBy("score")
        .agg(
            F.count(F.when(F.col("positive"), F.lit(1))).alias("pos"),
            F.count(F.when(~F.col("positive"), F.lit(1))).alias("neg"),
        )
    )
    totals = running_totals(counted, [], [F.desc("score")], ["pos", "neg"], df.count(), single_task_rows)

    def rate(m: str) -> Column:
        return F.when(F.col(f"all_{m}") > 0, F.col(f"run_{m}") / F.col(f"all_{m}"))

    points = totals.select(
        "score",
        F.col("run_pos").alias("tp"),
        F.col("run_neg").alias("fp"),
        rate("pos").alias("tpr"),
        rate("neg").alias("fpr"),
    )
    zero = F.lit(0).cast("bigint")
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"),
        zero.alias("tp"),
        zero.alias("fp"),
        F.lit(0.0).alias("tpr"),
        F.lit(0.0).alias("fpr"),
    )
    return origin.unionByName(points)


def roc_auc(df: DataFrame, label: Column, score: str, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Area under the ROC curve by trapezoids: ties count half. One row (auc)."""
    rows = df.select(label.cast("boolean").alias("positive"), number(df, score).alias("score"))
    counted = (
        rows.filter("positive is not null and score is not null")
        .groupBy("score")
        .agg(
            F.count(F.when(F.col("positive"), F.lit(1))).alias("pos"),
            F.count(F.when(~F.col("positive"), F.lit(1))).alias("neg"),
        )
    )
    totals = running_totals(counted, [], [F.asc("score")], ["neg"], df.count(), single_task_rows)
    # Each positive beats the negatives with a lower score and half of those with the same score.
    wins = F.sum(F.col("pos").cast("double") * (F.col("run_neg") - F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return totals.agg(F.when(pairs > 0, wins / pairs).alias("auc"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row (accuracy, f1, weightedPrecision, weightedRecall), weighted by class size.

    The rows are counted per (label, prediction) first; the rest works on these counts.
    """
    counted = _counts(df, label, prediction)
    sides = counted.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed")),
                F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed")),
            )
        ),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
    )
    # A hit appears once on each side.
    classes = sides.groupBy("c").agg(
        F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), (F.sum("hit") / 2).alias("hits")
    )
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(F.lit(0.0))
    recall = F.when(F.col("actual") > 0, F.col("hits") / F.col("actual")).otherwise(F.lit(0.0))
    both = precision + recall
    f1 = F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))

    def weighted(metric: Column) -> Column:
        return F.sum(metric * F.col("actual")) / F.sum("actual")

    return classes.agg(
        (F.sum("hits") / F.sum("actual")).alias("accuracy"),
        weighted(f1).alias("f1"),
        weighted(precision).alias("weightedPrecision"),
        weighted(recall).alias("weightedRecall"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row (rmse, mae, r2) from one aggregate."""
    require_columns(df, [label, prediction])
    actual, guess = number(df, label), number(df, prediction)
    both = F.when(actual.isNotNull() & guess.isNotNull(), actual)
    error = both - guess
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sum(error * error).alias("squares"),
        F.var_pop(both).alias("variance"),
        F.count(both).alias("n"),
    ).select(
        "rmse",
        "mae",
        F.when(F.col("variance") > 0, F.lit(1.0) - F.col("squares") / (F.col("variance") * F.col("n"))).alias("r2"),
    )
