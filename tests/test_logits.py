"""Logistic regression cross-validated in shared passes, against MLlib's cross-validation."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.operators.gramians import Penalty
from tablelens.operators.logits import cross_validated
from tablelens.operators.models import STANDARD_GRIDS
from tablelens.plans import training as T


@pytest.fixture(scope="module")
def df(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 4)) * [1, 50, 0.01, 0] + [5, 1000, 0, 7]
    y = (x[:, 0] - 5 + (x[:, 1] - 1000) / 60 + draw.normal(size=600) > 0.3).astype(float)
    rows = [([float(v) for v in a], float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    made = spark.createDataFrame(rows, "x array<double>, label double, fold int")
    return made.withColumn("features", array_to_vector("x")).cache()


def test_scores_are_those_of_mllib(df):
    asked = [(a, s) for a in (0.01, 0.1, 1.0) for s in (0.0, 0.5, 1.0)]
    found = cross_validated(df, [Penalty(a, s) for a, s in asked], 3)
    for (a, s), own in zip(asked, found, strict=True):
        one = LogisticRegression(regParam=a, elasticNetParam=s, tol=1e-10)
        theirs = [MulticlassClassificationEvaluator().evaluate(one.fit(df.filter(F.col("fold") != f)).transform(df.filter(F.col("fold") == f))) for f in range(3)]
        assert own == pytest.approx(np.mean(theirs), abs=0.004), (a, s)
    assert cross_validated(df.repartition(7), [Penalty(a, s) for a, s in asked], 3) == pytest.approx(found)


def test_separable_rows_end(df):
    clear = df.withColumn("label", (F.col("x")[0] > 5).cast("double"))
    assert cross_validated(clear, [Penalty(0.0, 0.0), Penalty(0.0001, 1.0)], 3)[0] > 0.97


def test_the_grid_is_scored_without_a_fit_for_each_fold(df, monkeypatch):
    def refuse(*_):
        raise AssertionError("fitted fold by fold")

    monkeypatch.setattr(T.CrossValidator, "fit", refuse)
    model, setting, score = T.tune(T.TrainingData("classification", df, df, T.TrainingFacts(600, 2)), "LogisticRegression", STANDARD_GRIDS["LogisticRegression"])
    assert setting["regParam"] == 0.01 and score > 0.7 and model.numFeatures == 4


def test_what_is_left_to_mllib(df):
    asked = [Penalty(0.1, 0.0)]
    assert cross_validated(df.limit(0), asked, 3) is None
    assert cross_validated(df.withColumn("label", F.lit(1.0)), asked, 3) is None
    assert cross_validated(df.withColumn("label", F.lit(2.0)), asked, 3) is None
    assert cross_validated(df.withColumn("features", array_to_vector(F.transform("x", lambda v, i: F.when(i == 0, float("nan")).otherwise(v)))), asked, 3) is None
