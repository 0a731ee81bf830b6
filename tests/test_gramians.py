import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.operators import gramians as G
from tablelens.operators.models import SPECS, STANDARD_GRIDS, WIDE_GRIDS, settings_of
from tablelens.plans import training as T


def frame(spark, n=300, seed=0, far=0.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 4)) * [1, 10, 0.1, 3] + [0, 5, 1, far]
    x[:, 2] += x[:, 0] / 10  # correlated
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + 5 * x[:, 2] + draw.normal(size=n) + far
    rows = [([*map(float, a), 4.0], float(b), int(f)) for a, b, f in zip(x, y, draw.integers(0, 3, n), strict=True)]
    return spark.createDataFrame(rows, "x array<double>, label double, fold int").withColumn("features", array_to_vector("x"))


@pytest.mark.parametrize("name, grid", [("LinearRegression", STANDARD_GRIDS["LinearRegression"]), ("Lasso", WIDE_GRIDS["Lasso"])])
def test_equals_fits_one_by_one(spark, name, grid):
    df = frame(spark).cache()
    settings = settings_of(grid)
    scores = G.cross_validated(df, [SPECS[name].penalty(s) for s in settings], 3)
    for setting, score in zip(settings, scores, strict=True):
        errors = []
        for fold in range(3):
            model = SPECS[name].build(setting, None).fit(df.filter(F.col("fold") != fold))
            errors.append(RegressionEvaluator().evaluate(model.transform(df.filter(F.col("fold") == fold))))
        assert score == pytest.approx(sum(errors) / 3, rel=1e-5), setting


def test_coefficients_of_large_values(spark):
    df = frame(spark, far=1e7)
    means, moments = G.fold_moments(df)
    coefficients, intercept = G.solve(sum(moments.values()), G.Penalty())
    rows = df.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    want = np.linalg.lstsq(np.column_stack([x[:, :4] - x[:, :4].mean(axis=0), np.ones(len(y))]), y - y.mean(), rcond=None)[0]
    assert coefficients[:4] == pytest.approx(want[:4], rel=1e-7) and coefficients[4] == 0 and abs(intercept) < 1e-6
    assert means[-1] == pytest.approx(y.mean())


def test_tune_takes_the_best(spark):
    df = frame(spark, seed=2)
    data = T.TrainingData("regression", df, df, T.TrainingFacts(300))
    model, setting, score = T.tune(data, "LinearRegression", {"regParam": [50.0, 0.0], "elasticNetParam": [0.0]})
    assert setting == {"regParam": 0.0, "elasticNetParam": 0.0} and 0.8 < score < 1.2
    assert len(model.coefficients) == 5


def test_odd_tables(spark):
    df = frame(spark)
    assert G.cross_validated(df.limit(0), [G.Penalty()], 3) == [0.0]
    assert G.cross_validated(df.withColumn("label", F.lit(3.0)), [G.Penalty(), G.Penalty(1.0, 1.0)], 3) == pytest.approx([0.0, 0.0], abs=1e-9)
    # no row in two of the folds: they add no error, and the third has nothing to learn from
    lone = df.withColumn("fold", F.lit(1))
    y = np.array([r["label"] for r in lone.collect()])
    assert G.cross_validated(lone, [G.Penalty()], 3) == pytest.approx([y.std() / 3], rel=1e-9)
    some = df.withColumn("label", F.when(F.col("x")[0] > 0, F.col("label")))
    assert G.cross_validated(some, [G.Penalty()], 3) == pytest.approx(G.cross_validated(some.filter("label is not null"), [G.Penalty()], 3))
