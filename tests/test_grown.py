"""Trees, forests and boosted trees from cells, against MLlib on the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tablelens.operators import grown as G
from tablelens.operators.grown import GrownPlan
from tablelens.operators.models import SPECS
from tablelens.plans import training as T


def drawn(n=900, seed=0):
    """Few values, so that rows share cells."""
    draw = np.random.default_rng(seed)
    x = draw.integers(0, 12, (n, 4)).astype(float)
    y = x[:, 0] + 3 * (x[:, 1] > 6) * (x[:, 2] < 4) + draw.normal(size=n)
    return x, y, draw.integers(0, 3, n)


def frame(spark, x, y, fold):
    rows = [([float(v) for v in a], float(b), int(f)) for a, b, f in zip(x, y, fold, strict=True)]
    made = spark.createDataFrame(rows, "x array<double>, label double, fold int")
    return made.withColumn("id", F.monotonically_increasing_id()).withColumn("features", array_to_vector("x")).cache()


def said(model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])


@pytest.fixture(scope="module")
def numbers(spark):
    return frame(spark, *drawn())


@pytest.fixture(scope="module")
def classes(numbers):
    return numbers.withColumn("label", (F.col("label") > 6).cast("double")).cache()


def test_single_trees_and_boosted_ones_are_those_of_mllib(classes, numbers):
    for depth in (3, 8):
        model, _, _ = G.tune(classes, [GrownPlan("tree", 2, depth)], 3)
        assert (said(model, classes) == said(DecisionTreeClassifier(maxDepth=depth).fit(classes), classes)).mean() > 0.995
        model, _, _ = G.tune(numbers, [GrownPlan("tree", 0, depth)], 3)
        assert np.abs(said(model, numbers) - said(DecisionTreeRegressor(maxDepth=depth).fit(numbers), numbers)).mean() < 0.01
    model, _, _ = G.tune(classes, [GrownPlan("boosted", 2, 3, 8)], 3)
    assert (said(model, classes) == said(GBTClassifier(maxDepth=3, maxIter=8).fit(classes), classes)).mean() > 0.995
    model, _, _ = G.tune(numbers, [GrownPlan("boosted", 0, 3, 8)], 3)
    assert said(model, numbers) == pytest.approx(said(GBTRegressor(maxDepth=3, maxIter=8).fit(numbers), numbers), abs=1e-6)


def test_forests_are_as_good_as_those_of_mllib(classes, numbers):
    model, _, _ = G.tune(classes, [GrownPlan("forest", 2, 5, 20, subset="sqrt")], 3)
    rate = MulticlassClassificationEvaluator(metricName="accuracy")
    theirs = RandomForestClassifier(seed=42).fit(classes)
    assert rate.evaluate(model.transform(classes)) > rate.evaluate(theirs.transform(classes)) - 0.02
    model, _, _ = G.tune(numbers, [GrownPlan("forest", 0, 5, 20, subset="onethird")], 3)
    error = RegressionEvaluator()
    theirs = RandomForestRegressor(seed=42).fit(numbers)
    assert error.evaluate(model.transform(numbers)) < 1.05 * error.evaluate(theirs.transform(numbers))
    assert len({t.value.tobytes() for t in model.trees}) == 20


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted"])
@pytest.mark.parametrize("n", [0, 2])
def test_scores_are_those_of_models_trained_without_the_fold(classes, numbers, kind, n):
    df = classes if n else numbers
    plans = [GrownPlan(kind, n, d, t) for d in (2, 4) for t in ((1,) if kind == "tree" else (3, 6))]
    model, best, score = G.tune(df, plans, 3)
    evaluator = MulticlassClassificationEvaluator() if n else RegressionEvaluator()
    means = []
    for plan in plans:
        if kind == "forest":
            break
        found = [G.tune(df.filter(F.col("fold") != f), [plan], 3)[0].transform(df.filter(F.col("fold") == f)) for f in range(3)]
        means.append(np.mean([evaluator.evaluate(x) for x in found]))
    if means:
        assert means[best] == (max(means) if n else min(means)) and score == pytest.approx(means[best])
    assert len(model.trees) == plans[best].trees
    if kind != "forest":  # whose draws go by the cells, which are apart by fold
        assert said(model, df) == pytest.approx(said(G.tune(df, [plans[best]], 3)[0], df), abs=1e-9)


def test_partitioning_and_copies_of_rows_do_not_matter(classes):
    plan = GrownPlan("tree", 2, 6)
    once = said(G.tune(classes, [plan], 3)[0], classes)
    assert (once == said(G.tune(classes.repartition(7).union(classes), [plan], 3)[0], classes)).all()
    forest = GrownPlan("forest", 2, 6, 5, subset="sqrt")
    assert (said(G.tune(classes, [forest], 3)[0], classes) == said(G.tune(classes.repartition(7), [forest], 3)[0], classes)).all()


def test_cells_are_no_more_than_the_combinations(numbers):
    rows = numbers.union(numbers).select(F.slice("x", 1, 2).alias("x"), "label", "fold")
    cells = G.cells_of(rows, [np.arange(11.0), np.array([5.0])], 0, 3).collect()
    assert len(cells) == 12 * 2 * 3 and sum(r["s0"] for r in cells) == 1800
    assert sum(r["s1"] for r in cells) == pytest.approx(rows.agg(F.sum("label")).first()[0])


def test_grids_are_tuned_without_a_pass_over_the_rows_for_each_tree(classes, numbers, monkeypatch):
    def refuse(*_):
        raise AssertionError("trained row by row")

    monkeypatch.setattr(T.CrossValidator, "fit", refuse)
    asked = {"DecisionTreeClassifier": {"maxDepth": [2, 20], "maxBins": [32, 64]}, "RandomForestClassifier": {"numTrees": [2, 4]}, "GBTClassifier": {"maxIter": [2, 3]}}
    for name, grid in asked.items():
        model, setting, score = T.tune(T.TrainingData("classification", classes, classes, T.TrainingFacts(900, 2)), name, grid)
        assert set(setting) == set(grid) and 0.5 < score <= 1 and T.parameters_of(model)["maxDepth"] == setting.get("maxDepth", 5)
    asked = {"DecisionTreeRegressor": {"maxDepth": [2, 4]}, "RandomForestRegressor": {"numTrees": [2, 4]}, "GBTRegressor": {"maxIter": [2, 3]}}
    for name, grid in asked.items():
        assert T.tune(T.TrainingData("regression", numbers, numbers, T.TrainingFacts(900)), name, grid)[1] in [{next(iter(grid)): v} for v in next(iter(grid.values()))]


def test_many_cells_are_left_to_mllib(classes, monkeypatch):
    assert G.tune(classes, [GrownPlan("tree", 2)], 3, copied=100) is None
    monkeypatch.setattr(G, "COPIED", 100)
    model, _, _ = T.tune(T.TrainingData("classification", classes, classes, T.TrainingFacts(900, 2)), "DecisionTreeClassifier", {"maxDepth": [3]})
    assert type(model).__name__ == "DecisionTreeClassificationModel"


def test_odd_tables(spark, classes):
    assert G.tune(classes.limit(0), [GrownPlan("tree", 2)], 3) is None
    missing = classes.withColumn("x", F.transform("x", lambda v, i: F.when(i == 0, float("nan")).otherwise(v))).withColumn("features", array_to_vector("x"))
    model, _, _ = G.tune(missing, [GrownPlan("tree", 2)], 3)
    assert all(0 not in t.feature for t in model.trees)
    same = classes.withColumn("label", F.lit(1.0))
    assert set(said(G.tune(same, [GrownPlan("forest", 2, 5, 3, subset="sqrt")], 3)[0], same)) == {1.0}
    assert SPECS["RandomForestClassifier"].grown({"impurity": "entropy", "featureSubsetStrategy": "log2", "numTrees": 8}, T.TrainingFacts(9, 3)).trees == 8
    assert SPECS["RandomForestClassifier"].grown({"minInfoGain": 0.5}, T.TrainingFacts(9, 3)) is None
