import pytest
from pyspark.sql import functions as F

from tablelens.operators.boosted import BoostedRegressor, Plan
from tablelens.operators.encode import assemble_features
from tablelens.operators.evaluate import regression_metrics
from tablelens.operators.models import LINE_UPS, SPECS, STANDARD_GRIDS, WIDE_GRIDS, settings_of
from tablelens.plans import training as T


@pytest.fixture(scope="module")
def known(spark):
    """A table with a rule: the class and the price follow from two of the columns."""
    base = spark.range(1500).select(
        "id",
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100 - 5).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 100).alias("b"),
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("kind"),
    )
    return base.select(
        "*",
        F.when(F.col("a") + F.col("b") > 5, "high").otherwise("low").alias("size"),
        (F.floor((F.col("a") + 5) / 3.4)).cast("int").alias("third"),
        (F.abs("a") * 10 + F.when(F.col("b") > 5, 20).otherwise(0)).alias("price"),
    ).coalesce(1).cache()


def instructions(problem, target):
    return {"problem_type": [problem], "target_column": [target], "label_encoding": ["kind", "nope", target]}


SMALL = {
    "LogisticRegression": {"regParam": [0.01, 1.0]},
    "DecisionTreeClassifier": {"maxDepth": [2, 6]},
    "RandomForestClassifier": {},
    "GBTClassifier": {"maxIter": [5]},
    "NaiveBayes": {},
}


def test_classification_leaderboard(spark, known):
    rows = known.select("id", "a", "b", "kind", "size")
    board, outcomes = T.train_table(rows, instructions("classification", "size"), ["id"], grids=SMALL)
    got = board.collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and {r["status"] for r in got} == {"trained"}
    assert got[0]["accuracy"] > 0.95
    assert [r["accuracy"] for r in got] == sorted([r["accuracy"] for r in got], reverse=True)
    assert T.best_model(board).first()["model"] == got[0]["model"]
    params = {(r["model"], r["param"]): r["value"] for r in T.best_params(spark, outcomes).collect()}
    assert params[("DecisionTreeClassifier", "maxDepth")] == "6"
    assert params[("LogisticRegression", "regParam")] == "0.01"
    # those that were not tuned are told as well
    assert params[("LogisticRegression", "maxIter")] == "100" and params[("NaiveBayes", "smoothing")] == "1.0"
    tuned = {(r["model"], r["param"]) for r in T.best_params(spark, outcomes).filter("tuned").collect()}
    assert tuned == {("DecisionTreeClassifier", "maxDepth"), ("LogisticRegression", "regParam"), ("GBTClassifier", "maxIter")}


def test_parameters_of_models_trained_together(known):
    rows = known.select("id", "a", "b", "price")
    data = T.prepare(rows, instructions("regression", "price"), ["id"])
    found = T.parameters_of(T.train_one(data, "XGBRegressor", {"maxIter": [4]}).model)
    assert found["rounds"] == 4 and found["penalty"] == 1.0 and "fold" not in found
    data = T.prepare(known.select("id", "a", "b", "size"), instructions("classification", "size"), ["id"])
    found = T.parameters_of(T.train_one(data, "DecisionTreeClassifier", {"splitter": ["random"]}).model)
    assert found["splitter"] == "random" and found["impurity"] == "gini" and found["depth"] == 5


def test_three_classes_skip_boosting_and_go_on(spark, known):
    rows = known.select("id", "a", "b", "kind", "third")
    grids = {"GBTClassifier": {}, "NaiveBayes": {}, "LinearSVM": {}}
    board, _ = T.train_table(rows, instructions("classification", "third"), ["id"], models=list(grids), grids=grids)
    got = {r["model"]: r for r in board.collect()}
    assert got["GBTClassifier"]["status"] == "skipped" and "two classes" in got["GBTClassifier"]["reason"]
    assert got["NaiveBayes"]["accuracy"] > 0.8 and got["LinearSVM"]["status"] == "trained"


def test_one_class_fails_without_ending_the_others(spark, known):
    rows = known.select("id", "a", F.lit("only").alias("size"))
    board, _ = T.train_table(rows, instructions("classification", "size"), ["id"], models=["GBTClassifier", "DecisionTreeClassifier"], grids={})
    got = {r["model"]: r["status"] for r in board.collect()}
    assert got["GBTClassifier"] == "skipped" and len(got) == 2


def test_regression_line_up(spark, known):
    rows = known.select("id", "a", "b", "kind", "price")
    grids = {"LinearRegression": {}, "DecisionTreeRegressor": {"maxDepth": [2, 6]}, "Lasso": {"alpha": [0.1, 10]}, "AdaBoostRegressor": {"maxIter": [6]}}
    board, _ = T.train_table(rows, instructions("regression", "price"), ["id"], models=list(grids), grids=grids)
    got = board.collect()
    assert got[0]["model"] == "DecisionTreeRegressor" and got[0]["r2"] > 0.9
    assert [r["rmse"] for r in got] == sorted(r["rmse"] for r in got)


def test_keys_and_target_are_no_features(known):
    data = T.prepare(known.select("id", "a", "price"), instructions("regression", "price"), ["id"])
    assert data.train.columns == ["id", "features", "label", "fold"]
    assert data.train.first()["features"].size == 1
    whole = T.prepare(known.select("a", "b", "price"), instructions("regression", "price"))
    assert whole.train.columns == ["features", "label", "fold"] and whole.train.first()["features"].size == 2


def test_split_is_stable_under_repartitioning(known):
    rows = known.select("id", "a", "kind", "size")
    asked = instructions("classification", "size")
    one = {r["id"] for r in T.prepare(rows, asked, ["id"]).holdout.collect()}
    two = {r["id"] for r in T.prepare(rows.repartition(9), asked, ["id"]).holdout.collect()}
    assert one == two


def test_bad_instructions_are_errors(known):
    with pytest.raises(ValueError):
        T.prepare(known, {"problem_type": ["classification"]}, ["id"])
    with pytest.raises(ValueError):
        T.prepare(known, {"problem_type": [], "target_column": ["size"]}, ["id"])


@pytest.mark.parametrize("loss", ["linear", "square", "exponential"])
def test_adaboost_beats_one_tree(known, loss):
    rows = assemble_features(known.withColumnRenamed("price", "label"), ["a", "b"]).select("features", "label").cache()
    one = SPECS["DecisionTreeRegressor"].build({"maxDepth": 3}, None).fit(rows).transform(rows)
    many = BoostedRegressor(Plan("adaboost", 3, 6, 1.0, loss)).fit(rows)
    predicted = many.transform(rows)
    assert predicted.columns == ["features", "label", "prediction"]
    assert regression_metrics(predicted, "label", "prediction").first()["rmse"] < regression_metrics(one, "label", "prediction").first()["rmse"]


@pytest.mark.parametrize("name", ["GradientBoostingRegressor", "XGBRegressor", "CatBoostingRegressor"])
def test_boosted_families_learn(known, name):
    data = T.prepare(known.select("id", "a", "b", "kind", "price"), instructions("regression", "price"), ["id"])
    outcome = T.train_one(data, name, {"stepSize": [0.01, 0.3], "maxIter": [5, 40]})
    assert outcome.status == "trained" and outcome.setting == {"stepSize": 0.3, "maxIter": 40}
    assert outcome.metrics["r2"] > 0.9 and outcome.cv_score == pytest.approx(outcome.metrics["rmse"], rel=0.5)


def test_line_ups_are_known_models():
    for (line_up, _), names in LINE_UPS.items():
        grids = STANDARD_GRIDS if line_up == "standard" else WIDE_GRIDS
        for name in names:
            assert name in SPECS and settings_of(grids.get(name, {}))


def test_wide_classification_settings_build(spark, known):
    facts = T.TrainingFacts(100, 2, True)
    for name in LINE_UPS[("wide", "classification")]:
        for setting in settings_of(WIDE_GRIDS[name]):
            assert SPECS[name].build(setting, facts) is not None


def test_a_tasks_share_of_the_rows_does_not_grow_with_them(spark, known, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(T, "MOST_PER_TASK", 50)
    with T.held(T.prepare(known.drop("size"), instructions("regression", "price"), ["id"])) as data:
        assert data.facts.n_rows == data.train.count() and data.train.rdd.getNumPartitions() >= data.facts.n_rows / 50 > 8
        assert max(data.train.rdd.glom().map(len).collect()) <= 60
