"""The registered training queries hand whole grids to the training plan."""

import pytest

from tablelens.catalog.training_queries import QUERIES
from tablelens.operators.models import LINE_UPS, STANDARD_GRIDS, WIDE_GRIDS
from tablelens.plans import training as T

ONE = {
    "clf_forest": ("RandomForestClassifier", STANDARD_GRIDS),
    "clf_tree_wide": ("DecisionTreeClassifier", WIDE_GRIDS),
    "clf_gbt": ("GBTClassifier", STANDARD_GRIDS),
    "clf_linear_svm": ("LinearSVM", WIDE_GRIDS),
    "clf_linear_svm_three_classes": ("LinearSVM", WIDE_GRIDS),
    "reg_forest": ("RandomForestRegressor", STANDARD_GRIDS),
    "reg_gbt": ("GBTRegressor", STANDARD_GRIDS),
    "reg_gbt_grid": ("CatBoostingRegressor", WIDE_GRIDS),
    "reg_adaboost": ("AdaBoostRegressor", WIDE_GRIDS),
    "reg_gradient_boosting_grid": ("GradientBoostingRegressor", WIDE_GRIDS),
    "reg_xgb_grid": ("XGBRegressor", WIDE_GRIDS),
}
ALL = {
    "train_leaderboard": "classification",
    "train_leaderboard_regression": "regression",
    "best_model": "classification",
    "best_params": "classification",
}


@pytest.mark.parametrize("name", [*ONE, *ALL])
def test_whole_grids(spark, folder, monkeypatch, name):
    told = {}

    def train_one(data, model, grid, folds=3, parallelism=2):
        told[model] = grid
        return T.Outcome(model, "skipped", "not trained here")

    monkeypatch.setattr(T, "train_one", train_one)
    QUERIES[name](spark, folder)
    if name in ONE:
        model, grids = ONE[name]
        assert told == {model: grids[model]}
    else:
        assert told == {m: STANDARD_GRIDS.get(m, {}) for m in LINE_UPS[("standard", ALL[name])]}
