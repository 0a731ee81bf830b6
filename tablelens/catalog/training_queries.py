"""Training queries (M1-M15, M18-M20, T4). The targets are close to random; the plumbing is what is checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.catalog.fixtures import rounded, table
from tablelens.operators.encode import assemble_features
from tablelens.operators.models import SPECS, STANDARD_GRIDS, WIDE_GRIDS, TrainingFacts
from tablelens.plans import training as T

KEYS = ["l_orderkey", "l_linenumber"]
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
FLAG = {"problem_type": ["classification"], "target_column": ["l_linestatus"], "label_encoding": ["l_returnflag"]}
THREE = {"problem_type": ["classification"], "target_column": ["l_returnflag"], "label_encoding": ["l_linestatus"]}
PRICE = {"problem_type": ["regression"], "target_column": ["l_extendedprice"], "label_encoding": ["l_returnflag"]}

# Settings trained at once.
PARALLEL = 8


def _rows(s, d, instructions):
    """All line items with the features, the target and the keys of the instructions."""
    extra = [c for c in instructions["label_encoding"] + instructions["target_column"] if c not in FEATURES]
    return table(s, d, "lineitem").select(*KEYS, *FEATURES, *extra)


def _scores(s, outcomes):
    """Rows (model, status, reason, metric, value)."""
    rows = [
        (o.name, o.status, o.reason, m, float(v) if v is not None else None)
        for o in outcomes
        for m, v in (o.metrics or {None: None}).items()
    ]
    return s.createDataFrame(rows, "model string, status string, reason string, metric string, value double")


def _one(name, instructions, grid):
    """Train one model on the whole table and score it on the held-out part."""

    def run(s, d):
        with T.held(T.prepare(_rows(s, d, instructions), instructions, KEYS)) as data:
            return _scores(s, [T.train_one(data, name, grid, parallelism=PARALLEL)])

    return run


def _standard(name, instructions):
    return _one(name, instructions, STANDARD_GRIDS[name])


def _wide(name, instructions):
    return _one(name, instructions, WIDE_GRIDS[name])


def _board(instructions):
    """Every model of the standard line-up over its whole grid."""

    def run(s, d):
        board, _ = T.train_table(_rows(s, d, instructions), instructions, KEYS, parallelism=PARALLEL)
        return board

    return run


def _best(s, d):
    return T.best_model(_board(FLAG)(s, d))


def _params(s, d):
    _, outcomes = T.train_table(_rows(s, d, FLAG), FLAG, KEYS, parallelism=PARALLEL)
    return T.best_params(s, outcomes)


def _holdout(s, d):
    data = T.prepare(_rows(s, d, PRICE), PRICE, KEYS)
    model = SPECS["LinearRegression"].build({}, data.facts).fit(data.train)
    return T.predict(model, data.holdout)


def _folds(s, d):
    """Cross-validation scores of the whole linear grid, by fold from the key hash."""
    with T.held(T.prepare(_rows(s, d, PRICE), PRICE, KEYS)) as data:
        _, setting, score = T.tune(data, "LinearRegression", STANDARD_GRIDS["LinearRegression"], parallelism=PARALLEL)
    rows = [(p, str(v), score) for p, v in setting.items()]
    return s.createDataFrame(rows, "param string, value string, cv_score double")


def _line(s, d):
    """The line through price over quantity, all rows."""
    rows = assemble_features(table(s, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label")), ["l_quantity"])
    model = SPECS["LinearRegression"].build({"solver": "normal"}, TrainingFacts(0)).fit(rows)
    found = s.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return rounded(found, {"slope": 4, "intercept": 2})


QUERIES = {
    "clf_logistic": _standard("LogisticRegression", FLAG),
    "clf_tree": _standard("DecisionTreeClassifier", FLAG),
    "clf_tree_wide": _wide("DecisionTreeClassifier", FLAG),
    "clf_forest": _standard("RandomForestClassifier", FLAG),
    "clf_gbt": _standard("GBTClassifier", FLAG),
    "clf_gbt_three_classes": _standard("GBTClassifier", THREE),
    "clf_naive_bayes": _standard("NaiveBayes", FLAG),
    "clf_linear_svm": _wide("LinearSVM", FLAG),
    "clf_linear_svm_three_classes": _wide("LinearSVM", THREE),
    "reg_linear": _line,
    "reg_linear_grid": _standard("LinearRegression", PRICE),
    "reg_lasso": _wide("Lasso", PRICE),
    "reg_tree": _standard("DecisionTreeRegressor", PRICE),
    "reg_forest": _standard("RandomForestRegressor", PRICE),
    "reg_gbt": _standard("GBTRegressor", PRICE),
    "reg_gbt_grid": _wide("CatBoostingRegressor", PRICE),
    "reg_adaboost": _wide("AdaBoostRegressor", PRICE),
    "reg_gradient_boosting_grid": _wide("GradientBoostingRegressor", PRICE),
    "reg_xgb_grid": _wide("XGBRegressor", PRICE),
    "cv_folds": _folds,
    "predict_holdout": _holdout,
    "best_params": _params,
    "best_model": _best,
    "train_leaderboard": _board(FLAG),
    "train_leaderboard_regression": _board(PRICE),
}

SQL = {
    "clf_gbt_three_classes": "SELECT 'GBTClassifier' AS model, 'skipped' AS status, 'needs two classes, the target has ' || "
    "count(DISTINCT l_returnflag) AS reason, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS DOUBLE) AS value FROM lineitem",
    "reg_linear": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, "
    "round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem",
}
