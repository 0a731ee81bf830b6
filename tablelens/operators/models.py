"""The models that can be trained, and their parameter grids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)

from tablelens.operators.boosted import BoostedRegressor, Plan
from tablelens.operators.classtrees import ClassTreeClassifier, TreePlan
from tablelens.operators.gramians import Penalty
from tablelens.operators.grown import GrownPlan

# The standard grids.
STANDARD_GRIDS: dict[str, dict[str, list]] = {
    "LogisticRegression": {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "DecisionTreeClassifier": {"maxDepth": [5, 10, 20], "maxBins": [32, 64]},
    "RandomForestClassifier": {"numTrees": [20, 50], "maxDepth": [5, 10]},
    "GBTClassifier": {"maxDepth": [3, 5], "maxIter": [20, 50]},
    "NaiveBayes": {},
    "LinearRegression": {"regParam": [0.0, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "DecisionTreeRegressor": {"maxDepth": [5, 10, 20], "maxBins": [32, 64]},
    "RandomForestRegressor": {"numTrees": [20, 50], "maxDepth": [5, 10]},
    "GBTRegressor": {"maxDepth": [3, 5], "maxIter": [20, 50]},
}

# The wide grids, under MLlib's parameter names. `C` is the inverse penalty.
WIDE_GRIDS: dict[str, dict[str, list]] = {
    "LogisticRegression": {"C": [0.1, 1, 10]},
    "RandomForestClassifier": {
        "impurity": ["gini", "entropy"],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
        "numTrees": [8, 16, 32, 64, 128, 256],
    },
    "DecisionTreeClassifier": {
        "impurity": ["gini", "entropy"],
        "featureSubsetStrategy": ["sqrt", "log2", "all"],
        "splitter": ["best", "random"],
    },
    "LinearSVM": {"C": [0.1, 1, 10]},
    "LinearRegression": {},
    "GradientBoostingRegressor": {"stepSize": [0.1, 0.01, 0.05, 0.001], "maxIter": [8, 16, 32, 64, 128, 256]},
    "XGBRegressor": {"stepSize": [0.1, 0.01, 0.05, 0.001], "maxIter": [8, 16, 32, 64, 128, 256]},
    "CatBoostingRegressor": {"maxDepth": [6, 8, 10], "stepSize": [0.01, 0.05, 0.1], "maxIter": [30, 50, 100]},
    "AdaBoostRegressor": {
        "learningRate": [0.1, 0.01, 0.5, 0.001],
        "loss": ["linear", "square", "exponential"],
        "maxIter": [8, 16, 32, 64, 128, 256],
    },
    "Lasso": {"alpha": [0.1, 1.0, 10]},
}


@dataclass(frozen=True)
class TrainingFacts:
    """What a model choice may depend on."""

    n_rows: int
    n_classes: int = 0
    any_negative: bool = False


@dataclass(frozen=True)
class ModelSpec:
    """A model family: how to build it for one setting, and when it cannot be trained."""

    build: Callable[[dict, TrainingFacts], Estimator]
    refuse: Callable[[TrainingFacts], str | None] = lambda facts: None
    #: For families whose settings and folds are trained together: the plan of a setting.
    plan: Callable[[dict], Plan] | None = None
    #: For single trees that are trained together: the plan of a setting, none if it is not of that kind.
    tree: Callable[[dict], TreePlan | None] | None = None
    #: For MLlib's trees, forests and boosted trees, which are grown from cells: the plan of a setting, none if it asks for more.
    grown: Callable[[dict, TrainingFacts], GrownPlan | None] = lambda setting, facts: None
    #: For logistic regression, whose settings and folds are scored in the same passes: the penalty of a setting, none if it asks for more.
    logit: Callable[[dict], Penalty | None] = lambda setting: None
    #: For linear families, whose settings and folds are scored from sums of products: the penalty of a setting.
    penalty: Callable[[dict], Penalty] | None = None


def _penalty(setting: dict, facts: TrainingFacts) -> dict:
    """An inverse penalty C on summed losses is a penalty 1 / (C n) on their mean, of coefficients as they are."""
    rest = {k: v for k, v in setting.items() if k != "C"}
    if "C" in setting:
        rest |= {"regParam": 1.0 / (setting["C"] * max(facts.n_rows, 1)), "standardization": False}
    return rest


def _tree_plan(setting: dict) -> TreePlan | None:
    """The plan of a tree that looks at some columns a node or draws its cuts; of other trees none."""
    names = {"impurity": "impurity", "featureSubsetStrategy": "subset", "splitter": "splitter", "maxDepth": "depth"}
    wide = "featureSubsetStrategy" in setting or "splitter" in setting
    return TreePlan(**{names[k]: v for k, v in setting.items()}) if wide else None


def _single_tree(setting: dict, facts: TrainingFacts) -> Estimator:
    plan = _tree_plan(setting)
    return ClassTreeClassifier(plan) if plan else DecisionTreeClassifier(seed=42, **setting)


def _linear_svm(setting: dict, facts: TrainingFacts) -> Estimator:
    machine = LinearSVC(**_penalty(setting, facts))
    return OneVsRest(classifier=machine, parallelism=2) if facts.n_classes > 2 else machine


def _naive_bayes(setting: dict, facts: TrainingFacts) -> Estimator:
    """Counts and shares suit the multinomial form; it cannot take negative values."""
    return NaiveBayes(modelType="gaussian" if facts.any_negative else "multinomial", **setting)


def _lasso(setting: dict, facts: TrainingFacts) -> Estimator:
    rest = {k: v for k, v in setting.items() if k != "alpha"}
    return LinearRegression(regParam=float(setting.get("alpha", 1.0)), elasticNetParam=1.0, standardization=False, **rest)


def _grown(kind: str, **usual) -> Callable[[dict, TrainingFacts], GrownPlan | None]:
    """Plans under MLlib's parameter names; what a setting does not say is as in MLlib."""
    names = {"maxDepth": "depth", "maxBins": "bins", "numTrees": "trees", "maxIter": "trees", "stepSize": "rate"}
    names |= {"impurity": "impurity", "featureSubsetStrategy": "subset"}

    def plan(setting: dict, facts: TrainingFacts) -> GrownPlan | None:
        asked = {names.get(k): v for k, v in setting.items()}
        if None in asked or asked.get("subset", "all") not in ("all", "sqrt", "log2", "onethird"):
            return None
        made = GrownPlan(**{"kind": kind, "classes": facts.n_classes} | usual | asked)
        # one tree looks at all features; a feature has 250 bins at most
        return None if made.bins > 250 or made.kind == "forest" and made.trees < 2 else made

    return plan


def _together(**usual) -> ModelSpec:
    """A boosted family: what holds where a setting says nothing, under the names of the grids."""
    names = {"maxDepth": "depth", "stepSize": "rate", "learningRate": "rate", "maxIter": "rounds", "loss": "loss"}

    def plan(setting: dict) -> Plan:
        return Plan(**usual | {names[k]: v for k, v in setting.items()})

    return ModelSpec(lambda s, f: BoostedRegressor(plan(s)), plan=plan)


SPECS: dict[str, ModelSpec] = {
    "LogisticRegression": ModelSpec(
        lambda s, f: LogisticRegression(maxIter=100 if "C" not in s else 2000, **_penalty(s, f)),
        logit=lambda s: None if set(s) - {"regParam", "elasticNetParam"} else Penalty(s.get("regParam", 0.0), s.get("elasticNetParam", 0.0)),
    ),
    "DecisionTreeClassifier": ModelSpec(_single_tree, tree=_tree_plan, grown=_grown("tree")),
    "RandomForestClassifier": ModelSpec(lambda s, f: RandomForestClassifier(seed=42, **s), grown=_grown("forest", trees=20, subset="sqrt")),
    "GBTClassifier": ModelSpec(
        lambda s, f: GBTClassifier(seed=42, **s),
        lambda f: None if f.n_classes == 2 else f"needs two classes, the target has {f.n_classes}",
        grown=_grown("boosted", trees=20),
    ),
    "NaiveBayes": ModelSpec(_naive_bayes),
    "LinearSVM": ModelSpec(_linear_svm),
    "LinearRegression": ModelSpec(
        lambda s, f: LinearRegression(**s), penalty=lambda s: Penalty(s.get("regParam", 0.0), s.get("elasticNetParam", 0.0))
    ),
    "Lasso": ModelSpec(_lasso, penalty=lambda s: Penalty(float(s.get("alpha", 1.0)), 1.0, standard=False)),
    "DecisionTreeRegressor": ModelSpec(lambda s, f: DecisionTreeRegressor(seed=42, **s), grown=_grown("tree")),
    "RandomForestRegressor": ModelSpec(
        lambda s, f: RandomForestRegressor(seed=42, **s), grown=_grown("forest", trees=20, subset="onethird")
    ),
    "GBTRegressor": ModelSpec(lambda s, f: GBTRegressor(seed=42, **s), grown=_grown("boosted", trees=20)),
    "GradientBoostingRegressor": _together(depth=3, rate=0.1, rounds=100),
    # by gradient and curvature, with a penalty on leaves and a learned side for missing values
    "XGBRegressor": _together(depth=6, rate=0.3, rounds=100, penalty=1.0, least_weight=1.0),
    # one cut a level, residuals from earlier rows only
    "CatBoostingRegressor": _together(depth=6, rate=0.03, rounds=100, penalty=3.0, alike=True, ordered=True),
    "AdaBoostRegressor": _together(kind="adaboost", depth=3, rate=1.0, rounds=50),
}

# The model line-ups. A model without a grid is fitted once.
LINE_UPS: dict[tuple[str, str], list[str]] = {
    ("standard", "classification"): [
        "LogisticRegression",
        "DecisionTreeClassifier",
        "RandomForestClassifier",
        "GBTClassifier",
        "NaiveBayes",
    ],
    ("standard", "regression"): ["LinearRegression", "DecisionTreeRegressor", "RandomForestRegressor", "GBTRegressor"],
    ("wide", "classification"): ["LogisticRegression", "RandomForestClassifier", "DecisionTreeClassifier", "LinearSVM"],
    ("wide", "regression"): [
        "GradientBoostingRegressor",
        "LinearRegression",
        "RandomForestRegressor",
        "DecisionTreeRegressor",
        "XGBRegressor",
        "CatBoostingRegressor",
        "AdaBoostRegressor",
        "Lasso",
    ],
}


def settings_of(grid: dict[str, list]) -> list[dict]:
    """All combinations of a grid; one empty setting if there is nothing to tune."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]
