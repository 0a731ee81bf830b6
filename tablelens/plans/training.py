"""Training: split, encode, tune each model by cross-validation, score on held-out rows, rank."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import quoted
from tablelens.operators import boosted, classtrees, grown, logits
from tablelens.operators.encode import (
    assemble_features,
    attach_codes,
    features_target,
    fit_labels,
    label_index,
    train_test_split,
    with_fold,
)
from tablelens.operators.evaluate import classification_metrics, regression_metrics
from tablelens.operators.gramians import cross_validated
from tablelens.operators.models import LINE_UPS, SPECS, STANDARD_GRIDS, WIDE_GRIDS, TrainingFacts, settings_of

CLASSIFICATION_METRICS = ["accuracy", "f1", "weightedPrecision", "weightedRecall"]
REGRESSION_METRICS = ["rmse", "mae", "r2"]


@dataclass
class TrainingData:
    """Assembled rows (keys, features, label, fold) of both parts."""

    problem_type: str
    train: DataFrame
    holdout: DataFrame
    facts: TrainingFacts


@dataclass
class Outcome:
    """What became of one model."""

    name: str
    status: str
    reason: str | None = None
    model: Model | None = None
    setting: dict = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    cv_score: float | None = None


def prepare(
    df: DataFrame,
    instructions: dict[str, list[str]],
    keys: list[str] | None = None,
    train_percent: int = 80,
    seed: int = 42,
    folds: int = 3,
) -> TrainingData:
    """Split by a hash of `keys` (of all columns if not given), encode and assemble.

    Label codes are fitted on the training part; a value that occurs in the other part only gets
    the extra code. The target and the keys are never features.
    """
    target = (instructions.get("target_column") or [None])[0]
    problem = (instructions.get("problem_type") or [""])[0].lower()
    columns, target = features_target(df, target, problem)
    features = [c for c in columns if c not in (keys or [])]
    carried = [k for k in keys or [] if k != target]
    keys = keys or df.columns

    if problem == "classification":
        rows = label_index(df, target)
        n_classes = rows.agg(F.max("label")).first()[0]
        n_classes = 0 if n_classes is None else int(n_classes) + 1
    else:
        rows = df.withColumn("label", F.col(target).cast("double")).filter("label is not null")
        n_classes = 0
    # Hashed before encoding, which changes values that may be part of the key.
    rows = rows.withColumn("_key", F.xxhash64(*[quoted(k) for k in keys]))
    train, holdout = train_test_split(rows, ["_key"], train_percent, seed)
    for column in [c for c in instructions.get("label_encoding") or [] if c in features]:
        labels = fit_labels(train, column)
        train, holdout = attach_codes(train, column, labels), attach_codes(holdout, column, labels)

    kept = [*carried, "features", "label"]
    train = with_fold(train, ["_key"], folds, seed)
    train = assemble_features(train, features).select(*kept, "fold")
    holdout = assemble_features(holdout, features).select(*kept)
    return TrainingData(problem, train, holdout, TrainingFacts(0, n_classes))


# Tuning reads the rows many times; a task should have this many to be worth its start, and no more than the latter.
ROWS_PER_TASK, MOST_PER_TASK = 100_000, 500_000


def _fit_partitions(rows: DataFrame, n: int) -> DataFrame:
    """Spread rows that come in too few partitions for the cores or for their number, or merge a swarm of tiny ones."""
    worth = max(1, -(-n // ROWS_PER_TASK))
    wanted = max(min(rows.sparkSession.sparkContext.defaultParallelism, worth), -(-n // MOST_PER_TASK))
    partitions = rows.rdd.getNumPartitions()
    if partitions > worth:
        return rows.coalesce(worth)
    if partitions < wanted:
        return rows.repartition(wanted)
    return rows


@contextmanager
def held(data: TrainingData):
    """Keep both parts in memory or on local disk while models are tuned on them, and count them.

    They are counted first and kept as they are spread for tuning, so that a task's share does not grow with
    the rows. A lost block is computed again from the source.
    """
    row = data.train.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array_min(vector_to_array("features"))).alias("low")
    ).first()
    facts = TrainingFacts(row["n"], data.facts.n_classes, bool(row["low"] is not None and row["low"] < 0))
    # the other part has about as many rows in each partition of the source; its share of the rows is smaller
    train, holdout = (_fit_partitions(rows, row["n"]).persist(StorageLevel.MEMORY_AND_DISK) for rows in (data.train, data.holdout))
    try:
        yield TrainingData(data.problem_type, train, holdout, facts)
    finally:
        train.unpersist()
        holdout.unpersist()


def _evaluator(problem_type: str):
    return MulticlassClassificationEvaluator() if problem_type == "classification" else RegressionEvaluator()


def tune(data: TrainingData, name: str, grid: dict[str, list], folds: int = 3, parallelism: int = 2) -> tuple[Model, dict, float | None]:
    """Fit the best setting of a grid by cross-validation; with nothing to tune, fit once.

    Folds come from the key hash, so the same rows meet in each run. Boosted families and trees with drawn cuts
    or columns train all settings and folds in the same passes; linear ones are scored from sums of products by fold, in one scan.
    MLlib's trees, forests and boosted trees are grown from cells of equal rows; where these are too many MLlib trains on the rows.
    Logistic regression of two classes is scored by Newton steps on sums over all rows, for all settings and folds at once.
    """
    settings = settings_of(grid)
    spec = SPECS[name]
    if spec.plan:
        model, best, score = boosted.tune(data.train, [spec.plan(s) for s in settings], folds)
        return model, settings[best], score
    if spec.tree and all(spec.tree(s) for s in settings):
        model, best, score = classtrees.tune(data.train, [spec.tree(s) for s in settings], folds)
        return model, settings[best], score
    plans = [spec.grown(s, data.facts) for s in settings]
    if all(plans):
        found = grown.tune(data.train, plans, folds)
        if found:
            model, best, score = found
            model.like = spec.build(settings[best], data.facts)
            return model, settings[best], score
    logit = [spec.logit(s) for s in settings]
    if all(logit) and len(settings) > 1 and data.facts.n_classes == 2:
        scores = logits.cross_validated(data.train, logit, folds)
        if scores:
            best = scores.index(max(scores))
            return spec.build(settings[best], data.facts).fit(data.train), settings[best], scores[best]
    if spec.penalty and len(settings) > 1:
        scores = cross_validated(data.train, [spec.penalty(s) for s in settings], folds)
        best = scores.index(min(scores))
        return spec.build(settings[best], data.facts).fit(data.train), settings[best], scores[best]
    if len(settings) == 1:
        return spec.build(settings[0], data.facts).fit(data.train), settings[0], None
    estimators = [spec.build(s, data.facts) for s in settings]
    base = spec.build({}, data.facts)
    cross = CrossValidator(
        estimator=base,
        estimatorParamMaps=[_changed(base, e) for e in estimators],
        evaluator=_evaluator(data.problem_type),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    fitted = cross.fit(data.train)
    scores = fitted.avgMetrics
    best = scores.index(max(scores) if cross.getEvaluator().isLargerBetter() else min(scores))
    return fitted.bestModel, settings[best], float(scores[best])


def _changed(base, built) -> dict:
    """The parameters in which one built estimator differs from the base, set on the base."""
    return {base.getParam(p.name): v for p, v in built.extractParamMap().items() if p.name != "classifier"} | (
        {base.getParam("classifier"): built.getClassifier()} if built.hasParam("classifier") else {}
    )


def score(data: TrainingData, model: Model) -> dict[str, float]:
    """All metrics on the held-out rows, in one job."""
    predicted = model.transform(data.holdout).select("label", "prediction")
    metrics = classification_metrics if data.problem_type == "classification" else regression_metrics
    return metrics(predicted, "label", "prediction").first().asDict()


def train_one(
    data: TrainingData, name: str, grid: dict[str, list], folds: int = 3, parallelism: int = 2
) -> Outcome:
    """Train and score one model. A model that cannot be trained is reported, not raised."""
    refusal = SPECS[name].refuse(data.facts)
    if refusal:
        return Outcome(name, "skipped", refusal)
    try:
        model, setting, cv_score = tune(data, name, grid, folds, parallelism)
        return Outcome(name, "trained", None, model, setting, score(data, model), cv_score)
    except Exception as problem:  # the other models go on
        return Outcome(name, "failed", str(problem).splitlines()[0])


def train_all(
    data: TrainingData,
    line_up: str = "standard",
    models: list[str] | None = None,
    folds: int = 3,
    parallelism: int = 2,
    grids: dict[str, dict[str, list]] | None = None,
) -> list[Outcome]:
    """Train a whole line-up, 'standard' or 'wide', over its grids or over given ones."""
    if grids is None:
        grids = STANDARD_GRIDS if line_up == "standard" else WIDE_GRIDS
    names = models or LINE_UPS[(line_up, data.problem_type)]
    return [train_one(data, n, grids.get(n, {}), folds, parallelism) for n in names]


def leaderboard(spark: SparkSession, problem_type: str, outcomes: list[Outcome]) -> DataFrame:
    """One row per model: (rank, model, status, reason, cv_score, metrics...), best first.

    Accuracy ranks high to low, rmse low to high; models without a score come last.
    """
    names = CLASSIFICATION_METRICS if problem_type == "classification" else REGRESSION_METRICS
    rows = [
        (o.name, o.status, o.reason, o.cv_score, *[o.metrics.get(m) for m in names]) for o in outcomes
    ]
    schema = "model string, status string, reason string, cv_score double, " + ", ".join(f"{m} double" for m in names)
    table = spark.createDataFrame(rows, schema)
    first = F.desc_nulls_last(names[0]) if problem_type == "classification" else F.asc_nulls_last(names[0])
    # One row per model: a handful.
    rank = F.row_number().over(Window.orderBy(first, "model"))
    return table.withColumn("rank", rank).orderBy("rank")


def best_model(board: DataFrame) -> DataFrame:
    """The first row of a leaderboard, if any model was trained."""
    return board.filter("rank = 1 and status = 'trained'")


def parameters_of(model: Model) -> dict:
    """All parameters of a fitted model by name; those that are objects themselves are left out."""
    if isinstance(model, boosted.BoostedModel):
        return {k: v for k, v in asdict(model.fitted.plan).items() if k not in ("fold", "rounds")} | {"rounds": model.rounds}
    if isinstance(model, classtrees.ClassTreeModel):
        return {k: v for k, v in asdict(model.tree.plan).items() if k != "fold"}
    if isinstance(model, grown.GrownModel):
        return parameters_of(model.like)
    return {p.name: v for p, v in model.extractParamMap().items() if isinstance(v, bool | int | float | str | list)}


def best_params(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """The winning setting of each model and its other parameters as rows (model, param, value, tuned)."""
    rows = [
        (o.name, p, str(v), p in o.setting)
        for o in outcomes
        if o.status == "trained"
        for p, v in (parameters_of(o.model) | o.setting).items()
    ]
    return spark.createDataFrame(rows, "model string, param string, value string, tuned boolean")


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """Add the prediction to assembled rows."""
    kept = [c for c in rows.columns if c not in ("features", "fold")]
    return model.transform(rows).select(*kept, "prediction")


def train_table(
    df: DataFrame,
    instructions: dict[str, list[str]],
    keys: list[str] | None = None,
    line_up: str = "standard",
    models: list[str] | None = None,
    train_percent: int = 80,
    seed: int = 42,
    folds: int = 3,
    parallelism: int = 2,
    grids: dict[str, dict[str, list]] | None = None,
) -> tuple[DataFrame, list[Outcome]]:
    """Leaderboard and fitted models for a cleaned table."""
    prepared = prepare(df, instructions, keys, train_percent, seed, folds)
    with held(prepared) as data:
        outcomes = train_all(data, line_up, models, folds, parallelism, grids)
    return leaderboard(df.sparkSession, prepared.problem_type, outcomes), outcomes
