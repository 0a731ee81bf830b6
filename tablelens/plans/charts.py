"""From chart specs to chart data: every requested chart of one reply in one long table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import is_numeric
from tablelens.operators import charts as V
from tablelens.operators import evaluate as M
from tablelens.operators.fused import Part, fused, pies

# Chart types with their other names.
ALIASES = {"pair-plot": "pairplot", "box": "boxplot", "line-chart": "line"}
PREDICTION_CHARTS = ("confusion matrix", "roc curve")
PER_COLUMN_CHARTS = ("histogram", "pie")

RESULT = "chart_id int, chart string, file_name string, status string, message string, label string, measure string, value double"


@dataclass(frozen=True)
class ChartSpec:
    chart_id: int
    cols: tuple[str, ...]
    charts: tuple[str, ...]


@dataclass(frozen=True)
class Predictions:
    """A table with true labels, predicted labels and scores, for the two evaluation charts."""

    rows: DataFrame
    label: str
    prediction: str | None = None
    score: str | None = None
    positive: object = 1


def specs_of(parsed: DataFrame) -> list[ChartSpec]:
    """The specs of one parsed reply. They are a handful of names, so the driver may hold them."""
    rows = parsed.select("chart_id", "cols", "charts").orderBy("chart_id").collect()
    return [ChartSpec(r["chart_id"], tuple(r["cols"]), tuple(r["charts"])) for r in rows]


def _file_name(spec: ChartSpec, chart: str, column: str | None = None) -> str:
    names = [c.replace(" ", "_") for c in spec.cols]
    stem = f"{spec.chart_id}_{chart}_{'_'.join(names) if names else 'no_cols'}"
    return f"{stem}_{column.replace(' ', '_')}.png" if column is not None else f"{stem}.png"


def _long(result: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Rows (label, measure, value); the label joins the keys."""
    label = F.concat_ws(",", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    cells = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    return result.select(label.alias("label"), F.inline(F.array(*cells)))


BOX_MEASURES = ["n", "low_whisker", "p25", "p50", "p75", "high_whisker", "n_outliers"]

# Chart type -> least number of columns.
CHARTS = {
    "pairplot": 1,
    "bar": 2,
    "scatter": 2,
    "histogram": 1,
    "boxplot": 1,
    "heatmap": 0,
    "line": 2,
    "pie": 1,
    "violin": 2,
}


@dataclass
class _Plan:
    """What is to be drawn, sorted by the scan that it shares; charts are numbered through."""

    drawn: list[tuple[ChartSpec, str, str]]
    parts: list[Part]
    boxes: list[tuple[int, str | None, str]]
    pies: list[tuple[int, str]]
    own: list[tuple[int, Callable[[], DataFrame]]]


def _turned(df: DataFrame, x: str, y: str) -> tuple[str, str] | None:
    """(groups, measured): y is measured per x, or x per y if x alone is a number; None if neither is."""
    if is_numeric(df, y):
        return x, y
    return (y, x) if is_numeric(df, x) else None


def _add(df: DataFrame, plan: _Plan, kind: str, cols: list[str]) -> str | None:
    """Enter a chart into the plan, or say why it cannot be drawn."""
    if kind not in CHARTS:
        return f"unknown chart type: {kind}"
    if len(cols) < CHARTS[kind]:
        return f"{kind} needs {CHARTS[kind]} columns, got {len(cols)}"
    chart = len(plan.drawn)
    if kind == "heatmap":
        plan.own.append((chart, lambda: _long(V.heatmap(df), ["x", "y"], ["r"])))
        return None
    unknown = [c for c in cols if c not in df.columns]
    if unknown:
        return f"unknown columns: {', '.join(unknown)}"
    numbers = [c for c in dict.fromkeys(cols) if is_numeric(df, c)]
    if kind == "pie":
        plan.pies.append((chart, cols[0]))
    elif kind == "histogram" and numbers:
        plan.parts += [Part(chart, "bins", cols[0]), Part(chart, "density", cols[0])]
    elif kind == "histogram":
        plan.parts.append(Part(chart, "grid", cols[0]))
    elif kind == "scatter":
        plan.parts.append(Part(chart, "grid", cols[0], cols[1]))
    elif kind == "pairplot":
        if not numbers:
            return f"not numeric: {', '.join(cols)}"
        plan.parts += [Part(chart, "panel", c) for c in numbers]
        plan.parts += [Part(chart, "panel", a, b) for a, b in combinations(numbers, 2)]
    elif kind == "boxplot" and len(cols) == 1:
        if not numbers:
            return f"not numeric: {cols[0]}"
        plan.boxes.append((chart, None, cols[0]))
    else:
        turned = _turned(df, cols[0], cols[1]) if kind in ("bar", "boxplot") else (cols[0], cols[1])
        if turned is None:
            return f"not numeric: {cols[0]}, {cols[1]}"
        x, y = turned
        if not is_numeric(df, y):
            return f"not numeric: {y}"
        if kind == "violin":
            plan.own.append((chart, lambda: _long(V.violin_stats(df, x, y), ["x", "point"], ["value", "density"])))
        elif kind == "boxplot":
            plan.boxes.append((chart, x, y))
        else:
            plan.parts.append(Part(chart, "mean", x, measured=y))
    return None


def _labelled(result: DataFrame, drawn: list[tuple[ChartSpec, str, str]], chart: Column) -> DataFrame:
    """Result rows under the names of their charts; `chart` is the number of each row's."""

    def name_of(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), chart + 1)

    return result.select(
        name_of([spec.chart_id for spec, _, _ in drawn]).alias("chart_id"),
        name_of([kind for _, kind, _ in drawn]).alias("chart"),
        name_of([name for _, _, name in drawn]).alias("file_name"),
        F.lit("drawn").alias("status"),
        F.lit(None).cast("string").alias("message"),
        "label",
        "measure",
        "value",
    )


def _evaluation(kind: str, given: Predictions | None) -> DataFrame | str:
    if kind == "confusion matrix":
        if given is None or given.prediction is None:
            return "confusion matrix needs labels and predictions"
        return _long(M.confusion_matrix(given.rows, given.label, given.prediction), ["label", "prediction"], ["n"])
    if given is None or given.score is None:
        return "roc curve needs labels and scores"
    positive: Column = F.col(given.label) == F.lit(given.positive)
    return _long(M.roc_curve(given.rows, positive, given.score), ["score"], ["tpr", "fpr"])


def chart_dispatch(df: DataFrame, specs: list[ChartSpec], predictions: Predictions | None = None) -> DataFrame:
    """Chart data of all specs: one long table, with a message row for each chart left out.

    Bars, lines, scatters, histograms with their densities and pair plots share two scans (ranges, then cells), boxes
    a scan of their own, pies another; heatmaps, violins and evaluations take one each. Text columns are drawn by
    their levels: a histogram counts them, a scatter has them on its axis, bars and boxes turn if only the first
    column is a number; a pair plot takes the numbers among its columns. The loop runs over the specs, on names only.
    """
    spark = df.sparkSession
    plan = _Plan([], [], [], [], [])
    messages: list[tuple] = []
    for spec in specs:
        for chart in spec.charts:
            lowered = chart.lower()
            kind = ALIASES.get(lowered, lowered)
            split = kind in PER_COLUMN_CHARTS and spec.cols
            for cols, column in [([c], c) for c in spec.cols] if split else [(list(spec.cols), None)]:
                name = _file_name(spec, lowered, column)
                if kind in PREDICTION_CHARTS:
                    found = _evaluation(kind, predictions)
                    objection = found if isinstance(found, str) else None
                    if objection is None:
                        plan.own.append((len(plan.drawn), lambda found=found: found))
                else:
                    objection = _add(df, plan, kind, cols)
                if objection is None:
                    plan.drawn.append((spec, lowered, name))
                else:
                    messages.append((spec.chart_id, lowered, name, "skipped", objection, None, None, None))
    results: list[DataFrame] = []
    if plan.parts:
        results.append(_labelled(fused(df, plan.parts), plan.drawn, F.col("chart")))
    if plan.boxes:
        boxes = V.box_stats_many(df, plan.boxes)
        cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in BOX_MEASURES])
        results.append(_labelled(boxes.select("chart", F.col("x").alias("label"), F.inline(cells)), plan.drawn, F.col("chart")))
    if plan.pies:
        cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in ("n", "share")])
        results.append(_labelled(pies(df, plan.pies).select("chart", "label", F.inline(cells)), plan.drawn, F.col("chart")))
    for chart, draw in plan.own:
        spec, kind, name = plan.drawn[chart]
        try:
            results.append(_labelled(draw(), plan.drawn, F.lit(chart)))
        except Exception as problem:  # the other charts go on
            messages.append((spec.chart_id, kind, name, "skipped", f"failed: {str(problem).splitlines()[0]}", None, None, None))
    if messages or not results:
        results.append(spark.createDataFrame(messages, RESULT))
    return reduce(DataFrame.unionByName, results)
