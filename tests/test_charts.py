import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts as V
from tablelens.operators import evaluate as M
from tablelens.plans.charts import ChartSpec, Predictions, chart_dispatch


@pytest.fixture
def points(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 100.0), ("b", 5.0), ("b", None), (None, 6.0), ("b", float("nan"))]
    return spark.createDataFrame(rows, "g string, v double")


def test_histogram_keeps_empty_bins_and_all_values(points):
    rows = V.histogram(points, "v", 10).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [5, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert rows[0]["bin_start"] == 1.0 and rows[-1]["bin_end"] == 100.0


def test_histogram_of_equal_values_is_one_bin(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [tuple(r) for r in V.histogram(df, "v").collect()] == [(0, 2.0, 2.0, 2)]
    assert V.histogram(df.filter("false"), "v").count() == 0
    assert V.kde_curve(df, "v").count() == 0


def test_box_by_group_on_both_paths(points):
    small = {r["x"]: r for r in V.box_stats_grouped(points, "g", "v").collect()}
    large = {r["x"]: r for r in V.box_stats_grouped(points, "g", "v", single_task_rows=0).collect()}
    assert small == large
    a = small["a"]
    assert (a["p25"], a["p50"], a["p75"]) == (1.75, 2.5, 27.25)
    assert (a["low_whisker"], a["high_whisker"], a["n_outliers"]) == (1.0, 3.0, 1)
    assert [tuple(r) for r in V.box_outliers(points, "v", "g").collect()] == [("a", 100.0, 1)]


def test_density_has_unit_area(spark):
    df = spark.range(2000).select((F.sin("id") * 3 + F.cos(F.col("id") * 7)).alias("v"), (F.col("id") % 2).alias("g"))
    rows = V.kde_curve(df, "v").orderBy("point").collect()
    step = rows[1]["value"] - rows[0]["value"]
    assert 0.9 < sum(r["density"] for r in rows) * step < 1.0
    assert V.violin_stats(df, "g", "v").count() == 400


def test_pie_counts_missing_as_a_level(points):
    rows = [tuple(r)[:2] for r in V.pie_chart(points, "g").orderBy(F.desc("n"), "level").collect()]
    assert rows == [("a", 4), ("b", 3), ("nan", 1)]


def test_pair_grid_is_symmetric(spark):
    df = spark.range(300).select(F.sin("id").alias("a"), F.cos("id").alias("b"))
    cells = {(r["x_col"], r["y_col"], r["x_bin"], r["y_bin"]): r["n"] for r in V.pair_grid(df, ["a", "b"], 5).collect()}
    assert all(cells[(y, x, j, i)] == n for (x, y, i, j), n in cells.items())
    assert sum(n for (x, y, _, _), n in cells.items() if x == y == "a") == 300


def test_confusion_matrix_has_all_combinations(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "y int, p int")
    got = {(r["label"], r["prediction"]): r["n"] for r in M.confusion_matrix(df, "y", "p").collect()}
    assert len(got) == 9 and got[(1, 1)] == 1 and got[(2, 1)] == 1 and got[(0, 0)] == 0
    asked = M.confusion_matrix(df, "y", "p", labels=[1, 2]).collect()
    assert len(asked) == 4 and sum(r["n"] for r in asked) == 2


@pytest.mark.parametrize("limit", [0, 10**9])
def test_auc_counts_ties_half(spark, limit):
    df = spark.range(400).select((F.col("id") % 3 == 0).alias("y"), ((F.col("id") * 7) % 11).cast("double").alias("s"))
    pdf = df.toPandas()
    pos, neg = pdf[pdf.y].s.to_numpy(), pdf[~pdf.y].s.to_numpy()
    expected = sum((p > neg).sum() + 0.5 * (p == neg).sum() for p in pos) / (len(pos) * len(neg))
    assert M.roc_auc(df, F.col("y"), "s", limit).first()[0] == pytest.approx(expected)
    curve = M.roc_curve(df, F.col("y"), "s", limit).orderBy(F.desc_nulls_first("score")).collect()
    assert (curve[0]["tpr"], curve[0]["fpr"]) == (0.0, 0.0) and (curve[-1]["tpr"], curve[-1]["fpr"]) == (1.0, 1.0)
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(expected)


def test_one_class_has_no_rate_and_no_area(spark):
    df = spark.createDataFrame([(True, 0.5), (True, 0.7)], "y boolean, s double")
    assert M.roc_auc(df, F.col("y"), "s").first()[0] is None
    assert {r["fpr"] for r in M.roc_curve(df, F.col("y"), "s").filter("score is not null").collect()} == {None}


def test_metrics_equal_mllib(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    df = spark.range(300).select(
        (F.col("id") % 3).cast("double").alias("label"), ((F.col("id") * F.col("id")) % 4).cast("double").alias("prediction")
    )
    mine = M.classification_metrics(df, "label", "prediction").first().asDict()
    for name, value in mine.items():
        assert value == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(df))
    mine = M.regression_metrics(df, "label", "prediction").first().asDict()
    for name, value in mine.items():
        assert value == pytest.approx(RegressionEvaluator(metricName=name).evaluate(df))


def test_dispatch_goes_on_after_a_bad_spec(points):
    specs = [
        ChartSpec(1, ("v",), ("BOX", "nonsense", "scatter")),
        ChartSpec(2, ("g", "v"), ("confusion matrix", "roc curve", "pair-plot")),
        ChartSpec(3, (), ("pie", "heatmap")),
    ]
    given = Predictions(points.select("g", F.col("g").alias("p"), F.col("v").alias("score")), "g", "p", "score", "a")
    rows = chart_dispatch(points, specs, given).collect()
    status = {(r["chart_id"], r["chart"]): (r["status"], r["message"]) for r in rows}
    assert status[(1, "box")] == ("drawn", None)
    assert status[(1, "nonsense")] == ("skipped", "unknown chart type: nonsense")
    assert status[(1, "scatter")] == ("skipped", "scatter needs 2 columns, got 1")
    assert status[(2, "confusion matrix")][0] == "drawn" and status[(2, "roc curve")][0] == "drawn"
    assert status[(2, "pair-plot")] == ("drawn", None)
    assert {r["label"].split(",")[0] for r in rows if r["chart"] == "pair-plot"} == {"v"}
    assert status[(3, "pie")] == ("skipped", "pie needs 1 columns, got 0")
    assert status[(3, "heatmap")][0] == "drawn"
    assert {r["file_name"] for r in rows if r["chart"] == "pie"} == {"3_pie_no_cols.png"}
    box = {r["measure"]: r["value"] for r in rows if r["chart"] == "box"}
    assert box["n"] == 6 and not math.isnan(box["p50"])


@pytest.mark.parametrize("labels", [1000, 1001])
def test_confusion_matrix_has_one_form_for_every_size(spark, labels):
    df = spark.range(labels).select(F.col("id").alias("y"), F.col("id").alias("p"))
    cells = M.confusion_matrix(df, "y", "p")
    assert cells.count() == labels**2 and cells.filter("n > 0").count() == labels


def test_resampled_interval(spark):
    draw = random.Random(1)
    rows = [(i, "ab"[i % 2], draw.gauss(5, 2)) for i in range(4000)] + [(9000, "c", 1.0), (9001, None, 1.0), (9002, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r["x"]: r for r in V.bar_chart_resampled(df.repartition(7), "g", "v", ["id"], replicates=400).collect()}
    usual = {r["x"]: r for r in V.bar_chart(df, "g", "v").collect()}
    for g in "ab":
        assert got[g]["n"] == 2000 and abs(got[g]["mean"] - usual[g]["mean"]) < 1e-9
        assert abs(got[g]["low"] - usual[g]["low"]) < 0.03 and abs(got[g]["high"] - usual[g]["high"]) < 0.03
    assert (got["c"]["low"], got["c"]["high"]) == (1.0, 1.0) and set(got) == {"a", "b", "c"}
    again = {r["x"]: r["low"] for r in V.bar_chart_resampled(df.repartition(2), "g", "v", ["id"], replicates=400).collect()}
    assert all(abs(again[g] - got[g]["low"]) < 1e-9 for g in got)
    assert V.line_chart_resampled(df.limit(0), "g", "v", ["id"]).collect() == []


def drawn(df, *specs):
    rows = chart_dispatch(df, [ChartSpec(i, tuple(cols), (chart,)) for i, (chart, *cols) in enumerate(specs)]).collect()
    found = {}
    for r in rows:
        found.setdefault(r["chart_id"], {})[(r["label"], r["measure"])] = r["message"] if r["status"] == "skipped" else r["value"]
    return found


def test_dispatch_equals_single_charts(spark):
    """Shared scans give what each chart gives alone, missing values, an empty column and names with blanks included."""
    draw = random.Random(5)
    rows = [
        (draw.choice(["a", "b,c", "", None]), draw.choice([None, float("nan"), 0.0, 1.5, draw.gauss(3, 2)]), draw.randrange(5), None, i % 3 == 0)
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "`a level` string, v double, k int, none double, yes boolean").repartition(5)
    got = drawn(
        df, ("bar", "a level", "v"), ("histogram", "v"), ("scatter", "v", "k"), ("pairplot", "v", "k", "a level", "none"),
        ("box", "a level", "v"), ("pie", "a level"), ("line", "k", "v"), ("histogram", "none"), ("histogram", "yes"),
        ("bar", "v", "a level"), ("scatter", "a level", "v"), ("box", "v"), ("scatter", "none", "v"), ("histogram", "a level"),
    )

    def alone(result, keys, measures):
        return {(",".join(str(r[k]) for k in keys), m): r[m] for r in result.collect() for m in measures}

    def same(mine, wanted):
        assert mine.keys() == wanted.keys()
        assert all(mine[k] == wanted[k] or abs(mine[k] - wanted[k]) < 1e-9 for k in wanted)

    means, box = ["n", "mean", "low", "high"], ["n", "low_whisker", "p25", "p50", "p75", "high_whisker", "n_outliers"]
    same(got[0], alone(V.bar_chart(df, "a level", "v"), ["x"], means))
    same(got[9], got[0])
    bins = alone(V.histogram(df, "v"), ["bin"], ["bin_start", "bin_end", "n"])
    curve = {(str(r["point"]), m): v for r in V.kde_curve(df, "v").collect() for m, v in (("density", r["density"]), ("density_at", r["value"]))}
    same(got[1], bins | curve)
    same(got[2], alone(V.scatter_grid(df, "v", "k"), ["x_bin", "y_bin"], ["n"]))
    same(got[3], alone(V.pair_grid(df, ["v", "k"]), ["x_col", "y_col", "x_bin", "y_bin"], ["n"]))
    same(got[4], alone(V.box_stats_grouped(df, "a level", "v"), ["x"], box))
    same(got[5], alone(V.pie_chart(df, "a level"), ["level"], ["n", "share"]))
    same(got[6], alone(V.bar_chart(df, "k", "v"), ["x"], means))
    same(got[11], alone(V.box_stats(df, "v"), [], box))
    assert 7 not in got and 12 not in got and sum(got[8].values()) == 600 and set(got[8]) == {("true", "n"), ("false", "n")}
    assert sum(got[10].values()) == df.filter("`a level` is not null and not isnan(v) and v is not null").count()
    assert sum(got[13].values()) == df.filter("`a level` is not null").count() and ("", "n") in got[13]


def test_dispatch_of_an_empty_table_and_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    got = drawn(df, ("bar", "g", "v"), ("histogram", "v"), ("scatter", "g", "v"), ("box", "v"), ("pie", "g"), ("bar", "g", "g"))
    assert got == {5: {(None, None): "not numeric: g, g"}}
    assert chart_dispatch(df, []).collect() == []


def test_dispatch_scans_do_not_grow_with_the_charts(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    few = [ChartSpec(1, ("l_returnflag", "l_tax"), ("bar", "box", "scatter"))]
    many = [ChartSpec(i, (a, "l_tax", "l_quantity"), ("bar", "box", "scatter", "line", "histogram", "pairplot"))
            for i, a in enumerate(["l_returnflag", "l_linestatus", "l_discount"])]
    scans = [
        chart_dispatch(df, specs)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for specs in (few, many)
    ]
    assert scans[0] == scans[1]


def test_draws_are_added_up_by_batch_and_not_row_by_row(spark):
    """A task gives a row for each part and value of x of a batch, of any type; sums are those of the hashed digits."""
    from hashlib import md5

    rows = [(i, "ab"[i % 2], float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, g string, v double").coalesce(1)
    found = {r["x"]: r for r in V.resampled_means(df, "g", "v", ["id"], replicates=8, percent=0.0).collect()}
    plan = V.resampled_means(df, "g", "v", ["id"])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "sequence(" not in plan
    for g in "ab":
        means = []
        for i in range(8):
            times = {r[0]: sum(md5(f"{r[0]}:0".encode()).hexdigest()[4 * i : 4 * i + 4] >= b for b in V._POISSON) for r in rows if r[1] == g}
            means.append(sum(times[r[0]] * r[2] for r in rows if r[1] == g) / sum(times.values()))
        means.sort()
        assert found[g]["n"] == 150 and found[g]["low"] == pytest.approx((means[3] + means[4]) / 2)
    nested = df.withColumn("g", F.struct("g"))
    assert V._numbered(pa.array([{"g": "a"}, {"g": "b"}, {"g": "a"}]))[0].tolist() == [0, 1, 0]
    assert {r["x"]["g"] for r in V.resampled_means(nested, "g", "v", ["id"]).collect()} == {"a", "b"}
