import pytest
from pyspark.sql import functions as F

from tablelens.operators import clean as K
from tablelens.operators import encode as E
from tablelens.plans.cleaning import clean_table

NAN = float("nan")


@pytest.fixture
def gappy(spark):
    rows = [(1, 1, 2.0, "x", None), (2, 2, None, "y", None), (3, None, NAN, None, None), (4, 2, 4.0, "y", None)]
    return spark.createDataFrame(rows, "id bigint, n int, v double, s string, e string")


def test_integer_column_is_filled_with_its_fractional_mean(gappy):
    rows = K.impute_mean(gappy).orderBy("id").collect()
    assert rows[2]["n"] == pytest.approx(5 / 3) and rows[2]["v"] == 3.0


def test_mode_fill(gappy):
    rows = K.impute_mode(gappy).orderBy("id").collect()
    assert rows[2]["s"] == "y" and {r["e"] for r in rows} == {"missing"}


def test_drop_empty_keeps_all_columns_of_an_empty_table(gappy):
    assert K.drop_empty_columns(gappy).columns == ["id", "n", "v", "s"]
    assert K.drop_empty_columns(gappy.filter("false")).columns == gappy.columns
    assert K.drop_empty_columns(gappy, threshold=0.5).columns == ["id", "n", "s"]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "c double, x double")
    for center in (True, False):
        assert {r["c"] for r in K.scale(df, center=center).collect()} == {0.0}


def test_fit_before_filling_equals_fit_after_filling(gappy):
    """The one-pass clean gives what imputing first and fitting the scale afterwards gives."""
    instructions = {"standard_scalar": ["yes"], "problem_type": ["regression"]}
    for center, ddof in ((True, 0), (True, 1), (False, 1)):
        filled = K.impute_mode(K.impute_mean(gappy.drop("e")))
        slow = K.scale(filled, center=center, ddof=ddof).orderBy("id").collect()
        fast = clean_table(gappy, instructions, center, ddof).orderBy("id").collect()
        for a, b in zip(slow, fast):
            assert a["s"] == b["s"]
            assert [a[c] for c in ("id", "n", "v")] == pytest.approx([b[c] for c in ("id", "n", "v")])


def test_clean_leaves_nothing_missing_and_unit_scale(gappy):
    done = clean_table(gappy, {"standard_scalar": ["YES"], "drop_columns": ["nope"]})
    row = done.agg(F.avg("v"), F.stddev_pop("v"), F.count("v"), F.count("s"), F.count("n")).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(1) and row[2:] == (4, 4, 4)


def test_absent_instructions_have_defaults(gappy):
    assert clean_table(gappy, {}).columns == ["id", "n", "v", "s"]
    assert not K.wants_scaling({"standard_scalar": []})


def test_classification_target_is_not_scaled(gappy):
    asked = {"problem_type": ["classification"], "target_column": ["n"], "standard_scalar": ["yes"]}
    assert K.columns_to_scale(gappy, asked) == ["id", "v"]
    asked["problem_type"] = ["regression"]
    assert K.columns_to_scale(gappy, asked) == ["id", "n", "v"]
    assert K.columns_to_scale(gappy, asked, exclude_target=True) == ["id", "v"]


@pytest.fixture
def hot(spark):
    """One label holds half of the rows, some are missing, the others are rare."""
    return spark.range(4000).select(
        "id",
        F.when(F.col("id") % 2 == 0, F.lit("hot"))
        .when(F.col("id") % 13 != 0, F.concat(F.lit("v"), (F.col("id") % 997).cast("string")))
        .alias("s"),
    )


@pytest.mark.parametrize("order", ["frequency", "sorted"])
def test_labels_are_the_same_on_all_paths(hot, order):
    small = E.fit_labels(hot, "s", order)
    ranged = E.fit_labels(hot, "s", order, single_task_rows=0)
    a = E.attach_codes(hot, "s", small).orderBy("id").collect()
    b = E.attach_codes(hot, "s", ranged).orderBy("id").collect()
    assert a == b and len(a) == 4000
    codes = {r["id"]: r["s"] for r in a}
    assert codes[13] == small.n_labels
    if order == "frequency":
        assert codes[0] == 0


def test_unseen_label_gets_the_extra_code(spark):
    labels = E.fit_labels(spark.createDataFrame([("a",), ("b",), ("b",)], "s string"), "s")
    other = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "s string")
    assert [r["s"] for r in E.attach_codes(other, "s", labels).collect()] == [1, 0, 2, 2]


def test_split_and_folds_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    train, test = E.train_test_split(df, ["id"])
    again, _ = E.train_test_split(df.repartition(13), ["id"])
    ids = {r["id"] for r in train.collect()}
    assert ids == {r["id"] for r in again.collect()}
    assert ids.isdisjoint({r["id"] for r in test.collect()}) and train.count() + test.count() == 5000
    assert 0.77 < len(ids) / 5000 < 0.83
    sizes = [r["count"] for r in E.with_fold(train, ["id"]).groupBy("fold").count().collect()]
    assert len(sizes) == 3 and min(sizes) > 1150


def test_feature_checks(gappy):
    with pytest.raises(ValueError):
        E.assemble_features(gappy, ["s"])
    with pytest.raises(ValueError):
        E.features_target(gappy, "nope", "regression")
    with pytest.raises(ValueError):
        E.features_target(gappy, "n", "clustering")


def test_encoding_reads_the_table_once_a_column_and_once_more(spark, tmp_path):
    spark.range(50).selectExpr("cast(id % 7 as string) a", "cast(id % 5 as string) b", "cast(id % 3 as string) c").write.parquet(
        str(tmp_path / "t")
    )
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = E.label_encode(table, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4


def test_more_classes_than_a_driver_should_list(spark):
    rows = spark.range(12_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("s"))
    assert E.label_index(rows, "s").filter("label != cast(substr(s, 2) as double)").count() == 0


def test_long_labels_are_sorted_by_ranges_and_not_sent_to_all_tasks(spark, monkeypatch):
    """The bytes of labels count, not their number; rows without a label find none wherever they are dealt."""
    rows = [(i, None if i % 3 == 0 else "x" * 90 + str(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    short = E.label_encode(df, ["s"]).orderBy("id").collect()
    bounds = []
    totals = E.running_totals
    monkeypatch.setattr(E, "running_totals", lambda *a: bounds.append(a[4]) or totals(*a))
    monkeypatch.setattr(E, "SENT", 0)
    labels = E.fit_labels(df, "s", single_task_rows=10)
    assert labels.n_labels == 7 and bounds[0] >= 7 * (91 + 32) // 32 > 10
    assert E.attach_codes(df, "s", labels).orderBy("id").collect() == short
    assert [r["s"] for r in short][::3] == [7] * 20
    sent = E.attach_codes(df, "s", E.LabelTable(labels.rows, 7, 40, 0))
    assert sent.orderBy("id").collect() == short and "Broadcast" in sent._jdf.queryExecution().toString()
