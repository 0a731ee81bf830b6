import math

import pytest
from pyspark.sql import functions as F

from tablelens.operators import correlate as C
from tablelens.operators import profile as P
from tablelens.operators.ranks import quantiles, running_totals

NAN = float("nan")


def by_name(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.fixture
def edges(spark):
    rows = [
        (1, 1.0, "b", None, 7, True),
        (2, NAN, "a", None, 7, False),
        (3, None, "a", None, 7, None),
        (4, 4.0, "b", None, 7, True),
        (4, 4.0, None, None, 7, True),
    ]
    return spark.createDataFrame(rows, "`a key` int, `x.y` double, s string, empty string, same int, flag boolean")


def test_nan_counts_as_missing(edges):
    info = by_name(P.dataset_info(edges))
    assert info["x.y"]["n_missing"] == 2
    assert info["empty"]["n_missing"] == 5
    assert info["a key"]["n_rows"] == 5 and info["a key"]["n_columns"] == 6


def test_mode_tie_takes_smallest_and_ignores_null(edges):
    modes = by_name(P.column_modes(edges))
    assert modes["s"]["mode"] == "a" and modes["s"]["n"] == 2
    assert modes["empty"]["mode"] is None
    assert modes["flag"]["mode"] == "true"


def test_describe_full(edges):
    full = by_name(P.describe_full(edges))
    assert full["x.y"]["n"] == 3 and full["x.y"]["mean"] == 3.0 and full["x.y"]["p50"] == 4.0
    assert full["s"]["n_unique"] == 2 and full["s"]["mean"] is None
    assert full["a key"]["n_unique"] is None
    assert full["empty"]["n"] == 0 and full["empty"]["n_unique"] is None


def test_distinct_with_and_without_null(edges):
    assert by_name(P.distinct_counts(edges))["x.y"]["n_distinct"] == 2
    assert by_name(P.distinct_counts(edges, include_null=True))["x.y"]["n_distinct"] == 3
    assert by_name(P.distinct_counts(edges))["empty"]["n_distinct"] == 0


def test_profile_and_alerts(edges):
    profile = P.column_profile(edges)
    found = by_name(profile)
    assert found["same"]["is_constant"] and not found["same"]["is_unique"]
    assert found["x.y"]["missing_share"] == 0.4
    assert found["s"]["max_length"] == 1
    alerts = {(r["column_name"], r["alert"]) for r in P.profile_alerts(profile).collect()}
    assert ("same", "constant") in alerts and ("empty", "high_missing") in alerts
    assert ("same", "unique") not in alerts


def test_empty_and_single_row_tables(spark, edges):
    empty = edges.filter("false")
    assert by_name(P.dataset_info(empty))["s"]["n_rows"] == 0
    assert by_name(P.column_profile(empty))["a key"]["p50"] is None
    assert P.duplicate_rows(empty).first()[0] == 0
    one = by_name(P.column_profile(edges.limit(1)))
    assert one["a key"]["p95"] == 1.0 and one["a key"]["std"] is None


def test_duplicates_with_missing_and_signed_zero(spark):
    rows = [(None, 0.0), (None, -0.0), (None, NAN), (None, None), ("a", 1.0), ("a", 1.0), ("a", 1.0)]
    df = spark.createDataFrame(rows, "s string, x double")
    # NaN and null are both missing, 0.0 equals -0.0.
    assert P.duplicate_rows(df).first()[0] == 4


def test_correlation_needs_two_columns(spark, edges):
    assert C.corr_adjacent(edges.select("same", "s")).count() == 0


def test_correlation_is_pairwise_complete_for_all_pairs(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 != 0, F.sin("id")).alias("a"),
        F.when(F.col("id") % 5 == 0, NAN).otherwise(F.cos("id") + F.sin("id")).alias("b"),
        (F.col("id") * 1e6 + 1e12).alias("c"),
        F.lit(3.0).alias("d"),
    )
    found = {(r["x"], r["y"]): r["r"] for r in C.corr_matrix(df).collect()}
    assert len(found) == 16
    pdf = df.toPandas().corr()
    for key, value in found.items():
        expected = pdf.loc[key]
        if math.isnan(expected):
            assert value is None
        else:
            assert value == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_quantiles_with_a_hot_key(spark, limit):
    """A third of the rows under one key and one value; both ways of ranking agree with pandas."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).alias("v"),
    ).unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0)], "k string, v double"))
    counted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counted, ["k"], [F.col("v")], ["n"], df.count(), limit)
    got = {r["k"]: (r["q1"], r["q9"]) for r in quantiles(totals, ["k"], "v", {"q1": 0.1, "q9": 0.9}).collect()}
    pdf = df.toPandas().groupby("k", dropna=False)["v"].quantile([0.1, 0.9]).unstack()
    assert len(got) == len(pdf)
    for k, row in pdf.iterrows():
        key = None if k is None or k != k else k
        assert got[key] == pytest.approx((row[0.1], row[0.9]))


def test_profile_is_the_same_on_the_range_path(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").drop("l_shipdate")
    one = P.column_profile(df).orderBy("position").collect()
    many = P.column_profile(df.repartition(7), single_task_rows=0).orderBy("position").collect()
    for a, b in zip(one, many):
        for f in a.__fields__:
            assert b[f] == (pytest.approx(a[f], rel=1e-9) if isinstance(a[f], float) else a[f])


def test_wide_tables_are_split_into_several_aggregates(spark):
    df = spark.range(50).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(70)])
    means = P.column_means(df).orderBy("position").collect()
    assert [r["mean"] for r in means] == [24.5 * i for i in range(70)]


def test_approximate_profile_is_close(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").drop("l_shipdate")
    exact, approx = by_name(P.column_profile(df)), by_name(P.column_profile(df, approx=True))
    for name, row in exact.items():
        near = approx[name]
        assert near["n_distinct"] == pytest.approx(row["n_distinct"], rel=0.05)
        assert near["mean"] == row["mean"] and near["top"] is None
        if row["p50"] is not None:
            below, upto = df.agg(F.avg((F.col(name) < near["p50"]).cast("int")), F.avg((F.col(name) <= near["p50"]).cast("int"))).first()
            assert below <= 0.51 and upto >= 0.49


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert P.column_means(df).count() == 0 and C.corr_matrix(df).count() == 0
    assert by_name(P.column_profile(df))["s"]["is_unique"]


@pytest.mark.parametrize("width", [2, 12, 13, 40])
def test_correlation_has_one_form_for_every_width(spark, width):
    df = spark.range(20).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(width - 1)], F.lit(0.1).alias("k"))
    endless = df.withColumn("c0", F.when(F.col("c0") > 0.9, float("inf")).otherwise(F.col("c0")))
    for table, dead in ((df, {"k"}), (endless, {"k", "c0"}), (df.limit(0), set(df.columns))):
        found = {(r["x"], r["y"]): r["r"] for r in C.corr_matrix(table).collect()}
        assert len(found) == width**2
        assert all((found[x, y] is None) == (x in dead or y in dead) for x, y in found)
        assert all(found[x, x] in (1.0, None) for x in table.columns)


def test_decimals_are_numbers(spark):
    df = spark.sql("SELECT cast(v AS decimal(8,2)) AS v FROM VALUES (10), (9), (10), (9), (2.5), (NULL) t(v)")
    assert P.column_modes(df).first()["mode"] == "9.00"
    full = P.describe_full(df).first()
    assert (full["p25"], full["p50"], full["p75"]) == (9.0, 9.0, 10.0)
    assert P.column_profile(df).first()["p50"] == 9.0
