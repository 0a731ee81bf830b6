import math

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tablelens.llm import mixing as M
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES, SQL


@pytest.fixture
def sources(spark):
    rows = [(i, f"{s}", " ".join(["w"] * (1 + i % 7))) for s, n in (("big", 900), ("mid", 300), ("small", 100)) for i in range(n)]
    return spark.createDataFrame([(k, s, t) for k, (_, s, t) in enumerate(rows)], "doc_id long, source string, text string")


def taken(mixed):
    rows = mixed.withColumn("tokens", M.words(F.col("text"))).groupBy("source")
    rows = rows.agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.sum("tokens").alias("has"), F.first("weight").alias("weight"))
    return {r["source"]: r for r in rows.collect()}


def test_query_equals_sql(spark, folder):
    assert compare(QUERIES["op10_mixing"](spark, folder), connect(folder), SQL["op10_mixing"]) == []


def test_repeats_are_kept_to(sources):
    found = taken(M.mix(sources, repeats=2.0))
    rates = {s: r["used"] / r["has"] for s, r in found.items()}
    assert rates["big"] == 1 and rates["small"] == pytest.approx(2, abs=0.02) and 1 < rates["mid"] < 2
    assert sum(r["weight"] for r in found.values()) == pytest.approx(1)
    assert M.mix(sources, repeats=2.0).filter("copies < 1").count() == 0


def test_entropy_is_met(sources):
    weights = [r["weight"] for r in taken(M.mix(sources, entropy=1.0)).values()]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(1.0, abs=1e-6)
    equal = [r["weight"] for r in taken(M.mix(sources, entropy=5.0)).values()]  # beyond reach: all alike
    assert equal == pytest.approx([1 / 3] * 3)


def test_budget_is_used(sources):
    found = taken(M.mix(sources, repeats=1.5, budget=3000))
    for r in found.values():
        assert r["used"] == pytest.approx(r["weight"] * 3000, abs=8)


def test_the_mixture_holds_each_row_as_often(sources):
    copies = {r["doc_id"]: r["copies"] for r in M.mix(sources, repeats=3.0).collect()}
    held = {r["doc_id"]: r["count"] for r in M.mixture(sources, repeats=3.0).groupBy("doc_id").count().collect()}
    assert held == copies


def test_odd_rows(odd, documents):
    mixed = M.mix(odd)
    assert mixed.columns == [*odd.columns, "weight", "copies"]
    assert mixed.count() == odd.count() and mixed.filter("copies < 1").count() == 0
    nameless = documents([(1, "a b"), (2, None)], source=None).union(documents([(3, "c")]))
    assert {(r["source"], r["copies"] > 0) for r in M.mix(nameless).collect()} == {(None, True), ("s", True)}
    assert M.mix(documents([(1, ""), (2, None)])).count() == 2
    assert M.mix(odd.limit(0)).count() == 0


def test_no_python_on_the_way(spark, folder):
    mixed = M.mix(table(spark, folder, "documents"))
    plan = mixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
