"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
ROWS_ONLY = [n for n in QUERIES if n not in SQL]


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_sql(spark, folder, duck, name):
    assert compare(QUERIES[name](spark, folder), duck, SQL[name]) == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, folder, name):
    found = QUERIES[name](spark, folder)
    if "status" in found.columns:
        told = found.groupBy("status").count().collect()
        assert told and "failed" not in {r["status"] for r in told}
    else:
        assert found.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
