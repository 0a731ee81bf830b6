"""All registered queries over the given tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "profile_queries",
    "cleaning_queries",
    "chart_queries",
    "reply_queries",
    "source_queries",
    "runlog_queries",
    "training_queries",
]


def _merged(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        merged |= getattr(import_module(f"tablelens.catalog.{module}"), name)
    return merged


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    from tablelens.catalog.cleaning_queries import CLEAN_INSTRUCTIONS
    from tablelens.catalog.fixtures import orders_gappy
    from tablelens.operators.profile import column_profile
    from tablelens.plans.cleaning import clean_table

    return column_profile(clean_table(orders_gappy(spark, folder), CLEAN_INSTRUCTIONS))
