"""All registered queries of the library with their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aislecraft.plans.base import ORACLES, QUERIES

MODULES = ("ingest", "features", "evaluate", "recommend", "sample", "combine")

for _name in MODULES:
    importlib.import_module(f"aislecraft.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_ndcg"](spark, sf_dir)
