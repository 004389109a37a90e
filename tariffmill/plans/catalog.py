"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import problems, reference


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | reference.QUERIES


def oracles() -> dict[str, str]:
    return problems.ORACLES | reference.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.flagship(spark, sf_dir)
