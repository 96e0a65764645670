"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftwork.plans import analytics, files, flows, general, signals, texts

MODULES = [general, signals, texts, analytics, flows, files]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return signals.t0_flagship(spark, sf)
