"""The list of queries: a name, a Spark function and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from areal.plans import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Inputs of one scale factor, by attribute or name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return inputs.load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its oracle."""

    def add(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = inputs.oracle(sql)
        return function

    return add
