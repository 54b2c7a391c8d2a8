"""Registration of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register a function of ``Tables`` under its own name, with SQL that gives the same rows."""

        def register(function):
            name = function.__name__
            self.queries[name] = lambda spark, folder: function(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return function

        return register
