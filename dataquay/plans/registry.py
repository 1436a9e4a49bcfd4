"""Named queries over the test tables, each with SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one folder, read on first use as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def view(self, *names: str) -> None:
        """Make tables visible to ``spark.sql``."""
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` yields the same rows and column names."""

    def add(run: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return add
