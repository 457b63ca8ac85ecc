"""Registration of the operators bound to the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contentflow.sources.layout import SPREAD_CONF, spread

# Tables whose jobs are bound by CPU, with their key.
TEXT_TABLES = {"pages": "page_id", "documents": "doc_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
        wanted = self.spark.conf.get(SPREAD_CONF, None)
        return spread(df, TEXT_TABLES[name], int(wanted) if wanted else None) if name in TEXT_TABLES else df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
