"""The post store: reading and writing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from contentflow.schemas import PAGE, POST


def _or_empty(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    """A store that does not exist yet reads as an empty table."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_posts(
    spark: SparkSession, path: str, schema: T.StructType = POST, array_file: bool = False
) -> DataFrame:
    """Posts under a fixed schema; a missing path gives an empty table.

    The store is JSON lines, which Spark can split.  ``array_file`` reads files that hold one
    JSON array, the exchange form; each of those is one task.
    """
    reader = spark.read.schema(schema).option("multiLine", array_file)
    return _or_empty(spark, lambda: reader.json(path), schema)


def write_posts(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "json") -> None:
    """Write posts, non-ASCII text as it is.  ``fmt`` is ``json`` or ``parquet``."""
    df.write.mode(mode).format(fmt).save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages.  A failed or empty fetch is a NULL ``html``, from which every extraction
    makes an empty list."""
    pages = _or_empty(spark, lambda: spark.read.parquet(path), PAGE)
    return pages.select([c for c in PAGE.names if c in pages.columns])
