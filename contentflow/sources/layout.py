"""Physical layout of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPREAD_CONF = "contentflow.input.partitions"


def spread(df: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Hash a scan over ``partitions`` partitions, or leave it as it is.

    For tables of a few megabytes, which are one row group and hence one task, before jobs that are all
    CPU.  The caller decides; the size of the table does not.
    """
    return df.repartition(partitions, key) if partitions else df
