"""Order-dependent operators that do not put a whole key, or the whole table, into one task.

A plain window sorts all rows of a key in one task, which fails when a key holds a third of the
table.  Here the order column is cut into ``buckets`` ranges.  Windows run inside (key, range);
what crosses ranges is carried by a summary with one row per (key, range), so a key contributes at
most ``buckets`` rows to the second window.  Results are exact for any bucket count.

The ranges hold about equally many rows: their borders are quantiles from Spark's mergeable quantile sketch, so
neither gaps nor outliers of the order column put many rows into one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS = 4096


def cut_points(df: DataFrame, seq: str, buckets: int = BUCKETS) -> Column:
    """Borders of ``buckets`` ranges of about equally many rows, as a scalar subquery: a rising array.

    The sketch is off by less than half a range.  Values that many rows share give equal borders, between which nothing lies.
    """
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return df.agg(F.percentile_approx(seq, shares, 4 * buckets)).scalar()


def with_bucket(df: DataFrame, seq: str, buckets: int = BUCKETS, name: str = "_bucket") -> DataFrame:
    """Add the number of the range that ``seq`` falls into: how many borders it reaches, by binary search."""
    if buckets == 1:
        return df.withColumn(name, F.lit(0))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((buckets - 1).bit_length()))])
    cut = df.withColumn("_cuts", cut_points(df, seq, buckets))
    # Past the end there is no border, and nothing compares as reached.
    reached = lambda at, step: F.get("_cuts", at + step - 1) <= F.col(seq)
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))
    return cut.withColumn(name, found).drop("_cuts")


def with_previous(
    df: DataFrame, keys: list[str], seq: str, value: str, name: str, buckets: int = BUCKETS
) -> DataFrame:
    """Add ``value`` of the preceding row of the same key, NULL on the first.

    ``value`` must not be NULL itself; a missing key is a key like any other.
    """
    cut = with_bucket(df, seq, buckets)
    inside = W.partitionBy(*keys, "_bucket").orderBy(seq)
    across = W.partitionBy(*keys).orderBy("_bucket")
    ends = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.max_by(value, seq).alias("_last"))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), F.lag("_last").over(across).alias("_carried"))
    )
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        cut.withColumn("_inside", F.lag(value).over(inside))
        .join(ends, same)
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_bucket", "_b", "_inside", "_carried", *[f"_k_{k}" for k in keys])
    )


def with_rank(
    df: DataFrame, group: Column, descending: bool, seq: str, name: str = "rank", buckets: int = BUCKETS
) -> DataFrame:
    """Add the global position by ``group`` (NULLs last), ties by ``seq``.

    For a group column with a bounded number of values, such as a date: the offsets of the groups
    come from a window over one row per value.
    """
    cut = with_bucket(df.withColumn("_group", group), seq, buckets)
    by_group = F.desc_nulls_last("_og") if descending else F.asc_nulls_last("_og")
    before = (W.unboundedPreceding, -1)
    sizes = cut.groupBy(F.col("_group").alias("_og"), F.col("_bucket").alias("_ob")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    group_offsets = (
        sizes.groupBy("_og")
        .agg(F.sum("_n").alias("_n"))
        .select(
            F.col("_og").alias("_gg"),
            F.coalesce(F.sum("_n").over(W.orderBy(by_group).rowsBetween(*before)), F.lit(0)).alias("_g"),
        )
    )
    in_group = W.partitionBy("_og").orderBy("_ob").rowsBetween(*before)
    offsets = (
        sizes.withColumn("_b", F.coalesce(F.sum("_n").over(in_group), F.lit(0)))
        .join(group_offsets, F.col("_og").eqNullSafe(F.col("_gg")))
        .select("_og", "_ob", (F.col("_b") + F.col("_g")).alias("_offset"))
    )
    local = F.row_number().over(W.partitionBy("_group", "_bucket").orderBy(seq))
    same = F.col("_group").eqNullSafe(F.col("_og")) & (F.col("_bucket") == F.col("_ob"))
    return (
        cut.withColumn("_local", local)
        .join(offsets, same)
        .select(*df.columns, (F.col("_local") + F.col("_offset")).alias(name))
    )
