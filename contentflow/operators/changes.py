"""Merging new rows into a store, and replaying change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from contentflow.operators.ordering import with_previous
from contentflow.operators.selection import after_high_water, unseen

UPSERT, DELETE = "upsert", "delete"


def merge_new_first(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Unseen rows ahead of the stored ones. ``batch`` (0 new, 1 stored) carries the order."""
    fresh = unseen(new, existing, key).withColumn("batch", F.lit(0))
    return fresh.unionByName(existing.withColumn("batch", F.lit(1)), allowMissingColumns=True)


def append_increment(existing: DataFrame, new: DataFrame, date: str = "date", key: str | None = None) -> DataFrame:
    """Stored rows followed by the rows past the high-water mark (``batch`` 0 stored, 1 new).

    With ``key``, rows whose key is stored are not appended again: undated rows pass the mark at every
    run.
    """
    fresh = after_high_water(new, existing, date)
    if key:
        fresh = unseen(fresh, existing, key)
    fresh = fresh.withColumn("batch", F.lit(1))
    return existing.withColumn("batch", F.lit(0)).unionByName(fresh, allowMissingColumns=True)


def linearize(changes: DataFrame) -> DataFrame:
    """Give the rows of a diff set their replay order as one number, ``seq``.

    Diffs come in order; inside a diff all update files precede all delete files; inside a phase
    files and lines count.  The number has gaps where files are shorter than the longest one.
    """
    size = lambda c: (F.max(c).cast("long") + 1).alias(c)
    most = changes.agg(F.struct(size("file_idx"), size("line_idx"))).scalar()
    phase = F.when(F.col("op") == DELETE, 1).otherwise(0)
    file = (F.col("diff_idx") * 2 + phase) * most["file_idx"] + F.col("file_idx")
    return changes.withColumn("seq", file * most["line_idx"] + F.col("line_idx"))


def latest_changes(changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last change of each key; pruned to one row per key in every task before the shuffle."""
    last = W.partitionBy(key).orderBy(F.desc(seq))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def apply_changes(target: DataFrame, changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The target after replaying upserts and deletes in order.

    A missing key is a key like any other.  Per key only the last change counts and replaces the whole record.  ``changes`` has the target's
    columns plus ``seq`` and ``op``.
    """
    values = [c for c in target.columns if c != key]
    last = latest_changes(changes, key, seq).select(
        F.col(key).alias("_key"), "op", *[F.col(c).alias(f"_new_{c}") for c in values]
    )
    merged = target.withColumn("_old", F.lit(1)).join(last, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    replaced = F.col("op").isNotNull()
    return merged.where(~F.col("op").eqNullSafe(DELETE)).select(
        F.when(F.col("_old").isNotNull(), F.col(key)).otherwise(F.col("_key")).alias(key),
        *[F.when(replaced, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
    )


def delete_misses(target: DataFrame, changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Deletes that hit an absent key at their point of the replay: ``(seq, key)``.

    A delete misses when the preceding change of the key is a delete too, or when it is the key's
    first change and the target does not hold the key.
    """
    ops = changes.select(key, seq, (F.col("op") == DELETE).cast("int").alias("_del"))
    history = with_previous(ops, [key], seq, "_del", "_before").where("_del = 1")
    known = target.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(1))
    absent = F.col("_before").isNull() & F.col("_known").isNull()
    return history.join(known, F.col(key).eqNullSafe(F.col("_k")), "left").where((F.col("_before") == 1) | absent).select(seq, key)
