"""The dataset flow: bring a keyed table from one release to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame

from contentflow.operators.changes import apply_changes, delete_misses, linearize


def apply_diffs(target: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The updated table and the deletes that found nothing.

    ``changes`` holds the lines of all diff files: ``diff_idx, op, file_idx, line_idx``, the key and
    the record.  Only the last change of a key matters for the table, so diffs need not be applied
    one after the other.
    """
    ordered = linearize(changes)
    return apply_changes(target, ordered, key), delete_misses(target, ordered, key)
