"""Segments of a growing store on levels, and the manifests that list them.

A segment is a folder that is written once and never changed.  New segments come on level 0; as soon as a level has ``fan`` of them
they are merged into one on the next level, so ``n`` batches leave about ``fan * log(n)`` segments and every row is rewritten
once per level.  A manifest lists the segments that count.  It is complete when Spark's success marker is there, so
readers swap from one state to the next at once; segments live on until two manifests do without them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

FAN = 4


class Segment(NamedTuple):
    kind: str
    level: int
    path: str


class Files:
    """The file system of a folder, on the driver; for names only, never for data."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifest/version={version}"


def read_manifest(spark: SparkSession, root: str, version: int) -> list[Segment]:
    path = _manifest(root, version)
    if not Files(spark, root).exists(f"{path}/_SUCCESS"):
        return []
    rows = spark.read.schema("kind string, level int, path string, place int").json(path).orderBy("place").collect()
    return [Segment(r["kind"], r["level"], f"{root}/{r['path']}") for r in rows]


def newest(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, list[Segment]]:
    """The last complete version, below ``before`` if that is given, and its segments; (-1, []) without one."""
    found = [int(m[1]) for m in (re.fullmatch(r"version=(\d+)", n) for n in Files(spark, root).names(f"{root}/manifest")) if m]
    for version in sorted(found, reverse=True):
        if (before is None or version < before) and Files(spark, root).exists(f"{_manifest(root, version)}/_SUCCESS"):
            return version, read_manifest(spark, root, version)
    return -1, []


def fresh_path(root: str, kind: str) -> str:
    return f"{root}/{kind}-{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, version: int, segments: list[Segment]) -> None:
    """Make ``segments`` the state of ``version``; drop what only the state before the last one needed."""
    before, old = read_manifest(spark, root, version - 1), read_manifest(spark, root, version - 2)
    rows = [(s.kind, s.level, s.path.removeprefix(f"{root}/"), i) for i, s in enumerate(segments)]
    listed = spark.createDataFrame(rows, "kind string, level int, path string, place int")
    listed.coalesce(1).write.mode("overwrite").json(_manifest(root, version))
    files = Files(spark, root)
    for path in {s.path for s in old} - {s.path for s in [*before, *segments]}:
        files.delete(path)
    files.delete(_manifest(root, version - 2))


def with_segment(
    spark: SparkSession, root: str, segments: list[Segment], kind: str, rows: DataFrame,
    write: Callable[[DataFrame, str], None], merge: Callable[[DataFrame], DataFrame], fan: int = FAN,
) -> list[Segment]:
    """The segments with ``rows`` written as one more on level 0, and full levels merged."""
    path = fresh_path(root, kind)
    write(rows, path)
    out = [*segments, Segment(kind, 0, path)]
    level = 0
    while len(full := [s for s in out if s.kind == kind and s.level == level]) >= fan:
        path = fresh_path(root, kind)
        # One by one: segments may be laid out in folders of their own.
        parts = [spark.read.schema(rows.schema).parquet(s.path).select(rows.columns) for s in full]
        write(merge(reduce(DataFrame.unionByName, parts)), path)
        out = [s for s in out if s not in full] + [Segment(kind, level + 1, path)]
        level += 1
    return out
