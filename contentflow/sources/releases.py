"""Dataset releases: the catalog of the newest release and its JSON-lines files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from contentflow.session import stage


def read_release_lines(
    spark: SparkSession, files: str | list[str], schema: str | T.StructType
) -> DataFrame:
    """JSON-lines dataset files as rows, one schema for all; gzip is read as it is."""
    return spark.read.schema(schema).json(files)


def read_diff_lines(spark: SparkSession, files: DataFrame, schema: str | T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """The records of diff files with their place: ``diff_idx, op, file_idx, line_idx`` and the columns of ``schema``.

    ``files(diff_idx, op, file_idx, path)`` lists JSON-lines files.  A large file is read in splits by many tasks.  Inside a split
    lines are numbered as they are read; the number of a split's first line is the prefix sum of the
    line counts of the splits before it in its file.  Blank lines count as lines and give no row.  A line that is not
    JSON is an error unless ``mode`` is PERMISSIVE.  Lines are parsed once and staged.
    """
    # The list of files; the scan needs it on the driver in any case.
    listed = files.select("diff_idx", "op", "file_idx", "path").collect()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(path: str) -> str:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return re.sub("^file:/+", "/", p.getFileSystem(hadoop).makeQualified(p).toUri().toString())

    if not listed:
        none = spark.createDataFrame([], schema)
        places = [F.lit(None).cast(t).alias(n) for n, t in (("diff_idx", "int"), ("op", "string"), ("file_idx", "int"), ("line_idx", "long"))]
        return none.select(*places, *none.columns)
    known = spark.createDataFrame([(r["diff_idx"], r["op"], r["file_idx"], qualified(r["path"])) for r in listed], "diff_idx int, op string, file_idx int, path string")
    lines = spark.read.text([r["path"] for r in listed]).select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        F.when(F.trim("value") != "", F.from_json("value", schema, {"mode": mode})).alias("record"),
    )
    lines = stage(lines, "diff-lines")
    # One row per split; a task reads a split's lines one after the other, so their numbers have no gaps.
    splits = lines.groupBy("path", "split").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = lines.where("record IS NOT NULL").join(splits, ["path", "split"]).join(known, "path")
    return placed.select("diff_idx", "op", "file_idx", (F.col("row") - F.col("first") + F.col("offset")).alias("line_idx"), "record.*")


def release_catalog(datasets: DataFrame, files: DataFrame) -> DataFrame:
    """Datasets of the newest release beside their files: one row per (dataset, file) at any size.

    ``datasets(release_id, name, description, readme)``, ``files(release_id, name, file)``.  ``n_files`` counts
    the files of the dataset; a dataset without files has one row with a NULL file.
    """
    newest = datasets.agg(F.max("release_id").alias("release_id")).scalar()
    current = datasets.where(F.col("release_id") == newest)
    listed = files.where((F.col("release_id") == newest) & F.col("file").isNotNull()).select("name", "file")
    counted = listed.groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))
    known = current.join(counted, "name", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)).cast("long"))
    # The files are the large side and one dataset may hold most of them: on the left of an inner join it can be split.
    none = known.where("n_files = 0").select("name", F.lit(None).cast("string").alias("file"))
    return listed.unionByName(none).join(known, "name").select("release_id", "name", "description", "readme", "n_files", "file")
