"""Inverted lists of vectors, with a lookup that reads few of them and loses nothing.

Every vector belongs to the list of its nearest centroid, by angle.  Angles obey the triangle inequality: with the target at
angle ``t`` from a centroid, a vector at angle ``a`` from it is at least ``|t - a|`` away from the target.  So once ``limit`` rows
are known within some angle, only lists and rows that may come closer are read: whole lists drop out by the range
of angles they hold, row groups by the angle column, by which the rows of a list are sorted.  Candidates
are then ranked exactly, by the same expression as a scan.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentflow.operators.catalog import _among, _difference, _length, _nearest, dot, mean_vector

#: Slack of angles, above the rounding of scores to 4 places and of sums of doubles.
SLACK = 2e-4
#: The list of vectors of another dimension than the centroids; it is always read.
OTHER = -1


def _angle(a: Column, b: Column) -> Column:
    cosine = F.try_divide(dot(a, b), _length(a) * _length(b))
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def _placed(vectors: DataFrame, centroids: list[list[float]], vector: str) -> DataFrame:
    """Add ``list`` and ``angle``: the nearest centroid (ties: the smaller number) and the angle to it."""
    if not centroids:
        return vectors.withColumns({"list": F.lit(OTHER), "angle": F.lit(0.0)})
    near = F.array_min(
        F.transform(
            F.col("_centroids"), lambda c, i: F.struct(_angle(F.col(vector), c).alias("angle"), i.alias("list"))
        )
    )
    known = vectors.withColumn("_centroids", F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids]))
    fits = (F.size(vector) == len(centroids[0])) & (_length(F.col(vector)) > 0)
    placed = known.withColumn("_near", F.when(fits, near)).drop("_centroids")
    return placed.withColumns({"list": F.coalesce("_near.list", F.lit(OTHER)), "angle": F.coalesce("_near.angle", F.lit(0.0))}).drop("_near")


def build(vectors: DataFrame, key: str, path: str, vector: str = "embedding", lists: int = 64, rounds: int = 2) -> None:
    """Write the index of ``vectors`` to ``path``: ``rows`` by list, and ``lists`` with centroid and range of angles.

    Centroids begin as the ``lists`` vectors with the smallest hash of their key and move to the mean of their list
    ``rounds`` times.  All columns of ``vectors`` are kept.
    """
    spark = vectors.sparkSession
    usable = vectors.where((F.size(vector) > 0) & (_length(F.col(vector)) > 0))
    # As many vectors as there are lists.
    first = usable.orderBy(F.xxhash64(key), key).limit(lists).select(F.col(vector).cast("array<double>").alias("c")).collect()
    width = len(first[0]["c"]) if first else 0
    centroids = [r["c"] for r in first if len(r["c"]) == width]
    for _ in range(rounds):
        unit = _placed(usable, centroids, vector).where(F.col("list") >= 0)
        unit = unit.withColumn("_n", _length(F.col(vector)))
        unit = unit.select("list", F.transform(vector, lambda x: F.try_divide(x.cast("double"), F.col("_n"))).alias("u"))
        moved = {r["list"]: r["c"] for r in mean_vector(unit, ["list"], "u", "c").collect()}
        # A mean of length zero has no direction.
        centroids = [m if (m := moved.get(i)) and any(m) else c for i, c in enumerate(centroids)]
    placed = _placed(vectors, centroids, vector)
    placed.repartition("list").sortWithinPartitions("list", "angle").write.partitionBy("list").parquet(f"{path}/rows")
    ends = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("list").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")
    )
    named = [(i, list(map(float, c))) for i, c in enumerate(centroids)] + [(OTHER, None)]
    about = spark.createDataFrame(named, "list int, centroid array<double>")
    about.join(ends, "list").write.parquet(f"{path}/lists")


def candidates(spark: SparkSession, path: str, target: list[float], limit: int, keep: Column, key: str, vector: str = "embedding") -> DataFrame:
    """The indexed rows that may be among the ``limit`` nearest to ``target`` of those with ``keep``.

    The lists nearest to the target that hold enough rows give a first answer; the angle of its last row bounds what is read
    for the second, whole one.
    """
    rows = spark.read.parquet(f"{path}/rows").where(keep)
    goal = F.array(*[F.lit(float(x)) for x in target])
    # One row per list.
    about = spark.read.parquet(f"{path}/lists").select("list", "low", "high", "n", _angle(F.col("centroid"), goal).alias("t")).collect()
    other = [r["list"] for r in about if r["t"] is None or math.isnan(r["t"])]
    near = sorted((r for r in about if r["list"] not in other), key=lambda r: (r["t"], r["list"]))
    if not near:
        return rows
    first, held = [], 0
    for r in near:
        first.append(r["list"])
        held += r["n"]
        if held >= 2 * limit:
            break
    aimed = spark.createDataFrame([([float(x) for x in target],)], "_t array<double>")
    known = _nearest(rows.where(F.col("list").isin(first)), aimed, key, vector, limit, None).select("score").collect()
    if len(known) < limit:
        return rows
    reach = math.acos(max(-1.0, min(1.0, known[-1]["score"] - SLACK))) + SLACK
    chosen = [r for r in near if r["t"] - reach <= r["high"] and r["low"] <= r["t"] + reach]
    # The bounds are literals: lists are pruned as partitions, row groups by the angle.
    parts = [(F.col("list") == r["list"]) & F.col("angle").between(r["t"] - reach, r["t"] + reach) for r in chosen]
    lists = F.col("list").isin([r["list"] for r in chosen] + other)
    return rows.where(lists & reduce(or_, parts, F.col("list").isin(other)))


def recommend(path: str, vectors: DataFrame, key: str, seed, limit: int = 100, vector: str = "embedding", fields: list[str] | None = None) -> DataFrame:
    """The rows of ``catalog.recommend`` from an index; the seed's vector comes from ``vectors``."""
    target = vectors.where(F.col(key) == F.lit(seed)).select(F.col(vector).cast("array<double>").alias("_t")).limit(1)
    aimed = target.collect()  # one vector
    if not aimed or not aimed[0]["_t"]:
        return _nearest(vectors.where("false"), target, key, vector, limit, fields)
    near = candidates(vectors.sparkSession, path, aimed[0]["_t"], limit, F.col(key) != F.lit(seed), key, vector)
    return _nearest(near, target, key, vector, limit, fields)


def recommend_from(path: str, vectors: DataFrame, key: str, positive: list, negative: list = (), limit: int = 100,
                           vector: str = "embedding", fields: list[str] | None = None) -> DataFrame:
    """The rows of ``catalog.recommend_from`` from an index."""
    mean = lambda ids: mean_vector(vectors.where(_among(key, ids)), [], vector, "_m")
    target = _difference(mean(positive), mean(negative) if negative else None)
    aimed = target.collect()  # one vector
    if not aimed or not aimed[0]["_t"]:
        return _nearest(vectors.where("false"), target, key, vector, limit, fields)
    keep = ~_among(key, [*positive, *negative])
    near = candidates(vectors.sparkSession, path, aimed[0]["_t"], limit, keep, key, vector)
    return _nearest(near, target, key, vector, limit, fields)
