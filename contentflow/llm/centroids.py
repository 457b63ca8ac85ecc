"""Centroid clustering of integer vectors, with a Walsh-Hadamard search for the nearest centroid.

Vectors of ``DIMS`` components become integers, ``floor(SCALE * x)``.  The Walsh-Hadamard transform is
integer and keeps distances but for the factor ``DIMS``, and most of a difference between smooth or clustered vectors
lies in few coefficients.  Squared coefficient differences are added up from coarse (few sign changes) to fine;
what has been added so far is a lower bound of a distance.  A centroid whose bound is strictly above the whole
distance of another one is left out, the rest get all ``DIMS`` coefficients.  So ties stay and results are exact.

Everything that grows with the vectors stays in tasks: each of them adds up its vectors by cluster,
Spark adds up these sums, and only the centroids' sums come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.session import stage

DIMS = 64
SCALE = 256
#: Integer components are below this, so that the squared distance of two transforms is below 2**61.
LIMIT = 1 << 23
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Coefficients that are added at a time.
STEPS = (0, 8, 16, 32, 64)
#: Vectors of a task that are compared in one go.
BLOCK = 4096

_KEPT = f"size(embedding) = {DIMS} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
_INSIDE = f"forall(embedding, x -> abs(x) < {LIMIT // SCALE})"


def _butterflies(x: np.ndarray) -> np.ndarray:
    n, h = len(x), 1
    while h < DIMS:
        pair = x.reshape(n, DIMS // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, DIMS)
        h *= 2
    return x


#: Coefficients by their number of sign changes: coarse before fine.
_ORDER = np.argsort((np.diff(_butterflies(np.eye(DIMS, dtype=np.int64)), axis=0) != 0).sum(axis=0), kind="stable")


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard coefficients of integer rows, coarse to fine."""
    return _butterflies(x)[:, _ORDER]


def nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed row the number of the nearest transformed centroid (ties: the smaller number) and the squared distance."""
    part = np.zeros((len(x), len(centre)), np.int64)
    for j in range(STEPS[1]):
        part += (x[:, j, None] - centre[None, :, j]) ** 2
    bound = ((x - centre[part.argmin(axis=1)]) ** 2).sum(axis=1)
    i, k = np.nonzero(part <= bound[:, None])
    d = part[i, k]
    for a, b in zip(STEPS[1:], STEPS[2:]):
        d = d + ((x[i, a:b] - centre[k, a:b]) ** 2).sum(axis=1)
        left = d <= bound[i]
        i, k, d = i[left], k[left], d[left]
    # Rows are in order, and centroids within a row: the first of the smallest ones is the row's.
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    least = np.minimum.reduceat(d, start)
    hit = np.flatnonzero(d == least[i])
    first = hit[np.append(True, i[hit][1:] != i[hit][:-1])]
    return k[first], least // DIMS


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of integers of an Arrow list column, and which rows are below ``LIMIT`` (the others are 0)."""
    value = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, DIMS)
    inside = (np.abs(value) <= LIMIT).all(axis=1)
    value[~inside] = 0
    return value.astype(np.int64), inside


def _assigned(batches, centre: np.ndarray):
    goal = transformed(centre)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            x, inside = integers(b.column("embedding"))
            cluster, distance = nearest(transformed(x), goal)
            yield b, x, inside, cluster, distance


def _sums(centre: np.ndarray):
    """Arrow batches of vectors to ``cluster, pos, s``: component sums by cluster, and at ``pos`` -1 the number of vectors."""

    def run(batches):
        total = np.zeros((len(centre), DIMS + 1), np.int64)
        for _, x, inside, cluster, _ in _assigned(batches, centre):
            np.add.at(total, cluster[inside], np.column_stack([np.ones(len(x), np.int64), x])[inside])
        k, pos = (z.ravel().astype(np.int32) for z in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(pos - 1), pa.array(total.ravel())], names=["cluster", "pos", "s"])

    return run


def _placed(centre: np.ndarray):
    def run(batches):
        for b, _, inside, cluster, distance in _assigned(batches, centre):
            out = [b.column("vec_id"), pa.array(cluster.astype(np.int32), mask=~inside), pa.array(distance, mask=~inside)]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "cluster", "distance"])

    return run


def _starting(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first ``k`` vectors by the hash of ``seed:vec_id``; null ids last, repeated ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(_INSIDE).select(key.alias("key"), "embedding").orderBy(F.asc_nulls_last("key"), "embedding").limit(k)
    # k rows: the number of centroids is a parameter.
    rows = sorted(rows.collect(), key=lambda r: (r["key"] is None, r["key"], r["embedding"]))
    return integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())))[0]


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``vectors`` (``vec_id``, ``embedding``).

    Rows whose vector is null, has another number of components, or a null, NaN or infinite one, are left out.  Vectors with
    a component of 32,768 or more would overflow a squared distance: they take no part and have null in all columns
    but ``vec_id`` and ``inertia``.  Ties go to the smaller number; a centroid without vectors stays.  Repeated rows and
    ids count one by one, null ids start no centroid unless too few others do.  With fewer vectors than ``k`` all of
    them start one.  Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(_KEPT)
    centre = _starting(kept, k, seed)
    if len(centre):
        for _ in range(rounds):
            total = np.zeros((len(centre), DIMS + 1), object)
            # One row for each centroid and component.
            for r in kept.mapInArrow(_sums(centre), "cluster int, pos int, s long").groupBy("cluster", "pos").agg(F.sum("s").alias("s")).collect():
                total[r["cluster"], r["pos"] + 1] = r["s"]
            centre = np.array([[int(s) // int(t[0]) for s in t[1:]] if t[0] else c.tolist() for c, t in zip(centre, total)], np.int64)
    else:
        centre = np.zeros((1, DIMS), np.int64)
    id_type = dict(vectors.dtypes)["vec_id"]
    placed = stage(kept.mapInArrow(_placed(centre), f"vec_id {id_type}, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: r["s"] for r in placed.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(i, sums.get(i, 0), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centre)]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string")
    return placed.join(about, "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256"
    )


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql() -> str:
    near = """
a{r} AS (SELECT vec_id, k, d FROM (SELECT v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
    move = """
c{s} AS (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM v JOIN a{r} USING (vec_id) GROUP BY ALL) m
  ON m.k = c.k AND m.i = c.i)"""
    steps = [near.format(r=r) + "," + move.format(r=r, s=r + 1) for r in range(ROUNDS)] + [near.format(r=ROUNDS)]
    return rf"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}),
v AS (SELECT vec_id, unnest(range(1, {DIMS + 1})) AS i, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k FROM e QUALIFY k < {CENTROIDS}),
c0 AS (SELECT k, i, x FROM v JOIN f USING (vec_id)),{",".join(steps)},
h AS (SELECT k, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN h USING (k)
"""


SQL = _sql()
