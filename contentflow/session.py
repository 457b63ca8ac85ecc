"""Session helpers: the recommended settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Staged folders of each application.
_made: dict[str, list[str]] = {}


def build_session(app: str = "contentflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE does the run-time work: it coalesces shuffle partitions, splits skewed join
    partitions and turns a shuffled join into a broadcast one when the measured side is
    below ``autoBroadcastJoinThreshold``.  That threshold is the size check behind every
    broadcast: no operator asks for one itself.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset and everything runs
    in one process (tests, a laptop) a local temporary folder takes its place; on a cluster, whose
    machines would not see each other's files, that is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="contentflow-")
        spark.conf.set(CHECKPOINT_CONF, root)
    folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Delete what this application has staged; for after the results that read it have been written."""
    for folder in _made.pop(spark.sparkContext.applicationId, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, purpose: str, drop_shuffles: bool = False) -> DataFrame:
    """Write a result that several branches of a plan read to the shared folder, once.

    Reading it again is cheaper than computing it again, and losing an executor does not undo it.
    ``drop_shuffles`` has Spark delete the shuffle files of this write when it has ended, so that the disk that a chain
    of writes needs is that of its largest step and not the sum of all.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true" if drop_shuffles else before)
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(folder)
