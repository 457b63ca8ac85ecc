"""Incremental forms of the ingest operators.

Each sink writes the output of a micro-batch to its own folder ``batch=<id>`` in overwrite mode and
looks only at the state that earlier batches left.  A batch that is run again after a failure therefore
replaces its own output and sees what it saw the first time.  What a batch reads of that state does not grow with the
number of batches: stored keys stand behind a Bloom filter (``stream_ingest``), changes on sorted
levels (``stream_apply_changes``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from contentflow.operators.changes import apply_changes, latest_changes
from contentflow.operators.selection import dedupe_posts, unseen
from contentflow.session import stage
from contentflow.sources.posts import _or_empty
from contentflow.streaming import levels


def _earlier(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Rows written by batches before this one; the filter prunes folders."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    read = _or_empty(spark, lambda: spark.read.schema(full).parquet(path), full)
    return read.where(F.col("batch") < batch_id).drop("batch")


def _start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: Buckets of the key index, bits of its filter per expected key.
BUCKETS, BITS = 64, 16


def _hashed(df: DataFrame, key: str, words: int) -> DataFrame:
    """Add the bucket of the key, the word of its bucket's filter that it belongs to, and its three bits there."""
    h = F.xxhash64(key)
    bit = lambda shift: F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(_h, {shift}) & 63 AS INT))")
    return df.withColumn("_h", h).withColumns(
        {
            "_bucket": F.pmod("_h", F.lit(BUCKETS)).cast("int"),
            "_word": F.pmod(F.shiftrightunsigned("_h", 8), F.lit(words)).cast("int"),
            "_bits": bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52)),
        }
    )


def _read_keys(spark: SparkSession, index: str, segments: list[levels.Segment], buckets: list[int], schema: T.StructType) -> DataFrame | None:
    """The stored keys of some buckets: only their folders are read."""
    files = levels.Files(spark, index)
    paths = [p for s in segments for b in buckets if files.exists(p := f"{s.path}/_bucket={b}")]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def store_new(batch: DataFrame, batch_id: int, target: str, key: str, seq: str, index: str | None = None, expected: int = 1 << 20) -> None:
    """Write the rows of a batch whose key no earlier batch has stored, each key once, and index their keys.

    The index holds the keys in ``BUCKETS`` buckets on levels, and a Bloom filter of one 64-bit word per key in
    ``expected * BITS`` bits.  Only keys that the filter lets through may be stored; only their buckets are read to find out.
    With more keys than ``expected`` more buckets are read; the result stays exact.
    """
    spark, index = batch.sparkSession, index or f"{target.rstrip('/')}-index"
    _, segments = levels.newest(spark, index, before=batch_id)
    filters, keys = ([s for s in segments if s.kind == kind] for kind in ("filter", "keys"))
    # An index keeps the filter's size that it began with; the manifest has it in the place of a level.
    words = filters[0].level if filters else max(1, expected * BITS // 64 // BUCKETS)
    fresh = stage(_hashed(dedupe_posts(batch, [key], seq), key, words), "batch")
    own = ["_h", "_bucket", "_word", "_bits"]
    new = fresh
    seen = spark.read.schema("_bucket int, _word int, _set long").parquet(filters[0].path) if filters else None
    if seen is not None:
        hit = fresh.join(seen, ["_bucket", "_word"]).where("_set & _bits = _bits")
        # At most BUCKETS numbers.
        buckets = [r["_bucket"] for r in hit.select("_bucket").distinct().collect()]
        stored = _read_keys(spark, index, keys, buckets, fresh.select(key, "_h").schema)
        if stored is not None:
            new = unseen(fresh, stored, key)
    out = f"{target}/batch={batch_id}"
    new.drop(*own).write.mode("overwrite").parquet(out)
    written = _hashed(spark.read.schema(batch.schema).parquet(out), key, words)

    def write(rows: DataFrame, path: str) -> None:
        placed = rows.withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)).cast("int")).repartition("_bucket")
        placed.sortWithinPartitions("_bucket", "_h").write.partitionBy("_bucket").parquet(path)

    listed = levels.with_segment(spark, index, keys, "keys", written.select(key, "_h"), write, lambda rows: rows)
    path = levels.fresh_path(index, "filter")
    added = written.select("_bucket", "_word", F.col("_bits").alias("_set"))
    both = added if seen is None else added.unionByName(seen)
    both.groupBy("_bucket", "_word").agg(F.bit_or("_set").alias("_set")).write.parquet(path)
    levels.commit(spark, index, batch_id, [*listed, levels.Segment("filter", words, path)])


def stream_ingest(stream: DataFrame, target: str, checkpoint: str, key: str, seq: str, expected: int = 1 << 20) -> StreamingQuery:
    """Store each key once: repeats inside a batch and keys of earlier batches are dropped (see ``store_new``)."""
    return _start(stream, lambda batch, batch_id: store_new(batch, batch_id, target, key, seq, expected=expected), checkpoint)


def dedupe_stream(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeats that arrive within ``delay``: the form with bounded state, for feeds whose
    repeats come close together."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_high_water(stream: DataFrame, target: str, marks: str, checkpoint: str, date: str) -> StreamingQuery:
    """Drop rows that are not newer than everything stored by earlier batches; undated rows pass.

    ``marks`` keeps one row per batch, so finding the mark does not read the target.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark_schema = T.StructType([T.StructField("mark", batch.schema[date].dataType)])
        mark = _earlier(spark, marks, mark_schema, batch_id).agg(F.max("mark").alias("_mark"))
        late = F.col(date) <= mark.scalar()
        fresh = batch.where(~F.coalesce(late, F.lit(False)))
        out = f"{target}/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(out)
        written = spark.read.schema(batch.schema).parquet(out)
        written.agg(F.max(date).alias("mark")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return _start(stream, sink, checkpoint)


def append_changes(batch: DataFrame, log: str, key: str, seq: str = "seq", fan: int = levels.FAN) -> None:
    """Add the last change per key of a batch to a log of sorted levels.

    A merged segment keeps the last change per key, sorted by key.  Changes are told apart by ``seq`` alone: a batch that
    is added twice, or comes again cut in other places, changes nothing.
    """
    spark = batch.sparkSession
    version, segments = levels.newest(spark, log)

    def merged(changes: DataFrame) -> DataFrame:
        return latest_changes(changes, key, seq)

    def write(changes: DataFrame, path: str) -> None:
        changes.sortWithinPartitions(key).write.parquet(path)

    levels.commit(spark, log, version + 1, levels.with_segment(spark, log, segments, "changes", merged(batch), write, merged, fan))


def stream_apply_changes(stream: DataFrame, log: str, checkpoint: str, key: str, seq: str = "seq") -> StreamingQuery:
    """Log the changes of every batch; the table is merged when it is read (``current_table``).

    Changes keep their ``seq``; the result does not depend on how the feed is cut into batches.
    """
    return _start(stream, lambda batch, _: append_changes(batch, log, key, seq), checkpoint)


def logged_changes(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """The changes of all segments that count, about ``fan * log(batches)`` folders; at most one change of a key in each."""
    _, segments = levels.newest(spark, log)
    read = spark.read.schema(schema)
    return read.parquet(*[s.path for s in segments]) if segments else spark.createDataFrame([], schema)


def current_table(target: DataFrame, spark: SparkSession, log: str, schema: T.StructType, key: str, seq: str = "seq") -> DataFrame:
    """The target with all logged changes applied."""
    return apply_changes(target, logged_changes(spark, log, schema), key, seq)
