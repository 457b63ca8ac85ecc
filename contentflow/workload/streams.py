"""The streaming forms: each runs its source to the end, in several runs of the same stream.

The source arrives in slices and the stream is started anew after each, so every run resumes from
the checkpoint of the one before.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contentflow.session import shared_folder
from contentflow.streaming import ingest as I
from contentflow.workload import fixtures as fx, sqltext as s
from contentflow.workload.registry import query
from contentflow.workload.selection import APPLIED

RUNS = 3


def _feed_in(t, table, seq, start, runs=RUNS):
    """Write the slices of ``table`` one by one and let ``start`` consume what is there."""
    source = shared_folder(t.spark, "stream-source")
    for part in fx.slices(table, seq, runs):
        part.write.mode("append").parquet(source)
        start(t.spark.readStream.schema(table.schema).parquet(source)).awaitTermination()


@query(
    "stream_ingest",
    f"""WITH {s.POSTS}, keyed AS (SELECT seq, title, md5(array_to_string(body, '|')) AS key FROM posts)
SELECT key, min(seq) AS seq FROM keyed GROUP BY key""",
)
def stream_ingest(t):
    posts = fx.posts(t).select("seq", "title", F.md5(F.array_join("body", "|")).alias("key"))
    target, checkpoint = shared_folder(t.spark, "ingest"), shared_folder(t.spark, "ingest-state")
    _feed_in(t, posts, "seq", lambda src: I.stream_ingest(src, target, checkpoint, "key", "seq"))
    return t.spark.read.parquet(target).select("key", "seq")


@query(
    "stream_high_water",
    f"""WITH span AS (SELECT min(event_id) AS lo, (max(event_id) - min(event_id) + 1) / {RUNS}.0 AS w FROM events
), cut AS (
  SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL
                        WHEN event_id % 10 = 0 THEN ts - INTERVAL 20 DAY ELSE ts END AS ts,
         CAST(floor((event_id - lo) / w) AS INTEGER) AS slice FROM events, span
), m AS (SELECT slice, max(ts) AS mark FROM cut GROUP BY slice)
SELECT event_id FROM cut c WHERE ts IS NULL OR coalesce(ts > (SELECT max(mark) FROM m WHERE m.slice < c.slice), true)""",
)
def stream_high_water(t):
    k = F.col("event_id")
    ts = F.when(k % 50 == 0, F.lit(None)).when(k % 10 == 0, F.expr("ts - INTERVAL 20 DAYS")).otherwise(F.col("ts"))
    events = t.events.select("event_id", ts.alias("ts"))
    target, marks, checkpoint = (shared_folder(t.spark, n) for n in ("late", "late-marks", "late-state"))
    _feed_in(t, events, "event_id", lambda src: I.stream_high_water(src, target, marks, checkpoint, "ts"))
    return t.spark.read.parquet(target).select("event_id")


@query("stream_apply_changes", APPLIED)
def stream_apply_changes(t):
    changes = fx.changes(t)
    log, checkpoint = shared_folder(t.spark, "changes"), shared_folder(t.spark, "changes-state")
    _feed_in(t, changes, "seq", lambda src: I.stream_apply_changes(src, log, checkpoint, "key"))
    return I.current_table(fx.change_target(t), t.spark, log, changes.schema, "key")


@query("dedupe_stream", "SELECT DISTINCT user_id AS key FROM events")
def dedupe_stream(t):
    """One batch, in which the watermark has not moved yet: every key comes once."""
    source, target, checkpoint = (shared_folder(t.spark, n) for n in ("repeats", "once", "once-state"))
    events = t.events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(source)
    stream = I.dedupe_stream(t.spark.readStream.schema(events.schema).parquet(source), "key", "ts", "60 days")
    out = stream.select("key").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    out.start(target).awaitTermination()
    return t.spark.read.parquet(target)
