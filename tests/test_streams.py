"""The streaming forms equal the batch forms for any cut of the input, and survive a rerun."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from contentflow.operators import changes, selection
from contentflow.session import shared_folder
from contentflow.streaming import ingest, levels
from contentflow.workload import fixtures as fx
from contentflow.workload.registry import Tables
from contentflow.workload.streams import _feed_in


@pytest.mark.parametrize("runs", [1, 4])
def test_ingest_equals_batch(spark, testdata, runs):
    t = Tables(spark, testdata)
    posts = fx.posts(t).select("seq", F.md5(F.array_join("body", "|")).alias("key"))
    target, state = shared_folder(spark, "t"), shared_folder(spark, "s")
    _feed_in(t, posts, "seq", lambda src: ingest.stream_ingest(src, target, state, "key", "seq"), runs)
    got = {(r.key, r.seq) for r in spark.read.parquet(target).collect()}
    assert got == {(r.key, r.seq) for r in selection.dedupe_posts(posts, ["key"]).collect()}


@pytest.mark.parametrize("runs", [1, 3])
def test_changes_equal_batch(spark, testdata, runs):
    t = Tables(spark, testdata)
    feed = fx.changes(t)
    log, state = shared_folder(spark, "l"), shared_folder(spark, "s")
    _feed_in(t, feed, "seq", lambda src: ingest.stream_apply_changes(src, log, state, "key"), runs)
    got = ingest.current_table(fx.change_target(t), spark, log, feed.schema, "key")
    want = changes.apply_changes(fx.change_target(t), feed, "key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    """A lost checkpoint replays the source: same batch numbers, same result, no doubles."""
    source, target = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq long, key string").write.parquet(source)
    stream = lambda: spark.readStream.schema("seq long, key string").parquet(source)
    for state in ("s1", "s2"):
        ingest.stream_ingest(stream(), target, str(tmp_path / state), "key", "seq").awaitTermination()
    assert sorted((r.seq, r.key) for r in spark.read.parquet(target).collect()) == [(1, "a"), (3, "b")]


def test_empty_log_reads_as_the_target(spark, tmp_path):
    target = spark.createDataFrame([(1, "x")], "key long, payload string")
    feed = spark.createDataFrame([], "seq long, op string, key long, payload string")
    got = ingest.current_table(target, spark, str(tmp_path / "none"), feed.schema, "key")
    assert [tuple(r) for r in got.collect()] == [(1, "x")]


def test_native_dedupe(spark, tmp_path):
    source = str(tmp_path / "src")
    spark.createDataFrame([("a", 0), ("a", 60), ("b", 30)], "key string, s long").select(
        "key", F.timestamp_seconds("s").alias("ts")
    ).coalesce(1).write.parquet(source)
    stream = ingest.dedupe_stream(spark.readStream.schema("key string, ts timestamp").parquet(source), "key", "ts")
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_what_a_batch_reads_stays_flat(spark, tmp_path, monkeypatch):
    """Sixteen batches of new keys with a few repeats: the filter and the buckets of the repeats are read, not the store."""
    read, target = [], str(tmp_path / "store")
    keys_of = ingest._read_keys

    def measured(*args):
        df = keys_of(*args)
        read.append(sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles()) if df is not None else 0)
        return df

    monkeypatch.setattr(ingest, "_read_keys", measured)
    filters = []
    for b in range(16):
        repeats = [(b * 100 + i, f"k{(b * 37 + i) % max(b * 40, 1)}") for i in range(2)]
        rows = repeats + [(b * 100 + 10 + i, f"k{b * 40 + i}") for i in range(40)]
        ingest.store_new(spark.createDataFrame(rows, "seq long, key string"), b, target, "key", "seq", expected=4096)
        segments = levels.newest(spark, f"{target}-index")[1]
        filters.append(sum(os.path.getsize(p) for p in glob.glob(f"{segments[-1].path}/*.parquet")))
        assert len(segments) <= 2 * 3 + 1
    stored = [r.key for r in spark.read.parquet(target).collect()]
    assert len(stored) == len(set(stored)) == 16 * 40
    index = sum(os.path.getsize(p) for p in glob.glob(f"{target}-index/keys-*/*/*.parquet"))
    # The store grew sixteenfold; a batch reads the buckets of two keys and of the filter's few mistakes.
    assert max(read[-6:]) < index / 4 and max(filters) <= 64 * 16 * 16
    assert len(glob.glob(f"{target}-index/*-*")) <= 2 * 7 + 4, "segments that no state needs are gone"


def test_a_full_filter_stays_exact(spark, tmp_path):
    """More keys than the filter was made for, missing keys, and a batch that runs twice."""
    target = str(tmp_path / "store")
    batches = [[(i, f"k{i % 70}" if i % 9 else None) for i in range(b * 60, b * 60 + 100)] for b in range(5)]
    for b in (0, 1, 1, 2, 2, 3, 4):
        ingest.store_new(spark.createDataFrame(batches[b], "seq long, key string"), b, target, "key", "seq", expected=4)
    first = {}
    for rows in batches:
        for seq, key in rows:
            first.setdefault(key, seq)
    assert {(r.key, r.seq) for r in spark.read.parquet(target).collect()} == set(first.items())


def test_replay_with_other_borders_stores_every_key(spark, tmp_path):
    target = str(tmp_path / "store")
    rows = [(i, f"k{i % 50}") for i in range(120)]
    for borders in ((0, 30, 60, 120), (0, 70, 90, 120)):
        for b, (lo, hi) in enumerate(zip(borders, borders[1:])):
            ingest.store_new(spark.createDataFrame(rows[lo:hi], "seq long, key string"), b, target, "key", "seq")
    assert sorted((r.seq, r.key) for r in spark.read.parquet(target).collect()) == [(i, f"k{i}") for i in range(50)]


def test_the_change_log_keeps_few_segments(spark, tmp_path):
    """Twenty batches, one added twice, one lost between its segment and its manifest: few folders, the same table."""
    log = str(tmp_path / "log")
    rnd = random.Random(4)
    feed = [(i, rnd.choice(["upsert", "delete"]), rnd.randrange(40), f"p{i}") for i in range(400)]
    schema = "seq long, op string, key int, payload string"
    for b in range(20):
        part = spark.createDataFrame(feed[b * 20 : b * 20 + 20], schema)
        if b == 6:
            commit, levels.commit = levels.commit, lambda *_: 1 / 0
            with pytest.raises(ZeroDivisionError):
                ingest.append_changes(part, log, "key")
            levels.commit = commit
        for _ in range(1 + (b == 9)):
            ingest.append_changes(part, log, "key")
        assert len(levels.newest(spark, log)[1]) <= 2 * 3
    df = spark.createDataFrame(feed, schema)
    target = spark.createDataFrame([(100, "kept"), (3, "old")], "key int, payload string")
    want = sorted(map(tuple, changes.apply_changes(target, df, "key").collect()))
    assert sorted(map(tuple, ingest.current_table(target, spark, log, df.schema, "key").collect())) == want
    # The same feed again, cut in other places.
    for lo in range(0, 400, 130):
        ingest.append_changes(spark.createDataFrame(feed[lo : lo + 130], schema), log, "key")
    assert sorted(map(tuple, ingest.current_table(target, spark, log, df.schema, "key").collect())) == want


def test_readers_see_whole_states(spark, tmp_path):
    root = str(tmp_path / "s")
    one, two = levels.Segment("k", 0, f"{root}/k-1"), levels.Segment("k", 1, f"{root}/k-2")
    assert levels.newest(spark, root) == (-1, [])
    levels.commit(spark, root, 0, [one])
    levels.commit(spark, root, 1, [two, one])
    assert levels.newest(spark, root) == (1, [two, one]) and levels.newest(spark, root, before=1) == (0, [one])
    (tmp_path / "s" / "manifest" / "version=1" / "_SUCCESS").unlink()
    assert levels.newest(spark, root) == (0, [one])
