"""Streams in append mode: late rows, restarts, repeats."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.streaming import append_to_files, distinct_events, event_stream, windowed_counts

SCHEMA = "event_id long, ts timestamp_ntz, event_type string"


@pytest.fixture
def feed(spark, tmp_path):
    """Adds a file of (event_id, minute, type) rows to a folder; each file is one micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()

    def add(n, rows):
        made = [(i, None if m is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), t) for i, m, t in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"tmp{n}"))
        next((tmp_path / f"tmp{n}").glob("part-*.parquet")).rename(folder / f"{n:03}.parquet")

    add.folder = str(folder)
    return add


def counts(df):
    return sorted((r["window_start"].hour, r["event_type"], r["n"]) for r in df.collect())


def test_windows_that_close_equal_batch_and_late_rows_are_left_out(spark, feed, tmp_path):
    def run():
        return append_to_files(windowed_counts(event_stream(spark, feed.folder, 1)), str(tmp_path / "out"), str(tmp_path / "state"))

    feed(0, [(0, 5, "a"), (1, 20, "a"), (2, 50, "b"), (3, None, "a")])
    feed(1, [(4, 15, "b"), (5, 69, "a")])  # minute 15 is not late: the watermark is at 40 at most
    assert counts(run()) == []  # watermark 59: hour 0 is open
    feed(2, [(6, 140, "a"), (7, 65, "a")])
    first = [(0, "a", 2), (0, "b", 2), (1, "a", 2)]
    assert counts(run()) == first  # watermark 130: hours 0 and 1 are closed
    feed(3, [(8, 30, "a"), (9, 121, "b"), (10, 100, "b")])  # hours 0 and 1 have been written: both rows are too late; minute 121 is not
    assert counts(run()) == first
    feed(4, [(11, 400, "a")])
    got = counts(run())
    batch = windowed_counts(spark.read.parquet(feed.folder).filter("event_id not in (8, 10)"))
    assert got == [r for r in counts(batch.filter("window_start is not null")) if r[0] < 6]
    assert counts(run()) == got  # nothing new: nothing twice


def test_stream_goes_on_after_a_failure(spark, feed, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    feed(0, [(0, 5, "a")])
    feed(1, [(1, 200, "a")])
    # the second file's batch fails after the first file's has been done
    broken = event_stream(spark, feed.folder, 1).withColumn("event_type", F.when(F.col("event_id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("event_type")))
    with pytest.raises(Exception, match="lost"):
        append_to_files(windowed_counts(broken), out, state)
    assert counts(append_to_files(windowed_counts(event_stream(spark, feed.folder, 1)), out, state)) == [(0, "a", 1)]


def test_repeats_within_the_watermark_count_once(spark, feed, tmp_path):
    def run():
        return append_to_files(distinct_events(event_stream(spark, feed.folder, 1), ["event_id"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))

    feed(0, [(1, 10, "a"), (1, 10, "a"), (2, 20, "b"), (None, 20, "n"), (None, 20, "n")])
    feed(1, [(1, 10, "a"), (3, 30, "c")])
    assert sorted((r["event_id"] or 0, r["event_type"]) for r in run().collect()) == [(0, "n"), (1, "a"), (2, "b"), (3, "c")]
    feed(2, [(3, 30, "c"), (4, 600, "d")])
    feed(3, [(5, 610, "e"), (2, 20, "b")])  # hours behind the watermark: dropped as late, repeat or not
    assert sorted((r["event_id"] or 0) for r in run().collect()) == [0, 1, 2, 3, 4, 5]
    feed(4, [(3, 620, "c")])  # its key has been forgotten, which bounds the state
    assert sorted((r["event_id"] or 0) for r in run().collect()) == [0, 1, 2, 3, 3, 4, 5]


def test_distinct_in_batch(spark):
    rows = [(1, datetime.datetime(2024, 1, 1), "a"), (1, datetime.datetime(2024, 1, 1), "a"), (None, None, None), (None, None, None)]
    assert distinct_events(spark.createDataFrame(rows, SCHEMA), ["event_id"]).count() == 2
