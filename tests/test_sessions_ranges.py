"""Session windows and range joins against Spark's own forms and plain Python."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.functions import micros
from millrace.operators import range_counts, range_join, sessions

START = datetime.datetime(2024, 1, 1)


def events(draw, n, step=5):
    return [(draw.choice([1, 1, 1, 2, None]), None if draw.random() < 0.03 else START + datetime.timedelta(minutes=draw.randrange(0, 6000, step)), draw.randrange(10)) for _ in range(n)]


@pytest.mark.parametrize("span", [1, 3, 4096])
@pytest.mark.parametrize("gap", [5, 30, 6000])
def test_sessions_are_those_of_session_window(spark, gap, span):
    df = spark.createDataFrame(events(random.Random(gap), 400), "user int, ts timestamp_ntz, v int")
    got = sessions(df, ["user"], "ts", gap * 60, {"total": F.col("v").cast("long")}, span)
    w = df.select("user", F.col("ts").cast("timestamp").alias("ts"), "v").groupBy("user", F.session_window("ts", f"{gap} minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    want = w.select("user", F.col("w.start").cast("timestamp_ntz"), F.col("w.end").cast("timestamp_ntz"), "n", "total")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_user_hot_for_days_is_no_single_task(spark):
    # one user with a row each second for three days: a session without end
    rows = spark.range(3 * 86400).select(F.lit(7).alias("user"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.lit(1).alias("_n"))
    got = sessions(rows, ["user"], "ts", 60, {"total": F.col("_n").cast("long")}, 64)
    assert [(r["n_rows"], r["total"]) for r in got.collect()] == [(3 * 86400, 3 * 86400)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "session_window" not in plan


def test_sessions_of_nothing(spark):
    df = spark.createDataFrame([], "user int, ts timestamp_ntz")
    assert sessions(df, ["user"], "ts", 60).collect() == []
    assert sessions(spark.createDataFrame([(1, None)], "user int, ts timestamp_ntz"), ["user"], "ts", 60).collect() == []
    one = spark.createDataFrame([(None, START), (None, START)], "user int, ts timestamp_ntz")
    assert [tuple(r) for r in sessions(one, ["user"], "ts", 60).collect()] == [(None, START, START + datetime.timedelta(minutes=1), 2)]


def test_micros_are_free_of_the_zone(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 3, 31, 2, 30, 0, 123456),), (datetime.datetime(1969, 12, 31, 23, 59, 59, 999999),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 2:30 does not exist there on that day
        got = [r[0] for r in df.select(micros(F.col("t"), df.schema["t"].dataType)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [1711852200123456, -1]


INF, NAN = float("inf"), float("nan")


def brute(points, bands):
    return sorted((i, j) for i, p in points for j, lo, hi in bands if None not in (p, lo, hi) and lo <= p < hi)


@pytest.mark.parametrize("few", [0, 1000])
def test_range_join_is_the_inequality(spark, few):
    draw = random.Random(2)
    values = [draw.uniform(-50, 50) for _ in range(200)] + [draw.choice([0.0, -0.0, 1.0, 1e-300, 1e300, -1e300, 2.0**60, 5e-324, INF, -INF, NAN]) for _ in range(60)] + [None]
    points = list(enumerate(values))
    bands = [(j, x, x + draw.choice([0, 1e-9, 0.5, 1, 2, 3.7, 40, 1000])) for j, x in enumerate(draw.uniform(-60, 60) for _ in range(150))]
    bands += [(150 + j, *b) for j, b in enumerate([(-INF, 0.0), (0.0, INF), (-INF, INF), (5.0, 5.0), (5.0, 4.0), (None, 3.0), (3.0, None), (NAN, 1.0), (1.0, NAN), (0.0, 5e-324), (2.0**60, 2.0**60 + 4096), (-1e300, 1e300), (0.0, 1e-300), (INF, INF)])]
    got = range_join(spark.createDataFrame(points, "i long, p double"), spark.createDataFrame(bands, "j long, lo double, hi double"), "p", "lo", "hi", few)
    assert got.columns == ["i", "p", "j", "lo", "hi"]
    assert sorted((r["i"], r["j"]) for r in got.collect()) == brute(points, bands)


def test_range_join_of_large_whole_numbers_and_repeats(spark):
    base = 2**60
    points, bands = [(i % 40, base + i % 40) for i in range(80)], [(j, base + j, base + j + j % 4) for j in range(40)] * 2
    got = range_join(spark.createDataFrame(points, "i long, p long"), spark.createDataFrame(bands, "j long, lo long, hi long"), "p", "lo", "hi", 0)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == brute(points, bands)
    assert range_join(spark.createDataFrame([], "i long, p long"), spark.createDataFrame(bands, "j long, lo long, hi long"), "p", "lo", "hi").collect() == []


def test_range_join_neither_broadcasts_nor_loops(spark):
    bands = spark.range(5000).select("id", (F.col("id") * 2.0).alias("lo"), (F.col("id") * 2.0 + 3).alias("hi"))
    got = range_join(spark.range(20_000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("p")), bands, "p", "lo", "hi")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Broadcast" not in plan
    assert got.count() == sum(2 * j <= p < 2 * j + 3 for p in range(10_004) for j in range(max(0, p // 2 - 2), min(5000, p // 2 + 1)))


def test_range_counts_are_those_of_the_join(spark):
    draw = random.Random(3)
    values = [draw.randrange(-300, 300) for _ in range(300)] + [draw.randrange(-(2**62), 2**62) for _ in range(60)] + [-(2**63), 2**63 - 1, 0, -1, 65535, 65536, 2**48, -(2**48), None]
    points = list(enumerate(values + values[:50]))
    bands = [(j, x, x + draw.choice([0, 1, 7, 90, 70_000, 2**33, 2**50])) for j, x in enumerate([draw.randrange(-350, 350) for _ in range(200)] + [draw.randrange(-(2**62), 2**61) for _ in range(60)])]
    bands += [(300 + j, *b) for j, b in enumerate([(5, 4), (None, 3), (3, None), (-(2**63), 2**63 - 1), (-1, 0), (65535, 65536)] * 2)]
    got = range_counts(spark.createDataFrame(points, "i long, p long"), spark.createDataFrame(bands, "j long, lo long, hi long"), "p", "lo", "hi", "n")
    assert got.columns == ["i", "p", "n"]
    want = dict.fromkeys(range(len(points)), 0)
    for i, _ in brute(points, bands):
        want[i] += 1
    assert {r["i"]: r["n"] for r in got.collect()} == want
    none = spark.createDataFrame([], "j long, lo long, hi long")
    assert [r["n"] for r in range_counts(spark.createDataFrame([(1, 5)], "i long, p long"), none, "p", "lo", "hi", "n").collect()] == [0]


def test_open_sessions_are_counted_without_pairs(spark, tmp_path):
    # 20,000 users of one session each, all open at 20,000 purchases: 400 million pairs
    rows = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_micros(1_700_000_000_000_000 + F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("purchase").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = plans.sessions_at_purchases(spark, str(tmp_path))
    assert "_level" not in got._jdf.queryExecution().optimizedPlan().toString()  # no join of points with intervals
    assert got.agg(F.count("*"), F.min(F.col("n_sessions") - F.col("event_id")), F.max(F.col("n_sessions") - F.col("event_id"))).first()[:] == (20_000, 1, 1)
