"""Moving sums, mergeable sketches and VARIANT properties against plain Python."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import json_number
from millrace.operators import distinct_estimate, merged_sketches, moving_sums, quantile, sketched

START = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("span", [1, 2, 50])
def test_moving_sums_match_plain_python(spark, span):
    draw = random.Random(span)
    rows = [(i, draw.choice([1, 1, 2, None]), None if draw.random() < 0.05 else START + datetime.timedelta(minutes=draw.randrange(3000)), draw.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, t timestamp_ntz, `a.b` int")
    got = {r["id"]: (r["total"], r["n"]) for r in moving_sums(df, ["k"], "t", 3600, {"total": F.col("`a.b`").cast("long"), "n": F.lit(1).cast("long")}, span).collect()}
    assert len(got) == 300
    for i, k, t, _ in rows:
        seen = [v for _, o, u, v in rows if o == k and None not in (t, u) and datetime.timedelta(0) <= t - u <= datetime.timedelta(hours=1)]
        known = [v for v in seen if v is not None]
        assert got[i] == ((sum(known) if known else None), len(seen) or None), i
    assert moving_sums(df.limit(0), ["k"], "t", 60, {"n": F.lit(1)}).collect() == []


def test_sketches_of_days_merge_to_that_of_all(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 9000).alias("user"), ((F.col("id") * 7919) % 60_000).cast("double").alias("v"))
    days = sketched(rows, ["day"], F.col("user"), F.col("v"))
    assert days.count() == 7 and days.agg(F.max(F.octet_length("amount_sketch"))).first()[0] < 20_000
    got = merged_sketches(days, []).select("n", distinct_estimate().alias("users"), quantile(0.1).alias("low"), quantile(0.9).alias("high")).first()
    assert got["n"] == 60_000 and abs(got["users"] - 9000) < 4 * 1.04 / 64 * 9000
    assert abs(got["low"] - 6000) < 1800 and abs(got["high"] - 54_000) < 1800


def test_sketches_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, 5, math.nan), (1, 5, 2.0), (2, 6, 3.0)], "day int, user int, v double")
    days = sketched(df, ["day"], F.col("user"), F.col("v"))
    got = merged_sketches(days, []).select("n", distinct_estimate().alias("users"), quantile(0.0).alias("low"), quantile(1.0).alias("high")).first()
    assert tuple(got) == (4, 2, 2.0, 3.0)
    assert sketched(df.limit(0), ["day"], F.col("user"), F.col("v")).collect() == []


def test_numbers_in_dirty_json(spark):
    texts = ['{"k": 69}', '{"k": "70"}', '{"k": null}', '{"k": [1]}', '{"k": 1e3}', '{"k": 99999999999999999999}', "{}", "[3]", "7", "", "{broken", None, '{"k": true}', '{"K": 5}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(json_number(F.col("t"), "$.k")).collect()]
    assert got == [69, 70, None, None, 1000, None, None, None, None, None, None, None, 1, None]
