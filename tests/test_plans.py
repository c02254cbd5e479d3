"""Each relational query against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from millrace import plans
from millrace.operators import as_of_join
from millrace.streaming import run_to_table, windowed_counts
from millrace.sources import table


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 4) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_duckdb(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    got = plans.QUERIES[name](spark, sf)
    want = con.sql(plans.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
    assert sorted(got.columns) == sorted(want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.SQL) <= set(__spark_entry__.oracle_sql())


def test_stream_equals_batch(spark, sf, tmp_path):
    got = run_to_table(spark, sf, "hourly", str(tmp_path / "c")).collect()
    assert sorted(got) == sorted(windowed_counts(table(spark, sf, "events")).collect())


def test_as_of_join_carries_values_over_spans(spark):
    import datetime
    import random

    draw = random.Random(5)
    time = lambda: None if draw.random() < 0.05 else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=draw.randrange(1200))
    left = [(draw.choice([1, 1, 1, 2, None]), i, time()) for i in range(150)]
    right = [(draw.choice([1, 1, 2, 3, None]), time(), draw.choice([None, *range(50)])) for _ in range(60)]
    got = as_of_join(spark.createDataFrame(left, "k int, id int, t timestamp_ntz"), spark.createDataFrame(right, "k int, u timestamp_ntz, v int"), ["k"], "t", "u", "v", "v")
    for k, i, t, v in got.collect():
        before = [(u, x) for key, u, x in right if key == k and None not in (t, u, x) and u <= t]
        assert v == (max(before)[1] if before else None), (k, i, t)
    assert got.count() == 150
