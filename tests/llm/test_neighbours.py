from __future__ import annotations

import numpy as np
import pytest

from millrace.llm import neighbours


def brute(ids, x, asked, k=20):
    scores = x @ x.T
    out = {}
    for i in np.flatnonzero(np.isin(ids, asked)):
        s = scores[i].copy()
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[ids[i]] = [ids[j] for j in order if s[j] > -np.inf]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_recall_on_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted(table.select("vec_id", "embedding").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = found(neighbours.op1_neighbours(spark, sf).collect())
    want = brute(ids, x, ids[ids % 20 == 0])
    assert got.keys() == want.keys()
    at = {v: i for i, v in enumerate(ids)}
    for q, rs in got.items():
        assert [r["rank"] for r in rs] == list(range(1, 21))
        assert all(abs(r["score"] - x[at[q]] @ x[at[r["vec_id"]]]) < 1e-12 for r in rs)
    recall = np.mean([len({r["vec_id"] for r in rs} & set(want[q])) / 20 for q, rs in got.items()])
    assert recall >= 0.9


def test_norms_ties_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    draw = np.random.default_rng(0)
    x = draw.normal(size=(150, 8)) * draw.uniform(0.1, 5, size=(150, 1))
    x[40:100] = x[40]  # a third and more alike: ties, and one bucket in many blocks
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (220, []), (240, [0.0] * 8), (260, [nan] + [1.0] * 7), (280, [inf] + [1.0] * 7), (300, [None] + [1.0] * 7), (None, [1.0] * 8), (320, [1.0, 2.0]), (340, [2.0, 1.0]), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS bucket", "3 AS v")
    got = found(neighbours.nearest(table, table.filter("vec_id % 20 = 0"), probes=400, slot=6.0).collect())
    want = brute(np.arange(150), x, np.arange(0, 150, 20))
    for q, ids in want.items():
        assert [r["vec_id"] for r in got[q]] == ids
    assert set(got) == set(want) | {320, 340}
    assert [r["vec_id"] for r in got[320]] == [340] and got[320][0]["score"] == pytest.approx(4.0)


def test_queries_whose_buckets_hold_too_few_meet_all(spark):
    draw = np.random.default_rng(3)
    few = draw.normal(size=(15, 16))
    many = draw.normal(size=(60, 16)) * draw.lognormal(0, 2, size=(60, 1))
    for x in (few, many):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = found(neighbours.nearest(table, table.filter("vec_id % 20 = 0"), tables=1, probes=1, slot=0.3).collect())
        want = brute(np.arange(len(x)), x, np.arange(0, len(x), 20))
        assert {q: [r["vec_id"] for r in rs] for q, rs in got.items()} == want


@pytest.mark.parametrize("longest", [1.0, 20.0, 1000.0])
def test_recall_beside_a_very_long_vector(spark, longest):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(2000, 32)).astype(np.float32)
    x[7] *= longest
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = found(neighbours.nearest(table, table.filter("vec_id % 20 = 0")).collect())
    want = brute(np.arange(2000), x.astype(float), np.arange(0, 2000, 20))
    assert got.keys() == want.keys()
    assert np.mean([len({r["vec_id"] for r in rs} & set(want[q])) / 20 for q, rs in got.items()]) >= 0.95


def test_of_rows_with_one_id_the_least_vector_counts(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, table.filter("vec_id = 0")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 2.0), (2, 2, 1.0)]


def test_norms_that_hardly_can_be_squared(spark):
    rows = [(0, [1e-300, 1e-300]), (1, [1e200, 0.0]), (2, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(table, table).collect())
    assert {q: [r["vec_id"] for r in rs] for q, rs in got.items()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, none).count() == 0


def test_perturbations_come_in_order_and_never_contradict():
    sets = neighbours.perturbations(6, 50)
    assert sets[0] == () and len(set(sets)) == 50
    assert all(11 - r not in s for s in sets for r in s)
