from __future__ import annotations

import os

import duckdb

from millrace.llm.mixing import OP3_SQL, mix, mixed_documents, op3_mixing


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(OP3_SQL)
    got = op3_mixing(spark, sf).select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
    assert os.path.exists(sf)


def test_targets_and_bounds(small):
    rows = mix(small).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) / 2 + 1
    assert sorted(map(tuple, mix(small.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_documents_are_repeated(small):
    plan = {r["doc_id"]: r["epochs"] for r in mix(small).collect()}
    got = {r["doc_id"]: r["count"] for r in mixed_documents(small).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}


def test_odd_rows(odd, none):
    rows = mix(odd).collect()
    assert len(rows) == 13 and all(0 <= r["epochs"] <= 2 for r in rows)
    assert all(r["target"] == 0 for r in rows if r["source_size"] == 0)
    out = mixed_documents(odd)
    assert out.columns == odd.columns and out.count() == sum(r["epochs"] for r in rows)
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0
