from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import frame
from millrace.llm import bbit
from tests_llm_help import shingles as shingles_of


def brute(rows, like=85):
    """doc_id -> (n_shingles, component_id) of (doc_id, text), by all pairs."""
    sets = [shingles_of((t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})), 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= like * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def found(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert all(kept == (d == c) for d, _, c, kept in rows)
    return sorted((r[:3] for r in rows), key=repr)


def families(draw, groups, copies, edits, size=(40, 300)):
    rows = []
    for _ in range(groups):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(*size))]
        rows.append(" ".join(words))
        for _ in range(copies):
            other = list(words)
            for at in draw.sample(range(len(words)), max(1, round(len(words) * draw.choice(edits)))):
                other[at] = f"v{draw.randrange(10**6)}"
            rows.append(" ".join(other))
    return rows


@pytest.mark.parametrize("few", [bbit.FEW, 2])
def test_links_about_the_threshold_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(bbit, "FEW", few)  # few = 2: all mixed buckets are dealt out anew, and what is left is compared in blocks
    monkeypatch.setattr(bbit, "BLOCK", 8)
    draw = random.Random(7)
    # 0.85 is crossed at some 1.6 % of words; texts of copies that lie about it chain up in part
    texts = families(draw, 12, 12, [0.01, 0.015, 0.02, 0.025]) + ["a b c", "A  b\tc", "a b c d e", None, "", "  \n"]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert found(bbit.near_duplicates(frame(spark, [(*r, "en", "a") for r in rows]))) == sorted(want, key=repr)
    assert 20 < len({c for _, _, c in want}) < len(rows) - 20


def test_pages_of_one_frame_are_no_candidates_of_each_other(spark, monkeypatch):
    draw = random.Random(3)
    shared = [f"f{i}" for i in range(150)]

    def page(i):
        words = list(shared)
        for block in range(3):  # three passages of its own, 50 words in all, between 150 words of the frame
            words[50 * block + 20 : 50 * block + 20] = [f"p{draw.randrange(10**7)}" for _ in range(17)]
        return " ".join(words)

    def candidates(n):
        docs = spark.createDataFrame([(i, page(i)) for i in range(n)], "doc_id long, text string")
        seen = spark.sparkContext.accumulator(0)
        plain = bbit.overlap

        def counted(x, y, like):
            seen.add(1)
            return plain(x, y, like)

        monkeypatch.setattr(bbit, "overlap", counted)
        try:
            assert bbit.near_duplicates(docs, 0.8).filter("not kept").count() == 0
        finally:
            monkeypatch.setattr(bbit, "overlap", plain)
        return seen.value

    small, large = candidates(500), candidates(2000)
    assert large < 100_000 and large < 8 * max(small, 500), (small, large)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert found(bbit.near_duplicates(odd)) == sorted(brute(rows), key=repr)
    assert bbit.near_duplicates(none).collect() == []


def test_large_group_of_copies_is_one_point(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one text that has seven words here").otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(9)])).alias("text"))
    got = bbit.near_duplicates(docs).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in got} == {True: 6667 + 1, False: 13333 - 1}


def test_estimate_is_corrected_for_chance():
    draw = np.random.default_rng(1)
    for like in (0.0, 0.5, 0.85):
        found = []
        for _ in range(60):
            n, both = 300, int(2 * 300 * like / (1 + like))
            all_ = draw.integers(0, 1 << 63, 2 * n - both, np.uint64) * np.uint64(2)
            x, y = (np.array(bbit.signature(np.unique(s))).view(np.uint64) for s in (all_[:n], all_[n - both :]))
            d = x ^ y
            same = bbit.MINIMA - int(np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(bbit.LOW)).sum())
            found.append((same / bbit.MINIMA - 0.25) / 0.75)
        assert abs(np.mean(found) - like) < 0.02
