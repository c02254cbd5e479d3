from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from conftest import frame
from millrace.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) of lists of (id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = set()
    for i, query in asked.items():
        scored = []
        for d, c in counts:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in query if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out |= {(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])}
    return out


def tuples(df):
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the cat went HOME home"), (2, None), (3, "..."), (4, "lorem ipsum ß é word 123"), (5, "nowhere tobefound"), (6, "the"), (6, "mat x"), (None, "a text of its own"), (7, "cat\x00cat")]
    return spark.createDataFrame([(*r, 0) for r in rows], "item_id long, text string, score int")


@pytest.mark.parametrize("limit", [search.POSTINGS, 6, 4, 1])
def test_odd_rows_match_brute_force_for_any_block(spark, odd, items, limit):
    docs = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = brute(docs, [(r[0], r[1]) for r in items.collect()], 3)
    # repeated rows tie in all: their entries differ in rank alone
    assert tuples(search.search(odd, items, 3, limit)) == want


def test_whole_table_matches_brute_force(spark, small, texts, sf, monkeypatch):
    monkeypatch.setattr(search, "STEP", 300)  # long texts are taken piece by piece
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(list(texts.items()), [(r["item_id"], r["text"]) for r in items.collect()], 10)
    got = tuples(search.op11_search(spark, sf))
    assert got == want and len(got) > 100


def test_ties_over_many_tasks_go_by_doc_id(spark):
    docs = frame(spark, [(i, f"same words here {'extra' if i == 77 else 'plain'}", "en", "a") for i in range(300)]).repartition(13)
    items = spark.createDataFrame([(1, "words here plain"), (2, "extra plain")], "item_id long, text string")
    got = tuples(search.search(docs, items, 5))
    assert [d for _, _, d, _ in sorted(g for g in got if g[0] == 2)][0] == 77
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(1, "words here plain"), (2, "extra plain")], 5)


def test_empty_tables(spark, odd, none, items):
    assert search.search(none, items).collect() == []
    assert search.search(odd, items.limit(0)).collect() == []
    assert search.search(none, items, limit=1).collect() == []
    assert search.search(odd.filter("text is null"), items).collect() == []
