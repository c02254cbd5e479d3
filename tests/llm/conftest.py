from __future__ import annotations

import pytest

from tests_llm_help import CLASH

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000

def frame(spark, rows, clash=True):
    """documents of (doc_id, text, lang, source) rows, with further columns."""
    made = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH if clash else ():
        made = made.selectExpr("*", f"'x' AS `{c}`")
    return made


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank and very long texts, ties and repeated rows."""
    rows = [
        (1, "the cat sat on the mat and then it went home", "en", "a"),
        (1, "the cat sat on the mat and then it went home", "en", "a"),
        (2, "the cat sat on the mat and then it went home", "en", None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \n\t \n", "de", "b"),
        (None, "a text without any number of its own to call it by", "en", "b"),
        (None, None, None, None),
        (6, LONG, "la", "c"),
        (7, LONG + "end", "la", "c"),
        (8, "123 456 !!! \x00 ...", "en", "c"),
        (9, "é" * 300 + " ß \U0001f600 word", "fr", "é"),
        (10, "x" * 100_000, "en", "c"),
    ]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}
