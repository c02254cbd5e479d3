from __future__ import annotations

from collections import Counter

import corpus_pipeline
from millrace.llm import language, mixing
from test_duplicates import templates_of
from test_packing import check
from tests_llm_help import CLASH
from tests_llm_help import shingles as shingles_of


def first_of_groups(texts):
    """Smallest ids of groups linked by Jaccard likeness of five-word shingles of 0.8 or more, by holding all texts against all."""
    sets, root = {i: shingles_of(t.lower(), 5) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and 10 * len(x & y) >= 8 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in texts}


def test_stages_do_what_their_operators_say(spark, small):
    docs = small.unionByName(spark.createDataFrame([(5000, None, "en", "src0", None), (5001, "1 2 3", "en", "src0", 5), (5002, "", None, None, 0)], small.schema))
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    said = {r["doc_id"]: r for r in language.identify(docs, language.fit_on(docs)).collect()}
    got = {r["doc_id"]: r for r in kept.collect()}
    assert set(got) == {i for i, r in said.items() if not r["rejected"]} and not {5000, 5001, 5002} & set(got)
    assert len(got) > 0.98 * small.count() and all(got[i]["lang"] == said[i]["lang_pred"] for i in got)

    rows = {(r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, kept, "").collect()}
    want = dict(templates_of([(i, r["text"]) for i, r in got.items()]))
    assert rows == {(i, t) for i, t in want.items() if t or t == got[i]["text"]}

    lined = corpus_pipeline.line_dedup(spark, kept, "")
    one = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, lined, "").collect()}
    assert one == first_of_groups({r["doc_id"]: r["text"] for r in lined.collect()})

    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, lined, "").collect())
    assert mixed == {r["doc_id"]: r["epochs"] for r in mixing.mix(lined).collect() if r["epochs"]}


def test_run_and_packing(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert check(rows, {}) > 0.9


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            rows = out.collect()
            assert len(rows) <= 2 * docs.count()
            assert all(r[c] == "x" for r in rows for c in CLASH)
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, "").collect()
    assert sum(r["start"] == 0 for r in pieces) == odd.count() and max(r["offset"] + r["length"] for r in pieces) <= 4096


def test_near_duplicates_keep_defined_rows(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a, "en"), (5, a, "en"), (5, b, "en"), (7, b, "en"), (None, a, "en"), (None, "x y z", "en"), (None, "x y z", "en"), (None, None, "en"), (9, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(5, a), (5, b), (None, "x y z"), (9, "")], key=repr)


def test_lines_without_n_chars(spark):
    docs = spark.createDataFrame([(i, f"same line here\nown {'abc'[i]}") for i in range(3)], "doc_id long, text string").selectExpr("*", "1 as `a.b`")
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} == {"same line here\nown a", "own b", "own c"}
