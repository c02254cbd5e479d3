from __future__ import annotations

import zlib

import numpy as np

from millrace.llm import features, language, quality


def test_language_on_held_out_documents(spark, sf):
    rows = {r["doc_id"]: r for r in language.op4_language(spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert rows.keys() == truth.keys()
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert np.mean([r["rejected"] for r in rows.values()]) < 0.02


def test_language_of_odd_rows(spark, sf, odd, none):
    model = language.fit_on(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = language.identify(odd, model).collect()
    assert len(rows) == 13
    for r in rows:
        blank = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == blank and (r["score"] == 0 if blank else 0 <= r["score"] <= 1)
        assert r["rejected"] or not blank
    assert language.identify(none, model).count() == 0
    assert language.fit_on(none) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


def test_far_texts_are_rejected(spark, sf):
    model = language.fit_on(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = spark.createDataFrame([(1, "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会" * 30)], "doc_id long, text string")
    assert language.identify(docs, model).first()["rejected"]


def test_quality_on_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = {r["doc_id"]: r for r in quality.op7_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (7, 1), (99, 1), (None, 1), (8, None)], "doc_id long, label int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(none, model).count() == 0
    assert quality.fit(odd, labels.limit(0)) is None and quality.fit(none, labels) is None
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}


def test_gram_counts_of_sliced_texts(monkeypatch):
    texts = [b"", b"a", b"ab", b"abcabcabd" * 7, b"xyz" * 40]
    want = features.gram_counts(texts, (1, 2, 3), 256)
    assert want.sum(1).tolist() == [max(0, len(t)) + max(0, len(t) - 1) + max(0, len(t) - 2) for t in texts]
    monkeypatch.setattr(features, "STEP", 10)
    assert (features.gram_counts(texts, (1, 2, 3), 256) == want).all()


def test_votes_match_plain_cosines_whatever_the_block(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").withColumnRenamed("quality", "label")
    model = quality.fit(docs.unionAll(docs.limit(5)), labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {i: quality.counts([t]) for i, t in texts.items()}
    want = {}
    for i, row in found.items():
        v = quality.weighed(row, model.idf)[0] @ model.axes
        sims = [round(float(v @ u / np.linalg.norm(v)), 9) for u in model.vectors]
        near = sorted(range(len(sims)), key=lambda j: (-sims[j], j))[: quality.NEIGHBOURS]
        weight = [max(sims[j], 1e-6) ** quality.POWER for j in near]
        want[i] = sum(w * model.labels[j] for w, j in zip(weight, near)) / sum(weight)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-9 for i in want)
    blocks = np.concatenate([model.votes(np.concatenate(list(found.values())[a : a + 7]), 9, 8) for a in range(0, len(found), 7)])
    assert dict(zip(found, blocks)) == got


def test_languages_match_plain_centroids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit_on(docs)
    rows = language.identify(docs, model).collect()
    for r in rows:
        text = " " + " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in r["text"].lower()).split()) + " "
        raw, vector = text.encode(), np.zeros(language.DIMS)
        for n in language.SIZES:
            for at in range(len(raw) - n + 1):
                h = 0
                for b in raw[at : at + n]:
                    h = (h * 0x01000193 + b + 1) % 2**32
                vector[(h * 0x9E3779B1 % 2**32) >> 20] += 1
        vector = np.log1p(vector) * model.idf
        sims = model.centroids @ vector / np.linalg.norm(vector)
        assert abs(sims.max() - r["score"]) < 1e-5 and sims[model.languages.index(r["lang_pred"]) :].max() > r["score"] - 1e-5
        assert max(s for s, lang in zip(sims, model.languages) if lang == r["lang_pred"]) > sims.max() - 1e-5


def test_repeated_ids_are_fitted_on_once(spark):
    rows = [(1, "alpha beta gamma", "en")] * 50 + [(1, "delta epsilon", "en"), (1, "delta epsilon", "de"), (2, "zeta eta theta", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, _, ids, matrix = features.fitting_pass(docs, {1: 0, 2: 0}, language.counts, language.DIMS)
    assert texts == 53 and ids == [1, 2] and len(matrix) == 2
    assert language.fit(docs).languages == ["de", "fr"]
