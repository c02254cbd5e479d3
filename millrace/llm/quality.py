"""Operator 7: quality by the votes of the nearest labelled texts in a latent-semantic space."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, slices
from millrace.llm.features import TEXTS, damped, draw, fitting_pass, gram_counts, inverse_frequency, remainder

#: Hashed n-grams of kinds of bytes, hashed words, and measures: the three parts of a row of counts, in this order.
GRAMS, SIZES = 2048, (1, 2, 3)
TERMS = 2048
MEASURES = 6
DIMS = GRAMS + TERMS + MEASURES
#: Labelled texts that vote, at most; latent dimensions; neighbours that vote; power of similarity in a vote.
SAMPLE, RANK, NEIGHBOURS, POWER = 4000, 48, 9, 8
SEED = 3
#: Decimals of a similarity and of a score; sums of doubles differ far below, so ties and reruns do not hang on how texts are dealt out.
DIGITS = 9

#: Kinds of bytes: capitals A, other letters a, digits 0; marks and white space stay.
KINDS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def counts(texts: list[str]) -> np.ndarray:
    """N-grams of the kinds of bytes, words in lower case, and shares of repeated words, lines and kinds, in 0..1."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    kinds = [b" " + r.translate(KINDS) + b" " for r in raw]
    terms, more = np.zeros((len(raw), TERMS), np.float32), np.zeros((len(raw), MEASURES), np.float32)
    for term, row, t, r, k in zip(terms, more, texts, raw, kinds):
        held = Counter(t.lower().encode("utf-8", "surrogatepass").split())
        if held:
            np.add.at(term, [zlib.crc32(w) % TERMS for w in held], list(held.values()))
        words, lines = r.split(), r.split(b"\n")
        row[:] = (
            share(sum(map(bytes.__eq__, words, words[1:])), len(words)),
            1 - share(len(set(lines)), len(lines)),
            1 - share(len(set(words)), len(words)),
            share(k.count(b"A"), len(k)),
            share(k.count(b"0"), len(k)),
            share(len(k) - k.count(b"A") - k.count(b"a") - k.count(b"0") - len(words), len(k)),
        )
    return np.c_[gram_counts(kinds, SIZES, GRAMS), terms, more]


def weighed(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of n-grams and of words, each of unit length, and the roots of the measures beside them."""
    ends = (GRAMS, GRAMS + TERMS)
    grams, terms, measures = np.split(found, ends, axis=1)
    return np.c_[damped(grams, idf[: ends[0]]), damped(terms, idf[ends[0] : ends[1]]), np.sqrt(measures)].astype(np.float64)


@dataclass
class Model:
    """Labelled unit vectors in the latent space, their labels, and the way into the space."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, found: np.ndarray) -> np.ndarray:
        y = weighed(found, self.idf) @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def votes(self, found: np.ndarray, neighbours: int, power: float) -> np.ndarray:
        """Label of each text as its nearest neighbours have it, weighted by similarity; of equally near ones the first, by id, vote."""
        sims = np.round(self.latent(found) @ self.vectors.T, DIGITS)
        k = min(neighbours, sims.shape[1])
        least = np.partition(sims, sims.shape[1] - k, axis=1)[:, [sims.shape[1] - k]]
        text, voter = np.nonzero(sims >= least)
        near = sims[text, voter]
        order = np.lexsort((voter, -near, text))
        text, voter, near = text[order], voter[order], near[order]
        first = np.arange(len(text)) - np.searchsorted(text, text) < k
        voter, near = voter[first].reshape(-1, k), near[first].reshape(-1, k)
        weight = np.maximum(near, 1e-6) ** power
        return np.round((weight * self.labels[voter]).sum(1) / weight.sum(1), DIGITS)


def axes_of(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration."""
    q = np.random.default_rng(SEED).normal(size=(x.shape[1], min(rank + 8, *x.shape)))
    for _ in range(5):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Model | None:
    """A model from ``labels`` (doc_id, label 0 or 1) on ``docs`` (doc_id, text); None without labels.

    Document frequencies cover all texts. Those that vote are a sample of the labelled rows, whose bound is a
    parameter: the smallest draws, which depend on doc_id alone. Several labels of one document are averaged.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label")).dropna()
    rows = rows.groupBy("doc_id").agg(F.avg("label").alias("label"))
    # only a small share of many labels is ranked, so what meets in one task does not grow with the table
    few = rows.withColumn("draw", draw(F.col("doc_id"))).filter(F.col("draw") * F.lit(rows.count()) < 4 * sample + 100)
    chosen = {r[0]: r[1] for r in few.orderBy("draw", "doc_id").limit(sample).collect()}
    if not chosen:
        return None
    texts, seen, ids, found = fitting_pass(docs, chosen, counts, DIMS)
    if not ids:
        return None
    model = Model(inverse_frequency(texts, seen), np.eye(1), np.zeros((1, 1)), np.array([chosen[i] for i in ids], np.float64))
    model.axes = axes_of(weighed(found, model.idf), rank)
    model.vectors = model.latent(found)
    return model


def score(docs: DataFrame, model: Model | None, neighbours: int = NEIGHBOURS, power: float = POWER) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text); whole texts, null as empty.

    Exact cosines with all labelled vectors, a block of texts at a time. Without a model every score is
    0.5. Repeated rows are kept, of equally near labelled texts those with the smaller doc_id vote, an
    empty table gives no rows, other columns are ignored.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, TEXTS):
                votes = model.votes(counts([t or "" for t in part.column(1).to_pylist()]), neighbours, power)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(votes, 0, 1).astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each whole document, as the labels that are not held out mark it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    found = score(docs, fit(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
