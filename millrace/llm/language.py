"""Operator 4: language by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from millrace.llm.common import col, documents, numbered, slices, unused
from millrace.llm.features import TEXTS, damped, draw, fitting_pass, gram_counts, inverse_frequency, remainder

DIMS, SIZES = 4096, (1, 2, 3)
#: Labelled texts that centroids are fitted on: so many of each language, and so many in all, at most.
PER_LANGUAGE, SAMPLE = 800, 8000
CENTROIDS, ROUNDS, SEED = 4, 12, 5
#: A text is rejected below this part of the first percentile of its language's similarities.
REJECTED = 0.4
UNKNOWN = "und"


#: ASCII characters other than letters become spaces.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def counts(texts: list[str]) -> np.ndarray:
    """N-grams of each text's letters in lower case, one space between words and around all."""
    words = [t.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split() for t in texts]
    return gram_counts([b" ".join([b"", *w, b""]) for w in words], SIZES, DIMS)


@dataclass
class Model:
    """Unit centroids, the language of each, and the least similarity that is accepted for each."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floors: np.ndarray


def clusters(x: np.ndarray, most: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means, seeded by the rows farthest from those taken before."""
    seeds, mean = [], x.mean(0)
    best = x @ (mean / max(np.linalg.norm(mean), 1e-12))
    seeds.append(int(best.argmax()))
    near = x @ x[seeds[0]]
    while len(seeds) < min(most, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].sum(0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """A model from ``labelled`` (doc_id, text, lang not null); None if it is empty.

    Document frequencies cover all of its texts. Centroids are fitted on a sample whose bound
    is a parameter: of each language the rows with the smallest draws, which depend on doc_id alone.
    """
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", draw(F.col("doc_id")).alias("draw")).filter("doc_id is not null")
    # no more languages than texts in the sample
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    languages = sizes.count()
    if not languages:
        return None
    most = max(1, min(per_language, sample // languages))
    # of a large language only a small share is looked at, so what one task ranks does not grow with the table
    few = known.join(F.broadcast(sizes), "lang").filter(F.col("draw") * F.col("n") < 4 * most + 100)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    ranked = few.withColumn("nth", nth).filter(F.col("nth") <= most).select("doc_id", "lang").collect()
    chosen = dict(sorted(map(tuple, ranked), reverse=True))  # an id with several languages has the first of them
    texts, seen, ids, found = fitting_pass(labelled, chosen, counts, DIMS)
    idf = inverse_frequency(texts, seen)
    x = damped(found, idf)
    langs = np.array([chosen[i] for i in ids])
    parts, names, floors = [], [], []
    for lang in sorted(set(chosen.values())):
        own = x[(langs == lang) & (found.sum(1) > 0)]
        if len(own):
            c = clusters(own.copy(), CENTROIDS)
            parts.append(c)
            names += [lang] * len(c)
            floors += [REJECTED * float(np.quantile((own @ c.T).max(1), 0.01))] * len(c)
    return Model(idf, np.concatenate(parts), names, np.array(floors, np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred, score (cosine with the nearest centroid) and rejected to ``docs`` (doc_id, text, ...).

    A text that is null or has no letter is UNKNOWN, scores 0 and is rejected; so is every text if there is no
    model. A text whose nearest centroid is farther than its language accepts
    keeps its language and is rejected.
    """
    kept, at_text = docs.columns, docs.columns.index("text")
    plain = numbered(docs)
    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    names = [*plain.columns, *(f.name for f in more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_text, TEXTS):
                sims = damped(counts([t or "" for t in part.column(at_text).to_pylist()]), model.idf) @ model.centroids.T
                best = sims.argmax(1)
                score = np.clip(sims[np.arange(len(best)), best], 0, 1)
                found = [pa.array([model.languages[b] for b in best], pa.string()), pa.array(score.astype(np.float64)), pa.array(score < model.floors[best])]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names)

    if model is None:
        return docs.withColumn("lang_pred", F.lit(None).cast("string")).withColumn("score", F.lit(0.0)).withColumn("rejected", F.lit(True))
    return plain.mapInArrow(run, StructType([*plain.schema.fields, *more])).toDF(*kept, *(f.name for f in more))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; letters are looked for in the JVM, before any text goes to Python.

    Whole texts count, however long, a slice at a time. A text equally near two centroids has the language that comes first. Other columns
    come along under any name, but ``lang_pred``, ``score`` and ``rejected`` are replaced.
    Repeated rows are kept; an empty table gives no rows.
    """
    plain = docs.drop("lang_pred", "score", "rejected")
    blank = unused("_none", plain)
    none = F.coalesce(~F.col("text").rlike(r"\p{L}"), F.lit(True))
    marked = predict(plain.withColumn(blank, none), model)
    none = F.col(blank) | F.col("lang_pred").isNull()
    return marked.select(
        *map(col, plain.columns),
        F.when(none, UNKNOWN).otherwise(F.col("lang_pred")).alias("lang_pred"),
        F.when(none, 0.0).otherwise(F.col("score")).alias("score"),
        (none | F.col("rejected")).alias("rejected"),
    )


def fit_on(docs: DataFrame) -> Model | None:
    """The model of the documents that are not held out and have a language."""
    return fit(docs.filter((remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull()))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole document, learnt from those that are not held out."""
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit_on(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
