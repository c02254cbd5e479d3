"""Operator 11: ranked lexical search, reversed: documents stream through a broadcast inverted index of the items."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, documents, slices

TOP = 10
#: Postings (item, term) of one broadcast index. More items are taken in several blocks; an item with more terms than that by a join.
POSTINGS = 500_000
#: Scores that a task holds at once, and bytes of a text that are split at once, up to the next separator.
SCORES, STEP = 2 << 20, 1 << 20
#: Groups in which tasks' heaps meet before they meet by item alone.
MEETINGS = 64
#: ASCII letters (lower-cased) and digits stay, and all bytes of other characters; the rest of ASCII separates terms.
FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def term_counts(text: bytes | None) -> Counter:
    """Terms of a whole text, as UTF-8, with repeats; null has none."""
    raw, out, at = (text or b"").translate(FOLD), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + STEP)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


class Index:
    """Postings of a block of items by term, and each term's weight. ``items`` are the ids of the block."""

    def __init__(self, found: pa.Table):
        found = found.sort_by([("term", "ascending")]).combine_chunks()
        ids, terms = found.column("item_id").combine_chunks(), found.column("term").to_pylist()
        self.items = pc.unique(ids).to_pylist()
        number = {x: i for i, x in enumerate(self.items)}
        self.item = np.array([number[x] for x in ids.to_pylist()], np.int64)
        self.times = found.column("times").to_numpy().astype(np.int64)
        first = [i for i, t in enumerate(terms) if not i or t != terms[i - 1]]
        self.starts = np.array([*first, len(terms)], np.int64)
        self.of = {terms[i]: n for n, i in enumerate(first)}
        self.weight = np.zeros(len(first), np.int64)

    def weigh(self, n: int, held: dict[int, int]) -> None:
        """``n``: documents with a term; ``held``: those that hold each term, by its number."""
        for at, df in held.items():
            self.weight[at] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))

    def scores(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """documents x items: sums over the (document, term) pairs given; ``m`` is each document's."""
        worth = self.weight[term] * (10**9 * tf // (1000 * tf + 8 * m[row]))
        many = self.starts[term + 1] - self.starts[term]
        own = np.repeat(np.arange(len(term)), many)
        at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + self.starts[term][own]
        out = np.zeros(len(m) * len(self.items), np.int64)
        np.add.at(out, row[own] * len(self.items) + self.item[at], worth[own] * self.times[at])
        return out.reshape(len(m), len(self.items))


def postings(items: DataFrame) -> DataFrame:
    """(item_id, term, times) over all rows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                for item, text in zip(part.column(0), part.column(1).to_pylist()):
                    found = term_counts(text)
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_id long, term binary, times long")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def statistics(texts: DataFrame, held: object) -> dict[int, int]:
    """Documents that hold each of the broadcast terms, by the term's number; -1: documents with a term, -2: all terms with repeats. One row a term and task is summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = held.value.of, Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    if found := term_counts(text):
                        total[-1] += 1
                        total[-2] += found.total()
                        total.update(map(of.__getitem__, of.keys() & found.keys()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    found = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.collect()}


def length_norm(n: int, documents_: int, terms: int) -> int:
    """m of a document of ``n`` terms, among so many documents and terms in all."""
    return 100 - 75 + 75 * n * documents_ // terms


def heaps(texts: DataFrame, shared: object, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): from each task, its ``k`` best documents for each item of the broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        best: list[list[tuple]] = [[] for _ in index.items]
        least = np.ones(len(index.items), np.int64)  # a score that a heap still takes; only scores above 0 count
        rows = max(1, min(256, SCORES // len(index.items)))
        for batch in batches:
            for part in slices(batch, 1, rows):
                docs, row, term, tf, m = part.column(0).to_pylist(), [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    found = term_counts(text)
                    m.append(length_norm(found.total(), n_docs, n_terms))
                    for t in index.of.keys() & found.keys():
                        row.append(i), term.append(index.of[t]), tf.append(found[t])
                scores = index.scores(*(np.array(x, np.int64) for x in (row, term, tf, m)))
                for i, j in zip(*(x.tolist() for x in np.nonzero(scores >= least))):
                    doc, heap = docs[i], best[j]
                    entry = (int(scores[i, j]), doc is not None, -(doc or 0))  # among equal scores the smaller doc_id is better, null is last
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[j] = heap[0][0]
        out = [(item, -e[2] if e[1] else None, e[0]) for item, heap in zip(index.items, best) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

    return texts.mapInArrow(run, "item_id long, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): heaps meet in MEETINGS groups an item first, so that no task reads all of them."""

    def rank(*keys: str) -> Column:
        return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))

    dealt = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MEETINGS)))
    first = dealt.withColumn("rank", rank("item_id", "_part")).filter(F.col("rank") <= k)
    return first.withColumn("rank", rank("item_id")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def by_join(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) for ``asked`` postings of items too large to broadcast: terms meet by a shuffled join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in slices(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found, key = term_counts(text), next(row)
                    n = found.total()
                    longs = [pa.array([x] * len(found), pa.int64()) for x in (key, doc, n)]
                    yield pa.RecordBatch.from_arrays([*longs, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["row", "doc_id", "n", "term", "tf"])

    rows = cut(texts.mapInArrow(run, "row long, doc_id long, n long, term binary, tf long"))
    n_docs, n_terms = rows.agg(F.count_distinct("row"), F.coalesce(F.sum("tf"), F.lit(0))).first()
    if not n_terms:
        return rows.select(F.lit(None).cast("long").alias("item_id"), "doc_id", F.col("n").alias("score")).limit(0)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.count("*") + 1)))
    held = cut(rows.groupBy("term").agg(weight.alias("weight")).select(F.col("term").alias("_held"), "weight"))
    asked = cut(asked.join(held.hint("merge"), F.col("term") == F.col("_held")).select("item_id", F.col("term").alias("_asked"), (F.col("times") * F.col("weight")).alias("worth")))
    met = rows.join(asked.hint("merge"), F.col("term") == F.col("_asked"))
    part = F.expr(f"worth * ((1000000000 * tf) div (1000 * tf + 8 * (25 + (75 * n * {n_docs}L) div {n_terms}L)))")
    return met.groupBy("item_id", "row", "doc_id").agg(F.sum(part).alias("score")).filter("score > 0").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, limit: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each item of ``items`` (item_id, text).

    The items are dealt into blocks of at most ``limit`` postings; each block's index is broadcast, and all whole texts stream through it: once
    for the document frequencies of its terms, once to be scored, into one heap of ``k`` entries an item and task. The heaps are
    then merged. Items of more than ``limit`` terms meet the documents' terms by a join. Scores are whole numbers.

    Null texts and those without a term, of documents or items, match nothing and do not count. Rows of one item_id, the null one too, are one item;
    each row of ``docs`` ranks on its own, repeated or not. Equal scores go by ascending doc_id, null last. A text
    of any length is split piece by piece. Empty tables give no rows; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asked = cut(postings(items))
    sizes = cut(asked.groupBy("item_id").agg(F.count("*").alias("n")))
    fits = sizes.filter(F.col("n") <= limit)
    total = fits.agg(F.sum("n")).first()[0] or 0
    blocks = 1 if total <= limit else math.ceil(2 * total / limit)

    def block() -> Column:
        return F.pmod(F.xxhash64("item_id"), F.lit(blocks))

    while (fits.groupBy(block().alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > limit:
        blocks *= 2
    found = []
    sc = docs.sparkSession.sparkContext
    wide = sizes.filter(F.col("n") > limit).select(F.col("item_id").alias("_item"))
    small = cut(asked.join(wide.hint("merge"), F.col("item_id").eqNullSafe(F.col("_item")), "left_anti")) if not wide.isEmpty() else asked
    for b in range(blocks if total else 0):
        index = Index(small.filter(block() == b).toArrow())
        if not index.items:
            continue
        held = sc.broadcast(index)
        stats = statistics(texts, held)
        held.unpersist()
        n_docs, n_terms = stats.pop(-1, 0), stats.pop(-2, 0)
        if n_docs:
            index.weigh(n_docs, stats)
            shared = sc.broadcast(index)
            found.append(cut(best_of(heaps(texts, shared, n_docs, n_terms, k), k)))
            shared.unpersist()
    if not wide.isEmpty():
        found.append(best_of(by_join(texts, asked.join(wide.hint("merge"), F.col("item_id").eqNullSafe(F.col("_item")), "left_semi")), k))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 10 best documents by weighted, length-normed term counts."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB SQL for ``op11_search``, where no item_id or doc_id is null or repeated.
OP11_SQL = r"""
WITH said AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
alls AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, alls GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN docs USING (doc_id), alls GROUP BY ALL HAVING score > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
