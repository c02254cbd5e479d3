"""Hashed n-gram counts of whole texts, and the pass over a corpus that classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, slices

#: Bytes whose n-grams are counted at once, and texts in one block of vectors.
STEP, TEXTS = 1 << 20, 256

Counts = Callable[[list[str]], np.ndarray]


def gram_counts(texts: list[bytes], sizes: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of the hashed byte n-grams of each text, len(texts) x dims. ``dims`` is a power of two.

    Texts are taken in slices of bounded size, which overlap by the longest n-gram less
    one byte, so every n-gram of a text counts once, however long the text.
    """
    out, most = np.zeros((len(texts), dims), np.float32), max(sizes)
    shift = np.uint32(32 - dims.bit_length() + 1)
    held, rows, total = [], [], 0

    def add() -> None:
        nonlocal held, rows, total
        if held:
            buf = np.frombuffer(b"".join(held) + bytes(most), np.uint8).astype(np.uint32)
            ends = np.cumsum([len(h) for h in held])
            row = np.repeat(np.arange(len(held)), [len(h) for h in held])
            n = int(ends[-1])
            left = np.repeat(ends, [len(h) for h in held]) - np.arange(n)  # bytes up to the slice's end
            gram = np.zeros(n, np.uint32)
            for size in range(1, most + 1):
                gram = gram * np.uint32(0x01000193) + buf[size - 1 : size - 1 + n] + np.uint32(1)
                if size in sizes:
                    # the last most-1 bytes of a slice that goes on are counted with the next one
                    whole = left >= np.where(more[row], most, size)
                    place = ((gram * np.uint32(0x9E3779B1)) >> shift).astype(np.int64) + row * dims
                    out_held = np.bincount(place[whole], minlength=len(held) * dims).reshape(len(held), dims)
                    np.add.at(out, rows, out_held.astype(np.float32))
        held, rows, total = [], [], 0
        flags.clear()

    flags: list[bool] = []
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), STEP):
            held.append(text[at : at + STEP + most - 1])
            rows.append(i)
            flags.append(at + STEP < len(text))
            total += len(held[-1])
            if total >= STEP or len(held) >= TEXTS:
                more = np.array(flags)
                add()
    more = np.array(flags)
    add()
    return out


def damped(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length: log of counts by idf; a text without n-grams stays zero."""
    x = np.log1p(counts) * idf
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def fitting_pass(docs: DataFrame, chosen: dict[int, object], counts: Counts, dims: int) -> tuple[int, np.ndarray, list[int], np.ndarray]:
    """One pass over all of ``docs`` (doc_id, text): number of texts, document frequencies, and the counts of the ``chosen`` ids.

    Frequencies are summed in each task and then over tasks, so that what moves is a
    row a task; chosen rows, whose number the caller bounds, come to the driver, sparse. Of rows that
    have a chosen id alike one counts, that with the least vector: a task gives each id once, and of the tasks' rows
    one is taken before they come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts, best = np.zeros(dims, np.int64), 0, {}
        for batch in batches:
            for part in slices(batch, 1, TEXTS):
                found = counts([t or "" for t in part.column(1).to_pylist()])
                seen += (found > 0).sum(0)
                texts += len(found)
                for doc, row in zip(part.column(0).to_pylist(), found):
                    if doc in chosen:
                        places = np.flatnonzero(row)
                        own = (places.astype("<u2").tobytes(), row[places].astype("<f4").tobytes())
                        best[doc] = min(own, best.get(doc, own))
        for doc, (places, values) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([None], pa.int64()), pa.array([places]), pa.array([values])], ["doc_id", "texts", "places", "values"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([texts]), pa.array([b""]), pa.array([seen.astype("<i8").tobytes()])], ["doc_id", "texts", "places", "values"])

    kind = "doc_id long, texts long, places binary, values binary"
    gathered = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(dims, np.int64), 0
        for batch in batches:
            texts += sum(batch.column(1).to_pylist())
            for v in batch.column(3).to_pylist():
                seen += np.frombuffer(v, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([texts]), pa.array([b""]), pa.array([seen.tobytes()])], ["doc_id", "texts", "places", "values"])

    # as in a tree: some tasks' sums, then those of the few that are left
    sums = gathered.filter("texts is not null").coalesce(64).mapInArrow(added, kind).collect()
    seen = sum((np.frombuffer(r["values"], "<i8") for r in sums), np.zeros(dims, np.int64))
    once = gathered.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("places", "values")).alias("row")).select("doc_id", "row.*")
    rows = sorted(once.collect())
    ids, matrix = [r["doc_id"] for r in rows], np.zeros((len(rows), dims), np.float32)
    for i, r in enumerate(rows):
        matrix[i, np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["values"], "<f4")
    return sum(r["texts"] for r in sums), seen, ids, matrix


def inverse_frequency(texts: int, seen: np.ndarray) -> np.ndarray:
    return np.log((1 + texts) / (1 + seen)).astype(np.float32) + np.float32(1)


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone: the rows with the smallest are a sample."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the text null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % by
