"""Operator 2: best-fit-decreasing packing into id matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, slices
from millrace.llm.tokens import rank_tokenizer

WIDTH, PAD = 4096, 50256
#: Ids that a task gathers before it packs them; bounds its memory, and is far above what little padding needs.
GATHERED = 1_500_000
STEP = 256


def best_fit_decreasing(lengths: np.ndarray, width: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that has room.

    A segment tree over capacities 0..width holds whether some bin has just that much room;
    the fullest bin that fits an item is the leftmost such capacity from its length on,
    found by climbing and descending the tree.
    """
    size = 1 << int(width).bit_length()
    tree = bytearray(2 * size)
    open_bins: list[list[int]] = [[] for _ in range(width + 1)]
    out, bins = np.empty(len(lengths), np.int64), 0

    def mark(room: int, on: int) -> None:
        at = room + size
        tree[at] = on
        while at > 1:
            at >>= 1
            tree[at] = tree[2 * at] | tree[2 * at + 1]

    def least(room: int) -> int:
        at = room + size
        while not tree[at]:
            while at & 1:
                at >>= 1
            if at <= 0:
                return -1
            at += 1
            if at & (at - 1) == 0:
                return -1
        while at < size:
            at *= 2
            at += not tree[at]
        return at - size

    for item in np.argsort(-lengths, kind="stable"):
        need = int(lengths[item])
        room = least(need)
        if room < 0:
            room, which = width, bins
            bins += 1
        else:
            which = open_bins[room].pop()
            if not open_bins[room]:
                mark(room, 0)
        out[item] = which
        rest = room - need
        if rest:
            open_bins[rest].append(which)
            if len(open_bins[rest]) == 1:
                mark(rest, 1)
    return out


def pack_matrices(docs: DataFrame, ranks_path: str, pattern: str, width: int = WIDTH, pad: int = PAD) -> DataFrame:
    """Whole texts of ``docs`` (doc_id, text) as rows of id matrices, ``width`` ids a row.

    Each task packs the documents of its own input split, some million ids at a time: no
    shuffle, and memory does not depend on the table. Documents longer than ``width`` are
    split, losslessly: segments carry doc_id and start. A segment is a document's ids
    without any mark; ``pad`` fills a row up.

    Returns sequence_id (unique, not gapless), ids (width little-endian uint32 as bytes), cu_seqlens
    (cumulative segment lengths from 0), position_ids (uint32 bytes: they start from 0 at
    each segment, and are 0 on padding), doc_ids and starts (of each segment).

    Null and empty texts have no ids and are in no row; repeated rows are packed each on
    its own; an empty table gives no rows; other columns are ignored.
    """

    def matrices(held: list[tuple[int | None, int, np.ndarray]], base: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(x[2]) for x in held], np.int64)
        where = best_fit_decreasing(lengths, width)
        order = np.lexsort((-lengths, where))
        edges = np.flatnonzero(np.r_[True, np.diff(where[order]) > 0, True])
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            segments = [held[i] for i in order[a:b]]
            ends = np.cumsum([0, *(len(s[2]) for s in segments)])
            ids, positions = np.full(width, pad, "<u4"), np.zeros(width, "<u4")
            for s, at in zip(segments, ends):
                ids[at : at + len(s[2])] = s[2]
                positions[at : at + len(s[2])] = np.arange(len(s[2]))
            for column, value in zip(rows, (base + n, ids.tobytes(), ends, positions.tobytes(), [s[0] for s in segments], [s[1] for s in segments])):
                column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["sequence_id", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names), base + len(edges) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = rank_tokenizer(ranks_path, pattern)
        base, held, total = TaskContext.get().partitionId() << 40, [], 0
        try:
            for batch in batches:
                for part in slices(batch, 1, STEP):
                    for doc, raw in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                        ids = np.frombuffer(raw, "<u4")
                        held += [(doc, s, ids[s : s + width]) for s in range(0, len(ids), width)]
                        total += len(ids)
                    if total >= GATHERED:
                        out, base = matrices(held, base)
                        yield out
                        held, total = [], 0
        finally:
            encode.forget()
        if held:
            yield matrices(held, base)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "sequence_id long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>")


def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents as rows of id matrices, with segment lengths and position resets."""
    import public_tokenizers

    return pack_matrices(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
