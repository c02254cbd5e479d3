"""Operator 10: shortest-pack-first packing over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import BUCKETS, cut, documents, running_total, slices
from millrace.llm.tokens import word_tokenizer

WIDTH, EOS = 4096, 2
#: Texts that a task tokenizes at once.
STEP = 512

Pattern = tuple[tuple[int, int], ...]  # runs of (length, how often), longest first


def pieces(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, eos: int = EOS, keep_ids: str | None = None) -> DataFrame:
    """Token pieces of every whole text (null: empty): doc_id, start, length, ids_crc32, doc_tokens.

    A document's ids end with ``eos`` and are cut every ``width`` ids. With ``keep_ids``, "<u4" or "<u2", the ids
    come along as bytes of that type; an id that it does not hold is an error. Needs doc_id and text; ignores other columns.
    """

    def typed(piece: bytes) -> bytes:
        ids = np.frombuffer(piece, "<u4")
        if ids.max() > np.iinfo(keep_ids).max:
            raise ValueError(f"id {ids.max()} does not fit {keep_ids}")
        return ids.astype(keep_ids).tobytes()

    end = np.asarray([eos], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * bool(keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer_path)
        try:
            for batch in batches:
                for part in slices(batch, 1, STEP):
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    out: tuple[list, ...] = ([], [], [], [], [], [])
                    for doc, ids in zip(part.column(0).to_pylist(), encode(texts)):
                        ids += end
                        for start in range(0, len(ids), 4 * width):
                            piece = ids[start : start + 4 * width]
                            for column, value in zip(out, (doc, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, typed(piece) if keep_ids else None)):
                                column.append(value)
                    arrays = [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.binary())] * bool(keep_ids)
                    yield pa.RecordBatch.from_arrays(arrays, names)
        finally:
            encode.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def shortest_pack_first(histogram: Mapping[int, int], width: int) -> list[tuple[int, Pattern]]:
    """Packing patterns, each with the number of packs that have it, for a histogram of lengths.

    Longest lengths first, each item goes to the shortest pack that it fits, or opens a
    pack. Packs of one pattern move together, so the work depends on the number of
    distinct lengths, not of items.
    """
    packs: dict[int, list[tuple[int, Pattern]]] = {}
    rooms: list[int] = []

    def put(room: int, count: int, pattern: Pattern) -> None:
        if room not in packs:
            packs[room] = []
            heapq.heappush(rooms, -room)
        packs[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not packs[-rooms[0]]:
                del packs[-heapq.heappop(rooms)]
            if not rooms or -rooms[0] < length:
                each = width // length
                if left >= each:
                    put(width - each * length, left // each, ((length, each),))
                if left % each:
                    put(width - left % each * length, 1, ((length, left % each),))
                break
            room = -rooms[0]
            count, pattern = packs[room].pop()
            taken = min(left, count)
            left -= taken
            if taken < count:
                packs[room].append((count - taken, pattern))
            runs = pattern[:-1] + ((length, pattern[-1][1] + 1),) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(room - length, taken, runs)
    return [pack for same in packs.values() for pack in same]


def slots(patterns: list[tuple[int, Pattern]]) -> np.ndarray:
    """Where the items of each length go, by rank: rows of length, first rank, first sequence, times a pack, first offset.

    A pattern has fewer than sqrt(2 * width) distinct lengths, so the table has a bound that
    depends on the width alone.
    """
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = given.get(length, 0)
            rows.append((length, first, sequence, times, offset))
            given[length] = first + count * times
            offset += length * times
        sequence += count
    out = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return out


def pack(cut_up: DataFrame, width: int = WIDTH) -> DataFrame:
    """``cut_up`` (doc_id, start, length <= width, ids_crc32, ...) with sequence_id and offset.

    The histogram of lengths, at most ``width`` rows, gives the patterns; pieces are then
    joined to them by their rank among those of the same length. The rank is a running
    total over ranges of a hash, so a length that very many pieces have is dealt out.
    Pieces that are alike in all columns may change places. No piece, no sequence.
    """
    histogram = {r[0]: r[1] for r in cut_up.groupBy("length").count().collect()}
    table = slots(shortest_pack_first(histogram, width))
    shift = 44
    keys = (table[:, 0] << shift) + table[:, 1]
    kept = cut_up.columns
    names = [*kept, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            row = table[np.searchsorted(keys, (length << shift) + rank, "right") - 1]
            nth = rank - row[:, 1]
            found = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + found, names)

    dealt = cut_up.withColumn("_one", F.lit(1).cast("long")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    ranked = running_total(dealt, ["length"], "_one", ["doc_id", "start", "ids_crc32", "doc_tokens"], "_rank").select(*cut_up.columns, "_rank")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_up.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, width: int = WIDTH, eos: int = EOS, keep_ids: str | None = None) -> DataFrame:
    """Whole texts of ``docs`` packed into sequences of at most ``width`` ids, one row a piece.

    Null and empty texts give a piece that is the end id alone; repeated rows give
    repeated pieces; a text of any length is cut into pieces, which may lie in different sequences; an empty table gives
    no rows; other columns are ignored. Each piece has the checksum of its ids; with ``keep_ids``
    the ids come along, as bytes of that type ("<u4" or "<u2").
    """
    return pack(cut(pieces(docs, tokenizer_path, width, eos, keep_ids)), width)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents packed into sequences of at most 4096 ids, a row a piece."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
