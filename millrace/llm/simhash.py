"""Operator 9: SimHash near-duplicates by a grid range-join over segment popcounts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, documents
from millrace.llm.graph import components

BITS, SHINGLE, SEED = 3, 3, 42
#: Bytes of a text that are split and hashed at once, up to the next white space.
STEP = 300_000
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Low bit of each of the 32 two-bit segments, as a signed 64-bit value.
LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, repeats included; unsigned 64 bits."""
    from xxhash import xxh64_digest

    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    n, ones, held, at = 0, np.zeros(64, np.int64), [], 0
    while at < len(raw):
        found = BLANK.search(raw, at + STEP)
        end = found.start() if found else len(raw)
        words = held + raw[at:end].split()  # bytes: at ASCII white space only
        at = end
        hashes = b"".join([xxh64_digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))])
        if hashes:
            n += len(hashes) // 8
            ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        held = words[max(0, len(words) - shingle + 1) :]
    if not n:
        return int.from_bytes(xxh64_digest(b" ".join(held), seed), "big") if held else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Ones in each two-bit segment, in unary: 0, 1, 2 as 00, 01, 11.

    Two embeddings' differing bits are then the Manhattan distance of the counts, which is
    never above the Hamming distance of the fingerprints.
    """
    low, next_ = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(next_).bitwiseAND(low)
    both = fp.bitwiseAND(next_).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def within(a: Column, b: Column, bits: int) -> Column:
    """Whether two fingerprints differ in ``bits`` bits or fewer: first by the Manhattan distance of their counts, which is a lower bound."""
    return (F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)


def zero_groups(points: int, bits: int = BITS) -> int:
    """Groups of segments that must agree, for a table of so many points.

    Two fingerprints of even bits agree in a segment's count with odds of 3 in 8, so in a cell over ``zeros`` of ``bits + zeros``
    groups with odds of 3/8 to the power of ``32 zeros / (bits + zeros)``. More zeros make cells finer, and choices more:
    those are taken that leave each point the fewest rows and candidates.
    """

    def rows(zeros: int) -> float:
        choices = math.comb(bits + zeros, zeros)
        return choices * (1 + points * 0.375 ** (32 * zeros / (bits + zeros)) / 8)  # a candidate costs less than a row

    return min(range(2, 7), key=rows)


def linked(distinct: DataFrame, bits: int = BITS, zeros: int = 2) -> DataFrame:
    """Pairs (a, b) of fingerprints in ``distinct`` (fp) that differ in 1 to ``bits`` bits, each once.

    The 32 segments form ``bits + zeros`` groups. Within Manhattan distance ``bits`` at least ``zeros`` groups have no
    difference at all, so both points lie in the same cell of the grid over these groups' counts. Cells
    over every choice of ``zeros`` groups are joined; the Manhattan bound, then the Hamming
    distance, are conditions of the join, which thus gives links alone. More ``zeros`` give the same links by
    finer cells (``zero_groups``).
    """
    n = bits + zeros
    edges = [round(32 * i / n) for i in range(n + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    choices = list(combinations(range(n), zeros))
    cells = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("u").bitwiseAND(F.lit(signed(sum(masks[g] for g in c)))).alias("cell")) for i, c in enumerate(choices)])
    points = distinct.select("fp", embedding(F.col("fp")).alias("u"))
    grid = points.select("fp", "u", F.inline(cells))
    a, b = grid.alias("a"), grid.alias("b")
    apart = F.col("a.u").bitwiseXOR(F.col("b.u"))
    # of the choices whose cells agree, only the first gives the pair
    first = reduce(
        lambda x, y: x | y,
        [
            (F.col("a.choice") == i) & reduce(lambda x, y: x & y, [apart.bitwiseAND(F.lit(signed(masks[g]))) != 0 for g in range(c[-1]) if g not in c], F.lit(True))
            for i, c in enumerate(choices)
        ],
    )
    near = (F.bit_count(apart) <= bits) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits)
    same = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.cell") == F.col("b.cell"))
    return a.hint("merge").join(b, same & (F.col("a.fp") < F.col("b.fp")) & near & first).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text), whole texts.

    Documents are linked if their fingerprints differ in ``bits`` bits or fewer; component_id is the
    smallest doc_id reachable. Equal fingerprints are collapsed first, so a group of
    copies is one point however large it is.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows
    each get a row; a null doc_id never names a component unless all its
    component's are null; an empty table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs, shingle, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked(distinct.select("fp"), bits, zero_groups(distinct.count(), bits)))
    placed = distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names.hint("merge"), "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(cut(named).hint("merge"), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document's fingerprint over three-word shingles, and the smallest doc_id that links of 3 bits or fewer reach."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
