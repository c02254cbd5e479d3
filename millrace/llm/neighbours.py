"""Operator 1: approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from millrace.llm.common import cut

#: Projections a table, tables, buckets probed in each, and bucket width in units of a range's greatest norm.
FUNCTIONS, TABLES, PROBES, SLOT = 6, 6, 30, 2.4
#: Vectors, and queries, of one bucket that meet in one block; larger buckets take several.
BLOCK = 8192
#: Norms of one range differ by this factor at most; the last of the ranges takes all smaller ones.
FACTOR, RANGES = 4.0, 8
#: Vectors hashed at once.
STEP = 2048
SEED = 11


@lru_cache(maxsize=4)
def perturbations(functions: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """The ``probes`` likeliest sets of perturbations, best first, as ranks among the 2 * functions of a query.

    A perturbation moves one hash value to a neighbour; its cost is the squared distance to that
    boundary, and ranks j and 2 * functions - 1 - j are always the two sides of one function.
    Sets are drawn from a heap in order of expected cost, by shifting or adding the last rank.
    """
    m = functions
    low = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost = low + [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - r in ranks for r in ranks):
            out.append(ranks)
        if (after := ranks[-1] + 1) < 2 * m:
            heapq.heappush(heap, (total + cost[after] - cost[ranks[-1]], (*ranks[:-1], after)))
            heapq.heappush(heap, (total + cost[after], (*ranks, after)))
    return tuple(out)


@lru_cache(maxsize=8)
def projections(width: int, functions: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal (2-stable) directions for vectors of ``width`` components and one more, and offsets in slots."""
    draw = np.random.default_rng((seed, width))
    return draw.normal(size=(tables, width + 1, functions)), draw.uniform(size=(tables, functions))


def bucket_keys(table: int, width: int, norm_range: np.ndarray | int, values: np.ndarray) -> np.ndarray:
    """One long for a table, a vector width, a range of norms and its hash values."""
    key = np.full(values.shape[:-1], table * 1_000_003 + width, np.uint64) + np.asarray(norm_range).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for i in range(values.shape[-1]):
        key = (key ^ values[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one width as rows, in double precision."""
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def same_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time whose vectors have one width, and those vectors."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for width in np.unique(lengths):
            rows = batch.filter(pa.array(lengths == width))
            for at in range(0, rows.num_rows, STEP):
                part = rows.slice(at, STEP)
                yield part, matrix(part.column("v"))


def hashed(part: pa.RecordBatch, keys: list[np.ndarray]) -> pa.RecordBatch:
    """``part`` with a list of all its ``keys`` for each row."""
    found = np.stack(keys, 1)
    ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], ["id", "v", "buckets"])


def top_of_block(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of the vectors ``right`` for each query ``left`` of one block, exactly.

    One matrix product finds the candidates; the scores of those that can be among
    the best are summed anew, each in the same order, so that equal vectors tie exactly.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if left.num_rows and right.num_rows:
        ids, first = np.unique(right.column("id").to_numpy(), return_index=True)
        rows, names, vectors = matrix(right.column("v"))[first], left.column("id").to_numpy(), matrix(left.column("v"))
    for at in range(0, left.num_rows if right.num_rows else 0, 512):
        asked, asking = vectors[at : at + 512], names[at : at + 512]
        scores = asked @ rows.T
        own = asking[:, None] == ids[None, :]
        scores[own] = -np.inf
        if len(ids) > k:
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            slack = 1e-12 * (1 + np.abs(asked).sum(1) * np.abs(rows).max())
            may = scores >= (least - slack)[:, None]
        else:
            may = np.ones_like(own)
        q, c = np.nonzero(may & ~own)
        exact = np.empty(len(q))
        for b in range(0, len(q), 1 << 16):
            exact[b : b + (1 << 16)] = (asked[q[b : b + (1 << 16)]] * rows[c[b : b + (1 << 16)]]).sum(1)
        order = np.lexsort((ids[c], -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((asking[q[best]], ids[c[best]], exact[best]))
    return pa.table([np.concatenate(c) for c in zip(*out)], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, v) of the vectors that are not null, zero, empty or partly null or not finite; of rows with one id, that with the least vector."""
    v = F.col(vector_col).cast(f"array<{kind}>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    return named.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def meet(stored: DataFrame, looking: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of ``stored`` (bucket, id, v) for each query of ``looking``, over all buckets that they share, in blocks of bounded size."""
    sizes = stored.groupBy("bucket").agg(F.count("*").alias("n")).join(looking.groupBy("bucket").agg(F.count("*").alias("m")).hint("merge"), "bucket")
    sizes = cut(sizes.select(F.col("bucket").alias("_b"), F.ceil(F.col("n") / BLOCK).cast("int").alias("down"), F.ceil(F.col("m") / BLOCK).cast("int").alias("across")))
    here = F.col("bucket") == F.col("_b")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = stored.join(sizes.hint("merge"), here).select("bucket", part("down").alias("i"), every("across").alias("j"), "id", "v")
    looking = looking.join(sizes.hint("merge"), here).select("bucket", part("across").alias("j"), every("down").alias("i"), "id", "v")
    keys = ["bucket", "i", "j"]
    best = looking.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(lambda a, b: top_of_block(a, b, k), "query_id long, vec_id long, score double")
    merged = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, asked: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", functions: int = FUNCTIONS, tables: int = TABLES, probes: int = PROBES, slot: float = SLOT, seed: int = SEED) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product found for each row of ``asked``.

    Inner product becomes distance: vectors are parted by ranges of norms; a vector gets one more component that brings its
    norm to the greatest of its range, a query is scaled to that norm and gets 0. So one very long vector does not
    crowd all others into few buckets. Every vector is
    indexed in ``tables`` hash tables. In each range a query looks into its own bucket and the likeliest
    perturbed ones, in estimated success order. Queries and vectors of a bucket
    meet in blocks of bounded size, whatever the bucket holds; the best of each block,
    by the exact product of the original vectors, are merged over blocks and tables. A query
    whose buckets held fewer than ``k`` vectors is then held against all of its width, in such blocks too.

    Returns query_id, rank from 1, vec_id, score; ties go to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do null
    ids; vectors of another width than the query's are no candidates; of rows with the same id the one with the least
    vector counts; a query is not its own candidate. No usable row gives no rows.
    """
    # floats stay floats while they move; scores are doubles
    kind = "float" if all(df.schema[vector_col].dataType == ArrayType(FloatType(), df.schema[vector_col].dataType.containsNull) for df in (vectors, asked)) else "double"
    space, queries = usable(vectors, id_col, vector_col, kind), usable(asked, id_col, vector_col, kind)
    longest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))  # squares of its share neither overflow nor vanish
    norm = longest * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / longest, F.lit(2.0))))
    space = cut(space.withColumn("n", norm))  # norms are worked out once
    greatest = float(space.agg(F.max("n")).first()[0] or 1.0)
    place = F.least(F.floor((math.log(greatest) - F.log("n")) / math.log(FACTOR)), F.lit(RANGES - 1)).cast("int")
    space = space.withColumn("r", F.greatest(place, F.lit(0)))
    tops = {r["r"]: r["n"] for r in space.groupBy("r").agg(F.max("n").alias("n")).collect()}  # RANGES rows at most
    sets = perturbations(functions, probes)

    def index(batches):
        for part, x in same_width(batches):
            ranges = part.column("r").to_numpy()
            x = x / np.array([tops[r] for r in ranges.tolist()])[:, None]
            full, (directions, offsets) = np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))], projections(x.shape[1], functions, tables, seed)
            yield hashed(part, [bucket_keys(t, x.shape[1], ranges, np.floor(full @ directions[t] / slot + offsets[t])) for t in range(tables)])

    def probe(batches):
        for part, x in same_width(batches):
            full = x / np.abs(x).max(1, keepdims=True)
            full /= np.sqrt((full * full).sum(1))[:, None]
            directions, offsets = projections(x.shape[1], functions, tables, seed)
            found = []
            for t in range(tables):
                places = full @ directions[t][:-1] / slot + offsets[t]
                values = np.floor(places)
                cost = np.c_[places - values, 1 - places + values]  # to the lower and the upper neighbour
                order = np.argsort(cost, axis=1)
                for ranks in sets:
                    moved = values.copy()
                    for r in ranks:
                        side = order[:, r]
                        moved[np.arange(len(x)), side % functions] += np.where(side < functions, -1, 1)
                    found += [bucket_keys(t, x.shape[1], r, moved) for r in tops]
            yield hashed(part, found)

    # hashed once, and written; each vector is copied to its buckets only where it moves
    spread = lambda x: x.select(F.explode("buckets").alias("bucket"), "id", "v")
    schema = f"id long, v array<{kind}>, buckets array<long>"
    indexed, probing = cut(space.select("id", "v", "r").mapInArrow(index, schema)), cut(queries.mapInArrow(probe, schema))
    top = cut(meet(spread(indexed), spread(probing), k))
    served = cut(top.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("_q")))
    # the rest, if any, meet all vectors of their width
    short = probing.join(served.hint("merge"), F.col("id") == F.col("_q"), "left_anti")
    by_width = lambda x: x.select(F.size("v").cast("long").alias("bucket"), "id", "v")
    return top.join(served.hint("merge"), F.col("query_id") == F.col("_q"), "left_semi").unionAll(meet(by_width(indexed), by_width(short), k))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors found nearest, by inner product, to each whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
