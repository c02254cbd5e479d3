"""Operator 13: MinHash near-duplicates: bands of minima propose pairs, packed b-bit signatures sift them, whole shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, documents, slices
from millrace.llm.graph import components
from millrace.llm.simhash import within

SHINGLE, LIKE, SEED = 5, 0.85, 42
#: Minima a set, and low bits kept of each; packed into WIDTH longs.
MINIMA, BITS = 256, 2
WIDTH = MINIMA * BITS // 64
#: Minima a band, and odds at most that a pair of just the likeness asked for agrees in no band.
ROWS, MISSED = 5, 1e-6
#: Standard deviations by which an estimate may fall short of the likeness: one pair in three million falls further.
SHORT = 5
#: Low bit of each two-bit place of a long, as a signed value.
LOW = 0x5555555555555555
#: Shingles that meet all hash functions at once.
STEP = 4096
#: Sets of one bucket that are held against each other in one place, and shingles of them; and sets of one block of a larger bucket.
FEW, WEIGHT, BLOCK = 256, 1 << 20, 512
#: Counters by which shingles are put in order, the rarer first; shingles share them by hash.
SLOTS = 1 << 18


def band_count(like: float) -> int:
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-(like**ROWS)))) if like < 1 else 1


def least_agreement(like: float) -> int:
    """Places in which signatures of two sets of that likeness agree, less SHORT deviations.

    Unequal minima agree in their low bits with odds of 1 in 2 ** BITS, so a share of ``chance + (1 - chance) * likeness`` of the places agrees.
    """
    chance = 0.5**BITS
    share = chance + (1 - chance) * like
    return max(0, math.floor(MINIMA * share - SHORT * math.sqrt(MINIMA * share * (1 - share))))


def shingle_hashes(text: str | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's word shingles, A-Z in lower case; a shorter text is one shingle."""
    from xxhash import xxh64_digest

    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()  # bytes: A-Z only, and at ASCII white space only
    size = min(shingle, len(words))
    if not size:
        return np.empty(0, np.uint64)
    return np.unique(np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(size))))]), np.uint64))


@lru_cache(maxsize=4)
def hashing(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the first n of an endless row of hash functions."""
    draws = [np.random.default_rng([SEED, i]).integers(0, 1 << 63, (n, 1), np.uint64) for i in (0, 1)]
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1]


def minima(hashes: np.ndarray, many: int, first: int = 0) -> np.ndarray:
    """The least value of each of ``many`` hash functions, from the ``first`` on, over a set that is not empty."""
    a, b = (x[first : first + many] for x in hashing(first + many))
    return np.min([(hashes[at : at + STEP] * a + b).min(1) for at in range(0, len(hashes), STEP)], axis=0)


def band_keys(hashes: np.ndarray, bands: int) -> list[int]:
    """A long for each band of minima; none for a set without shingles."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    rows = minima(hashes, bands * ROWS).reshape(bands, ROWS)
    return np.array([xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def signature(hashes: np.ndarray) -> list[int]:
    """BITS bits of each of MINIMA minima, packed into longs; none for a set without shingles."""
    if not len(hashes):
        return []
    low = ((minima(hashes, MINIMA) >> np.uint64(20)) & np.uint64(2**BITS - 1)).astype(np.uint8)  # the lowest bits of a product are the same for many functions
    return np.packbits(np.unpackbits(low.reshape(-1, 1), axis=1)[:, -BITS:].reshape(-1)).view("<i8").tolist()


def set_print(hashes: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed long: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<i8")[0])


def set_key(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """Tells rows apart by doc_id, null too, and text. One plain column: a join on it and then ``dropDuplicates`` move the rows once."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash.cast("string"))


def keyed(docs: DataFrame, like: float = LIKE, prints: bool = False) -> DataFrame:
    """(doc_id, text_hash, set, n, bands) for each row of ``docs``: its set's key and size, and the keys of its bands; with ``prints`` its fingerprint fp comes last."""
    bands, of_set = band_count(like), [set_key, len, *[set_print] * prints]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = [shingle_hashes(text) for text in part.column(2).to_pylist()]
                longs = [pa.array([of(x) for x in sets], pa.int64()) for of in of_set]
                keys = pa.array([band_keys(x, bands) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *longs[:2], keys, *longs[2:]], ["doc_id", "text_hash", "set", "n", "bands", *["fp"] * prints])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return named.mapInArrow(run, "doc_id long, text_hash long, set long, n long, bands array<long>" + ", fp long" * prints)


def agreement(x: Column, y: Column) -> Column:
    """Places in which two packed signatures agree."""
    apart = [x[i].bitwiseXOR(y[i]) for i in range(WIDTH)]
    return F.lit(MINIMA) - reduce(lambda a, b: a + b, [F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(LOW))) for d in apart])


def sifted(pairs: DataFrame, held: DataFrame, like: float, radius: int | None) -> DataFrame:
    """The different ``pairs`` (a, b) whose sizes and signatures, and fingerprints within ``radius`` bits if that is given, allow ``like``."""
    x, y = (held.select(F.col("set").alias(s), F.struct("n", "marks", "fp").alias(f"_{s}")) for s in ("_x", "_y"))
    met = pairs.distinct().join(x.hint("merge"), F.col("a") == F.col("_x")).join(y.hint("merge"), F.col("b") == F.col("_y"))
    n, m = F.col("__x.n"), F.col("__y.n")
    keep = (F.least(n, m) >= F.lit(like) * F.greatest(n, m)) & (agreement(F.col("__x.marks"), F.col("__y.marks")) >= least_agreement(like))
    return met.filter(keep if radius is None else keep & within(F.col("__x.fp"), F.col("__y.fp"), radius)).select("a", "b")


def overlap(x: bytes, y: bytes, like: float) -> bool:
    """Whether two sets, as bytes of sorted hashes, have Jaccard likeness ``like`` or more."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= like * (len(x) + len(y) - both) - 1e-9


def alike(pairs: DataFrame, held: DataFrame, like: float) -> DataFrame:
    """The ``pairs`` (a, b) of sets whose Jaccard likeness is ``like`` or more, by their whole hash sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [overlap(x.as_buffer(), y.as_buffer(), like) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(held.select(F.col("set").alias("_a"), F.col("hashes").alias("x")).hint("merge"), F.col("a") == F.col("_a"))
    sized = sized.join(held.select(F.col("set").alias("_b"), F.col("hashes").alias("y")).hint("merge"), F.col("b") == F.col("_b"))
    return sized.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def hash_sets(docs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, n, marks, fp, hashes) for each of ``sets`` (set), from the text of one of its ``rows`` (set, row). Texts move once."""
    wanted = rows.join(sets.select(F.col("set").alias("_set")).distinct().hint("merge"), F.col("set") == F.col("_set"), "left_semi")
    wanted = cut(wanted.select(row_key(F.col("row.doc_id"), F.col("row.text_hash")).alias("_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = [shingle_hashes(text) for text in part.column(0).to_pylist()]
                longs = [pa.array([of(x) for x in found], pa.int64()) for of in (set_key, len, set_print)]
                lists = [pa.array([signature(x) for x in found], pa.list_(pa.int64())), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([longs[0], longs[1], lists[0], longs[2], lists[1]], ["set", "n", "marks", "fp", "hashes"])

    named = docs.select(row_key(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    texts = named.join(wanted.hint("merge"), F.col("key") == F.col("_key"), "left_semi")
    return texts.dropDuplicates(["key"]).select("text").mapInArrow(run, "set long, n long, marks array<long>, fp long, hashes binary")


def different(buckets: DataFrame) -> DataFrame:
    """(bucket, set, n, head, size, total) of ``buckets`` (bucket, set, n) that hold several sets; of buckets of the same sets, one. head is a bucket's least set."""
    sums = [F.count("*").alias("size"), F.sum("n").alias("total"), F.min("set").alias("head"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("_sum")]
    found = buckets.groupBy("bucket").agg(*sums).filter("size > 1")
    once = cut(found.groupBy("size", "total", "head", "_sum").agg(F.min("bucket").alias("_bucket")).drop("_sum"))
    return buckets.join(once.hint("merge"), F.col("bucket") == F.col("_bucket")).select("bucket", "set", "n", "head", "size", "total")


def apart(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """``buckets`` whose sets are of different components by ``roots`` (node, root), with each set's root."""
    rooted = cut(buckets.join(roots.hint("merge"), F.col("set") == F.col("node"), "left").select(*buckets.columns, F.coalesce("root", "set").alias("root")))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low != _high")
    return cut(rooted.join(cut(mixed.select(F.col("bucket").alias("_bucket"))).hint("merge"), F.col("bucket") == F.col("_bucket"), "left_semi"))


def joined(rows: pa.StructArray, more: pa.StructArray | None, like: float, radius: int | None) -> list[tuple[int, int]]:
    """Links (a, b) that join what all like pairs of sets (set, root, n, marks, fp, hashes) join, beyond their roots; with ``more`` only pairs between the two.

    Sizes, signatures and fingerprints sift first; then whole sets are compared, unless they are joined already.
    """

    def columns(x: pa.StructArray) -> tuple:
        longs = [x.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4)]
        return (*longs, x.field(3).flatten().to_numpy().reshape(len(x), -1).view(np.uint64), x.field(5))

    own, least, above, found = columns(rows), least_agreement(like), {}, []
    other = columns(more) if more is not None else own
    prints = other[3].view(np.uint64)
    counts = [(prints | prints >> np.uint64(1)) & np.uint64(LOW), prints & prints >> np.uint64(1) & np.uint64(LOW)]  # ones in each two-bit segment: some, both

    def root(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    for i in range(len(rows)):
        start = i + 1 if more is None else 0
        set_, mine, n, fp = (int(own[c][i]) for c in range(4))
        fits = (other[1][start:] != mine) & (np.minimum(other[2][start:], n) >= like * np.maximum(other[2][start:], n))
        if radius is not None:
            bits = np.uint64(fp & (1 << 64) - 1)
            some, both = (bits | bits >> np.uint64(1)) & np.uint64(LOW), bits & bits >> np.uint64(1) & np.uint64(LOW)
            bound = np.bitwise_count(counts[0][start:] ^ some).astype(np.int64) + np.bitwise_count(counts[1][start:] ^ both)
            fits &= (bound <= radius) & (np.bitwise_count(prints[start:] ^ bits) <= radius)
        at = np.flatnonzero(fits) + start
        d = other[4][at] ^ own[4][i]
        same = MINIMA - np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(LOW)).sum(1, dtype=np.int64)
        for j in at[same >= least].tolist():
            x, y = root(mine), root(int(other[1][j]))
            if x != y and overlap(own[5][i].as_buffer(), other[5][j].as_buffer(), like):
                above[max(x, y)] = min(x, y)
                found.append((set_, int(other[0][j])))
    return found


MEMBER = ("set", "root", "n", "marks", "fp", "hashes")


def whole(buckets: DataFrame, held: DataFrame) -> DataFrame:
    """``buckets`` (bucket, set, root, ...) with the whole sets."""
    return buckets.drop("n").join(held.withColumnRenamed("set", "_set").hint("merge"), F.col("set") == F.col("_set")).drop("_set")


def within_buckets(few: DataFrame, held: DataFrame, like: float, radius: int | None) -> DataFrame:
    """Links (a, b) from small buckets (bucket, set, root), a row of lists each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0):
                found = joined(group.values, None, like, radius)
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return whole(few, held).groupBy("bucket").agg(F.collect_list(F.struct(*MEMBER)).alias("sets")).select("sets").mapInArrow(run, "a long, b long")


def against_rest(many: DataFrame, held: DataFrame, like: float, radius: int | None) -> DataFrame:
    """Links (a, b) from larger buckets (bucket, set, root, size, total): the sets outside a bucket's main component meet all of it, block by block."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        found: list = []
        if block.num_rows and asked.num_rows:
            rows, more = (t.select([p + c for c in MEMBER]).combine_chunks().to_struct_array().combine_chunks() for t, p in ((asked, "_"), (block, "")))
            found = joined(rows, more, like, radius)
        return pa.table([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    main = many.groupBy("bucket", "root").agg(F.count("*").alias("_n")).groupBy("bucket").agg(F.max_by("root", F.struct("_n", "root")).alias("_main"), (F.sum("_n") - F.max("_n")).alias("_rest"))
    main = cut(main.select(F.col("bucket").alias("_bucket"), "_main", "_rest"))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / (WEIGHT / 2))).cast("int")
    full = many.join(main.hint("merge"), F.col("bucket") == F.col("_bucket")).withColumn("parts", parts).withColumn("asking", F.ceil(F.col("parts") * F.col("_rest") / F.col("size")).cast("int"))
    full = cut(whole(full, held))
    nth = F.xxhash64("set")
    left = full.select("bucket", F.pmod(nth, "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("ask"), *MEMBER)
    rest = full.filter("root != _main").withColumn("_ask", F.pmod(nth, "asking").cast("int"))
    right = rest.select(F.col("bucket").alias("_bucket_"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"), "_ask", *[F.col(c).alias(f"_{c}") for c in MEMBER])
    return left.groupBy("bucket", "part", "ask").cogroup(right.groupBy("_bucket_", "_part", "_ask")).applyInArrow(run, "a long, b long")


def prefixes(sets: DataFrame, held: DataFrame, like: float) -> DataFrame:
    """(bucket, set, n): the rarest shingles of each of ``sets`` (set), so many that two sets of likeness ``like`` share one of them.

    Of n shingles in an order that all sets keep, these are the first ``n - ceil(like * n) + 1``. The order goes by counts over all ``sets``, in a fixed number of
    counters that shingles share by hash: very frequent shingles come last, and which come first changes no result.
    """
    own = cut(held.join(sets.select(F.col("set").alias("_set")).distinct().hint("merge"), F.col("set") == F.col("_set"), "left_semi"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                np.add.at(counts, (np.frombuffer(raw.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["slot", "n"])

    summed = own.select("hashes").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    order = np.zeros(SLOTS, np.int64)
    order[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = np.frombuffer(raw.as_buffer(), np.uint64)
                first = np.lexsort((hashes, shared.value[(hashes % np.uint64(SLOTS)).astype(np.int64)]))[: len(hashes) - math.ceil(like * len(hashes) - 1e-9) + 1]
                longs = [hashes[first].view(np.int64), np.full(len(first), key), np.full(len(first), len(hashes))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in longs], ["bucket", "set", "n"])

    return own.select("set", "hashes").mapInArrow(run, "bucket long, set long, n long")


def links(docs: DataFrame, prints: DataFrame, like: float = LIKE, radius: int | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) of sets of likeness ``like`` or more that join all sets such pairs join.

    Sets meet in the buckets of their bands, and in those (bucket, set, n) that ``near`` makes of all sets (set, n, fp), if it is given; buckets of the same sets are one. The sets of a bucket of at most FEW are compared in one place. In a larger
    one each is held against the least, which settles groups of near copies. Where that leaves several components, its sets are dealt out
    anew by their rarest shingles, which parts what only shares a frame; the new buckets are treated likewise, and in those that are large even
    then, the sets outside the main component meet all others block by block. Sizes and signatures, and fingerprints within ``radius`` bits if
    that is given, sift what is compared; the whole sets decide.
    """
    marked = cut(prints.groupBy("set").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), *[F.first("fp").alias("fp")] * (near is not None)))
    buckets = marked.select("set", "n", F.explode("bands").alias("bucket"))
    if near is not None:
        buckets = buckets.unionByName(cut(near(marked.select("set", "n", "fp"))))
    shared = cut(different(buckets))
    held = cut(hash_sets(docs, marked.select("set", "row"), shared))
    small = (F.col("size") <= FEW) & (F.col("total") <= WEIGHT)

    def stars(buckets: DataFrame, held: DataFrame) -> DataFrame:
        pairs = buckets.filter("set != head").select(F.col("head").alias("a"), F.col("set").alias("b"))
        return cut(alike(sifted(pairs, held, like, radius), held, like))

    edges = cut(within_buckets(shared.filter(small).withColumn("root", F.col("set")), held, like, radius))
    large = shared.filter(~small)
    if large.isEmpty():
        return edges
    # what follows concerns the sets of large buckets alone; the others' hashes move no more
    few = large.select(F.col("set").alias("_set")).distinct()
    held = cut(held.join(few.hint("merge"), F.col("set") == F.col("_set"), "left_semi"))
    edges = edges.unionAll(stars(large, held))
    roots = components(edges)
    open_ = apart(large, roots)
    if open_.isEmpty():
        return edges
    finer = apart(cut(prefixes(open_.select("set"), held, like)), roots)
    rooted = finer.select(F.col("set").alias("_set"), "root").distinct()
    finer = cut(different(finer.drop("root")).join(cut(rooted).hint("merge"), F.col("set") == F.col("_set")).drop("_set"))
    edges = edges.unionAll(cut(within_buckets(finer.filter(small), held, like, radius)))
    large = finer.filter(~small)
    if large.isEmpty():
        return edges
    edges = edges.unionAll(stars(large, held))
    open_ = apart(large.drop("root"), components(edges))
    return edges if open_.isEmpty() else edges.unionAll(cut(against_rest(open_, held, like, radius)))


def placed(docs: DataFrame, prints: DataFrame, like: float, radius: int | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text_hash, n, component_id, component) for each row of ``prints``; rows of equal sets are one."""
    roots = components(links(docs, prints, like, radius, near))
    distinct = prints.groupBy("set").agg(F.min("doc_id").alias("least"))
    with_roots = cut(distinct.join(roots.hint("merge"), F.col("set") == F.col("node"), "left").select("set", "least", F.coalesce("root", "set").alias("root")))
    names = with_roots.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("_root"), "component_id")
    named = cut(with_roots.join(names.hint("merge"), F.col("root") == F.col("_root")).select(F.col("set").alias("_set"), "component_id", F.col("root").alias("component")))
    return prints.join(named.hint("merge"), F.col("set") == F.col("_set")).select("doc_id", "text_hash", "n", "component_id", "component")


def near_duplicates(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text), whole texts.

    Documents are linked if their sets of five-word shingles have Jaccard likeness ``like`` or more, confirmed on the full sets (of 64-bit hashes);
    component_id is the smallest doc_id reachable, and kept says that it is the row's own. Equal sets are collapsed first, so copies cost nothing however many they are.
    A pair of just that likeness is never proposed with odds of ``MISSED``, and sifted out with odds of one in three million.

    A text of fewer words is one shingle; null, empty and blank texts have none and are linked with nothing. Repeated rows each get a row.
    A null doc_id names a component only if all its ids are null; such rows are kept. A text of any length is hashed whole, in one task's memory.
    An empty table gives no rows; other columns are ignored.
    """
    prints = cut(keyed(docs, like))
    some, none = prints.filter("n > 0"), prints.filter("n = 0")
    found = placed(docs, some, like).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    found = found.unionAll(none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document's set size, the smallest doc_id that links of likeness 0.85 reach, and whether it is its own."""
    return near_duplicates(documents(spark, sf_dir))


#: DuckDB SQL for ``op13_minhash``, where no doc_id is null or repeated: all pairs that share a shingle, and what their links reach.
OP13_SQL = r"""
WITH RECURSIVE said AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingled AS (SELECT doc_id, list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
  FROM said WHERE len(words) > 0),
each AS (SELECT doc_id, unnest(shingles) AS shingle FROM shingled),
sizes AS (SELECT doc_id, len(shingles) AS n FROM shingled),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM each x JOIN each y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN linked ON other = a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
