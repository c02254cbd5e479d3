"""Operator 5: one-permutation MinHash fingerprints. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, documents

#: Words of a shingle, bins of a fingerprint (a power of two), and low-order bits kept of each bin.
SHINGLE, BINS, BITS = 5, 256, 8
SEED = 77
#: Code points of the texts that one task holds in order, at most about.
RANGE = 1_000_000
#: Ranges in each of two levels, at most.
MOST_SIDE = 1000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """64-bit hashes of a text's word shingles; fewer words are one shingle, none give no hash."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<long>"))

    return let(words, hashes)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS, seed: int = SEED) -> Column:
    """The bins of a text's fingerprint, each the low-order ``bits`` of its least hash.

    Each shingle is hashed once; the high bits give its bin. Sorted together with the
    greatest value of each bin, the first hash of each bin is its least, and a bin
    without hashes shows that value. An empty bin is filled by optimal densification:
    it tries other bins in an order drawn from its own number, and takes the first
    that is not empty. So texts that share shingles fill empty bins alike. A text
    without words has the value 0 in every bin.
    """
    shift, width = 64 - int(math.log2(bins)), bins - 1
    empty = F.lit((1 << shift) - 1)
    edges = F.array(*[F.lit((b << shift) + (1 << shift) - 1 - ((1 << 64) if b >= bins // 2 else 0)) for b in range(bins)])
    of = lambda h: F.shiftrightunsigned(h, shift)

    def firsts(all_: Column) -> Column:
        return F.filter(all_, lambda h, i: (i == 0) | (of(h) != of(F.get(all_, i - 1))))

    def filled(least: Column) -> Column:
        bare = lambda h: h.bitwiseAND(empty) == empty
        probe = lambda i, t: F.get(least, F.pmod(F.xxhash64(i, t, F.lit(seed)), F.lit(bins)).cast("int"))

        def tries(i: Column, a: int, b: int) -> Column:
            return F.get(F.filter(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda t: probe(i, t)), lambda h: ~bare(h)), F.lit(0))

        # later tries are only worked out where the earlier find nothing; the last is the next bin, in turn, that is not empty
        def donor(i: Column) -> Column:
            turn = F.filter(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda t: F.get(least, F.pmod(i + t, F.lit(bins)).cast("int"))), lambda h: ~bare(h))
            return F.coalesce(tries(i, 0, 3), tries(i, 4, 19), tries(i, 20, 99), tries(i, 100, 499), F.get(turn, F.lit(0)))

        return F.transform(least, lambda h, i: F.when(bare(h), donor(i)).otherwise(h).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))

    def of_hashes(hashes: Column) -> Column:
        whole = let(firsts_sorted(hashes), filled)
        return F.when(F.size(hashes) > 0, whole).otherwise(F.array_repeat(F.lit(0), bins))

    def firsts_sorted(hashes: Column) -> Column:
        return let(F.sort_array(F.concat(hashes, edges)), firsts)

    return let(shingle_hashes(text, shingle), of_hashes)


def packed(bins: Column, bits: int = BITS) -> Column:
    """A fingerprint as lower-case hex, ``bits`` bits a bin (a multiple of 4)."""
    return F.array_join(F.transform(bins, lambda v: F.lower(F.lpad(F.hex(v), bits // 4, "0"))), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, less what chance makes equal among low-order bits."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(bins))
    chance = 1 / (1 << bits)
    return F.greatest((equal - chance) / (1 - chance), F.lit(0.0))


def ranged(docs: DataFrame, size: int = RANGE) -> DataFrame:
    """Adds ``_range``: ranges of doc_id of about ``size`` code points (column n_chars) each, however the ids lie.

    Quantiles of doc_id in two levels, of MOST_SIDE ranges each at most: those of all rows, then
    those within each. The table of bounds is thus bounded, and a row's place in
    it is found by two short lists. A null id lies in the lowest range.
    """
    total = docs.agg(F.sum("n_chars")).first()[0] or 0
    side = min(math.isqrt(total // size) + 1, MOST_SIDE)
    parts = F.array(*[F.lit(i / side) for i in range(1, side)]) if side > 1 else F.array(F.lit(0.5))
    bounds = F.percentile_approx("doc_id", parts, F.lit(50 * side))
    upper = sorted(docs.agg(bounds.alias("q")).first()["q"] or [])
    below = lambda q: F.coalesce(F.size(F.filter(q, lambda v: v <= F.col("doc_id"))), F.lit(0))
    coarse = docs.withColumn("_coarse", below(F.array(*[F.lit(v) for v in upper]).cast("array<long>")))
    inner = {r["_coarse"]: sorted(r["q"] or []) for r in coarse.groupBy("_coarse").agg(bounds.alias("q")).collect()}
    lower = F.array(*[F.array(*[F.lit(v) for v in inner.get(i, [])]).cast("array<long>") for i in range(len(upper) + 1)])
    return coarse.withColumn("_range", (F.col("_coarse") * (side + 1) + below(F.get(lower, F.col("_coarse")))).cast("long")).drop("_coarse")


def with_next(docs: DataFrame, columns: list[str], size: int = RANGE) -> DataFrame:
    """Adds ``next_<column>`` of the row that follows in descending doc_id; the first follows the last.

    One shuffle of the rows, by ranges of doc_id. A range's first row is what the
    last one of the range above needs, and is dealt to that range as well. Rows with the same id
    follow each other by a hash of the text; a null id comes last. Needs doc_id, text and n_chars.
    """
    dealt = ranged(docs, size).withColumn("_hash", F.xxhash64("text"))
    top = F.max_by(F.struct("doc_id", "_hash"), F.struct("doc_id", -F.col("_hash").cast("decimal(20,0)")))
    # a row for each range, whose number is bounded: MOST_SIDE + 1, squared
    tops = sorted((r["_range"], *r["top"]) for r in dealt.groupBy("_range").agg(top.alias("top")).collect())
    over = [(doc, hash_, tops[(i + 1) % len(tops)][0]) for i, (_, doc, hash_) in enumerate(tops)]
    also = docs.sparkSession.createDataFrame(over, "_doc long, _h long, _over long")
    here = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_h"))
    both = dealt.join(F.broadcast(also), here, "left").withColumn("_over", F.col("_over"))
    places = F.when(F.col("_over").isNull(), F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("copy"))))
    places = places.otherwise(F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("copy")), F.struct(F.col("_over").alias("at"), F.lit(True).alias("copy"))))
    spread = both.select(*docs.columns, "_hash", F.inline(places))
    w = Window.partitionBy("at").orderBy("copy", F.desc_nulls_last("doc_id"), "_hash")
    return spread.select(*docs.columns, "copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter("not copy").drop("copy")


def fingerprint_edits(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS, seed: int = SEED, size: int = RANGE) -> DataFrame:
    """Fingerprints of the whole texts of ``docs`` (doc_id, text; null text: empty) and of edited ones.

    The edited text is the text with its last third (rounded down, in code points) replaced by
    the first as many code points of the next document in descending doc_id, or all it has.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Equal texts have equal fingerprints; a blank text is like any other blank one. Repeated rows follow one another; an only
    row is its own next; an empty table gives no rows; other columns are ignored.
    """
    mark = lambda t: F.transform(fingerprint(t, shingle, bins, bits, seed), lambda v: (v - 128).cast("byte"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    linked = with_next(rows.withColumn("mark", mark(F.col("text"))), ["text", "mark"], size)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("next_text", third))
    done = linked.withColumn("edited", edited).withColumn("edited_mark", mark(F.col("edited")))
    shown = lambda m: packed(F.transform(m, lambda v: v.cast("int") + 128), bits)
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("mark")).alias("fingerprint"),
        shown(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark"), bins, bits).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark"), bins, bits).alias("near_next"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each whole document and of its edited text, and what likeness they tell."""
    return fingerprint_edits(documents(spark, sf_dir))
