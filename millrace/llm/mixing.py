"""Operator 3: mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import BUCKETS, col, cut, documents, running_total, word_count


def source_targets(sources: DataFrame, budget_ratio: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to ``sources`` (source, source_size, weight): words to take of each.

    Water-filling: all sources share the budget by weight; those whose share is above
    ``max_epochs`` times their size are clamped there, and what is left is shared
    anew among the others by weight, until none is above. Each round is one
    aggregate of ``sources`` to a single row, and clamps a source at least.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level = float(total) * budget_ratio, 0.0
    while True:
        over = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        higher = (budget - row[0]) / row[1] if row[1] else level
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def ranked_sources(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """The sources of ``sized`` (source, size) with weights that repeat in code point order, null last.

    The rank is exact and no task sees all sources: range partitions are counted, and
    only those counts, one a partition, are added up in one place.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = each.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_offset")
    turn = ranged.join(offsets.hint("merge"), "_part").withColumn("_turn", nth % len(weights))
    return cut(turn.select("source", "source_size", F.element_at(F.lit(list(weights)), (F.col("_turn") + 1).cast("int")).alias("weight")))


def mix(docs: DataFrame, seed: str = "mix", budget_ratio: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source): adds its size and ``epochs``.

    A source's ratio is its target by its size. Every row is taken as often as the
    ratio's whole part says; the fraction is made up by a seeded sample of whole rows,
    in the order of a hash of seed and doc_id, as long as half of a row's words
    still fit; so a source misses its target by half a document at most. The same
    seed and rows give the same mix. Returns doc_id, source, size, source_size,
    target, epochs and taken = epochs * size.

    Null text has size 0 and a null source is a source of its own; a null doc_id is
    hashed as such. Rows with the same doc_id and size are alike: how many are taken
    is fixed, not which. Sources without words have target 0 and are taken 0 times.
    An empty table gives an empty one. Other columns are ignored.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("_hash"))
    sized = cut(sized)
    targets = source_targets(ranked_sources(sized, weights), budget_ratio, max_epochs)
    # the target reaches the rows by (source, bucket), so that a large source is dealt out as well
    dealt = sized.withColumn("_bucket", (F.conv(F.substring("_hash", 1, 6), 16, 10).cast("long") % BUCKETS).cast("int"))
    placed = running_total(dealt, ["source"], "size", ["_hash", "doc_id", "size"], "_before")
    spread = targets.select(F.col("source").alias("_s"), "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("_b"))
    placed = placed.join(spread.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = F.col("target") - F.floor(ratio) * F.col("source_size")
    chosen = (F.col("_before") + F.col("size") / 2 <= part) & (part > 0)
    return (
        placed.withColumn("epochs", F.floor(ratio) + F.when(chosen, 1).otherwise(0))
        .withColumn("taken", F.col("epochs") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as ``mix`` takes it.

    Rows are matched by doc_id, source, size and a hash of the text; if several rows have all of these alike,
    their epochs are added and dealt out evenly among them, as they come. Null and repeated ids, null texts and sources, ties
    and an empty table are as in ``mix``.
    """
    plan = mix(docs, **options).groupBy(F.struct("doc_id", "source", "size").alias("_key")).agg(F.sum("epochs").alias("total"), F.count("*").alias("n"))
    # a row's own columns stay together in one, so that their names are free
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("row"), F.struct("doc_id", "source", word_count(F.col("text")).alias("size")).alias("key"), F.xxhash64("text").alias("order"))
    joined = rows.join(plan.hint("merge"), F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
    alone = joined.filter("n = 1").select("row", F.col("total").cast("int").alias("times"))
    # rows that share a key, however many: each has a place in the order of its text's hash, found without sorting them all in one task
    alike = cut(joined.filter("n > 1").withColumn("_bucket", F.pmod("order", F.lit(BUCKETS)).cast("int")).withColumn("one", F.lit(1).cast("long")))
    alike = running_total(alike, ["key"], "one", ["order"], "turn")
    times = F.floor(F.col("total") / F.col("n")) + F.when(F.col("turn") < F.col("total") % F.col("n"), 1).otherwise(0)
    both = alone.unionAll(alike.select("row", times.cast("int").alias("times")))
    return both.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "epochs")


OP3_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size) * 2.0::DOUBLE AS cap,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
w(level, higher) AS (
  SELECT 0.0::DOUBLE, sum(source_size)::DOUBLE * 1.5 / sum(weight) FROM s
  UNION ALL
  SELECT w.higher,
         (SELECT (sum(source_size)::DOUBLE * 1.5 - coalesce(sum(CASE WHEN cap < weight * w.higher THEN cap END), 0))
                 / nullif(sum(CASE WHEN cap < weight * w.higher THEN 0 ELSE weight END), 0) FROM s)
  FROM w WHERE w.higher > w.level),
t AS (SELECT s.*, least(cap, weight * (SELECT max(level) FROM w)) AS target FROM s),
r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(h, 1, 6) AS BIGINT) % 1024, h, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CAST(floor(ratio) AS BIGINT)
            + CASE WHEN target - floor(ratio) * source_size > 0 AND before + size / 2 <= target - floor(ratio) * source_size THEN 1 ELSE 0 END AS epochs
  FROM r)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs FROM e
"""
