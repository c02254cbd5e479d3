"""Connected components of an edge table, by joins and aggregates alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard, shared_folder, stored

#: Tasks at least of a step of a round, and edges that one more task is worth.
TASKS, EDGES = 8, 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node reachable.

    Large-star and small-star steps by turns: every node's larger, then smaller,
    neighbours are linked to its least neighbour, until each component is a star. The number of
    edges never grows and rounds are logarithmic in practice. Nodes with very many
    neighbours are met by partial aggregation and by joins that can be split. Each round is written to
    the shared folder, and the one before it deleted; the result is a checkpoint.
    """
    spark, home = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/components-{uuid.uuid4().hex}"
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{home}/0")
    seen, turn = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            out = cut(now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()))
            discard(spark, home)
            return out
        seen = mark
        tasks = max(TASKS, mark[0] // EDGES + 1)  # as many as the edges want: few edges are not worth a task, and a file, a shuffle partition
        both = now.select(F.col("u").alias("n"), F.col("v").alias("o")).unionAll(now.select(F.col("v").alias("n"), F.col("u").alias("o")))
        # written out, so that both sides of the join are plain shuffles, and a hub's edges can be split
        least = both.groupBy("n").agg(F.min("o").alias("m")).select(F.col("n").alias("_n"), F.least("n", "m").alias("m"))
        least = stored(least.coalesce(tasks), f"{home}/{turn}-least")
        large = both.filter("o > n").join(least.hint("merge"), F.col("n") == F.col("_n")).select(F.col("o").alias("v"), F.col("m").alias("u"))
        large = stored(large.coalesce(tasks), f"{home}/{turn}-large")
        lowest = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("_v"), "m")
        lowest = stored(lowest.coalesce(tasks), f"{home}/{turn}-lowest")
        joined = large.join(lowest.hint("merge"), F.col("v") == F.col("_v"))
        moved = joined.filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).coalesce(tasks)
        after = stored(moved.unionAll(lowest.select(F.col("_v").alias("v"), F.col("m").alias("u"))).distinct().coalesce(tasks), f"{home}/{turn + 1}")
        for used in (f"{turn}", f"{turn}-least", f"{turn}-large", f"{turn}-lowest"):
            discard(spark, f"{home}/{used}")
        now, turn = after, turn + 1
