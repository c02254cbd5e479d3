"""Session windows: runs of a key's rows with no gap of a given length between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import micros


def merged(parts: DataFrame, keys: Sequence[str], within: Sequence[str], gap: int, sums: Sequence[str]) -> DataFrame:
    """``parts`` (keys, _first, _last, _from, _to, sums) of the same ``within`` that lie no more than a gap apart, made one."""
    by = Window.partitionBy(*within).orderBy("_first", "_last")
    before = F.lag("_last").over(by)
    starts = parts.withColumn("_starts", (before.isNull() | (F.col("_first") - before > gap)).cast("long"))
    run = starts.withColumn("_run", F.sum("_starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    held = [F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.min("_from").alias("_from"), F.max("_to").alias("_to")]
    return run.groupBy(*within, "_run").agg(*held, *[F.sum(s).alias(s) for s in sums]).select(*within, "_run", "_first", "_last", "_from", "_to", *sums)


def sessions(rows: DataFrame, by: Sequence[str], time: str, gap_seconds: int, measures: Mapping[str, Column] | None = None, span_gaps: int = 4096) -> DataFrame:
    """(by, session_start, session_end, n_rows, measures) for each session of each key.

    A session is a longest run of rows of which each comes at most ``gap_seconds`` after the one before it; it starts with its first row and ends a gap after its
    last, as ``session_window`` has it. ``measures`` are columns that are summed over it; they should be whole numbers or decimals, whose sums depend on no order.

    No key is ever one task's: rows of one key within the same slice of a gap's length always share a session, so they are aggregated first, before any
    shuffle. The slices of a span of ``span_gaps`` gaps are then merged, and sessions that neither begin nor end a span's are done. What is left, two a span
    and key at most, meets once more over spans.

    Null times are in no session; null keys are alike; times that are equal share a session; an empty table gives no rows. Columns other
    than those named are ignored, whatever their names.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    sums = ["_n", *(f"_m{i}" for i in range(len(measures or {})))]
    gap, at = gap_seconds * 1_000_000, micros(F.col(time), rows.schema[time].dataType)
    named = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(time).alias("_time"), at.alias("_at"), F.lit(1).cast("long").alias("_n"), *[m.alias(f"_m{i}") for i, m in enumerate((measures or {}).values())])
    sliced = named.filter("_at is not null").withColumn("_slice", F.floor(F.col("_at") / F.lit(gap))).withColumn("_span", F.floor(F.col("_slice") / F.lit(span_gaps)))
    ends = [F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.min("_time").alias("_from"), F.max("_time").alias("_to")]
    slices = sliced.groupBy(*keys, "_span", "_slice").agg(*ends, *[F.sum(s).alias(s) for s in sums])
    local = merged(slices, keys, [*keys, "_span"], gap, sums)
    # a session in the middle of its span is whole: rows of it lie between it and any other span's
    spanned = Window.partitionBy(*keys, "_span")
    edge = local.withColumn("_open", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(spanned)))
    columns = [*keys, "_first", "_last", "_from", "_to", *sums]
    rest = merged(edge.filter("_open").select(*columns), keys, keys, gap, sums)
    found = edge.filter("not _open").select(*columns).unionByName(rest.select(*columns))
    out = [F.col(k).alias(c) for k, c in zip(keys, by)]
    total = [F.col(f"_m{i}").alias(m) for i, m in enumerate(measures or {})]
    return found.select(*out, F.col("_from").alias("session_start"), (F.col("_to") + F.expr(f"interval '{gap_seconds}' second")).alias("session_end"), F.col("_n").alias("n_rows"), *total)
