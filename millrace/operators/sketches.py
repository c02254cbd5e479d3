"""Sketches that are kept a day and merged over any days: distinct counts and quantiles without a second look at the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of an HLL sketch's buckets: its standard error is 1.04 / sqrt(2 ** LG). Size of a KLL sketch: ranks are off by some 1.3 % at most, with odds of 99 %.
LG, KLL = 12, 200


def sketched(rows: DataFrame, by: Sequence[str], distinct: Column, amount: Column) -> DataFrame:
    """(by, n, distinct_sketch, amount_sketch): a row a group, of some kilobytes however many rows it has; both are built map-side first.

    Nulls are in no sketch, and NaN is in no amount sketch; n counts all rows. A group without any value has a sketch of nothing, or null.
    """
    number = F.when(~F.isnan(amount.cast("double")), amount.cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LG)).alias("distinct_sketch"), F.kll_sketch_agg_double(number, F.lit(KLL)).alias("amount_sketch"))


def merged_sketches(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``sketched`` rows, of whatever finer groups, merged to ``by``."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("amount_sketch").alias("amount_sketch"))


def distinct_estimate() -> Column:
    return F.hll_sketch_estimate("distinct_sketch")


def quantile(share: float) -> Column:
    return F.kll_sketch_get_quantile_double("amount_sketch", F.lit(share))
