"""Relational operators that Spark's DataFrame API has no single call for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.moving import moving_sums as moving_sums
from millrace.operators.ranges import range_counts as range_counts
from millrace.operators.ranges import range_join as range_join
from millrace.operators.sessions import sessions as sessions
from millrace.operators.sketches import distinct_estimate as distinct_estimate
from millrace.operators.sketches import merged_sketches as merged_sketches
from millrace.operators.sketches import quantile as quantile
from millrace.operators.sketches import sketched as sketched


def as_of_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, alias: str, span: str = "hour"
) -> DataFrame:
    """Each left row with the latest earlier-or-equal right ``value`` of the same key.

    Times are timestamps. A key's rows are split by ``span`` (a unit of ``date_trunc``), so that no task sorts more than one
    span of a key. The last value of each span is aggregated first and carried over into the spans
    after it; these carried values come in as rows, so one shuffle of the rows on key and span does. A null
    time matches nothing; null keys are alike; ties on the right take the greatest value.
    """
    keys = list(by)
    cols = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*cols).alias("_row"), F.col(left_time).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*keys, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side")).filter("_t is not null and _v is not null")
    both = a.unionByName(b).withColumn("_span", F.date_trunc(span, "_t"))
    ends = both.groupBy(*keys, "_span").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(F.col("_span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_v", F.last("_end", ignorenulls=True).over(before).getField("_v")).filter("_v is not null")
    carried = carried.select(*keys, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.lit(None).cast(a.schema["_t"].dataType).alias("_t"), "_v", F.lit(-1).alias("_side"), "_span")
    w = Window.partitionBy(*keys, "_span").orderBy(F.col("_side") >= 0, F.col("_t").asc_nulls_first(), "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.unionByName(carried)
        .withColumn("_last", F.last("_v", ignorenulls=True).over(w))
        .filter("_side = 1")
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols], F.when(F.col("_t").isNotNull(), F.col("_last")).alias(alias))
    )
