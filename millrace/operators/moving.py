"""Moving sums over a stretch of time, by frames of an interval rather than of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import micros


def moving_sums(rows: DataFrame, by: Sequence[str], time: str, seconds: int, measures: Mapping[str, Column], span_windows: int = 8) -> DataFrame:
    """``rows`` with each of ``measures`` summed over the rows of the same key from ``seconds`` before up to the row's own time, both included.

    Measures should be whole numbers or decimals, whose sums depend on no order; a sum over nulls alone is null. A key's rows are split by spans of
    ``span_windows`` stretches; rows within a stretch of a span's end are sent to the next span as well, where they count but give no row. So no task sorts
    more than one span of a key and a stretch, and one shuffle does.

    Rows of one time see each other. A null time is in no frame: its sums are null. Null keys are alike; repeated rows each count; an empty table
    gives no rows. Columns may have any names but those of ``measures``.
    """
    width, length = seconds * 1_000_000, seconds * 1_000_000 * span_windows
    held = rows.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]).alias("_row"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], micros(F.col(time), rows.schema[time].dataType).alias("_at"), *[m.alias(f"_m{i}") for i, m in enumerate(measures.values())])
    span = F.floor(F.col("_at") / F.lit(length))
    late = F.floor((F.col("_at") + width) / F.lit(length))  # the span in which the row still counts
    spread = held.withColumn("_own", span).withColumn("_span", F.explode(F.when(F.col("_at").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array(span, late)))))
    frame = Window.partitionBy(*[f"_k{i}" for i in range(len(by))], "_span").orderBy("_at").rangeBetween(-width, Window.currentRow)
    sums = [F.when(F.col("_at").isNotNull(), F.sum(f"_m{i}").over(frame)).alias(m) for i, m in enumerate(measures)]
    return spread.select("_row", "_own", "_span", *sums).filter("_own <=> _span").select("_row.*", *measures)
