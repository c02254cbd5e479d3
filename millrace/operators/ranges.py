"""Range joins: points that lie in intervals, without a broadcast and without all against all; and counts of them without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals that are broadcast to be held against every point: so few that this is cheaper than to deal out the points.
FEW = 32
#: Interval lengths of 2 ** LEVELS and more, infinite ones too, share the top level, of a single cell.
LEVELS = 1000
#: Bits of a whole number that one step of a running total over its 64 bits goes through: no task sorts more than 2 ** DIGIT rows of one group.
DIGIT = 16


def cell(x: Column, level: Column) -> Column:
    """Number of the cell, ``2 ** level`` wide, that holds x; exact, as the width is a power of two."""
    at = x / F.pow(F.lit(2.0), level)
    # from 2 ** 53 on every double is whole, and floor() would leave the range of its bigint
    return F.when(level >= LEVELS, F.lit(0.0)).when(F.abs(at) >= 2.0**53, at).otherwise(F.floor(at).cast("double"))


def levelled(bands: DataFrame, low: str, high: str) -> DataFrame:
    """``bands`` with _level: the power of two next above their length. Empty and inverted ones go, and those with a bound that is null or NaN."""
    length = F.col(high).cast("double") - F.col(low).cast("double")
    held = bands.filter((F.col(low) < F.col(high)) & ~F.isnan(F.col(low).cast("double")) & ~F.isnan(F.col(high).cast("double")))
    # lengths that vanish in double precision still have a level, the lowest
    above = F.floor(F.log2(length)) + 1
    level = F.when(length <= 0, F.lit(-LEVELS)).when(length >= 2.0**LEVELS, F.lit(LEVELS)).otherwise(F.greatest(above, F.lit(-LEVELS)))
    return held.withColumn("_level", level.cast("int"))


def range_join(points: DataFrame, bands: DataFrame, point: str, low: str, high: str, few: int = FEW) -> DataFrame:
    """Each row of ``points`` with each row of ``bands`` for which ``low <= point < high``; the tables' other column names must differ.

    Bands go by their length to levels of cells as wide as the next power of two, where each lies in one or two cells. A point goes to its cell of every level that some band
    is on, so the two meet by an equality join that Spark can deal out, and split where cells are crowded; the inequality then decides on the
    columns as they are. A band covers at least a quarter of the cells it is in, so pairs that meet in vain stay in proportion to those found.
    Only if there are at most ``few`` bands, which is counted, they are broadcast instead.

    Points and bounds are numbers of any kind. Nulls and NaN match nothing; infinite bounds hold all on their side; repeated rows and ties each
    match on their own. Empty tables give no rows.
    """
    number = ~F.isnan(F.col(point).cast("double")) & ~F.isnan(F.col(low).cast("double")) & ~F.isnan(F.col(high).cast("double"))
    within = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)) & number
    if bands.select(F.lit(1)).limit(few + 1).count() <= few:
        return points.join(F.broadcast(bands), within)
    made = levelled(bands, low, high)
    levels = sorted(r["_level"] for r in made.select("_level").distinct().collect())  # at most 2 * LEVELS + 1, mostly a handful
    ends = [cell(F.col(c).cast("double"), F.col("_level")) for c in (low, high)]
    left = made.withColumn("_cell", F.explode(F.array_distinct(F.array(*ends))))
    right = points.filter(F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double")))
    right = right.withColumn("_on", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_at", cell(F.col(point).cast("double"), F.col("_on")))
    met = right.hint("merge").join(left, (F.col("_on") == F.col("_level")) & (F.col("_at") == F.col("_cell")) & within)
    return met.drop("_on", "_at", "_level", "_cell")


def range_counts(points: DataFrame, bands: DataFrame, point: str, low: str, high: str, out: str) -> DataFrame:
    """``points`` with ``out``: the number of rows of ``bands`` for which ``low <= point < high``.

    As many as have begun by the point, less those that have ended: a running total over the different values of bounds and points, so the work goes by the rows
    of both tables, never by the pairs. The total is carried down a tree over the values' bits, DIGIT at a time: each node's sum is added to what lies
    before its parent and before it in its parent, which are at most 2 ** DIGIT rows however the values crowd.

    Points and bounds are longs. Null points are in no band, bands with a null bound, empty and inverted ones hold no point: they count 0. Repeated rows
    count each; empty tables are allowed. Points may have any columns but ``out`` and _at.
    """
    held = bands.filter(F.col(low) < F.col(high))
    ends = held.select(F.inline(F.array(F.struct(F.col(low).alias("_at"), F.lit(1).cast("long").alias("_step")), F.struct(F.col(high).alias("_at"), F.lit(-1).cast("long").alias("_step")))))
    asked = points.filter(F.col(point).isNotNull()).select(F.col(point).alias("_at"), F.lit(0).cast("long").alias("_step"))
    sums = [ends.unionByName(asked).groupBy("_at").agg(F.sum("_step").alias("_step"))]
    for _ in range(DIGIT, 64, DIGIT):
        sums.append(sums[-1].groupBy(F.shiftright("_at", DIGIT).alias("_at")).agg(F.sum("_step").alias("_step")))
    before = Window.partitionBy("_up").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    total = None
    for level in reversed(sums):  # _before: the sum of all that comes before a node
        inside = F.coalesce(F.sum("_step").over(before), F.lit(0).cast("long"))
        if total is None:
            total = level.withColumn("_up", F.lit(0)).select("_at", "_step", inside.alias("_before"))
            continue
        above = total.select(F.col("_at").alias("_node"), F.col("_before").alias("_carried"))
        met = level.withColumn("_up", F.shiftright("_at", DIGIT)).join(above.hint("merge"), F.col("_up") == F.col("_node"))
        total = met.select("_at", "_step", (F.col("_carried") + inside).alias("_before"))
    counts = total.select("_at", (F.col("_before") + F.col("_step")).alias(out))
    found = points.join(counts.hint("merge"), F.col(point) == F.col("_at"), "left")
    return found.withColumn(out, F.coalesce(out, F.lit(0).cast("long"))).drop("_at")
