"""What several operators share: checkpoints, column names, slices of batches, distributed running totals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources import shared_folder as shared_folder

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges into which a hash deals the rows of one group, however large it is.
BUCKETS = 1024


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage ends here."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet to ``folder`` and read back, for loops.

    A checkpoint keeps the planner's estimate of its size, which is a product over all joins that led to it: carried through a
    loop, that number alone grows to millions of digits. Files have the size that they have.
    """
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> Column:
    """The column of just that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, docs: DataFrame) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    had = {c.lower() for c in docs.columns}
    while name.lower() in had:
        name += "_"
    return name


def aside(docs: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of these names renamed, and the columns that give all of ``docs`` back by its own names."""
    given = {c: unused(f"_{c}", docs) if c.lower() in names else c for c in docs.columns}
    return docs.select(*[col(c).alias(n) for c, n in given.items()]), [col(n).alias(c) for c, n in given.items()]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with plain names c0, c1 and so on: ``mapInArrow`` takes no names with dots."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def slices(batch: pa.RecordBatch, at_text: int, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and, unless a single text is longer, ``size`` bytes of text."""
    begin, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at_text)), 0).to_pylist()):
        if i > begin and (i - begin >= rows or total + n > size):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before.

    Rows come in the order of ``_bucket``, then ``order``. ``_bucket`` (a column of
    ``df``) cuts every group into ranges, so no task sorts more than one
    range of a group: sums per range are aggregated first, the ranges' offsets are a
    window over at most as many rows as there are ranges, and one shuffle on (group,
    range) serves both the join and the window within a range.
    """
    keys = [*group, "_bucket"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets.hint("merge"), on)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_offset", *[f"_k{i}" for i in range(len(keys))])
    )
