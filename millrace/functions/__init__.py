"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType


def exact_sum(col: Column, scale: int = 4) -> Column:
    """Sum of a money column held as double, free of the order of addition."""
    return F.sum(col.cast(f"decimal(18,{scale})")).cast("double")


def micros(time: Column, kind: DataType) -> Column:
    """Microseconds since 1970 of a time column of that type; those without a zone are read as they stand, whatever the session's zone."""
    if not isinstance(kind, TimestampNTZType):
        return F.unix_micros(time)
    days = F.date_diff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(time)) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def json_number(text: Column, path: str, kind: str = "bigint") -> Column:
    """The number at ``path`` of a JSON text, read once into a VARIANT; null where the text is no JSON, has nothing there, or something that is no such number."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)
