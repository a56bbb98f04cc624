"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
#: The setting may lower the limit or raise it to this: as many numbers reach the driver.
MOST_BROADCAST_ROWS = 1_000_000
BROADCAST_ROWS_SETTING = "spark.evenkeel.broadcastRows"


def row_bytes(schema: T.StructType) -> Column:
    """Size of a row's values: exact for text, JSON length for nested values, 8 for the rest."""
    fixed, parts = 0, []
    for field in schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            fixed += 8
    return sum(parts, F.lit(fixed)).cast("long")


def fits(df: DataFrame, max_rows: int | None = None, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the whole frame is within both limits; the first is a setting of the session.

    ``take`` reads a first partition and widens only while it has too few rows,
    so on a large frame this stops early; what reaches the driver is at most
    ``max_rows + 1`` numbers.
    """
    if max_rows is None:
        max_rows = int(df.sparkSession.conf.get(BROADCAST_ROWS_SETTING, str(BROADCAST_ROWS)))
    max_rows = min(max_rows, MOST_BROADCAST_ROWS)
    if max_rows <= 0:
        return False
    widths = df.select(row_bytes(df.schema).alias("b")).take(max_rows + 1)
    return len(widths) <= max_rows and sum(r.b for r in widths) <= max_bytes


def broadcast_if_fits(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The frame with a broadcast hint if it was measured to fit, else as it is."""
    return F.broadcast(df) if fits(df, max_rows) else df
