"""Measured size bounds, asked before anything is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes: text by its length, eight for every other value."""
    return reduce(Column.__add__, (_field_bytes(field) for field in df.schema)).cast("bigint")


def _field_bytes(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(value))
    else:
        size = F.lit(0)
    return F.coalesce(size, F.lit(0)) + F.lit(8)


def is_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Whether a frame stays within both bounds.

    Rows are counted first, which reads no column of a stored table; only a frame with
    few rows is read for its bytes.
    """
    if df.count() > max_rows:
        return False
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Hint a frame for broadcast if it is measured to be small, else leave it alone.

    Without the hint the planner shuffles, and adaptive execution splits hot keys.
    """
    return F.broadcast(df) if is_small(df) else df
