"""One row per key, chosen by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row that comes first in ``order_by`` for every key; null keys count as one key.

    An aggregate rather than ``row_number``: copies are combined before the shuffle,
    so a key that holds a third of all rows sends one row per task instead of
    sorting all its copies in one. ``order_by`` has to decide every tie.
    """
    return _keep(df, keys, F.min_by(F.struct(*df.columns), F.struct(*order_by)))


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row that comes last in ``order_by`` for every key."""
    return _keep(df, keys, F.max_by(F.struct(*df.columns), F.struct(*order_by)))


def _keep(df: DataFrame, keys, chosen) -> DataFrame:
    picked = df.groupBy(*keys).agg(chosen.alias("_kept"))
    return picked.select("_kept.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without nulls that occur more than once. Reads the key columns only."""
    return df.dropna(subset=list(keys)).groupBy(*keys).count().filter("count > 1")
