"""Joining facts to a small dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.operators.bounds import bounded_broadcast
from smelter.operators.dedupe import duplicate_keys


def lowered_dimension(dim: DataFrame, code: str = "category_code", name: str = "category_name"):
    """Join key in lower case plus the name; nothing else of the dimension is carried."""
    return dim.select(F.lower(code).alias("_code_key"), F.col(name))


def join_names(
    facts: DataFrame, dim: DataFrame, code: str = "category_code", name: str = "category_name"
) -> DataFrame:
    """Add the name for a code, ignoring case; an unknown code names itself.

    Every fact row survives. Dimension codes are expected to differ beyond case
    (see :func:`colliding_codes`), else the facts fan out.
    """
    keyed = facts.withColumn("_code_key", F.lower(code))
    joined = keyed.join(bounded_broadcast(lowered_dimension(dim, code, name)), "_code_key", "left")
    return joined.withColumn(name, F.coalesce(name, code)).drop("_code_key")


def colliding_codes(dim: DataFrame, code: str = "category_code") -> DataFrame:
    """Codes that are equal once lowered."""
    return duplicate_keys(dim.select(F.lower(code).alias(code)), [code])


def lookup(code: Column, names: dict[str, str], default: str = "Unknown") -> Column:
    """Name of a code from a small fixed mapping, held in the plan instead of joined."""
    pairs = [F.lit(text) for pair in names.items() for text in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), F.lit(default))
