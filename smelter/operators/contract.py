"""Declarative record contract: valid rows, rejected rows with reasons, counts per reason."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATIONS = "_violations"


class Rule(NamedTuple):
    """A named condition. A null outcome counts as a violation."""

    name: str
    holds: Column


def required_text(column: str) -> Rule:
    return Rule(f"{column}_required", F.col(column).isNotNull() & (F.length(column) >= 1))


def required_list(column: str) -> Rule:
    """Present, non-empty and free of null elements."""
    values = F.col(column)
    return Rule(
        f"{column}_not_empty",
        values.isNotNull()
        & (F.size(values) > 0)
        & (F.size(F.array_compact(values)) == F.size(values)),
    )


def required_value(column: str) -> Rule:
    return Rule(f"{column}_present", F.col(column).isNotNull())


def article_rules() -> list[Rule]:
    """Contract of one article. The link may be empty but not missing."""
    return [
        required_text("id"),
        required_text("title"),
        required_text("summary"),
        required_list("authors"),
        required_list("categories"),
        required_value("published_date"),
        required_value("updated_date"),
        required_value("pdf_url"),
    ]


def _holds(rule: Rule) -> Column:
    return F.coalesce(rule.holds, F.lit(False))


def valid_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that keep every rule, as a plain conjunction that can reach the scan."""
    return df.filter(reduce(Column.__and__, (rule.holds for rule in rules)))


def with_violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the names of the broken rules."""
    broken = [F.when(~_holds(rule), F.lit(rule.name)) for rule in rules]
    return df.withColumn(VIOLATIONS, F.array_compact(F.array(*broken)))


def rejected_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break a rule, with the reasons."""
    return with_violations(df, rules).filter(F.size(VIOLATIONS) > 0)


def validate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split into valid and rejected rows; one bad row never stops the others."""
    return valid_rows(df, rules), rejected_rows(df, rules)


def broken_rules(rules: Sequence[Rule]) -> list[Column]:
    """Rows per broken rule, as aggregates to observe where rows pass anyway."""
    return [F.count_if(~_holds(rule)).alias(rule.name) for rule in rules]


def reject_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows per broken rule, from one scan and one map-side combined count per rule.

    Wide enough to count all rules at once instead of exploding a row per reason.
    """
    counts = df.agg(*broken_rules(rules))
    pairs = [
        F.struct(F.lit(rule.name).alias("rule"), F.col(rule.name).alias("n_rows"))
        for rule in rules
    ]
    return counts.select(F.inline(F.array(*pairs))).filter("n_rows > 0")
