"""Checks on the finished layers, as a report and as a gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smelter.sources.tables import INVALIDATED, ensure_table, in_partitions, overwrite_table, table_property

MAX_NULL_RATE = 0.05

REPORT = "check_no int, check string, passed boolean, observed double, threshold double"


class QualityError(AssertionError):
    """A check of the report failed."""


def year_totals(fact: DataFrame) -> DataFrame:
    """Papers per year, with the rows and nameless rows the other checks need."""
    return fact.groupBy("publication_year").agg(
        F.sum("paper_count").alias("n"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("category_name").isNull()).alias("n_nameless"),
    )


def null_rate(nulls, rows):
    """Share of nulls; an empty table counts as all null."""
    share = F.try_divide(nulls.cast("double"), rows.cast("double"))
    return F.coalesce(share, F.lit(1.0))


def fact_profile(fact: DataFrame) -> DataFrame:
    """One row for the whole fact, from one scan: totals are rolled up from the years."""
    return merged_profiles(year_totals(fact))


def merged_profiles(years: DataFrame) -> DataFrame:
    """The profile of a fact from those of its years."""
    return years.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_nameless"), F.lit(0)).alias("n_nameless"),
        F.count_if(F.col("n") <= 0).alias("n_bad_years"),
    )


# A stored fact whose profile is up to date has this property; every write to it takes it away.
PROFILED = INVALIDATED[0]

PROFILE = "publication_year int, n bigint, n_rows bigint, n_nameless bigint"


def profile_name(fact: str) -> str:
    return f"{fact}_profile"


def profile_fact(spark: SparkSession, fact: str, years: set[str] | None = None) -> None:
    """Bring the stored profile of a fact up to date: of the named partitions only, or of all.

    A row per year is kept beside the fact. Profiles of years merge into that of the whole, so a check
    after an increment looks at the years that changed and at no others.
    """
    name = profile_name(fact)
    ensure_table(spark, name, PROFILE)
    stored, table = spark.table(name), spark.table(fact)
    if years is None:
        fresh = year_totals(table)
    else:
        changed = in_partitions(table, ["publication_year"], years)
        fresh = year_totals(table.filter(changed)).unionByName(stored.filter(~F.coalesce(
            in_partitions(stored, ["publication_year"], years), F.lit(False)
        )))
    overwrite_table(fresh, name)
    spark.sql(f"ALTER TABLE {fact} SET TBLPROPERTIES ('{PROFILED}' = 'true')")


def is_profiled(spark: SparkSession, fact: str) -> bool:
    return table_property(spark, fact, PROFILED) is not None


def quality_report(
    silver: DataFrame, fact: DataFrame, max_null_rate: float = MAX_NULL_RATE
) -> DataFrame:
    """One row per check, numbered in the order in which a failure counts."""
    return _report(silver, fact_profile(fact), max_null_rate)


def _report(silver: DataFrame, profile: DataFrame, max_null_rate: float = MAX_NULL_RATE) -> DataFrame:
    silver_check = silver.limit(1).agg(F.count(F.lit(1)).alias("n_rows"))
    rows, nameless, bad = F.col("n_rows"), F.col("n_nameless"), F.col("n_bad_years")
    rate = null_rate(nameless, rows)
    checks = F.array(
        _check(2, "fact_not_empty", rows > 0, F.least(rows, F.lit(1)), 1),
        _check(3, "category_name_null_rate", rate <= max_null_rate, rate, max_null_rate),
        _check(4, "year_totals_positive", bad == 0, bad, 0),
    )
    return (
        silver_check.select(_check(1, "silver_not_empty", rows > 0, rows, 1).alias("c"))
        .unionByName(profile.select(F.explode(checks).alias("c")))
        .select("c.*")
    )


def _check(number, name, passed, observed, threshold):
    return F.struct(
        F.lit(number).alias("check_no"),
        F.lit(name).alias("check"),
        passed.alias("passed"),
        observed.cast("double").alias("observed"),
        F.lit(float(threshold)).alias("threshold"),
    )


def missing_tables(spark: SparkSession, names: Sequence[str]) -> list[str]:
    """Which of the tables the catalog does not know, in the given order."""
    return [name for name in names if not spark.catalog.tableExists(name)]


def tables_report(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """A report row per table, numbered to come before all other checks."""
    missing = set(missing_tables(spark, names))
    rows = [
        (i - len(names), f"table_exists:{name}", name not in missing, float(name not in missing), 1.0)
        for i, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, REPORT)


def table_quality(spark: SparkSession, dim: str, silver: str, fact: str) -> DataFrame:
    """The whole report for stored tables; contents are looked at once all tables exist.

    A fact with an up-to-date profile is not scanned: the profile tells.
    """
    present = tables_report(spark, [dim, silver, fact])
    if missing_tables(spark, [silver, fact]):
        return present
    if is_profiled(spark, fact):
        profile = merged_profiles(spark.table(profile_name(fact)))
    else:
        profile = fact_profile(spark.table(fact))
    return present.unionByName(_report(spark.table(silver), profile))


def assert_quality(report: DataFrame) -> None:
    """Raise on the first failed check."""
    failed = report.filter(~F.col("passed")).orderBy("check_no").first()
    if failed is not None:
        raise QualityError(
            f"{failed['check']}: observed {failed['observed']}, allowed {failed['threshold']}"
        )
