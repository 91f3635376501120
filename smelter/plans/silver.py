"""Bronze articles to silver papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.functions.categories import normalize_categories
from smelter.functions.text import as_date
from smelter.schemas import SILVER, SILVER_COLUMNS
from smelter.sources.tables import ensure_table, upsert_table


def publication_year() -> Column:
    """Year a paper is filed under, from its publication time or date."""
    return F.year(as_date(F.col("published_date")))


def silver_papers(articles: DataFrame) -> DataFrame:
    """Dates, publication year and clean categories; papers left without any vanish.

    One narrow stage: a row in is at most one row out, nothing is shuffled.
    """
    nothing = F.array().cast("array<string>")
    codes = F.coalesce(normalize_categories(F.col("categories")), nothing)
    # Dropping rows by exploding none or one list, not by a filter on its size: a filter
    # would be pushed below the projection and clean every list a second time.
    kept = F.explode(F.array_remove(F.array(codes), nothing))
    return articles.select(
        "id",
        "title",
        "summary",
        "authors",
        kept.alias("categories"),
        as_date(F.col("published_date")).alias("published_date"),
        as_date(F.col("updated_date")).alias("updated_date"),
        "pdf_url",
        publication_year().alias("publication_year"),
    )


def silver_papers_counted(articles: DataFrame) -> DataFrame:
    """Papers equal in everything but categories as one row, with a count for each category.

    ``category_counts`` says how often each category stands in the copies. Copies are counted before
    they travel, and stay counts: a paper that is there a billion times is one row per task in the
    shuffle, and a counter per category after it.
    """
    others = [c for c in SILVER_COLUMNS if c != "categories"]
    lists = silver_papers(articles).groupBy(*others, "categories").agg(F.count(F.lit(1)).alias("n_copies"))
    merged = lists.groupBy(*others).agg(F.collect_list(F.struct("categories", "n_copies")).alias("_lists"))
    codes = F.array_distinct(F.flatten(F.transform("_lists", lambda one: one["categories"])))

    def counted(code: Column) -> Column:
        def own(total: Column, one: Column) -> Column:
            return total + one["n_copies"] * F.size(F.filter(one["categories"], lambda c: c == code))

        return F.struct(code.alias("category_code"), F.aggregate("_lists", F.lit(0).cast("bigint"), own).alias("n"))

    return merged.select(*others, F.transform(codes, counted).alias("category_counts"))


def silver_papers_merged(articles: DataFrame) -> DataFrame:
    """The same with the categories of all copies in one list, repeats included, as grouping gives it.

    The list is as long as it has to be, and made from the counts in the last step. With unique ids
    there is nothing to merge: use :func:`silver_papers` and save the shuffles.
    """
    repeated = F.transform(
        "category_counts", lambda one: F.array_repeat(one["category_code"], one["n"].cast("int"))
    )
    return silver_papers_counted(articles).withColumn("categories", F.flatten(repeated)).select(SILVER_COLUMNS)


def ensure_silver(
    spark, name: str, location: str | None = None, using: str = "parquet", buckets: int = 0
) -> None:
    ensure_table(spark, name, SILVER, ["publication_year"], location, using, buckets, ["id"])


def upsert_silver(
    papers: DataFrame, name: str, stored: bool = False, gathered: bool = False
) -> dict[str, int]:
    """Replace stored papers by id. The papers come from a table with unique ids, or are one."""
    return upsert_table(
        name, papers, ["id"], on_duplicates="trusted", stored_source=stored, gathered=gathered
    )
