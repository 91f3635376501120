"""Silver papers to the category dimension and the publication-trend fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smelter.operators.dimension import join_names, lookup
from smelter.schemas import CATEGORY_CODES, CATEGORY_NAMES


def named_codes(codes: DataFrame, names: Mapping[str, str] = CATEGORY_NAMES) -> DataFrame:
    """Dimension rows for a frame of codes; a code without a name is ``Unknown``."""
    return codes.select("category_code", lookup(F.col("category_code"), names).alias("category_name"))


def category_dim(
    spark: SparkSession,
    codes: Sequence[str] = CATEGORY_CODES,
    names: Mapping[str, str] = CATEGORY_NAMES,
) -> DataFrame:
    """The category dimension for a list of codes."""
    listed = F.explode(F.array(*[F.lit(code) for code in codes]))
    return named_codes(spark.range(0, 1, 1, 1).select(listed.alias("category_code")), names)


def check_codes(codes: Sequence[str] | Mapping[str, str]) -> None:
    """Raise on codes that are equal but for case: facts would fan out over them."""
    listed = list(codes)
    lowered = [code.lower() for code in listed]
    equal = sorted({code for code, low in zip(listed, lowered) if lowered.count(low) > 1})
    if equal:
        raise ValueError(f"codes that differ by case alone: {equal}")


def trend_counts(papers: DataFrame, dim: DataFrame) -> DataFrame:
    """Category occurrences per year and category name, in no order.

    Counted per code before the names are joined: the join sees one row per year and
    code however many papers there are, and a code that holds a third of all papers is
    already combined on the map side. Codes that share a name add up afterwards.
    """
    return _named_counts(papers, dim, F.count("id"))


def _named_counts(papers: DataFrame, dim: DataFrame, counted: Column) -> DataFrame:
    listed = papers.withColumn("category_code", F.explode("categories"))
    per_code = listed.groupBy("publication_year", "category_code").agg(counted.alias("code_count"))
    named = join_names(per_code, dim)
    return named.groupBy("publication_year", "category_name").agg(
        F.sum("code_count").alias("paper_count")
    )


def trend_deltas(added: DataFrame, removed: DataFrame, dim: DataFrame) -> DataFrame:
    """What papers that come in add to the counts, less what those they replace took part in."""
    columns = ["publication_year", "id", "categories"]
    signed = added.select(*columns, F.lit(1).alias("_sign")).unionByName(
        removed.select(*columns, F.lit(-1).alias("_sign"))
    )
    deltas = _named_counts(signed, dim, F.sum(F.when(F.col("id").isNotNull(), F.col("_sign")).otherwise(0)))
    return deltas.filter("paper_count <> 0")


def moved_counts(fact: DataFrame, deltas: DataFrame) -> DataFrame:
    """The fact after its deltas, both of the same years; counts that fall to zero go.

    A count below zero shows that the fact was not counted from the papers that change.
    """
    total = F.sum("paper_count")
    below = F.raise_error(F.lit("a count fell below zero: the fact is out of step, load it in full"))
    return (
        fact.select("publication_year", "category_name", "paper_count").unionByName(deltas)
        .groupBy("publication_year", "category_name").agg(total.alias("paper_count"))
        .filter("paper_count <> 0")
        .withColumn("paper_count", F.when(F.col("paper_count") > 0, F.col("paper_count")).otherwise(below))
    )


def publication_trends(papers: DataFrame, dim: DataFrame) -> DataFrame:
    """The counts with the latest year and the most frequent category first.

    Names decide ties. The order is for readers; the fact table is written without it.
    """
    return trend_counts(papers, dim).orderBy(
        F.desc("publication_year"), F.desc("paper_count"), "category_name"
    )
