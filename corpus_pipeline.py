"""From raw documents to shards of a training mix; every stage is one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from smelter.llm import decontam, mixing, parity_join, quality_eb, sharding
from smelter.llm.common import read_table, written

#: Words of a shingle, and percent of shingles in common from which documents are near copies.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps.

    Null and empty texts are judged by their host and path alone; equal rows are judged alike and
    keep their number; null hosts and paths are values of their own; an empty table stays empty.
    """
    judged = quality_eb.judge(docs, read_table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id.

    Rows of one id with different texts are different documents, and rows equal in id and text
    copies, of which one stays. A null id counts as the largest. Rows without words have no
    copies and all stay; an empty table stays empty.
    """
    return parity_join.representatives(docs, shingle=SHINGLE, percent=PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts have none and stay; equal rows stay or go together, whatever their
    ids; an empty table stays empty.
    """
    found = decontam.contaminated(docs, read_table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return found.filter("NOT contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes.

    Null and blank texts have no words: they go with the hashes of their source and count nothing.
    A null source is one of its own. Of equal rows as many are taken as come nearest to the
    target, whichever they are; an empty table stays empty.
    """
    return mixing.take(docs)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix.

    Null texts have a size of one byte; equal rows get slots of their own; an empty table gives none.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("sharding", shard_rows),
]

#: Learned weights and hashes decide what stays: SQL cannot express it. Tests compare each stage with
#: a plain version of it on what its predecessor kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
