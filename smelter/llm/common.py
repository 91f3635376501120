"""What several operators share: words, tables written once, bounded join sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smelter.operators.bounds import is_small
from smelter.session import remove, scratch_path

# Words stand between ASCII white space (space, tab, line feed to carriage return). Splitting
# at separators takes a sixth of the time that extracting every match does.
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes that travel to a Python worker at once. A batch stands there, and beside the heap of its executor.
BATCH_BYTES = 2 * 1024**2


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, read many times.

    Cuts the lineage at files that every executor reaches, so a lost executor costs
    no more than its running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean_batches(df: DataFrame) -> DataFrame:
    """The frame; its session hands rows to Python a few MB at a time from now on.

    Batches are else bounded by their rows, ten thousand texts of whatever length. What is
    computed does not depend on where batches end.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def discard(df: DataFrame) -> None:
    """Remove a written table. Nothing that reads it may run later."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rpartition("/")[0])


def small_side(df: DataFrame) -> DataFrame:
    """A written table, hinted for broadcast if it is measured to be small.

    Beyond the bound the join shuffles, and adaptive execution splits its hot keys.
    """
    return F.broadcast(df) if is_small(df) else df


def words(text: Column | str) -> Column:
    """All words of a text; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return split_at(F.coalesce(text, F.lit("")), SPACE)


def split_at(text: Column, separators: str) -> Column:
    """What stands between separators, without empty pieces."""
    return F.array_remove(F.split(text, separators), "")


def ascii_lower(text: Column | str) -> Column:
    """A to Z in lower case, every other character as it is; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Names a row by its content: equal rows share a key, others of the same id do not."""
    return [
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("_hash"),
    ]
