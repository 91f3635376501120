"""A third of all rows shares one key, day, code, partition, or has none."""

import pytest
from pyspark.sql import functions as F

from smelter.operators.dedupe import keep_first
from smelter.operators.numbering import number_rows
from smelter.operators.upsert import upsert_actions, upsert_counts
from smelter.plans.gold import category_dim, trend_counts
from smelter.plans.silver import silver_papers_merged
from smelter.sources import tables as tb

ROWS = 90_000
THIRD = ROWS // 3


def third(hot, other):
    return F.when(F.col("n") % 3 == 0, hot).otherwise(other)


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(0, ROWS, 1, 12).withColumnRenamed("id", "n")


def shuffled_rows(df):
    """Rows that enter the exchanges of a plan, as counted while it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_copies_of_a_hot_key_are_combined_before_the_shuffle(spark, base):
    df = base.select(third(F.lit(-1), F.col("n")).alias("k"), "n", F.lit("text").alias("t"))
    first = keep_first(df, ["k"], ["n"])
    assert first.filter("k = -1").first()["n"] == 0
    assert first.count() == ROWS - THIRD + 1
    # One row per task for the hot key, and one for every other key.
    assert max(shuffled_rows(first)) <= ROWS - THIRD + 12


@pytest.mark.parametrize("small", [True, False])
def test_rows_without_a_key_stay_out_of_the_join(spark, base, small):
    df = base.select(third(F.lit(None).cast("bigint"), F.col("n")).alias("id"), "n")
    actions = upsert_actions(
        df, df.withColumn("n", F.col("n") + 1), ["id"], "s.n > t.n",
        on_duplicates="trusted", small_source=small,
    )
    assert upsert_counts(actions).first().asDict() == {
        "n_inserted": THIRD, "n_updated": ROWS - THIRD, "n_unchanged": THIRD,
    }
    if not small:
        assert max(shuffled_rows(actions)) <= ROWS - THIRD


def test_a_hot_day_does_not_disturb_the_numbers(spark, base):
    df = base.select(third(F.lit("hot"), F.col("n").cast("string")).alias("day"), "n")
    numbered = number_rows(df, [F.desc("day"), F.asc("n")], "at")
    stats = numbered.agg(F.min("at"), F.max("at"), F.countDistinct("at")).first()
    assert tuple(stats) == (1, ROWS, ROWS)
    hot = numbered.filter("day = 'hot'").agg(F.min("at"), F.max("at"), F.max(F.col("at") - F.col("n") / 3))
    low, high, offset = hot.first()
    assert (low, high - low, offset) == (1, THIRD - 1, 1)


def test_a_hot_code_is_counted_before_the_join(spark, base):
    papers = base.select(
        F.col("n").cast("string").alias("id"), F.lit(2024).alias("publication_year"),
        F.array(third(F.lit("cs.ai"), F.lit("cs.db")), F.lit("cs.lg")).alias("categories"),
    )
    counts = trend_counts(papers, category_dim(spark))
    assert {r["category_name"]: r["paper_count"] for r in counts.collect()} == {
        "Artificial Intelligence": THIRD, "Databases": ROWS - THIRD, "Machine Learning": ROWS,
    }
    assert max(shuffled_rows(counts)) <= 3 * 12


def test_copies_of_one_paper_are_counted_before_the_shuffle(spark, base):
    text = lambda name: F.lit(name).alias(name)
    articles = base.select(
        third(F.lit("hot"), F.col("n").cast("string")).alias("id"), text("title"), text("summary"),
        F.array(F.lit("a")).alias("authors"), F.array(F.lit("cs.AI")).alias("categories"),
        F.lit("2024-01-01").alias("published_date"), F.lit("2024-01-01").alias("updated_date"),
        text("pdf_url"),
    )
    merged = silver_papers_merged(articles).select("id", F.size("categories").alias("n"))
    assert merged.filter("id = 'hot'").first()["n"] == THIRD
    assert merged.filter("n > 1").count() == 1
    assert max(shuffled_rows(merged)) <= ROWS - THIRD + 12


def test_a_hot_partition_is_written_whole(spark, base, tmp_path):
    tb.ensure_schema(spark, "lab")
    spark.sql("DROP TABLE IF EXISTS lab.hot")
    tb.ensure_table(spark, "lab.hot", "n bigint, year int", ["year"], str(tmp_path / "hot"))
    df = base.select("n", third(F.lit(1999), F.col("n") % 7 + 2000).cast("int").alias("year"))
    tb.overwrite_table(df, "lab.hot")
    done = tb.upsert_table("lab.hot", df.filter("year = 1999").withColumn("year", F.lit(2003)), ["n"])
    assert done["n_updated"] == THIRD
    stored = spark.table("lab.hot")
    assert stored.count() == stored.select("n").distinct().count() == ROWS
    assert stored.filter("year = 1999").isEmpty()
