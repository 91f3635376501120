"""What an increment reads and writes: buckets, deltas, rejects, profiles, streams, page indexes."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from smelter.operators.budget import admitted_pages, article_bytes, page_sizes
from smelter.operators.contract import valid_rows
from smelter.plans import bronze, medallion, quality as qa
from smelter.plans.bronze import accepted_articles, fetched_entries, page_rules
from smelter.plans.gold import moved_counts, trend_counts, trend_deltas
from smelter.plans.medallion import Layout, ensure_layers, ensure_rejects, load_increment, store_rejects
from smelter.plans.silver import silver_papers_counted
from smelter.schemas import DIM, FACT
from smelter.session import staged
from smelter.sources import paging, tables as tb
from smelter.sources.feed import read_page_stream
from smelter.streaming.ingest import collect_categories, collect_stream, ingest_first_copies, settle
from smelter.streaming.state import BrokenRules
from tests.test_feed import entry, feed, land, page_frame
from tests.test_skew import shuffled_rows


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def scanned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_rows(df):
    """Rows that the scans of a plan let through."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, rows = [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan], 0
    while todo:
        node = todo.pop()
        if "Scan" in node.nodeName():
            rows += node.metrics().apply("numOutputRows").value()
        if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


# Upserts by bucket


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    """One partition of 64,000 rows in 64 buckets."""
    spark.sql("CREATE SCHEMA IF NOT EXISTS inc")
    where = str(tmp_path_factory.mktemp("bucketed"))
    tb.ensure_table(spark, "inc.wide", "id string, body string, year int", ["year"], where, buckets=64, bucket_by=["id"])
    rows = spark.range(64_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.sha2((F.col("id") * 7).cast("string"), 512).alias("body"),
        F.lit(2024).alias("year"),
    )
    tb.overwrite_table(rows, "inc.wide")
    return where


def test_one_row_rewrites_its_bucket_only(spark, bucketed):
    before = folder_bytes(bucketed)
    held = set(spark.table("inc.wide").inputFiles())
    one = spark.table("inc.wide").limit(1).select("id", F.lit("new").alias("body"), "year")
    id = one.first()["id"]
    with staged(one, "one") as source:
        done = tb.upsert_table("inc.wide", source, ["id"])
    assert done["n_updated"] == 1 and done["n_inserted"] == 0 and 0 < done["n_unchanged"] < 64_000 / 32
    assert 0 < folder_bytes(bucketed) - before <= before / 32
    assert len(held - set(spark.table("inc.wide").inputFiles())) == 1
    assert spark.table("inc.wide").filter(F.col("id") == id).first()["body"] == "new"
    assert spark.table("inc.wide").count() == 64_000


def test_looking_for_a_few_keys_reads_a_few_rows(spark, bucketed):
    table = spark.table("inc.wide")
    source = tb._conform(table.limit(3).select("id", "body", "year"), "inc.wide")
    with staged(source, "few") as few:
        near = tb.near_rows(table, few, ["id"], tb._profile(few, ["id"], ["year", tb.KEY_BUCKET]))
        assert "PartitionFilters: [" in scanned(near) and "key_bucket" in scanned(near)
        assert near.count() == 3 and scan_rows(near) <= 3 * 2000


def test_bloom_filters_rule_row_groups_out(spark, bucketed):
    files = spark.table("inc.wide").inputFiles()
    plain = spark.read.option("parquet.filter.dictionary.enabled", "false").option("parquet.filter.columnindex.enabled", "false")
    absent = F.col("id") == "7" * 64
    known = plain.parquet(*files).select("id").filter(absent)
    blind = plain.option("parquet.filter.bloom.enabled", "false").parquet(*files).select("id").filter(absent)
    assert scan_rows(known) < scan_rows(blind) / 10


def test_bucketed_tables_live_like_others(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS inc")
    tb.ensure_table(spark, "inc.life", "id string, v int, year int", ["year"], str(tmp_path), buckets=4, bucket_by=["id"])
    frame = lambda rows, ddl="id string, v int, year int": spark.createDataFrame(rows, ddl)
    rows = lambda: {tuple(r) for r in spark.table("inc.life").select("id", "v", "year").collect()}
    first = [(str(i), i, 2020 + i % 3) for i in range(20)] + [(None, 1, 2020), (None, 1, None)]
    tb.overwrite_table(frame(first), "inc.life")
    assert rows() == set(first)
    tb.upsert_table("inc.life", frame([("1", 5, 2030), (None, 9, 2021), ("x", 1, None)]), ["id"])
    now = (set(first) - {("1", 1, 2021)}) | {("1", 5, 2030), (None, 9, 2021), ("x", 1, None)}
    assert rows() == now
    tb.replace_partitions(frame([("5", 6, 2022)]), "inc.life", {"year=2022"})
    assert rows() == {r for r in now if r[2] != 2022} | {("5", 6, 2022)}
    wider = frame([("a", 10**12, 2020)], "id string, v long, year int")
    tb.overwrite_table(wider, "inc.life", replace_schema=True)
    assert dict(spark.table("inc.life").dtypes)["v"] == "bigint" and tb.KEY_BUCKET in spark.table("inc.life").columns
    assert tb.upsert_table("inc.life", frame([("a", 1, 2021)]), ["id"])["n_updated"] == 1
    tb.truncate_table(spark, "inc.life")
    assert rows() == set()


def test_replaced_rows_are_told(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS inc")
    tb.ensure_table(spark, "inc.told", "id string, v int, year int", ["year"], str(tmp_path))
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, v int, year int")
    tb.overwrite_table(frame(("a", 1, 2020), ("b", 2, 2021), ("c", 3, 2021)), "inc.told")
    source = frame(("a", 9, 2022), ("b", 2, 2021), ("n", 1, 2020))
    with tb.upsert_changes("inc.told", source, ["id"], replaced_columns=["v"]) as changes:
        assert {r["id"] for r in changes.rows.collect()} == {"a", "n"}
        assert [(r["v"], r["year"]) for r in changes.replaced.collect()] == [(1, 2020)]
        assert changes.touched == {"year=2020", "year=2022"} and (changes.n_rows, changes.n_replaced) == (2, 1)
        assert tb.write_changes(changes) == {"n_inserted": 1, "n_updated": 1, "n_unchanged": 0}


# The fact by deltas


def layout(tmp_path, name, **more):
    return Layout(*(f"{name}.{t}" for t in ("bronze", "rejects", "silver", "dim", "fact")), str(tmp_path), **more)


def test_deltas_equal_counting_again(spark):
    rng = random.Random(3)
    codes = ["cs.ai", "cs.se", "x.gen", "CS.AI"]
    dim = spark.createDataFrame([("cs.AI", "A"), ("cs.SE", "S")], DIM)
    papers = {i: (2000 + rng.randrange(3), rng.choices(codes, k=rng.randrange(1, 4))) for i in range(40)}
    frame = lambda some: spark.createDataFrame(
        [(y, str(i), c) for i, (y, c) in some.items()], "publication_year int, id string, categories array<string>"
    )
    shown = lambda df: sorted(map(tuple, df.select("publication_year", "category_name", "paper_count").collect()))
    fact = trend_counts(frame(papers), dim)
    moved = {i: (2000 + rng.randrange(4), rng.choices(codes, k=2)) for i in (1, 5, 9, 60, 61)}
    gone = {i: papers[i] for i in moved if i in papers}
    deltas = trend_deltas(frame(moved), frame(gone), dim)
    assert shown(moved_counts(fact, deltas)) == shown(trend_counts(frame(papers | moved), dim))
    assert trend_deltas(frame(moved), frame(moved), dim).isEmpty()
    with pytest.raises(Exception, match="out of step"):
        moved_counts(fact.limit(0), trend_deltas(frame(moved).limit(0), frame(moved), dim)).collect()


def test_an_increment_counts_no_other_papers(spark, tmp_path, monkeypatch):
    where = layout(tmp_path, "deltas", buckets=4)
    ensure_layers(spark, where)
    load_increment(page_frame(spark, feed(*[entry(id=f"x/{i}") for i in range(9)])), where)
    plans, keep = [], medallion.trend_deltas
    monkeypatch.setattr(medallion, "trend_deltas", lambda *a: plans.append(keep(*a)) or plans[-1])
    monkeypatch.setattr(medallion, "trend_counts", lambda *a: pytest.fail("counted in full"))
    newer = entry(id="x/3", published="2020-01-01T00:00:00Z", updated="2030-01-01T00:00:00Z", terms=("cs.AI", "cs.SE"))
    assert load_increment(page_frame(spark, feed(newer)), where)["n_updated"] == 1
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plans and "publication_year" in plan and "deltas.silver" not in plan
    got = {(r["publication_year"], r["category_name"]): r["paper_count"] for r in spark.table(where.fact).collect()}
    assert got == {(2024, "Software Engineering"): 8, (2020, "Artificial Intelligence"): 1, (2020, "Software Engineering"): 1}


def test_new_names_count_all_papers_again(spark, tmp_path):
    where = layout(tmp_path, "names")
    ensure_layers(spark, where)
    load_increment(page_frame(spark, feed(entry(id="x/1"), entry(id="x/2"))), where)
    load_increment(page_frame(spark, feed(entry(id="x/3"))), where, names={"cs.SE": "New"})
    assert [tuple(r)[1:] for r in spark.table(where.fact).select("publication_year", "category_name", "paper_count").collect()] == [("New", 3)]


@pytest.mark.parametrize("step", ["write_changes", "refresh_gold", "replace_partitions", "upsert_bronze"])
def test_a_broken_increment_is_finished_by_the_next(spark, tmp_path, monkeypatch, step):
    where = layout(tmp_path, f"redo_{step}")
    ensure_layers(spark, where)
    load_increment(page_frame(spark, feed(entry(id="x/1"), entry(id="x/2"))), where)
    moved = page_frame(spark, feed(entry(id="x/1", published="2030-01-01T00:00:00Z", updated="2031-01-01T00:00:00Z")))
    with monkeypatch.context() as broken:
        broken.setattr(medallion, step, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            load_increment(moved, where)
    # The next batch is another one: the first is brought to its end all the same.
    load_increment(page_frame(spark, feed(entry(id="x/9"))), where)
    got = {r["publication_year"]: r["paper_count"] for r in spark.table(where.fact).collect()}
    assert got == {2024: 2, 2030: 1}
    assert {r["id"] for r in spark.table(where.bronze).filter("published_month = '2030-01'").collect()} == {"1"}
    assert tb.table_property(spark, where.bronze, "smelter.increment") is None


# Rejects and profiles


def test_rejects_are_written_near_their_pages(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS inc")
    ensure_rejects(spark, "inc.rej", str(tmp_path))
    bad = feed(entry(id="x/1", title=""), entry(id="x/2"))
    pages = spark.createDataFrame([("cs.AI", 0, bad), ("cs.SE", 5_000_000, bad), ("cs.CL", None, bad)], "category string, page_start long, payload string")
    assert store_rejects(fetched_entries(pages), "inc.rej") == 4
    before = set(spark.table("inc.rej").inputFiles())
    # A clean page of its own writes nothing.
    clean = page_frame(spark, feed(entry(id="x/3")), category="cs.LG")
    assert store_rejects(fetched_entries(clean), "inc.rej") == 0
    assert set(spark.table("inc.rej").inputFiles()) == before
    # Read again and clean: only the bucket of that page changes.
    again = page_frame(spark, feed(entry(id="x/1")), category="cs.AI")
    store_rejects(fetched_entries(again), "inc.rej")
    assert spark.table("inc.rej").count() == 3 and set(spark.table("inc.rej").inputFiles()) < before


def test_unlisted_categories_are_rejects(spark, tmp_path):
    where = layout(tmp_path, "unlisted")
    ensure_layers(spark, where)
    good = feed(entry(id="x/1"), entry(id="x/2"))
    rows = [("cs.AI", 0, good), ("econ.EM", 0, good), (None, 0, good)]
    pages = spark.createDataFrame(rows, "category string, page_start long, payload string")
    assert load_increment(pages, where)["n_inserted"] == 2
    rejects = spark.table(where.rejects).select("category", "_violations", "id").collect()
    assert sorted(map(tuple, rejects), key=str) == [("econ.EM", ["category_listed"], None), (None, ["category_listed"], None)]


def test_checks_read_profiles_until_the_fact_changes(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS inc")
    for name, ddl, parts in (("dim", DIM, ()), ("silver", "id string", ()), ("fact", FACT, ("publication_year",))):
        tb.ensure_table(spark, f"inc.p{name}", ddl, parts, str(tmp_path / name))
    names = ["inc.pdim", "inc.psilver", "inc.pfact"]
    fact = lambda *rows: spark.createDataFrame(list(rows), "category_name string, paper_count long, publication_year int")
    tb.overwrite_table(spark.createDataFrame([("1",)], "id string"), "inc.psilver")
    tb.overwrite_table(fact(("a", 1, 2020), ("b", 2, 2021), (None, 3, None)), "inc.pfact")
    result = lambda: sorted(map(tuple, qa.table_quality(spark, *names).collect()))
    plain = result()
    qa.profile_fact(spark, "inc.pfact")
    assert result() == plain and "inc.pfact[" not in scanned(qa.table_quality(spark, *names)).replace("spark_catalog.", "")
    tb.replace_partitions(fact(("c", -5, 2021)), "inc.pfact", {"publication_year=2021"})
    assert not qa.is_profiled(spark, "inc.pfact")
    scan = result()
    assert scan != plain
    qa.profile_fact(spark, "inc.pfact", {"publication_year=2021"})
    assert result() == scan
    tb.replace_partitions(fact(("d", 5, None)), "inc.pfact", {"publication_year=__HIVE_DEFAULT_PARTITION__"})
    scan = result()
    qa.profile_fact(spark, "inc.pfact", {"publication_year=__HIVE_DEFAULT_PARTITION__"})
    assert result() == scan and spark.table("inc.pfact_profile").count() == 3


# What travels


def test_first_articles_are_found_without_their_texts(spark):
    names = ["cs.CL", "cs.AI"]
    pages = [
        (names[p % 2], p, feed(*[entry(id=f"x/{(p * 7 + i) % 900}", title=f"{p}-{i}") for i in range(300)]))
        for p in range(12)
    ]
    frame = page_frame(spark, pages)
    with staged(fetched_entries(frame, names), "entries") as entries:
        want = sorted((r["id"], r["title"], tuple(r["fetched"])) for r in accepted_articles(entries).collect())
        with bronze.first_articles(entries) as articles:
            assert "SortAggregate" not in scanned(articles) and not shuffled_rows(articles)
            assert sorted((r["id"], r["title"], tuple(r["fetched"])) for r in articles.collect()) == want
    # Two pages in one place: places do not tell their entries apart.
    with staged(fetched_entries(frame.unionByName(frame), names), "entries") as twice:
        with bronze.first_articles(twice) as articles:
            assert sorted((r["id"], r["title"], tuple(r["fetched"])) for r in articles.collect()) == want


def test_long_texts_are_compared_by_digests(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS inc")
    tb.ensure_table(spark, "inc.texts", "id bigint, body string, year int", ["year"], str(tmp_path / "texts"))
    long = "t" * 500
    rows = [(0, None, 1), (1, "", 1), (2, long, 1), (3, "short", 2), (4, long, 2)]
    columns = "id bigint, body string, year int"
    tb.upsert_table("inc.texts", spark.createDataFrame(rows, columns), ["id"])
    new = [(0, "", 1), (1, None, 1), (2, long, 1), (3, "short", 2), (4, long + "t", 2), (5, None, 3)]
    with tb.upsert_changes("inc.texts", spark.createDataFrame(new, columns), ["id"], small_source=False) as changes:
        assert sorted(r["id"] for r in changes.rows.collect()) == [0, 1, 4, 5] and changes.n_replaced == 3
        done = tb.write_changes(changes)
    assert done == {"n_inserted": 1, "n_updated": 3, "n_unchanged": 2}
    assert sorted(map(tuple, spark.table("inc.texts").collect())) == new


def test_partitions_that_keep_nothing_are_not_read(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS inc")
    tb.ensure_table(spark, "inc.full", "id bigint, n int, year int", ["year"], str(tmp_path / "full"))
    rows = spark.range(90).select("id", F.lit(0).alias("n"), (F.col("id") % 3).cast("int").alias("year"))
    tb.upsert_table("inc.full", rows, ["id"])
    # One year is replaced whole, one in part, one moves away; one is left alone.
    newer = rows.filter("year = 0 OR (year = 1 AND id < 10)").withColumn("n", F.lit(1))
    newer = newer.unionByName(rows.filter("year = 2").select("id", F.lit(1).alias("n"), F.lit(7).alias("year")))
    with tb.upsert_changes("inc.full", newer, ["id"], small_source=False) as changes:
        target = spark.table("inc.full")
        assert tb._emptied(changes, target, ["year"]) == {"year=0", "year=2"}
        assert tb.write_changes(changes, gathered=True) == {"n_inserted": 0, "n_updated": 63, "n_unchanged": 27}
    got = {tuple(r) for r in spark.table("inc.full").collect()}
    assert got == {(i, int(i % 3 != 1 or i < 10), 7 if i % 3 == 2 else i % 3) for i in range(90)}


# Streams


def landed(tmp_path):
    land(tmp_path, "cs.CL", 0, feed(entry(id="x/1", title="CL"), entry(id="x/2", title="CL"), entry(id="x/8", title="")))
    land(tmp_path, "cs.AI", 1000, feed(entry(id="x/1", title="AI second page"), entry(id="x/3", title="AI second page")))
    land(tmp_path, "cs.AI", 0, feed(entry(id="x/1", title="AI"), entry(id="x/4", title="AI")))
    for i, place in enumerate(("CL/start=0", "AI/start=1000", "AI/start=0")):
        os.utime(tmp_path / f"landed/category=cs.{place}/page.xml", (1e9 + i, 1e9 + i))
    return str(tmp_path / "landed")


def test_only_first_copies_reach_the_table(spark, tmp_path, monkeypatch):
    from smelter.streaming import ingest

    source, merged = landed(tmp_path), []
    keep = ingest.upsert_bronze
    monkeypatch.setattr(ingest, "upsert_bronze", lambda rows, *a, **k: merged.append(sorted(r["id"] for r in rows.collect())) or keep(rows, *a, **k))
    spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
    listener = BrokenRules()
    spark.streams.addListener(listener)
    try:
        for again in (False, True):
            if again:
                # A worse copy, landed later: the state knows a better one.
                land(tmp_path, "cs.CL", 1000, feed(entry(id="x/1", title="late"), entry(id="x/5", title="late")))
                os.utime(f"{source}/category=cs.CL/start=1000/page.xml", (1e9 + 9, 1e9 + 9))
            pages = read_page_stream(spark, source, max_files=1)
            query = ingest_first_copies(pages, "streamed.firsts", str(tmp_path / "state"), location=str(tmp_path / "t"), rejects="streamed.firsts_rejects")
            query.awaitTermination()
        for _ in range(50):
            if listener.rows:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows = sorted(tuple(r) for r in spark.table("streamed.firsts").select("id", "title").collect())
    assert rows == [("1", "AI"), ("2", "CL"), ("3", "AI second page"), ("4", "AI"), ("5", "late")]
    assert [m for m in merged if m] == [["1", "2"], ["1", "3"], ["1", "4"], ["5"]]
    assert listener.rows == {"title_required": 1} and len(listener.batches) >= 3
    assert [r["id"] for r in spark.table("streamed.firsts_rejects").collect()] == ["8"]


@pytest.mark.parametrize("files", [1, 2, 5])
def test_a_budget_over_a_stream_is_that_of_one_pass(spark, tmp_path, files):
    source = landed(tmp_path)
    from smelter.sources.feed import read_pages

    entries = fetched_entries(read_pages(spark, source))
    sizes = page_sizes(valid_rows(entries, page_rules()), article_bytes())
    budget = sorted(r["page_bytes"] for r in sizes.collect())[0] + 1
    want = sorted(r["title"] for r in accepted_articles(entries, budget).collect())
    n_in = admitted_pages(sizes, budget).count()
    spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
    folder, names = str(tmp_path / "collected"), [f"streamed.{t}_{files}" for t in ("settled", "left")]
    assert settle(spark, folder, names[0], str(tmp_path / "t"))["n_inserted"] == 0
    collect_stream(read_page_stream(spark, source, max_files=files), folder, str(tmp_path / "state")).awaitTermination()
    done = settle(spark, folder, names[0], str(tmp_path / "t"), budget, names[1], keep=True)
    assert sorted(r["title"] for r in spark.table(names[0]).collect()) == want and done["n_inserted"] == len(want)
    assert spark.table(names[1]).count() == sizes.count() - n_in > 0
    assert settle(spark, folder, names[0], None, budget, names[1]) == {"n_inserted": 0, "n_updated": 0, "n_unchanged": 0}
    assert settle(spark, folder, names[0])["n_inserted"] == 0


@pytest.mark.parametrize("files", [1, 5])
def test_collecting_a_batch_is_one_job_and_chooses_no_copy(spark, tmp_path, files):
    source = landed(tmp_path)
    land(tmp_path, "cs.CL", 2000, feed(entry(id="x/1", title="newer", updated="2030-01-01T00:00:00Z")))
    spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
    folder, name = str(tmp_path / "collected"), f"streamed.collected_{files}"
    query = collect_stream(read_page_stream(spark, source, max_files=files), folder, str(tmp_path / "state"))
    query.awaitTermination()
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == (4 if files == 1 else 1)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) == len(batches)
    settle(spark, folder, name, str(tmp_path / "t"))
    titles = dict(tuple(r) for r in spark.table(name).select("id", "title").collect())
    assert titles == {"1": "newer", "2": "CL", "3": "AI second page", "4": "AI"}


def test_collected_first_copies_and_rejects_are_settled_once(spark, tmp_path):
    source, folder = landed(tmp_path), str(tmp_path / "collected")
    spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
    names = ["streamed.collected_firsts", "streamed.collected_rejects"]

    def run():
        pages = read_page_stream(spark, source, max_files=1)
        query = ingest_first_copies(
            pages, names[0], str(tmp_path / "state"), location=str(tmp_path / "t"), rejects=names[1], collected=folder
        )
        query.awaitTermination()
        batches = [p["batchId"] for p in query.recentProgress]
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) <= len(batches)
        done = settle(spark, folder, names[0], str(tmp_path / "t"), rejects=names[1])
        rows = sorted(tuple(r) for r in spark.table(names[0]).select("id", "title").collect())
        left = sorted(((r["id"], r["_violations"], r["page_start"]) for r in spark.table(names[1]).collect()), key=str)
        return done["n_inserted"], rows, left

    want = [("1", "AI"), ("2", "CL"), ("3", "AI second page"), ("4", "AI")]
    assert run() == (4, want, [("8", ["title_required"], 0)])
    # A worse copy, landed later, and a page without a category on the list.
    land(tmp_path, "cs.CL", 1000, feed(entry(id="x/1", title="late"), entry(id="x/5", title="late")))
    land(tmp_path, "no.NO", 0, feed(entry(id="x/9")))
    assert run() == (1, [*want, ("5", "late")], sorted([(None, ["category_listed"], 0), ("8", ["title_required"], 0)], key=str))


def test_state_is_cut_by_cores_and_batches_share_their_code(spark, tmp_path):
    source, folder = landed(tmp_path), str(tmp_path / "collected")
    spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        pages = read_page_stream(spark, source, max_files=1)
        query = ingest_first_copies(
            pages, "streamed.by_cores", str(tmp_path / "state"), location=str(tmp_path / "t"), collected=folder
        )
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert state and {s["numShufflePartitions"] for s in state} == {spark.sparkContext.defaultParallelism}
    plan = query._jsq.streamingQuery().lastExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    code = debug.codegenString(plan)
    assert "Generated code" in code and not re.search(r"\b1[78]\d{14}L", code)


@pytest.mark.parametrize("budget", [None, 400])
def test_categories_are_collected_side_by_side(spark, tmp_path, budget):
    """With pages that are read for their scopes, among them a broken one, and one of no listed category."""
    from smelter.sources.feed import read_pages

    source, atom = landed(tmp_path), "http://www.w3.org/2005/Atom"
    inner = entry(id="x/6", title="by scope").replace("<", "<a:").replace("<a:/", "</a:")
    land(tmp_path, "cs.CV", 0, f'<a:feed xmlns:a="{atom}">{inner}</a:feed>')
    land(tmp_path, "cs.CV", 1000, f'<a:feed xmlns:a="{atom}"><a:entry></a:feed>')
    land(tmp_path, "no.NO", 0, feed(entry(id="x/9")))
    entries = fetched_entries(read_pages(spark, source))
    want = {(r["id"], r["title"]) for r in accepted_articles(entries, budget).collect()}
    assert budget or ("6", "by scope") in want
    spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
    folder, name = str(tmp_path / "collected"), f"streamed.side_by_side_{budget}"
    for again in (False, True):
        collect_categories(spark, source, folder, str(tmp_path / "state"), max_files=1, side_by_side=2)
        done = settle(spark, folder, name, str(tmp_path / "t"), budget)
        assert done["n_inserted"] == (0 if again else len(want))
        assert {(r["id"], r["title"]) for r in spark.table(name).collect()} == want
    lanes = {p.name for p in (tmp_path / "state").iterdir()}
    assert lanes == {"category=cs.AI", "category=cs.CL", "category=cs.CV", "category=no.NO"}


def test_a_micro_batch_writes_its_own_rows_only(spark, tmp_path):
    """Batches of new articles of one month leave the rows of earlier ones where they are."""
    from smelter.streaming.ingest import ingest_stream

    for i in range(6):
        land(tmp_path, "cs.AI", i, feed(*[entry(id=f"x/{10 * i + k}") for k in range(10)]))
    spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
    pages = read_page_stream(spark, str(tmp_path / "landed"), max_files=1)
    ingest_stream(pages, "streamed.own_rows", str(tmp_path / "state"), location=str(tmp_path / "t")).awaitTermination()
    assert spark.table("streamed.own_rows").select("id").distinct().count() == 60
    # Every snapshot that was ever written is still there.
    assert spark.read.parquet(f"{tmp_path}/t/_snapshots/*/*/*").count() == 60


def test_loads_lose_rows_and_are_merged_in_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tb, "LOADS", 3)
    spark.sql("CREATE SCHEMA IF NOT EXISTS inc")
    tb.ensure_table(spark, "inc.loads", "k int, v int, p int", ["p"], str(tmp_path / "t"), loads=True)
    held, rng, seen = {}, random.Random(1), []
    for i in range(14):
        rows = {k: (k, i, k % 2) for k in rng.sample(range(1000), 5)} | {1000 + i: (1000 + i, i, 0)}
        # Older rows lose; k moves to another partition now and then.
        rows |= {k: (k, rng.choice([-1, i]), rng.randrange(3)) for k in rng.sample(sorted(held), min(3, len(held)))}
        won = {k: r for k, r in rows.items() if k not in held or r[1] > held[k][1]}
        source = spark.createDataFrame(list(rows.values()), "k int, v int, p int")
        done = tb.upsert_table("inc.loads", source, ["k"], "s.v > t.v")
        assert done["n_inserted"] == len(won.keys() - held.keys()) and done["n_updated"] == len(won.keys() & held.keys())
        held |= won
        assert sorted(tuple(r) for r in spark.table("inc.loads").select("k", "v", "p").collect()) == sorted(held.values())
        folders = tb._held_folders(spark, "inc.loads")
        seen += [f.partition(f"{tb.LOAD}=")[2].partition("-")[0] for f in folders]
        assert len(folders) <= 3 * 3 * 3
    assert set(seen) >= {"0", "1"}
    assert tb.upsert_table("inc.loads", source, ["k"], "s.v > t.v")["n_unchanged"] == 0
    # Equal rows change nothing; whole partitions are replaced and truncated with all of their loads.
    assert tb.upsert_table("inc.loads", spark.table("inc.loads").drop(tb.LOAD), ["k"])["n_updated"] == 0
    tb.replace_partitions(spark.createDataFrame([(7, 7, 2)], "k int, v int, p int"), "inc.loads", {"p=2"})
    assert [tuple(r)[:3] for r in spark.table("inc.loads").filter("p = 2").select("k", "v", "p").collect()] == [(7, 7, 2)]
    tb.overwrite_table(spark.createDataFrame([(1, "a", 2)], "k int, w string, p int"), "inc.loads", replace_schema=True)
    assert [tuple(r) for r in spark.table("inc.loads").select("k", "w", "p").collect()] == [(1, "a", 2)]
    assert tb.partition_columns(spark, "inc.loads") == ["p", tb.LOAD]
    tb.truncate_table(spark, "inc.loads")
    assert spark.table("inc.loads").count() == 0


# Pages from an index, copies as counts


def test_pages_come_from_one_range(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"{i:04}", None if i % 50 == 7 else f"2020-01-{1 + rng.randrange(28):02}", rng.sample(["a", "b", "c"], rng.randrange(4))) for i in range(1000)]
    rows += [(None, "2020-01-09", ["a"])]
    df = spark.createDataFrame(rows, "id string, published_date string, categories array<string>")
    path = str(tmp_path / "index")
    paging.build_page_index(df, path, F.col("categories"), fence_rows=100)
    order = paging.sort_columns(paging.NEWEST_FIRST)
    for group in "abc":
        all_rows = [r["id"] for r in df.filter(F.array_contains("categories", group)).orderBy(*order).collect()]
        for start, n in ((0, 10), (95, 120), (len(all_rows) - 3, 50), (5000, 5)):
            got = paging.seek_page(spark, path, start, n, group)
            assert [r["id"] for r in got.collect()] == all_rows[start:start + n] and got.columns == df.columns
    assert paging.seek_page(spark, path, 0, 5, "none").count() == 0
    deep = paging.seek_page(spark, path, 300, 20, "b")
    assert scan_rows(deep) <= 200 and "Exchange" not in scanned(deep)
    paging.build_page_index(df.limit(0), str(tmp_path / "empty"))
    assert paging.seek_page(spark, str(tmp_path / "empty"), 0, 5).columns == df.columns
    paging.build_page_index(df, str(tmp_path / "all"), fence_rows=100)
    everything = [r["id"] for r in df.orderBy(*order).collect()]
    assert [r["id"] for r in paging.seek_page(spark, str(tmp_path / "all"), 700, 40).collect()] == everything[700:740]


def test_copies_of_a_paper_stay_counts(spark):
    copies = spark.range(0, 300_000, 1, 8).select(
        F.lit("1").alias("id"), F.lit("T").alias("title"), F.lit("s").alias("summary"), F.array(F.lit("a")).alias("authors"),
        F.array(F.lit("cs.AI"), F.when(F.col("id") % 3 == 0, "ml"), F.lit("cs.AI")).alias("categories"),
        *[F.lit("2024-01-01").alias(c) for c in ("published_date", "updated_date")], F.lit("u").alias("pdf_url"),
    )
    counted = silver_papers_counted(copies)
    assert max(shuffled_rows(counted)) <= 16
    got = {r["category_code"]: r["n"] for r in counted.select(F.inline("category_counts")).collect()}
    assert got == {"cs.ai": 600_000, "ml.gen": 100_000}
