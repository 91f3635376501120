import datetime as dt
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from smelter.plans import quality as qa
from smelter.plans.gold import category_dim, check_codes, named_codes, publication_trends, trend_counts
from smelter.plans.medallion import (
    NOTHING_DONE, Layout, ensure_layers, load_bronze, load_increment, load_silver, run_medallion,
)
from smelter.plans.silver import silver_papers, silver_papers_merged
from smelter.schemas import BRONZE, CATEGORY_CODES, DIM, FACT, SILVER_COLUMNS
from smelter.session import get_session, shared_folder, staged
from smelter.sources.feed import read_page_stream
from smelter.streaming.ingest import ingest_stream, layers_stream
from tests.test_feed import entry, feed, land, page_frame


def articles(spark, rows):
    ddl = BRONZE.replace("timestamp", "string")
    full = [(i, f"T{i}", "s", ["a"], cats, day, day, "u") for i, cats, day in rows]
    return spark.createDataFrame(full, ddl)


def test_silver(spark):
    df = articles(spark, [
        ("A", ["cs.NI (Networking)"], "2019-07-30T23:59:59Z"),
        ("B", ["cs.GR - rendering", "cs.OS"], "2021-12-31T08:15:00Z"),
        ("C", ["optics"], "2018-03-03T03:03:03Z"),
        ("D", None, "2023-05-05T10:00:00Z"), ("E", [], "2023-05-05T10:00:00Z"),
        ("F", [" (junk)", ""], "2023-05-05T10:00:00Z"), ("G", ["cs.DB"], "garbage"),
    ])
    out = silver_papers(df)
    assert out.columns == SILVER_COLUMNS
    got = {r["id"]: (r["categories"], r["publication_year"]) for r in out.collect()}
    assert got == {
        "A": (["cs.ni"], 2019), "B": (["cs.gr", "cs.os"], 2021), "C": (["optics.gen"], 2018),
        "G": (["cs.db"], None),
    }
    assert dict(out.dtypes)["published_date"] == "date"
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_merged_form_agrees_on_unique_ids_and_merges_copies(spark):
    rng = random.Random(2)
    pool = ["cs.AI", "cs.AI (x)", "ml", "", None, "cs.CL - y, cs.DB", " (z)"]
    rows = [(str(i), [rng.choice(pool) for _ in range(rng.randrange(4))], "2024-01-01") for i in range(60)]
    df = articles(spark, rows)
    order = lambda out: sorted((r["id"], sorted(r["categories"])) for r in out.collect())
    assert order(silver_papers(df)) == order(silver_papers_merged(df))
    copies = articles(spark, [("1", ["cs.AI"], "2024-01-01")] * 3 + [("1", ["ml"], "2024-01-01")])
    assert order(silver_papers_merged(copies)) == [("1", ["cs.ai"] * 3 + ["ml.gen"])]


def papers(spark, rows):
    return spark.createDataFrame(rows, "id string, publication_year bigint, categories array<string>")


def test_trends(spark):
    df = papers(spark, [
        ("a7", 2019, ["cs.ni", "cs.gr"]), ("b8", 2019, ["cs.gr"]), ("c9", 2011, ["cs.os"]),
        ("d0", 2011, ["cs.os", "cs.os", "math.nt"]), (None, 2008, ["cs.gr"]), ("e1", None, ["cs.gr"]),
    ])
    dim = spark.createDataFrame(
        [("cs.NI", "Networks"), ("cs.GR", "Graphics"), ("cs.OS", "Systems")], DIM
    )
    got = [tuple(r) for r in publication_trends(df, dim).collect()]
    assert got == [
        (2019, "Graphics", 2), (2019, "Networks", 1),
        (2011, "Systems", 3), (2011, "math.nt", 1),
        (2008, "Graphics", 0), (None, "Graphics", 1),
    ]


def test_codes_sharing_a_name_add_up(spark):
    dim = spark.createDataFrame([("a.x", "N"), ("b.x", "N")], DIM)
    got = trend_counts(papers(spark, [("1", 2024, ["a.x", "b.x"])]), dim).collect()
    assert [tuple(r) for r in got] == [(2024, "N", 2)]


def test_category_dim(spark):
    got = category_dim(spark, ["cs.AI", "cs.CL", "cs.XY"]).collect()
    assert [r["category_name"] for r in got] == [
        "Artificial Intelligence", "Computation and Language", "Unknown",
    ]
    assert category_dim(spark).count() == len(CATEGORY_CODES) == 40
    assert named_codes(category_dim(spark)).filter("category_name = 'Unknown'").isEmpty()


def fact(spark, nameless=0, named=10, counts=((2024, 5),)):
    rows = [(None, 1, 2024)] * nameless + [("x", 1, 2024)] * named
    return spark.createDataFrame(rows + [("y", n, y) for y, n in counts], FACT)


def outcome(spark, silver_rows, fact_df):
    report = qa.quality_report(spark.range(silver_rows), fact_df)
    return {r["check"]: r["passed"] for r in report.collect()}, report


@pytest.mark.parametrize(
    "silver_rows, fact_args, failed",
    [
        (5, {}, None),
        (0, {}, "silver_not_empty"),
        (5, {"nameless": 5, "named": 95, "counts": ()}, None),
        (5, {"nameless": 6, "named": 94, "counts": ()}, "category_name_null_rate"),
        (5, {"counts": ((2020, 0),)}, "year_totals_positive"),
        (5, {"counts": ((2020, -3), (2020, 3))}, "year_totals_positive"),
        (5, {"counts": ((2020, None),)}, None),
    ],
)
def test_quality(spark, silver_rows, fact_args, failed):
    checks, report = outcome(spark, silver_rows, fact(spark, **fact_args))
    assert [c for c, ok in checks.items() if not ok] == ([failed] if failed else [])
    if failed:
        with pytest.raises(qa.QualityError, match=failed):
            qa.assert_quality(report)
    else:
        qa.assert_quality(report)


def test_empty_fact_fails_as_such_first(spark):
    checks, report = outcome(spark, 5, fact(spark).limit(0))
    assert not checks["fact_not_empty"] and not checks["category_name_null_rate"]
    with pytest.raises(qa.QualityError, match="fact_not_empty"):
        qa.assert_quality(report)


def test_fact_is_scanned_once(spark, tmp_path):
    fact(spark).write.parquet(str(tmp_path / "f"))
    profile = qa.fact_profile(spark.read.parquet(str(tmp_path / "f")))
    assert profile._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def layout(tmp_path, name):
    return Layout(*(f"{name}.{t}" for t in ("bronze", "rejects", "silver", "dim", "fact")), str(tmp_path))


def test_all_layers(spark, tmp_path):
    where = layout(tmp_path, "e2e")
    pages = page_frame(
        spark,
        feed(entry(id="x/1v1", terms=("cs.SE", "cs.AI")), entry(id="x/2v1", title="")),
        feed(entry(id="x/3v1", terms=("math.CO (a)",)), entry(id="x/1v1", title="copy")),
        "broken",
    )
    report = run_medallion(pages, where)
    assert all(r["passed"] for r in report.collect()) and report.count() == 7
    qa.assert_quality(report)
    assert {r["id"]: r["title"] for r in spark.table(where.bronze).collect()} == {
        "1v1": "On Rivers", "3v1": "On Rivers",
    }
    assert spark.table(where.rejects).count() == 2
    got = {(r["publication_year"], r["category_name"]): r["paper_count"] for r in spark.table(where.fact).collect()}
    assert got == {
        (2024, "Software Engineering"): 1, (2024, "Artificial Intelligence"): 1, (2024, "math.co"): 1,
    }
    # An older copy changes nothing, a newer one replaces its row and moves its partition.
    older = page_frame(spark, feed(entry(id="x/1v1", title="old", updated="2023-01-01T00:00:00Z")))
    assert load_bronze(older, where)["n_updated"] == 0
    newer = feed(entry(id="x/1v1", title="new", published="2025-05-05T00:00:00Z", updated="2025-06-01T00:00:00Z"))
    assert load_bronze(page_frame(spark, newer), where)["n_updated"] == 1
    load_silver(spark, where)
    assert {(r["id"], r["title"], r["publication_year"]) for r in spark.table(where.silver).collect()} == {
        ("1v1", "new", 2025), ("3v1", "On Rivers", 2024),
    }
    # Nothing valid: the target stays as it is.
    assert load_bronze(page_frame(spark, feed()), where)["n_inserted"] == 0
    assert spark.table(where.bronze).count() == 2


def test_increments_equal_full_runs(spark, tmp_path):
    rng = random.Random(11)
    full, steps = layout(tmp_path / "a", "full"), layout(tmp_path / "b", "steps")
    terms = ["cs.AI", "cs.SE (x)", "ml", "math.CO - y", "cs.CL,cs.DB", " (junk)"]

    def batch(n):
        picked = [
            entry(
                id=f"x/{rng.randrange(12)}",
                title=f"T{rng.randrange(99)}" if rng.random() > 0.1 else "",
                terms=rng.sample(terms, rng.choice([1, 1, 2])),
                published=f"{rng.choice([2021, 2022, 2023])}-0{rng.randrange(1, 9)}-01T00:00:00Z",
                updated=f"2024-0{rng.randrange(1, 9)}-01T00:00:00Z",
            )
            for _ in range(n)
        ]
        return page_frame(spark, feed(*picked[:n // 2]), feed(*picked[n // 2:]))

    def state(where):
        shape = lambda name, *cols: sorted(str(r) for r in spark.table(name).select(*cols).collect())
        return (
            shape(where.bronze, "id", "title", "updated_date", "published_month"),
            shape(where.silver, "id", "title", "categories", "publication_year"),
            shape(where.fact, "publication_year", "category_name", "paper_count"),
            shape(where.dim, "category_code", "category_name"),
            spark.table(where.rejects).count(),
        )

    ensure_layers(spark, steps)
    for n in (9, 6):
        pages = batch(n)
        run_medallion(pages, full)
        load_increment(pages, steps)
        assert state(steps) == state(full)
    assert load_increment(pages, steps) == NOTHING_DONE and state(steps) == state(full)


def test_a_broken_increment_can_be_repeated(spark, tmp_path, monkeypatch):
    from smelter.plans import medallion

    where = layout(tmp_path, "broken")
    ensure_layers(spark, where)
    load_increment(page_frame(spark, feed(entry(id="x/1"), entry(id="x/2"))), where)
    moved = page_frame(spark, feed(
        entry(id="x/1", published="2030-01-01T00:00:00Z", updated="2031-01-01T00:00:00Z"),
        entry(id="x/2", published="2030-01-01T00:00:00Z", updated="2031-01-01T00:00:00Z"),
    ))
    for step in ("refresh_gold", "upsert_bronze"):
        with monkeypatch.context() as broken:
            broken.setattr(medallion, step, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                load_increment(moved, where)
    assert load_increment(moved, where)["n_updated"] == 2
    got = [tuple(r) for r in spark.table(where.fact).select("publication_year", "paper_count").collect()]
    assert got == [(2030, 2)]


def test_silver_keeps_papers_bronze_lost_unless_truncated(spark, tmp_path):
    where = layout(tmp_path, "trunc")
    run_medallion(page_frame(spark, feed(entry(id="x/1"), entry(id="x/2"))), where)
    from smelter.sources.tables import overwrite_table

    overwrite_table(spark.table(where.bronze).filter("id = '1'"), where.bronze)
    load_silver(spark, where)
    assert spark.table(where.silver).count() == 2
    load_silver(spark, where, truncate_first=True)
    assert spark.table(where.silver).count() == 1


def test_missing_tables_are_reported_in_order(spark):
    report = qa.table_quality(spark, "no.dim", "no.silver", "no.fact")
    with pytest.raises(qa.QualityError, match="table_exists:no.dim"):
        qa.assert_quality(report)
    assert report.count() == 3


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    late = entry(id="x/1", title="late but older", updated="2023-12-31T00:00:00Z")
    land(tmp_path, "cs.AI", 0, feed(entry(id="x/1"), entry(id="x/2"), entry(id="x/bad", title="")))
    land(tmp_path, "cs.AI", 1000, feed(late, entry(id="x/3")))
    spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
    source = str(tmp_path / "landed")

    def run(checkpoint):
        pages = read_page_stream(spark, source, max_files=1)
        query = ingest_stream(pages, "streamed.bronze", str(tmp_path / checkpoint), location=str(tmp_path / "t"))
        query.awaitTermination()
        batches = {p["batchId"] for p in query.recentProgress if p["numInputRows"]}
        rows = spark.table("streamed.bronze").select("id", "title").collect()
        return len(batches), sorted(tuple(r) for r in rows)

    want = [("1", "On Rivers"), ("2", "On Rivers"), ("3", "On Rivers")]
    assert run("c1") == (2, want)
    land(tmp_path, "cs.CL", 0, feed(entry(id="x/2", title="new", updated="2025-01-01T00:00:00Z")))
    want[1] = ("2", "new")
    assert run("c1") == (1, want)
    assert run("c2") == (3, want)  # everything once more, as after a lost checkpoint


@pytest.mark.parametrize("layers", [False, True])
def test_limits_of_a_stream_do_not_choose_the_copy(spark, tmp_path, layers):
    # Files are read in the order they were landed, here against the order of fetching.
    land(tmp_path, "cs.CL", 0, feed(entry(id="x/1", title="CL"), entry(id="x/2", title="CL")))
    land(tmp_path, "cs.AI", 1000, feed(entry(id="x/1", title="AI second page")))
    land(tmp_path, "cs.AI", 0, feed(entry(id="x/1", title="AI")))
    for i, place in enumerate(("CL/start=0", "AI/start=1000", "AI/start=0")):
        os.utime(tmp_path / f"landed/category=cs.{place}/page.xml", (1e9 + i, 1e9 + i))
    pages = read_page_stream(spark, str(tmp_path / "landed"), max_files=1)
    state = str(tmp_path / "state")
    if layers:
        where = layout(tmp_path / "tables", "copies")
        layers_stream(pages, where, state).awaitTermination()
        names = [where.bronze, where.silver]
    else:
        spark.sql("CREATE SCHEMA IF NOT EXISTS streamed")
        names = ["streamed.copies"]
        ingest_stream(pages, names[0], state, location=str(tmp_path / "t")).awaitTermination()
    for name in names:
        rows = spark.table(name).select("id", "title").collect()
        assert sorted(map(tuple, rows)) == [("1", "AI"), ("2", "CL")]


def test_streamed_layers(spark, tmp_path):
    land(tmp_path, "cs.AI", 0, feed(entry(id="x/1"), entry(id="x/2", title="")))
    land(tmp_path, "cs.CL", 0, feed(entry(id="x/1", published="2020-01-01T00:00:00Z",
                                          updated="2025-01-01T00:00:00Z"), entry(id="x/3")))
    where = layout(tmp_path / "tables", "stream_layers")
    pages = read_page_stream(spark, str(tmp_path / "landed"), max_files=1)
    layers_stream(pages, where, str(tmp_path / "state")).awaitTermination()
    got = [tuple(r) for r in spark.table(where.fact).select("publication_year", "paper_count").collect()]
    assert sorted(got) == [(2020, 1), (2024, 1)]
    qa.assert_quality(qa.table_quality(spark, where.dim, where.silver, where.fact))


def test_session_and_shared_folder(spark):
    assert get_session() is spark
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    with staged(spark.range(3), "t") as kept:
        path = kept.inputFiles()[0]
        assert kept.agg(F.sum("id")).first()[0] == 3 and shared_folder(spark) in path
    with pytest.raises(Exception):
        spark.read.parquet(path.rpartition("/")[0]).count()


@pytest.mark.parametrize("master", ["local[2]", "yarn"])
def test_without_a_shared_folder_only_local_mode_goes_on(master):
    class Context:
        folder = None

        def __init__(self):
            self.master = master

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    session = SimpleNamespace(conf={}, sparkContext=Context())
    if master == "yarn":
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session)
    else:
        assert shared_folder(session) == shared_folder(session) == session.sparkContext.folder


def test_timestamps_are_utc_whatever_the_offset(spark):
    page = feed(entry(published="2023-12-31T23:30:00-05:00"))
    from smelter.sources.feed import parse_pages

    row = parse_pages(page_frame(spark, page)).select(F.col("published_date").cast("string")).first()
    assert row[0] == "2024-01-01 04:30:00"
    assert dt.datetime.fromisoformat(row[0]).year == 2024


def test_rejects_of_earlier_batches_stay(spark, tmp_path):
    where = layout(tmp_path, "rej")
    ensure_layers(spark, where)
    first = page_frame(spark, feed(entry(id="x/1v1", title="")))
    other = page_frame(spark, feed(entry(id="x/2v1"))).withColumn("page_start", F.lit(500).cast("bigint"))
    load_increment(first, where)
    assert spark.table(where.rejects).count() == 1
    load_increment(other, where)
    assert spark.table(where.rejects).count() == 1
    load_increment(first, where)
    assert spark.table(where.rejects).count() == 1


def test_codes_that_differ_by_case_are_refused():
    check_codes(["cs.AI", "cs.CL"])
    with pytest.raises(ValueError, match="cs.AI"):
        check_codes({"cs.AI": "a", "CS.ai": "b"})
