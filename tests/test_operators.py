import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from smelter.operators import budget
from smelter.operators.bounds import bounded_broadcast, is_small
from smelter.operators.contract import (
    VIOLATIONS, article_rules, reject_counts, rejected_rows, validate,
)
from smelter.operators.dedupe import duplicate_keys, keep_first, keep_last
from smelter.operators.dimension import colliding_codes, join_names
from smelter.operators.numbering import number_rows
from smelter.operators.upsert import (
    DuplicateKeys, new_rows, upsert, upsert_actions, upsert_counts,
)
from smelter.schemas import BRONZE
from smelter.sources import paging
from smelter.sources.paging import in_category, page

NEWER = "s.u > t.u"


def frame(spark, rows, ddl="id string, u int, v int"):
    return spark.createDataFrame(rows, ddl)


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TARGET = [("a", 1, 10), ("b", 5, 20), ("n", None, 30)]
SOURCE = [("a", 2, 11), ("b", 5, 21), ("n", 9, 31), ("c", 1, 40), (None, 1, 50), (None, 1, 50)]


@pytest.mark.parametrize("small", [True, False])
def test_newer_wins(spark, small):
    got = upsert(frame(spark, TARGET), frame(spark, SOURCE), ["id"], NEWER, small_source=small)
    want = [("a", 2, 11), ("b", 5, 20), ("n", None, 30), ("c", 1, 40), (None, 1, 50), (None, 1, 50)]
    assert as_set(got) == sorted(want, key=str)


@pytest.mark.parametrize("small", [True, False])
def test_unconditional_upsert_keeps_null_keys_and_unmatched_rows(spark, small):
    target = [*TARGET, (None, 0, 0), (None, 0, 0)]
    actions = upsert_actions(frame(spark, target), frame(spark, SOURCE), ["id"], small_source=small)
    assert upsert_counts(actions).first().asDict() == {
        "n_inserted": 3, "n_updated": 3, "n_unchanged": 2,
    }
    assert ("b", 5, 21) in as_set(actions.drop("_action"))


def test_upsert_matches_columns_by_name_and_refuses_others(spark):
    source = frame(spark, [(7, "a", 9)], "v int, id string, u int")
    assert ("a", 9, 7) in as_set(upsert(frame(spark, TARGET), source, ["id"]))
    with pytest.raises(ValueError, match="differ in columns"):
        upsert(frame(spark, TARGET), source.drop("v"), ["id"])


def test_upsert_duplicate_source_keys(spark):
    twice = frame(spark, [("a", 2, 1), ("a", 3, 2)])
    with pytest.raises(DuplicateKeys):
        upsert(frame(spark, TARGET), twice, ["id"])
    latest = upsert(frame(spark, TARGET), twice, ["id"], on_duplicates="latest", latest_by=["u"])
    assert ("a", 3, 2) in as_set(latest) and latest.count() == 3


@pytest.mark.parametrize("small", [True, False])
def test_upsert_on_two_keys_against_brute_force(spark, small):
    rng = random.Random(5)
    some = lambda: rng.choice([None, 0, 1, 2, 3])
    unique = lambda n: {(some(), some()): (rng.choice([None, 1, 2, 3]), rng.random()) for _ in range(n)}
    ddl = "a int, b int, u int, v double"
    target, source = unique(30), unique(30)
    expected = {("t", *k): v for k, v in target.items()}
    for key, (u, v) in source.items():
        stored = expected.get(("t", *key)) if None not in key else None
        if stored is None:
            expected[("s", *key)] = (u, v)
        elif u is not None and stored[0] is not None and u > stored[0]:
            expected[("t", *key)] = (u, v)
    got = upsert(
        frame(spark, [(*k, *v) for k, v in target.items()], ddl),
        frame(spark, [(*k, *v) for k, v in source.items()], ddl),
        ["a", "b"], NEWER, small_source=small,
    )
    assert as_set(got) == sorted(((*k[1:], *v) for k, v in expected.items()), key=str)


def test_new_rows(spark):
    got = new_rows(frame(spark, TARGET), frame(spark, SOURCE), ["id"])
    assert as_set(got) == [("c", 1, 40), (None, 1, 50), (None, 1, 50)]


def test_keep_first_and_last(spark):
    rows = [("x", 2, 1), ("x", 1, 5), ("x", 1, 4), ("y", 9, 9), (None, 3, 3), (None, 2, 2)]
    df = frame(spark, rows)
    assert as_set(keep_first(df, ["id"], ["u", "v"])) == [("x", 1, 4), ("y", 9, 9), (None, 2, 2)]
    assert as_set(keep_last(df, ["id"], ["u", "v"])) == [("x", 2, 1), ("y", 9, 9), (None, 3, 3)]
    assert as_set(duplicate_keys(df, ["id"])) == [("x", 3)]


def test_keep_first_combines_before_the_shuffle(spark):
    plan = keep_first(frame(spark, TARGET), ["id"], ["u"])._jdf.queryExecution().toString()
    assert "partial_min_by" in plan and "Window" not in plan


GOOD = ("1", "t", "s", ["a"], ["c"], dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), "")


def broken(**changes):
    names = [c.split()[0] for c in BRONZE.strip().split(", ")]
    row = dict(zip(["id", "title", "summary", "authors", "categories", "published_date",
                    "updated_date", "pdf_url"], GOOD))
    return tuple({**row, **changes}.values())


def test_contract(spark):
    rows = [
        GOOD, broken(id="2", title=" "), broken(id=None), broken(id=""), broken(title=""),
        broken(summary=None), broken(authors=[]), broken(authors=["a", None]),
        broken(categories=None), broken(updated_date=None, pdf_url=None),
    ]
    df = spark.createDataFrame(rows, BRONZE)
    valid, rejects = validate(df, article_rules())
    assert sorted(r["id"] for r in valid.collect()) == ["1", "2"]
    assert rejects.count() == 8
    reasons = {tuple(r[VIOLATIONS]) for r in rejects.collect()}
    assert reasons == {
        ("id_required",), ("title_required",), ("summary_required",), ("authors_not_empty",),
        ("categories_not_empty",), ("updated_date_present", "pdf_url_present"),
    }
    counts = {r["rule"]: r["n_rows"] for r in reject_counts(df, article_rules()).collect()}
    assert counts == {
        "id_required": 2, "title_required": 1, "summary_required": 1, "authors_not_empty": 2,
        "categories_not_empty": 1, "updated_date_present": 1, "pdf_url_present": 1,
    }


def pages(spark, rows):
    return frame(spark, rows, "category_ordinal int, page_start bigint, n bigint")


def test_budget_admits_the_page_that_reaches_it(spark):
    df = pages(spark, [(0, 0, 25), (0, 0, 25), (0, 1, 60), (0, 2, 10), (1, 0, 5)])
    got = budget.admit(df, 100, F.col("n"))
    assert as_set(got) == [(0, 0, 25), (0, 0, 25), (0, 1, 60)]
    assert budget.admit(df, None, F.col("n")).count() == 5
    assert budget.admit(df, 10**9, F.col("n")).count() == 5
    assert budget.admit(df.limit(0), 100, F.col("n")).count() == 0
    assert as_set(budget.admit(df, 1, F.col("n"))) == [(0, 0, 25), (0, 0, 25)]


def test_budget_totals_across_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(budget, "BLOCK_SPAN", 10)
    rng = random.Random(3)
    rows = [(c, s, rng.randrange(50)) for c in range(4) for s in range(0, 90, 3)]
    total, expected = 0, {}
    for c, s, n in sorted(rows):
        expected[c, s] = total
        total += n
    sizes = budget.page_sizes(pages(spark, rows), F.col("n"))
    got = {(r["category_ordinal"], r["page_start"]): r["bytes_before"]
           for r in budget.bytes_before(sizes).collect()}
    assert got == expected
    for limit in (0, 1, 300, 1500, total, total + 1):
        admitted = budget.admit(pages(spark, rows), limit, F.col("n"))
        assert {(r[0], r[1]) for r in admitted.collect()} == {
            k for k, before in expected.items() if before < limit
        }


def test_text_sizes_count_bytes(spark):
    df = spark.createDataFrame([("é", ["ab", None, "ü"]), (None, None)], "t string, l array<string>")
    got = df.select(budget.text_bytes("t"), budget.list_bytes("l")).collect()
    assert [tuple(r) for r in got] == [(2, 4), (0, 0)]


def test_number_rows_with_a_hot_leading_key(spark):
    rows = [("same" if i % 3 else str(i), i * 7 % 500, i) for i in range(500)]
    df = frame(spark, rows).repartition(7)
    got = number_rows(df, [F.col("id").desc(), F.col("u").asc()], "n")
    want = sorted(rows, key=lambda r: r[1])
    want = sorted(want, key=lambda r: r[0], reverse=True)
    assert [r["v"] for r in got.orderBy("n").collect()] == [r[2] for r in want]
    assert [r["n"] for r in got.orderBy("n").select("n").collect()] == list(range(1, 501))


def test_pages_near_and_deep_agree(spark, monkeypatch):
    day = dt.datetime(2024, 1, 1)
    rows = [(f"{i:03}", ["x"] if i % 4 else ["y"], day + dt.timedelta(days=i % 5)) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, categories array<string>, published_date timestamp")
    want = sorted((r for r in rows if "x" in r[1]), key=lambda r: r[0])
    want = [r[0] for r in sorted(want, key=lambda r: r[2], reverse=True)]

    def fetch(start, n):
        return [r["id"] for r in page(df, in_category("x"), start, n).collect()]

    cases = [(0, 10), (10, 10), (60, 30), (200, 5)]
    near = [fetch(*case) for case in cases]
    monkeypatch.setattr(paging, "TOP_K_ROWS", 0)
    assert near == [fetch(*case) for case in cases] == [want[s : s + n] for s, n in cases]


def test_join_names(spark):
    facts = frame(spark, [("CS.ai", 1), ("math.co", 2), (None, 3)], "category_code string, n int")
    dim = frame(spark, [("cs.AI", "Art")], "category_code string, category_name string")
    got = join_names(facts, dim)
    assert as_set(got.select("category_code", "n", "category_name")) == [
        ("CS.ai", 1, "Art"), ("math.co", 2, "math.co"), (None, 3, None),
    ]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert colliding_codes(dim).isEmpty()
    assert colliding_codes(dim.unionByName(frame(spark, [("CS.AI", "B")], dim.schema))).count() == 1


def test_broadcast_is_measured(spark):
    df = frame(spark, TARGET)
    assert is_small(df) and not is_small(df, max_rows=2) and not is_small(df, max_bytes=40)
    assert is_small(df.limit(0), max_rows=0, max_bytes=0)
    assert "ResolvedHint" in bounded_broadcast(df)._jdf.queryExecution().analyzed().toString()


def test_rejected_rows_survive_null_conditions(spark):
    df = spark.createDataFrame([broken(id=None)], BRONZE)
    assert rejected_rows(df, article_rules()).count() == 1
