"""Landed pages to bronze articles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.operators.bounds import is_small
from smelter.operators.budget import admit, article_bytes
from smelter.operators.contract import Rule, article_rules, valid_rows
from smelter.operators.dedupe import keep_first
from smelter.schemas import BRONZE, BRONZE_COLUMNS, CATEGORY_CODES
from smelter.session import staged
from smelter.sources.feed import FETCH_ORDER, MALFORMED, parse_pages, with_ordinal
from smelter.sources.tables import Changes, ensure_table, upsert_table, write_changes

# A newer version of a stored article replaces it; an older or undated one never does.
NEWER_WINS = "s.updated_date > t.updated_date"

# The same where one fetch arrives in several micro-batches: of copies of one date, the one
# fetched first stays, whichever batch it came with.
FIRST_FETCHED_WINS = f"{NEWER_WINS} OR (s.updated_date = t.updated_date AND s.fetched < t.fetched)"

# Layout column of the bronze table: place in fetch order.
FETCHED = "fetched"
FETCHED_TYPE = "struct<category_ordinal: int, page_start: bigint, entry_pos: int>"

# Layout column of the bronze table: an upsert rewrites only the months it touches.
MONTH = "published_month"


def feed_rules() -> list[Rule]:
    """The article contract, plus the demand that the page could be read at all."""
    return [Rule("page_well_formed", ~F.col(MALFORMED)), *article_rules()]


def page_rules() -> list[Rule]:
    """The same for landed pages: their place in fetch order has to be known.

    A page whose category is not on the list is not read. It has this one reason.
    """
    unlisted = F.col("category_ordinal").isNull()
    rules = [Rule("page_start_present", F.col("page_start").isNotNull()), *feed_rules()]
    return [Rule("category_listed", ~unlisted), *[Rule(rule.name, unlisted | rule.holds) for rule in rules]]


def fetched_entries(
    pages: DataFrame, codes: Sequence[str] = CATEGORY_CODES, held: str | None = None
) -> DataFrame:
    """All entries of the pages of the listed categories, not yet validated.

    A page of an unlisted or null category gives one row, which :func:`page_rules` rejects. For
    pages that are ``held`` see :func:`parse_pages`.
    """
    return parse_pages(with_ordinal(pages, codes, keep_unlisted=True), held)


@contextmanager
def first_articles(entries: DataFrame, budget_bytes: int | None = None) -> Iterator[DataFrame]:
    """:func:`accepted_articles` of stored entries, as a stored or narrow frame.

    Copies are found by ids and places, and the places of those to leave out are broadcast if they are
    measured to be small: no text travels then. Where they are not, or where two entries share a
    place, whole rows are compared.
    """
    admitted = admit(valid_rows(entries, page_rules()), budget_bytes, article_bytes())
    with staged(admitted.select("id", *FETCH_ORDER), "places") as places:
        place = F.struct(*FETCH_ORDER)
        firsts = places.groupBy("id").agg(F.min(place).alias("_first"))
        later = places.join(firsts, "id").filter(place != F.col("_first"))
        page = [*FETCH_ORDER[:-1], _PART]
        per_page = later.withColumn(_PART, _part()).groupBy(*page).agg(F.collect_list(FETCH_ORDER[-1]).alias("_later"))
        with staged(per_page, "later") as left_out:
            n_left_out = left_out.agg(F.coalesce(F.sum(F.size("_later")), F.lit(0))).first()[0]
            if is_small(left_out) and places.count() - n_left_out == firsts.count():
                marked = admitted.withColumn(_PART, _part()).join(F.broadcast(left_out), page, "left")
                kept = marked.filter(~F.coalesce(F.array_contains("_later", F.col(FETCH_ORDER[-1])), F.lit(False)))
                yield kept.select(*BRONZE_COLUMNS, F.struct(*FETCH_ORDER).cast(FETCHED_TYPE).alias(FETCHED))
                return
        with staged(accepted_articles(entries, budget_bytes), "articles") as articles:
            yield articles


# Entries of a page in one list: a lookup stays short however long the page is.
_PART, _PART_ENTRIES = "_part", 256


def _part() -> Column:
    return F.floor(F.col(FETCH_ORDER[-1]) / _PART_ENTRIES)


def accepted_articles(entries: DataFrame, budget_bytes: int | None = None) -> DataFrame:
    """Valid articles of the pages within the budget, one per id, earliest fetched first.

    Their place in fetch order stands in ``fetched``.
    """
    admitted = admit(valid_rows(entries, page_rules()), budget_bytes, article_bytes())
    narrow = admitted.select(*BRONZE_COLUMNS, *FETCH_ORDER)
    first = keep_first(narrow, ["id"], FETCH_ORDER)
    return first.select(*BRONZE_COLUMNS, F.struct(*FETCH_ORDER).cast(FETCHED_TYPE).alias(FETCHED))


def ensure_bronze(
    spark, name: str, location: str | None = None, using: str = "parquet", buckets: int = 0, loads: bool = False
) -> None:
    columns = f"{BRONZE}, {FETCHED} {FETCHED_TYPE}, {MONTH} string"
    ensure_table(spark, name, columns, [MONTH], location, using, buckets, ["id"], loads)
    if FETCHED not in spark.table(name).columns:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({FETCHED} {FETCHED_TYPE})")


def bronze_rows(articles: DataFrame) -> DataFrame:
    """Articles with the layout columns of the table; ``fetched`` may be absent."""
    rows = articles.withColumn(MONTH, F.date_format("published_date", "yyyy-MM"))
    return rows if FETCHED in rows.columns else rows.withColumn(FETCHED, F.lit(None).cast(FETCHED_TYPE))


def upsert_bronze(
    articles: DataFrame, name: str, wins: str = NEWER_WINS, stored: bool = False, changes: Changes | None = None,
    gathered: bool = False,
) -> dict[str, int]:
    """Newer-wins upsert of articles with unique ids; what it changes may be known already."""
    if changes is not None:
        return write_changes(changes, gathered)
    return upsert_table(
        name, bronze_rows(articles), ["id"], wins, on_duplicates="trusted", stored_source=stored, gathered=gathered
    )
