"""Server-style queries on landed articles: category predicate, order, offset and limit.

:func:`page` answers from the articles as they are. Where many deep pages are asked for,
:func:`build_page_index` sorts and numbers the rows once, and :func:`seek_page` reads the one
range of them in which a page lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from smelter.operators.bounds import MAX_BROADCAST_ROWS
from smelter.operators.numbering import number_rows

# Up to here a page comes from a top-k heap of sort keys in every task, merged in one.
TOP_K_ROWS = 2_000


def in_category(code: str) -> Column:
    """Articles listed in a category."""
    return F.array_contains("categories", code)


# Latest submission first; the id decides ties, so pages never overlap.
NEWEST_FIRST = ("-published_date", "id")


def sort_columns(order: Sequence[str]) -> list[Column]:
    """Sort keys from names; a leading minus sorts downwards."""
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in order]


def page(
    df: DataFrame,
    predicate: Column,
    start: int,
    max_results: int,
    order: Sequence[str] = NEWEST_FIRST,
    key: str = "id",
) -> DataFrame:
    """Rows ``start`` up to ``start + max_results`` of the filtered, ordered articles.

    The page is found on the sort keys alone; its rows are then fetched by ``key``, which
    has to be unique. Every task of a top-k sends all rows up to the end of the page to a
    single one, so that serves pages near the top; the sort keys of deeper pages are
    numbered by a distributed sort.
    """
    found = df.filter(predicate)
    keys = sort_columns(order)
    narrow = found.select(*dict.fromkeys([key, *(name.lstrip("-") for name in order)]))
    if start + max_results <= TOP_K_ROWS:
        wanted = narrow.orderBy(*keys).offset(start).limit(max_results)
    else:
        number = F.col("_number")
        inside = (number > start) & (number <= start + max_results)
        wanted = number_rows(narrow, keys, "_number").filter(inside)
    wanted = wanted.select(F.col(key).alias("_key"))
    small = F.broadcast(wanted) if max_results <= MAX_BROADCAST_ROWS else wanted
    # A null key is a key. The limit removes nothing where keys are unique; it spares a small
    # page the sampling of a global sort, which would read the articles once more.
    rows = found.join(small, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return rows.orderBy(*keys).limit(max_results)


# Rows between two fences of an index: what a page reads at least.
FENCE_ROWS = 1_000_000

_GROUP, _POSITION, _FENCE = "_group", "_position", "_fence"


def build_page_index(
    df: DataFrame,
    path: str,
    groups: Column | None = None,
    order: Sequence[str] = NEWEST_FIRST,
    fence_rows: int = FENCE_ROWS,
) -> None:
    """Store the rows of each group in order, cut by fences every ``fence_rows`` rows.

    ``groups`` is a list per row (such as its categories): a row is stored once for each value in it;
    without it all rows are one group. ``order`` has to decide every tie. All groups are
    sorted and numbered in one pass over all tasks. Pass only the columns that pages show.

    Beside the rows stands a table of groups (where each begins, and its number of rows) and one of
    fences (first sort keys and number of rows between two). An index is built anew, not updated.
    """
    listed = F.explode(F.array_distinct(groups)) if groups is not None else F.lit("")
    rows = df.select(listed.alias(_GROUP), *df.columns)
    numbered = number_rows(rows, [F.asc(_GROUP), *sort_columns(order)], _POSITION)
    fence = F.floor((F.col(_POSITION) - 1) / fence_rows).alias(_FENCE)
    numbered.select(*rows.columns, _POSITION, fence).write.partitionBy(_FENCE).parquet(f"{path}/rows")
    df.limit(0).write.parquet(f"{path}/nothing")
    stored = df.sparkSession.read.schema(numbered.withColumn(_FENCE, fence).schema).parquet(f"{path}/rows")
    names = [name.lstrip("-") for name in order]
    fences = stored.groupBy(_FENCE).agg(
        F.min_by(F.struct(_GROUP, *names), _POSITION).alias("first"), F.count(F.lit(1)).alias("n_rows")
    )
    fences.write.parquet(f"{path}/fences")
    stored.groupBy(_GROUP).agg(F.min(_POSITION).alias("first"), F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{path}/groups")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def seek_page(spark: SparkSession, path: str, start: int, max_results: int, group: str = "") -> DataFrame:
    """Rows ``start`` up to ``start + max_results`` of a group, in order, from a stored index.

    The place of the group is looked up (one row), then only the rows between the fences
    around the page are read, and of these the files' row groups near it. Nothing but the page is
    sorted. A group that the index does not know has no rows.
    """
    place = _read(spark, path, "groups").filter(F.col(_GROUP) == group).first()
    if place is None:
        return _read(spark, path, "nothing")
    rows = _read(spark, path, "rows")
    first = place["first"] + start
    last = min(first + max_results, place["first"] + place["n_rows"]) - 1
    return between(rows, fences_around(spark, path, first, last), first, last)


def fences_around(spark: SparkSession, path: str, first: int, last: int) -> tuple[int, int]:
    """The fences that enclose two positions: one row per fence is looked at."""
    counted = _read(spark, path, "fences")
    upto = Window.orderBy(_FENCE).rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.select(_FENCE, F.sum("n_rows").over(upto).alias("upto"), "n_rows")
    hit = ends.filter((F.col("upto") >= first) & (F.col("upto") - F.col("n_rows") < last))
    found = hit.agg(F.min(_FENCE), F.max(_FENCE)).first()
    return (found[0], found[1]) if found[0] is not None else (0, -1)


def between(rows: DataFrame, fences: tuple[int, int], first: int, last: int) -> DataFrame:
    inside = F.col(_FENCE).between(*fences) & F.col(_POSITION).between(first, last)
    found = rows.filter(inside)
    # One or two ranges are read and put in order by one task, without an exchange.
    near = fences[1] - fences[0] < 2
    ordered = found.coalesce(1).sortWithinPartitions(_POSITION) if near else found.orderBy(_POSITION)
    return ordered.drop(_GROUP, _POSITION, _FENCE)
