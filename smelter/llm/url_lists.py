"""URL filters by a temporal list join.

A list is a log of dated entries: from a day on, a host, a domain or a path prefix is
listed or no longer listed. Entries of one pattern become validity intervals; intervals are cut
at the borders of time blocks. Every capture asks for its own few patterns (its host, the
domains above it, its path prefixes down to the deepest of the list), and an as-of join finds the intervals that held when
it was fetched: an equality join on pattern and block, with the time as a condition, which
adaptive execution can split where one host holds a third of all rows.

Entries and captures have one normal form: scheme, user, port, query and fragment are off, the
host is in lower case without dots at its end, empty path segments do not count, and paths are
otherwise as they are spelled. A host means itself and all below it, down from a bare top-level domain.

Defined cases: null or empty URLs and null times match nothing and pass; entries without
host, date or action list nothing and are returned by :func:`unreadable`; of entries of one pattern and time the one that lists
wins; repeated captures each get their row;
without entries every capture passes; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smelter.llm.common import small_side, written

#: Length of a time block in days.
BLOCK_DAYS = 32


def rest_of(url: Column | str) -> Column:
    """Host and path: scheme, query and fragment off."""
    url = F.col(url) if isinstance(url, str) else url
    plain = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_replace(plain, r"(?s)[?#].*$", "")


def host_of(url: Column | str) -> Column:
    """The host in lower case, without user, port and dots at its end; empty if there is none."""
    host = F.regexp_replace(F.substring_index(rest_of(url), "/", 1), r"(?s)^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.+$", ""))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(rest_of(url), r"(?s)^[^/]*(/.*)$", 1)


def segments_of(url: Column | str) -> Column:
    """Path segments as they are spelled; empty ones do not count."""
    return F.array_remove(F.split(path_of(url), "/"), "")


def normal(pattern: Column | str) -> Column:
    """The one spelling of a host or of a host with a path; null if there is no host."""
    host = host_of(pattern)
    return F.when(host != "", F.array_join(F.concat(F.array(host), segments_of(pattern)), "/"))


def unreadable(entries: DataFrame) -> DataFrame:
    """Entries of a list that can name nothing, and so would pass unseen: for the owner of the list."""
    lacks = reduce(Column.__or__, (F.col(c).isNull() for c in ("day", "label", "listed")))
    return entries.filter(lacks | normal("pattern").isNull())


def patterns_of(url: Column | str, deepest: int) -> Column:
    """What a list may name to mean a URL: its host, each domain above, host and path prefixes.

    Prefixes go down to ``deepest`` segments, the most that any pattern of the list has.
    """
    host, segments = host_of(url), segments_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    depth = F.least(F.size(segments), F.lit(deepest))
    prefixes = F.transform(
        F.when(depth > 0, F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")),
    )
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, label, since (inclusive) and until (exclusive, null if it still holds), in days.

    ``entries`` has pattern, day, label and listed; the entries of one pattern are ordered
    by a window, which holds no more of them than there are days.
    """
    sound = entries.filter("pattern IS NOT NULL AND day IS NOT NULL AND label IS NOT NULL AND listed IS NOT NULL")
    sound = sound.withColumn("pattern", normal("pattern")).filter("pattern IS NOT NULL")
    daily = sound.groupBy("pattern", "label", "day").agg(F.max("listed").alias("listed"))
    w = Window.partitionBy("pattern", "label").orderBy("day")
    return (
        daily.withColumn("until", F.lead("day").over(w))
        .filter("listed")
        .select("pattern", "label", F.col("day").alias("since"), "until")
    )


def active(captures: DataFrame, entries: DataFrame, last_day: int) -> DataFrame:
    """capture, pattern and label of every interval that held when a capture was fetched.

    ``captures`` has capture, url and day. Open intervals are cut at ``last_day``, the last day
    that was fetched, so an interval has a row for each block it covers.
    """
    block = lambda c: F.floor(F.col(c) / F.lit(BLOCK_DAYS))
    held = intervals(entries).withColumn("until", F.coalesce("until", F.lit(last_day + 1)))
    cut = held.filter("since < until").withColumn(
        "_block", F.explode(F.sequence(block("since"), F.floor((F.col("until") - 1) / F.lit(BLOCK_DAYS))))
    )
    deepest = entries.agg(F.max(F.size(segments_of("pattern")))).first()[0] or 0
    asked = captures.select("capture", "day", F.explode(patterns_of("url", deepest)).alias("_pattern")).withColumn("_at", block("day"))
    return asked.join(
        small_side(written(cut, "intervals")),
        (F.col("_pattern") == F.col("pattern")) & (F.col("_at") == F.col("_block"))
        & (F.col("day") >= F.col("since")) & (F.col("day") < F.col("until")),
    ).select("capture", "pattern", "label")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture, n_active, labels (sorted, comma-joined) and passes for every capture."""
    last = captures.agg(F.max("day")).first()[0]
    found = active(captures, entries, last if last is not None else 0)
    # Equal captures ask alike: entries are counted once each.
    listed = found.distinct().groupBy(F.col("capture").alias("_capture")).agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels")
    )
    return captures.join(listed, F.col("capture") == F.col("_capture"), "left").select(
        "capture", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.col("_capture").isNull().alias("passes"),
    )
