"""Column expressions on text. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a summary or a
# category term is stripped (ASCII controls, space, and the Unicode spaces).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def last_segment(path: Column) -> Column:
    """What follows the last slash: ``a/b`` gives ``b``, ``a/`` gives the empty string."""
    return F.substring_index(path, "/", -1)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text as a timestamp, null for anything else.

    Spark's cast alone would also take a bare year or a bare time of day.
    """
    looks_iso = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}")
    return F.when(looks_iso, F.try_to_timestamp(text))


def as_date(value: Column) -> Column:
    """Date of a timestamp or of ISO text; null instead of an ANSI error on garbage."""
    return value.try_cast("date")
