"""Clean-up of messy multi-valued category columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a regular-expression dot does not match, plus the list separator.
_STOP = "[^,\\n\\r\\u0085\\u2028\\u2029]"

# What is cut from a category, and how a bare one is completed.
DASH_NOTE = f"\\s-{_STOP}*"
PARENTHETICAL = f"\\s*\\({_STOP}*\\)"
GENERIC_SUFFIX = ".gen"


def normalize_categories(categories: Column) -> Column:
    """Clean codes of one row, in source order; empty when only junk was given.

    An element may itself hold several codes separated by commas. Of each code the
    part from `` -`` on and any parenthetical are cut, the rest is trimmed and
    lowered, and a code without a dot gets ``.gen``. Blank codes disappear,
    duplicates stay.

    As every step works between commas, the list is joined once and cleaned as one
    string: no explode, no regrouping shuffle, and no lambda that would leave
    generated code. Null elements are dropped by the join; a null list stays null.
    """
    joined = F.array_join(categories, ",")
    cut = F.regexp_replace(F.regexp_replace(joined, DASH_NOTE, ""), PARENTHETICAL, "")
    trimmed = F.trim(F.regexp_replace(cut, " *, *", ","))
    # Most lists are clean: without these characters there is nothing to cut or trim.
    messy = joined.contains("-") | joined.contains("(") | joined.contains(" ")
    tidy = F.when(messy, trimmed).otherwise(joined)
    completed = F.regexp_replace(
        F.lower(tidy), "(^|,)([^,.]+)(?=,|\\z)", "$1$2" + GENERIC_SUFFIX
    )
    return F.array_remove(F.array_remove(F.split(completed, ","), ""), GENERIC_SUFFIX)
