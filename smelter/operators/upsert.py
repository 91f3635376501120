"""Upsert as an equi join, for tables whose format has no MERGE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.operators.dedupe import duplicate_keys, keep_last

ACTION = "_action"
INSERT, UPDATE, KEEP = "insert", "update", "keep"


class DuplicateKeys(ValueError):
    """Several source rows share a key, so the row to write is undecided."""


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__or__, (F.col(key).isNull() for key in keys))


def prepare_source(
    source: DataFrame, keys: Sequence[str], on_duplicates: str = "raise", latest_by: Sequence[str] = ()
) -> DataFrame:
    """Source with at most one row per key.

    ``raise`` looks for repeated keys first (key columns only), ``latest`` keeps the
    last row in ``latest_by``, ``trusted`` skips the check where the caller has just
    made the keys unique.
    """
    if on_duplicates == "latest":
        keyless = source.filter(_any_null(keys))
        return keep_last(source.filter(~_any_null(keys)), keys, latest_by).unionByName(keyless)
    if on_duplicates == "raise":
        if not duplicate_keys(source, keys).isEmpty():
            raise DuplicateKeys(f"source has several rows for one value of {list(keys)}")
    elif on_duplicates != "trusted":
        raise ValueError(f"unknown on_duplicates: {on_duplicates}")
    return source


def upsert_actions(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    when_matched: str | None = None,
    *,
    on_duplicates: str = "raise",
    latest_by: Sequence[str] = (),
    small_source: bool = False,
) -> DataFrame:
    """Rows of the target after the upsert, with what happened to each in ``_action``.

    ``when_matched`` is SQL over the aliases ``t`` and ``s``; a matched row is replaced
    only where it is true (null is not true). Null keys match nothing: they never enter
    the join, where they would all meet in one task. Target rows without a source row
    stay. Columns are matched by name.

    The target is expected to hold each key once, as every upsert leaves it.
    ``small_source`` broadcasts the source and leaves the target unshuffled; use it
    after measuring it with :func:`smelter.operators.bounds.is_small`.
    """
    missing = set(target.columns) ^ set(source.columns)
    if missing:
        raise ValueError(f"target and source differ in columns {sorted(missing)}")
    columns = target.columns
    source = prepare_source(source, keys, on_duplicates, latest_by).select(columns)
    if small_source:
        return _broadcast_actions(target, source, keys, when_matched, columns)
    keyed = _joined(
        target.filter(~_any_null(keys)), source.filter(~_any_null(keys)), keys, "full_outer",
        when_matched, columns,
    )
    kept = target.filter(_any_null(keys)).withColumn(ACTION, F.lit(KEEP))
    added = source.filter(_any_null(keys)).withColumn(ACTION, F.lit(INSERT))
    return keyed.unionByName(kept).unionByName(added)


LANE = "_lane"
# Ways that rows without a key take through a join.
LANES = 4096


def in_lanes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add a join column that spreads rows with a null key over many tasks.

    They match nothing wherever they go, but by their keys alone would all go to one task. Rows
    with a key share one lane, so among them the column changes nothing.
    """
    apart = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(LANES))
    return df.withColumn(LANE, F.when(_any_null(keys), apart).otherwise(F.lit(0).cast("bigint")))


def _same_keys(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"t.{key}") == F.col(f"s.{key}") for key in keys))


def _wins(when_matched: str | None) -> Column:
    return F.lit(True) if when_matched is None else F.coalesce(F.expr(when_matched), F.lit(False))


def within_key_range(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose keys lie between the least and the greatest of the source.

    No other row can match. The bounds reach the scan as plain comparisons, so of files
    kept in key order only the row groups near the source are read.
    """
    return target.filter(in_bounds(target, keys, source.agg(*key_bounds(keys)).first().asDict()))


def key_bounds(keys: Sequence[str]) -> list[Column]:
    return [end(key).alias(f"{name}_{key}") for key in keys for name, end in (("min", F.min), ("max", F.max))]


def in_bounds(target: DataFrame, keys: Sequence[str], known: dict) -> Column:
    inside = F.lit(True)
    for key in keys:
        kind = target.schema[key].dataType
        low, high = (F.lit(known[f"{end}_{key}"]).cast(kind) for end in ("min", "max"))
        inside = inside & F.col(key).between(low, high)
    return inside


def matched_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], when_matched: str | None = None
) -> DataFrame:
    """Pairs of a stored row ``t`` and a source row ``s`` of one key, and whether ``s`` wins."""
    pairs = target.alias("t").join(source.alias("s"), _same_keys(keys))
    return pairs.withColumn("wins", _wins(when_matched))


def _joined(target, source, keys, how, when_matched, columns) -> DataFrame:
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = source.withColumn("_in_source", F.lit(True)).alias("s")
    on = _same_keys(keys)
    action = (
        F.when(F.col("t._in_target").isNull(), INSERT)
        .when(F.col("s._in_source").isNotNull() & _wins(when_matched), UPDATE)
        .otherwise(KEEP)
    )
    take_source = F.col(ACTION) != KEEP
    return (
        t.join(s, on, how)
        .withColumn(ACTION, action)
        .select(
            *[
                F.when(take_source, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
                for c in columns
            ],
            ACTION,
        )
    )


def _broadcast_actions(target, source, keys, when_matched, columns) -> DataFrame:
    present = _joined(target, F.broadcast(source), keys, "left", when_matched, columns)
    # At most one target row per source key, so never larger than the source.
    hits = target.select(*keys).join(F.broadcast(source.select(*keys)), list(keys), "left_semi")
    added = new_rows(hits, source, keys).withColumn(ACTION, F.lit(INSERT))
    return present.unionByName(added)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    when_matched: str | None = None,
    **options,
) -> DataFrame:
    """The target after the upsert; see :func:`upsert_actions` for the rules."""
    return upsert_actions(target, source, keys, when_matched, **options).drop(ACTION)


def new_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key the target does not hold; null keys are always new.

    Keyless rows go around the join, where one task would receive all of them.
    """
    keyless = source.filter(_any_null(keys))
    unmatched = source.filter(~_any_null(keys)).join(
        target.select(*keys), list(keys), "left_anti"
    )
    return unmatched.select(source.columns).unionByName(keyless)


def upsert_counts(actions: DataFrame) -> DataFrame:
    """Rows inserted, updated and left alone, in one row."""
    return actions.agg(
        F.count_if(F.col(ACTION) == INSERT).alias("n_inserted"),
        F.count_if(F.col(ACTION) == UPDATE).alias("n_updated"),
        F.count_if(F.col(ACTION) == KEEP).alias("n_unchanged"),
    )
