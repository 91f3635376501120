"""Catalog tables: creation, scans, and writes that never touch files being read.

A table keeps its data in snapshot folders below its own location. A write fills a new
folder first and then points the catalog at it: the whole table, or just the partitions
that changed. Readers of the old files are undisturbed, and a write that fails half way
has changed nothing. Old folders stay until they are removed by the owner of the table.

A table that takes small upserts into large partitions is cut further by a hash of its key
(``buckets``). The bucket is a partition column like the others, so an upsert reads and rewrites
just the buckets its keys fall into, and the files of a bucketed table carry Bloom filters on
the key, by which a scan for a few keys skips row groups.

A table that takes many upserts of mostly new rows is cut by its writes (``loads``). What is new goes
to partitions of its own beside those of earlier writes, of which only those that lose a row are
rewritten. Loads of a partition are merged ``LOADS`` at a time, so a row is rewritten once per
power of ``LOADS`` writes and not with every write.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smelter.operators.bounds import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, row_bytes
from smelter.operators.upsert import (
    ACTION, INSERT, KEEP, LANE, in_bounds, in_lanes, key_bounds, matched_rows, new_rows, prepare_source,
)
from smelter.session import COMPRESSION, staged

# Table properties: where snapshots go, the partition columns, the number of buckets and their keys.
_ROOT, _PARTS, _BUCKETS = "smelter.root", "smelter.partitions", "smelter.buckets"
# Partitions named in one catalog statement.
_PER_STATEMENT = 200

# Properties that say something of the content, and end with the next write.
INVALIDATED = ("smelter.profiled",)

# Partition column of a bucketed table.
KEY_BUCKET = "key_bucket"

# Partition column of a table cut by its writes: how often its rows were merged, and a name for the write.
LOAD = "write_load"

# So many loads of a partition, merged equally often, become one.
LOADS = 16

# Columns that a table is cut by beside its own partition columns.
_LAST = (KEY_BUCKET, LOAD)

# Up to so many keys are looked for one by one, which lets Bloom filters rule row groups out.
POINT_KEYS = 64

_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def use_catalog(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentCatalog(name)


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{at}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def scan(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A table or (global) temporary view by name; a frame is taken as it is."""
    return spark.table(source) if isinstance(source, str) else source


def ensure_table(
    spark: SparkSession,
    name: str,
    columns: str,
    partition_by: Sequence[str] = (),
    location: str | None = None,
    using: str = "parquet",
    buckets: int = 0,
    bucket_by: Sequence[str] = (),
    loads: bool = False,
) -> None:
    """Create the table unless it exists, by default below the folder of its schema.

    A parquet table always gets a location of its own, so that the catalog never deletes
    files when a partition or the table is dropped. ``buckets`` cuts every partition of a parquet
    table by a hash of the columns ``bucket_by``, in a last partition column that writes
    fill in. Choose so many that a bucket is a file or a few; formats with a
    MERGE of their own keep their files by other means and take none. ``loads`` cuts every
    partition of a parquet table by the writes that filled it, likewise; it takes no buckets.
    """
    if table_exists(spark, name):
        return
    kept = ""
    if loads and using == "parquet":
        if buckets:
            raise ValueError("a table is cut by buckets or by loads")
        columns, partition_by = f"{columns}, {LOAD} string", [*partition_by, LOAD]
    if buckets and using == "parquet":
        columns, partition_by = f"{columns}, {KEY_BUCKET} int", [*partition_by, KEY_BUCKET]
    if using == "parquet":
        schema, _, table = name.rpartition(".")
        home = spark.catalog.getDatabase(schema or spark.catalog.currentDatabase()).locationUri
        location = (location or f"{home}/{table}").rstrip("/")
        held = {_ROOT: location, _PARTS: ",".join(partition_by)}
        if buckets:
            held[_BUCKETS] = f"{buckets}:{','.join(bucket_by)}"
        kept = f" TBLPROPERTIES ({', '.join(f"'{k}' = '{v}'" for k, v in held.items())})"
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {using}{parts}{at}{kept}")


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def table_property(spark: SparkSession, name: str, key: str) -> str | None:
    return _properties(spark, name).get(key)


def _is_ours(spark: SparkSession, name: str) -> bool:
    """Whether the table is kept as snapshots, not by a format with transactions of its own."""
    return _ROOT in _properties(spark, name)


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    """Partition columns of a table made by :func:`ensure_table`."""
    return [part for part in _properties(spark, name)[_PARTS].split(",") if part]


def _bucketing(spark: SparkSession, name: str) -> tuple[int, list[str]]:
    """Number of buckets and their key columns; none for a table without."""
    number, _, keys = _properties(spark, name).get(_BUCKETS, "0:").partition(":")
    return int(number), [key for key in keys.split(",") if key]


def _new_snapshot(spark: SparkSession, name: str) -> str:
    return f"{_properties(spark, name)[_ROOT]}/_snapshots/{uuid.uuid4().hex}"


def _publish(
    df: DataFrame,
    name: str,
    parts: Sequence[str],
    replaced: set[str],
    metrics: Sequence[Column] = (),
    keys: Sequence[str] = (),
    redefine: bool = False,
    gathered: bool = False,
) -> dict:
    """Write a new snapshot and point the table, or its partitions, at it.

    ``replaced`` names the partition folders whose old content ends here; those without
    a row in the new snapshot are dropped. Partitions outside of it are not touched.
    Metrics are observed in the writing stage, whose tasks count once even if run twice.
    Files are kept in the order of ``keys``, so that later scans can skip by them.
    ``redefine`` gives the table the columns of the frame, once these are written. Rows that are
    ``gathered``, so that a task holds few partitions, are written where they are.
    """
    spark = df.sparkSession
    path = _new_snapshot(spark, name)
    if not redefine:
        df = _conform(df, name, ACTION if metrics else None)
    if not parts:
        seen = _write(df, path, parts, metrics, keys)
        _invalidate(spark, name)
        if redefine:
            _redefine(df, name)
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    else:
        folders = F.collect_set(partition_folder(parts)).alias("folders")
        # Files of even size: small partitions are gathered, a hot one is split.
        even = df if gathered and KEY_BUCKET not in parts else df.hint("rebalance", *parts)
        seen = _write(even, path, parts, [*metrics, folders], keys)
        written = set(seen.pop("folders"))
        _invalidate(spark, name)
        if redefine:
            _redefine(df, name)
        held = _held_folders(spark, name)
        for folder in sorted(written & held):
            spark.sql(f"ALTER TABLE {name} {_spec(folder)} SET LOCATION '{path}/{folder}'")
        added = [f"{_spec(f)} LOCATION '{path}/{f}'" for f in sorted(written - held)]
        for at in range(0, len(added), _PER_STATEMENT):
            spark.sql(f"ALTER TABLE {name} ADD {' '.join(added[at:at + _PER_STATEMENT])}")
        _drop_folders(spark, name, (replaced & held) - written)
    spark.catalog.refreshTable(name)
    return seen


def _invalidate(spark: SparkSession, name: str) -> None:
    """Take away what was said of the old content, before the new one is seen."""
    held = [f"'{p}'" for p in INVALIDATED if p in _properties(spark, name)]
    if held:
        spark.sql(f"ALTER TABLE {name} UNSET TBLPROPERTIES IF EXISTS ({', '.join(held)})")


def _redefine(df: DataFrame, name: str) -> None:
    """Define the table anew with the columns of a frame; no file is deleted."""
    spark = df.sparkSession
    root, parts = _properties(spark, name)[_ROOT], partition_columns(spark, name)
    buckets, keys = _bucketing(spark, name)
    own, loads = [part for part in parts if part not in _LAST], LOAD in parts
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in parts or f.name in own
    )
    spark.sql(f"DROP TABLE {name}")
    ensure_table(spark, name, columns, own, root, buckets=buckets, bucket_by=keys, loads=loads)


def _conform(df: DataFrame, name: str, *others: str | None) -> DataFrame:
    """The columns of a table, matched by name and cast to its types; its bucket is computed.

    Rows that have no load yet are a load of their own.
    """
    spark = df.sparkSession
    buckets, keys = _bucketing(spark, name)
    types = {f.name: f.dataType for f in spark.table(name).schema}
    if buckets:
        del types[KEY_BUCKET]
    elif LOAD not in df.columns and _is_ours(spark, name) and LOAD in partition_columns(spark, name):
        df = df.withColumn(LOAD, F.lit(f"0-{_load_name()}"))
    columns = [F.col(c).cast(kind).alias(c) for c, kind in types.items()]
    if buckets:
        columns.append(bucket_of(buckets, *[F.col(key).cast(types[key]) for key in keys]))
    return df.select(*columns, *filter(None, others))


def _load_name() -> str:
    return uuid.uuid4().hex[:12]


def bucket_of(buckets: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(KEY_BUCKET)


def _write(df: DataFrame, path: str, parts, metrics, keys) -> dict:
    seen = Observation()
    df = df.observe(seen, *metrics) if metrics else df
    # The writer sorts by partition anyway; adding the keys makes it one sort for both.
    df = df.sortWithinPartitions(*parts, *keys) if keys else df
    writer = df.drop(ACTION).write.option("compression", COMPRESSION)
    if KEY_BUCKET in parts:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        for key in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return seen.get if metrics else {}


def partition_folder(parts: Sequence[str]) -> Column:
    """Folder of a row's partition, as the writer names it.

    Only plain values are taken, so that no name has to be escaped.
    """
    pieces = []
    for part in parts:
        value = F.col(part).cast("string")
        plain = F.when(value.rlike(r"^[A-Za-z0-9_.-]+$"), value).otherwise(
            F.raise_error(F.concat(F.lit(f"not a plain partition value of {part}: "), value))
        )
        pieces.append(
            F.concat(
                F.lit(f"{part}="), F.when(value.isNull(), F.lit(_NULL_FOLDER)).otherwise(plain)
            )
        )
    return F.concat_ws("/", *pieces)


def _part_names(folders: set[str]) -> list[str]:
    return [piece.partition("=")[0] for folder in list(folders)[:1] for piece in folder.split("/")]


def in_partitions(df: DataFrame, parts: Sequence[str], folders: set[str]) -> Column:
    """Rows of the named partitions, as plain comparisons by which the catalog prunes."""
    values = [dict(piece.split("=", 1) for piece in folder.split("/")) for folder in folders]
    inside = F.lit(bool(folders))
    for part in parts:
        kind = df.schema[part].dataType
        named = sorted({v[part] for v in values} - {_NULL_FOLDER})
        inside = inside & (
            F.col(part).isin([F.lit(value).cast(kind) for value in named])
            | (F.col(part).isNull() & F.lit(any(v[part] == _NULL_FOLDER for v in values)))
        )
    if len(parts) < 2 or not folders:
        return inside
    # Values of each column alone would also name combinations that nobody asked for.
    pieces = [
        F.concat(F.lit(f"{part}="), F.coalesce(F.col(part).cast("string"), F.lit(_NULL_FOLDER))) for part in parts
    ]
    return inside & F.concat_ws("/", *pieces).isin(sorted(folders))


def _held_folders(spark: SparkSession, name: str) -> set[str]:
    """Partitions known to the catalog: one entry per partition, never rows."""
    return {row["partition"] for row in spark.sql(f"SHOW PARTITIONS {name}").collect()}


def _drop_folders(spark: SparkSession, name: str, folders: set[str]) -> None:
    specs = [_spec(folder) for folder in sorted(folders)]
    for at in range(0, len(specs), _PER_STATEMENT):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {', '.join(specs[at:at + _PER_STATEMENT])}")


def _spec(folder: str) -> str:
    pairs = []
    for piece in folder.split("/"):
        column, _, value = piece.partition("=")
        pairs.append(f"{column} = " + ("null" if value == _NULL_FOLDER else f"'{value}'"))
    return f"PARTITION ({', '.join(pairs)})"


def overwrite_table(df: DataFrame, name: str, replace_schema: bool = False) -> None:
    """Replace the whole content; columns are matched by name, new ones are added to the table.

    With ``replace_schema`` the table takes the columns and types of the frame if they
    differ from its own; without it, values are cast to the stored types.
    """
    spark = df.sparkSession
    if not _is_ours(spark, name):
        if replace_schema:
            parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
            writer = df.write.format(_provider(spark, name)).mode("overwrite")
            writer = writer.option("overwriteSchema", "true")
            (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        else:
            df.writeTo(name).option("mergeSchema", "true").overwrite(F.lit(True))
        return
    parts, (buckets, keys) = partition_columns(spark, name), _bucketing(spark, name)
    held = {k: v for k, v in _types(spark.table(name)).items() if k not in parts or k not in _LAST}
    if replace_schema and _types(df) != held:
        if buckets:
            df = df.withColumn(KEY_BUCKET, bucket_of(buckets, *map(F.col, keys)))
        elif LOAD in parts:
            df = df.withColumn(LOAD, F.lit(f"0-{_load_name()}"))
        _publish(df, name, parts, set(), keys=keys, redefine=True)
        return
    stored = set(spark.table(name).columns)
    added = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in stored]
    if added:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(added)})")
    _publish(df, name, parts, _held_folders(spark, name) if parts else set(), keys=keys)


def _types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def _provider(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Provider'")
    return rows.first()["data_type"]


def replace_partitions(df: DataFrame, name: str, folders: set[str]) -> None:
    """Replace the content of some partitions by the frame, which holds rows of no others.

    Of a table cut further whole partitions are named, without a bucket or load.
    """
    spark = df.sparkSession
    if not _is_ours(spark, name):
        df.writeTo(name).overwrite(in_partitions(spark.table(name), _part_names(folders), folders))
        return
    parts, (_, keys) = partition_columns(spark, name), _bucketing(spark, name)
    if parts[-1] in _LAST:
        folders = {f for f in _held_folders(spark, name) if f.rpartition("/")[0] in folders}
    _publish(df, name, parts, folders, keys=keys)


def replace_buckets(df: DataFrame, name: str, buckets: set[int]) -> None:
    """Replace some buckets of a table that is cut by nothing else."""
    _publish(df, name, [KEY_BUCKET], {f"{KEY_BUCKET}={b}" for b in buckets})


def truncate_table(spark: SparkSession, name: str) -> None:
    """Empty the table. It keeps its definition; files being read are left alone."""
    _invalidate(spark, name)
    if not _is_ours(spark, name):
        spark.sql(f"TRUNCATE TABLE {name}")
    elif partition_columns(spark, name):
        _drop_folders(spark, name, _held_folders(spark, name))
    else:
        overwrite_table(spark.table(name).limit(0), name)


def merge_statement(
    target: str, source_view: str, keys: Sequence[str], when_matched: str | None = None
) -> str:
    """MERGE for a table format that has it."""
    on = " AND ".join(f"t.{key} = s.{key}" for key in keys)
    only = f" AND {when_matched}" if when_matched else ""
    return (
        f"MERGE INTO {target} t USING {source_view} s ON {on} "
        f"WHEN MATCHED{only} THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
    )


class Changes(NamedTuple):
    """What an upsert does to a table, found but not written."""

    name: str
    keys: list[str]
    #: Source rows that are new or win over a stored row.
    rows: DataFrame
    #: Stored rows that they replace; the columns asked for.
    replaced: DataFrame
    touched: set[str]
    small: bool
    n_rows: int
    n_replaced: int


def upsert_table(
    name: str,
    source: DataFrame,
    keys: Sequence[str],
    when_matched: str | None = None,
    *,
    on_duplicates: str = "raise",
    latest_by: Sequence[str] = (),
    small_source: bool | None = None,
    stored_source: bool = False,
    gathered: bool = False,
) -> dict[str, int]:
    """Upsert into a table and report the rows inserted, updated and left in place.

    Of a partitioned table only the partitions (and of a bucketed one the buckets) that lose or
    gain a row are rewritten; see :func:`upsert_changes` for how they are found. Rows left in
    place are counted in those. A batch that changes nothing writes nothing, so running one
    again is cheap and harmless. A format with MERGE reports what it counts itself.
    """
    spark = source.sparkSession
    if not _is_ours(spark, name):
        source = prepare_source(source, keys, on_duplicates, latest_by)
        source.createOrReplaceTempView("upsert_source")
        return merge_counts(spark.sql(merge_statement(name, "upsert_source", keys, when_matched)))
    with upsert_changes(
        name, source, keys, when_matched, on_duplicates=on_duplicates, latest_by=latest_by,
        small_source=small_source, stored_source=stored_source,
    ) as changes:
        return write_changes(changes, gathered)


@contextmanager
def upsert_changes(
    name: str,
    source: DataFrame,
    keys: Sequence[str],
    when_matched: str | None = None,
    *,
    on_duplicates: str = "raise",
    latest_by: Sequence[str] = (),
    replaced_columns: Sequence[str] = (),
    small_source: bool | None = None,
    stored_source: bool = False,
) -> Iterator[Changes]:
    """Find the rows an upsert changes, in one look at the stored rows near the source.

    The source is written once, unless the caller says that it is a stored table. Finding reads
    the key and partition columns, those of the condition (all columns if there is
    none: a source row equal to the stored one changes nothing) and ``replaced_columns``; of the
    stored rows only the buckets and the key range of the source, and for a few keys only
    row groups whose Bloom filters know them. A source measured to be small (or said to be by
    ``small_source``) is broadcast, which spares the stored rows their shuffle.
    """
    spark = source.sparkSession
    if on_duplicates == "latest":
        source = prepare_source(source, keys, on_duplicates, latest_by)
    source = _conform(source, name)
    with nullcontext(source) if stored_source else staged(source, "upsert-source") as source:
        if on_duplicates != "latest":
            prepare_source(source, keys, on_duplicates)
        target = spark.table(name)
        parts = partition_columns(spark, name) if _is_ours(spark, name) else []
        known = _profile(source, keys, parts)
        small = known["n_rows"] <= MAX_BROADCAST_ROWS and known["n_bytes"] <= MAX_BROADCAST_BYTES
        small = small if small_source is None else small_source
        near = near_rows(target, source, keys, known)
        looked_up = source
        if when_matched is None:
            content = _content(target, keys)
            near, looked_up = near.withColumn(_CONTENT, content), source.select(*keys, content.alias(_CONTENT))
        hits = matched_rows(near, F.broadcast(looked_up) if small else looked_up, keys, when_matched)
        if when_matched is None:
            hits = hits.withColumn("wins", ~F.col(f"t.{_CONTENT}").eqNullSafe(F.col(f"s.{_CONTENT}")))
        shown = [F.struct(*[f"s.{key}" for key in keys]).alias("key"), "wins"]
        shown += [F.struct(*[f"t.{c}" for c in dict.fromkeys([*parts, *replaced_columns, *keys[:1]])]).alias("stored")]
        with staged(hits.select(*shown), "upsert-hits") as hits:
            won = hits.filter("wins").select("stored.*")
            counts = hits.agg(F.count_if("wins"), F.count_if(~F.col("wins"))).first()
            rows = source
            if counts[1]:
                lost = hits.filter("NOT wins").select("key.*")
                # At most one per source row, so as small as the source.
                rows = new_rows(F.broadcast(lost) if small else lost, source, keys)
            n_rows = rows.count() if counts[1] else known["n_rows"]
            touched = folder_names(parts, won, rows) if parts and n_rows else set()
            yield Changes(name, list(keys), rows, won, touched, small, n_rows, counts[0])


_CONTENT = "_content"
# Texts that are longer are compared by their digests.
_PLAIN_BYTES = 64


def _content(table: DataFrame, keys: Sequence[str]) -> Column:
    """All columns but the keys, to be compared: long texts by SHA-256, so that they need not travel."""

    def short(field) -> Column:
        value = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            return value
        long = F.octet_length(value) > _PLAIN_BYTES
        return F.struct(F.when(~long, value), F.when(long, F.unhex(F.sha2(value.cast("binary"), 256))))

    return F.struct(F.lit(0), *[short(field) for field in table.schema if field.name not in (*keys, LOAD)])


def _emptied(changes: Changes, target: DataFrame, parts: Sequence[str]) -> set[str]:
    """Partitions all of whose rows are replaced. Counted by partition columns, which are not in the files."""

    def counted(rows: DataFrame) -> dict[str, int]:
        per_part = rows.groupBy(partition_folder(parts).alias("folder")).count()
        return {row["folder"]: row["count"] for row in per_part.collect()}

    held, gone = counted(target), counted(changes.replaced)
    return {folder for folder, n in held.items() if gone.get(folder) == n}


def _crowded(held: set[str], touched: set[str]) -> set[str]:
    """Loads to be merged: all that were merged equally often, where a touched partition has ``LOADS`` of them."""
    alike: dict[tuple[str, str], set[str]] = {}
    near = {folder.rpartition("/")[0] for folder in touched}
    for folder in held:
        partition, _, load = folder.rpartition("/")
        if partition in near:
            alike.setdefault((partition, load.partition("=")[2].partition("-")[0]), set()).add(folder)
    return set().union(*(folders for folders in alike.values() if len(folders) >= LOADS))


def write_changes(changes: Changes, gathered: bool = False) -> dict[str, int]:
    """Write what :func:`upsert_changes` found: stored rows of other keys stay, changed ones come in.

    A source that is ``gathered`` by about the partitions of the table, as one read from a table cut
    alike, is written without a shuffle where no stored row has to join it.
    """
    if not changes.n_rows:
        return {"n_inserted": 0, "n_updated": 0, "n_unchanged": 0}
    spark = changes.rows.sparkSession
    if not _is_ours(spark, changes.name):
        changes.rows.createOrReplaceTempView("upsert_source")
        return merge_counts(spark.sql(merge_statement(changes.name, "upsert_source", changes.keys)))
    parts, target = partition_columns(spark, changes.name), spark.table(changes.name)
    touched, crowded = changes.touched, set()
    if parts:
        held = _held_folders(spark, changes.name)
        if LOAD in parts:
            crowded = _crowded(held, touched)
            touched = touched | crowded
        near = touched & held
        target = target.filter(in_partitions(target, parts, near))
        if changes.n_replaced:
            # Of a partition that keeps nothing no row is read.
            near = near - _emptied(changes, target, parts)
            target = target.filter(in_partitions(target, parts, near))
        gathered = gathered and not near
    gone = changes.rows.select(*changes.keys)
    if changes.small:
        kept = target.join(F.broadcast(gone), changes.keys, "left_anti")
    else:
        kept = in_lanes(target, changes.keys).join(in_lanes(gone, changes.keys), [*changes.keys, LANE], "left_anti")
    if crowded:
        # The others keep the load that they came with.
        again = F.concat(F.substring_index(LOAD, "-", 1).cast("int") + 1, F.lit(f"-{_load_name()}"))
        moved = in_partitions(kept, parts, crowded)
        kept = kept.withColumn(LOAD, F.when(moved, again).otherwise(F.col(LOAD)))
    merged = kept.select(*target.columns, F.lit(KEEP).alias(ACTION)).unionByName(
        changes.rows.withColumn(ACTION, F.lit(INSERT))
    )
    left = F.count_if(F.col(ACTION) == KEEP).alias("n_unchanged")
    seen = _publish(merged, changes.name, parts, touched, [left], changes.keys, gathered=gathered)
    return {"n_inserted": changes.n_rows - changes.n_replaced, "n_updated": changes.n_replaced, **seen}


def _profile(source: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> dict:
    """Size, key bounds and buckets of an upsert source, from one look at it."""
    # A value for each bucket at most.
    buckets = [F.collect_set(KEY_BUCKET).alias("buckets")] if KEY_BUCKET in parts else []
    return source.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row_bytes(source)), F.lit(0)).alias("n_bytes"),
        *key_bounds(keys), *buckets,
    ).first().asDict()


def near_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], known: dict) -> DataFrame:
    """Stored rows that can match the source: of its buckets, and between its least and greatest key.

    The bounds reach the scan as plain comparisons, so of files kept in key order only the row
    groups near the source are read; a few keys are compared one by one, which Bloom filters answer.
    """
    if "buckets" in known:
        target = target.filter(F.col(KEY_BUCKET).isin(known["buckets"]))
    inside = in_bounds(target, keys, known)
    if 0 < known["n_rows"] <= POINT_KEYS:
        kind = target.schema[keys[0]].dataType
        points = source.filter(F.col(keys[0]).isNotNull()).select(keys[0]).distinct().collect()
        # Spelled out, as a long list would reach the files as a range only.
        same = [F.col(keys[0]) == F.lit(row[0]).cast(kind) for row in points]
        inside = inside & (reduce(Column.__or__, same) if same else F.lit(False))
    return target.filter(inside)


def merge_counts(result: DataFrame) -> dict[str, int]:
    """The row counts that a MERGE returns, as far as its format returns any."""
    names = {"num_inserted_rows": "n_inserted", "num_updated_rows": "n_updated"}
    row = result.select(*[c for c in result.columns if c in names]).first()
    return {names[c]: n for c, n in row.asDict().items()} if row else {}


def folder_names(parts: Sequence[str], *frames: DataFrame) -> set[str]:
    """Names of all partitions the frames have rows in: one per partition, never rows."""
    named = [df.select(partition_folder(parts).alias("folder")) for df in frames]
    names = reduce(DataFrame.unionByName, named).groupBy("folder").count()
    return {row["folder"] for row in names.collect()}
