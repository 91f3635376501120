"""Landing folder to bronze, or to all layers, as a stream of bounded micro-batches.

There are two ways into bronze. :func:`ingest_stream` merges each micro-batch into the table, for
readers that wait for it. New rows go beside the stored ones. :func:`collect_stream` only appends what comes in to a folder, and
:func:`settle` merges all of it at once: partitions are rewritten once per settlement, not
once per batch, and a size budget can be applied to the whole stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from smelter.operators.budget import article_bytes, bytes_before
from smelter.operators.contract import VIOLATIONS, Rule, broken_rules, valid_rows, with_violations
from smelter.operators.dedupe import keep_first
from smelter.plans.bronze import (
    FETCHED, FETCHED_TYPE, FIRST_FETCHED_WINS, ensure_bronze, fetched_entries, first_articles, page_rules, upsert_bronze,
)
from smelter.plans.medallion import (
    NOTHING_DONE, Layout, ensure_layers, ensure_rejects, load_increment, store_rejects,
)
from smelter.schemas import BRONZE, BRONZE_COLUMNS, CATEGORY_CODES, CATEGORY_NAMES
from smelter.session import COMPRESSION, configured, remove, staged
from smelter.sources.feed import FETCH_ORDER, LANDED, MALFORMED, category_folders, parse_pages, read_page_stream
from smelter.sources.tables import ensure_table, overwrite_table
from smelter.streaming.state import BROKEN, first_copies, keep_state_on_disk, state_by_cores

#: Pages that a budget left out, with their size and that of all pages before them.
LEFT_OUT = "category_ordinal int, page_start bigint, page_bytes bigint, page_rows bigint, bytes_before bigint"


def ingest_stream(
    pages: DataFrame,
    table: str,
    checkpoint: str,
    codes: Sequence[str] = CATEGORY_CODES,
    location: str | None = None,
    rejects: str | None = None,
) -> StreamingQuery:
    """Upsert all pages landed so far into bronze, then stop.

    Rejects go to the table named by ``rejects``, by page, if there is one.

    Each micro-batch, bounded by the limits of the page stream, is parsed, validated and
    deduped once, and merged newer-wins. A batch repeated after a failure changes
    nothing, and a late older version never replaces a newer one, whatever the order
    in which the files arrive. Of copies with one date the first in fetch order stays, so
    the limits do not decide what is stored.

    The table is cut by its loads, too, so a batch writes its own rows and the partitions that lose a
    row to it, not the months that it falls into. A table that was made without loads stays as it is.
    """
    ensure_bronze(pages.sparkSession, table, location, loads=True)
    if rejects:
        ensure_rejects(pages.sparkSession, rejects)

    def merge(batch: DataFrame, batch_id: int) -> None:
        with staged(fetched_entries(batch, codes), f"entries-{batch_id}") as entries:
            if rejects:
                store_rejects(entries, rejects)
            with first_articles(entries) as ready:
                upsert_bronze(ready, table, FIRST_FETCHED_WINS, stored=True)

    return _available_now(pages, checkpoint, merge)


def ingest_first_copies(
    pages: DataFrame,
    table: str,
    checkpoint: str,
    codes: Sequence[str] = CATEGORY_CODES,
    location: str | None = None,
    rejects: str | None = None,
    wait: str = "1 day",
    collected: str | None = None,
) -> StreamingQuery:
    """The same with keyed state: of an article only copies fetched before all earlier ones reach the table.

    State remembers the first copy of each article for as long as ``wait`` after it came in;
    a copy that comes later is compared with the table, as every copy is by :func:`ingest_stream`. Rows
    per broken rule are reported with each batch, for a listener like
    :class:`smelter.streaming.state.BrokenRules`.

    With a folder ``collected`` the copies of a batch, rejects included, are only appended there, in the
    one job that moves the state, and :func:`settle` merges all of them at once. A batch then costs
    what comes in with it, however large the table is.
    """
    spark = pages.sparkSession
    ensure_bronze(spark, table, location)
    if rejects:
        ensure_rejects(spark, rejects)
    keep_state_on_disk(spark)
    rules = page_rules()
    entries = with_violations(fetched_entries(pages, codes), rules).observe(BROKEN, *broken_rules(rules))
    broken = F.size(VIOLATIONS) > 0
    # A reject has no copies: its place is its key.
    keyed = entries.withColumns(
        {"_id": F.when(~broken, F.col("id")), "_place": F.when(broken, F.struct("category", "page_start", "entry_pos"))}
    )
    keyed = keyed.withColumn(_AGE, _age())
    firsts = first_copies(keyed, ["_id", "_place"], [_AGE, *FETCH_ORDER], LANDED, wait)

    if collected:
        with state_by_cores(spark):
            return _available_now(
                firsts, checkpoint, lambda batch, batch_id: _append(_sized(batch), collected, batch_id), "update"
            )

    def merge(batch: DataFrame, batch_id: int) -> None:
        with staged(batch, f"firsts-{batch_id}") as rows:
            if rejects:
                store_rejects(rows.drop(VIOLATIONS), rejects)
            good = rows.filter(F.size(VIOLATIONS) == 0).select(*BRONZE_COLUMNS, _fetched())
            upsert_bronze(_newest(good), table, FIRST_FETCHED_WINS)

    with state_by_cores(spark):
        return _available_now(firsts, checkpoint, merge, "update")


# Sorts newer versions first.
_AGE = "_age"


def _age() -> Column:
    return -F.unix_micros("updated_date")


def _newest(articles: DataFrame) -> DataFrame:
    """One row per article: its newest version, and of copies of that the one fetched first."""
    return keep_first(articles.withColumn(_AGE, _age()), ["id"], [_AGE, FETCHED]).drop(_AGE)


def _fetched() -> Column:
    return F.struct(*FETCH_ORDER).cast(FETCHED_TYPE).alias(FETCHED)


def collect_stream(
    pages: DataFrame,
    folder: str,
    checkpoint: str,
    codes: Sequence[str] = CATEGORY_CODES,
    rejects: str | None = None,
    lane: str | None = None,
) -> StreamingQuery:
    """Append the valid articles of all pages landed so far to a folder, then stop.

    A micro-batch is one narrow job: what it parses is written with the size of each article, and
    nothing is shuffled or read again. Copies and sizes are settled over all batches at once. A batch
    that is repeated after a failure replaces its own part. Pages that have to be read for the scopes
    of their names are appended as they are, and read when they are settled: so no batch waits for
    Python workers that hardly any needs.

    Streams that append to one folder at a time need a ``lane`` each, and take no ``rejects``.
    """
    if not rejects:
        # Parsed by the plan of the stream, which is built once and not anew for each batch.
        return _available_now(
            _valid_articles(fetched_entries(pages, codes, _PAGE), _PAGE), checkpoint,
            lambda batch, batch_id: _append(batch, folder, batch_id, lane),
        )
    if lane:
        raise ValueError("a table of rejects has one writer")
    ensure_rejects(pages.sparkSession, rejects)

    def append(batch: DataFrame, batch_id: int) -> None:
        with staged(batch, f"entries-{batch_id}") as entries:
            store_rejects(entries, rejects)
            _append(_valid_articles(entries), folder, batch_id)

    return _available_now(fetched_entries(pages, codes), checkpoint, append)


#: Categories collected at a time.
SIDE_BY_SIDE = 8

# A small batch is cut into a few tasks, not into one per core: other categories fill the cores that it leaves.
_FEW_TASKS = {"spark.sql.files.minPartitionNum": "3", "spark.sql.files.openCostInBytes": "1m"}


def collect_categories(
    spark: SparkSession,
    path: str,
    folder: str,
    checkpoint: str,
    codes: Sequence[str] = CATEGORY_CODES,
    max_bytes: int | None = None,
    max_files: int | None = None,
    side_by_side: int = SIDE_BY_SIDE,
) -> None:
    """Collect a landing folder by :func:`collect_stream`, a stream for each category, and wait for all.

    Small micro-batches wait for their logs and plans longer than they compute. The batches of one
    category come one after the other, those of several at the same time; the limits hold for
    each batch. Every category has a checkpoint of its own, so later runs may find other categories.
    """
    waiting, running = category_folders(spark, path), []
    with configured(spark, _FEW_TASKS):
        try:
            while waiting or running:
                while waiting and len(running) < side_by_side:
                    name = waiting.pop(0)
                    pages = read_page_stream(spark, path, max_bytes, max_files, only=name)
                    lane = name.partition("=")[2]
                    running.append(collect_stream(pages, folder, f"{checkpoint}/{name}", codes, lane=lane))
                running = [query for query in running if not query.awaitTermination(0.1)]
        finally:
            for query in running:
                query.stop()


# Size of a collected article; text of a page that is parsed when it is settled.
_BYTES, _PAGE = "_bytes", "_page"
# Rejects may be collected along with the articles; these say what they break.
COLLECTED = (
    f"{BRONZE}, {FETCHED} {FETCHED_TYPE}, {_BYTES} bigint, category string, {MALFORMED} boolean, "
    f"{VIOLATIONS} array<string>, {_PAGE} string, batch bigint"
)


def _valid_articles(entries: DataFrame, held: str | None = None) -> DataFrame:
    """Valid entries as they are collected, and the pages that were held."""
    rules, more = page_rules(), [c for c in (held, "batch") if c in entries.columns]
    if held:
        rules = [Rule(rule.name, F.col(held).isNotNull() | rule.holds) for rule in rules]
    return _sized(valid_rows(entries, rules)).select(*BRONZE_COLUMNS, FETCHED, _BYTES, *more)


def _with_held_pages(collected: DataFrame) -> DataFrame:
    """What was collected, with the pages that were held parsed."""
    articles, held = collected.filter(F.col(_PAGE).isNull()), collected.filter(F.col(_PAGE).isNotNull())
    if held.isEmpty():
        return articles.drop(_PAGE)
    place = [F.col(f"{FETCHED}.{c}").alias(c) for c in ("category_ordinal", "page_start")]
    parsed = _valid_articles(parse_pages(held.select(*place, F.col(_PAGE).alias("payload"), "batch")))
    return articles.select(parsed.columns).unionByName(parsed)


def _sized(entries: DataFrame) -> DataFrame:
    kept = [c for c in ("category", MALFORMED, VIOLATIONS, _PAGE, "batch") if c in entries.columns]
    return entries.select(*BRONZE_COLUMNS, _fetched(), article_bytes().alias(_BYTES), *kept)


def _collected_entries(collected: DataFrame) -> DataFrame:
    """What was collected with its violations, as entries: of a page that came in twice, the later ones."""
    entries = collected.filter(F.col(VIOLATIONS).isNotNull()).select(
        "category", f"{FETCHED}.*", *BRONZE_COLUMNS, MALFORMED, "batch"
    )
    last = entries.groupBy("category", "page_start").agg(F.max("batch").alias("_last"))
    last = last.select(F.col("category").alias("_c"), F.col("page_start").alias("_p"), "_last")
    # Read again, only a page's own rows can be news: nothing is compared but places.
    same = F.col("category").eqNullSafe(F.col("_c")) & F.col("page_start").eqNullSafe(F.col("_p"))
    return entries.join(last, same & (F.col("batch") == F.col("_last")), "left_semi").drop("batch")


def _append(articles: DataFrame, folder: str, batch_id: int, lane: str | None = None) -> None:
    writer = articles.write.mode("overwrite").option("compression", COMPRESSION)
    writer.parquet(f"{folder}/articles/{f'lane={lane}/' if lane else ''}batch={batch_id}")


def _collected_sizes(articles: DataFrame) -> DataFrame:
    """Page sizes of everything collected. A page that came in twice is one page, as large as it ever was."""
    place = [F.col(f"{FETCHED}.{c}").alias(c) for c in ("category_ordinal", "page_start")]
    per_batch = articles.groupBy("batch", *place).agg(
        F.sum(_BYTES).alias("page_bytes"), F.count(F.lit(1)).alias("page_rows")
    )
    return per_batch.groupBy("category_ordinal", "page_start").agg(
        F.max("page_bytes").alias("page_bytes"), F.max("page_rows").alias("page_rows")
    )


def settle(
    spark: SparkSession,
    folder: str,
    table: str,
    location: str | None = None,
    budget_bytes: int | None = None,
    left_out: str | None = None,
    keep: bool = False,
    rejects: str | None = None,
) -> dict[str, int]:
    """Merge everything collected in a folder into bronze, within a size budget if one is given.

    The budget is that of one pass over all pages: which pages are admitted is decided on the
    sizes of all of them, in fetch order, whatever batches they came in. Pages beyond it are
    listed in the table ``left_out``. Rejects that were collected go to the table ``rejects``, by page.
    What was settled is removed from the folder (unless ``keep``)
    after it is in the table; a settlement that broke off is simply run again.
    """
    ensure_bronze(spark, table, location)
    if left_out:
        ensure_table(spark, left_out, LEFT_OUT)
    try:
        # The schema is known; looking it up would open files of every batch.
        articles = spark.read.schema(COLLECTED).parquet(f"{folder}/articles")
    except Exception as missing:  # nothing was ever collected
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return dict(NOTHING_DONE)
    if rejects:
        ensure_rejects(spark, rejects)
        with staged(_collected_entries(articles), "entries") as entries:
            store_rejects(entries, rejects)
    broken = F.col(VIOLATIONS)
    articles = articles.filter(broken.isNull() | (F.size(broken) == 0)).drop("category", MALFORMED, VIOLATIONS)
    articles = _with_held_pages(articles)
    if budget_bytes is not None:
        with staged(bytes_before(_collected_sizes(articles)), "sizes") as running:
            beyond = running.filter(F.col("bytes_before") >= budget_bytes)
            if left_out:
                overwrite_table(beyond, left_out)
            first = beyond.agg(F.min(F.struct("category_ordinal", "page_start")).alias("page")).first()["page"]
        if first is not None:
            # Admitted pages come before all others in fetch order: one comparison, no join.
            place = F.struct(f"{FETCHED}.category_ordinal", f"{FETCHED}.page_start")
            end = F.struct(F.lit(first["category_ordinal"]), F.lit(first["page_start"]).cast("bigint"))
            articles = articles.filter(place < end)
    done = upsert_bronze(_newest(articles.select(*BRONZE_COLUMNS, FETCHED)), table, FIRST_FETCHED_WINS)
    if not keep:
        remove(spark, f"{folder}/articles")
    return done


def layers_stream(
    pages: DataFrame,
    layout: Layout,
    checkpoint: str,
    codes: Sequence[str] = CATEGORY_CODES,
    names: Mapping[str, str] = CATEGORY_NAMES,
) -> StreamingQuery:
    """Bring all pages landed so far through all layers, then stop.

    Each micro-batch is one increment; like it, a batch can be repeated after a failure.
    """
    ensure_layers(pages.sparkSession, layout)

    def advance(batch: DataFrame, batch_id: int) -> None:
        load_increment(batch, layout, codes, names, wins=FIRST_FETCHED_WINS)

    return _available_now(pages, checkpoint, advance)


def _available_now(rows: DataFrame, checkpoint: str, each_batch, mode: str = "append") -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(each_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
