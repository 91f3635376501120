"""One callable per operator of the library; each takes the session and the table folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smelter.functions.categories import normalize_categories
from smelter.functions.text import as_date, iso_timestamp, last_segment, strip
from smelter.operators.bounds import is_small
from smelter.operators.budget import admit, admitted_pages, article_bytes, page_sizes, text_bytes
from smelter.operators.contract import (
    VIOLATIONS, article_rules, reject_counts, rejected_rows, valid_rows,
)
from smelter.operators.dedupe import keep_first, keep_last
from smelter.operators.dimension import join_names
from smelter.operators.numbering import number_rows
from smelter.operators.upsert import new_rows, upsert, upsert_actions, upsert_counts
from smelter.plans.bronze import NEWER_WINS, accepted_articles, feed_rules, fetched_entries
from smelter.plans.gold import category_dim, named_codes, publication_trends, trend_counts
from smelter.plans.medallion import (
    Layout, ensure_rejects, load_increment, run_medallion, store_rejects,
)
from smelter.plans.quality import fact_profile, null_rate, quality_report, table_quality, year_totals
from smelter.plans.silver import silver_papers, silver_papers_counted, silver_papers_merged
from smelter.schemas import BRONZE_COLUMNS, CATEGORY_NAMES, SILVER_COLUMNS
from smelter.session import scratch_path, shared_folder, staged
from smelter.sources.feed import (
    parse_pages, read_page_stream, read_page_table, read_pages, scan_entries,
)
from smelter.sources.paging import (
    NEWEST_FIRST, TOP_K_ROWS, build_page_index, in_category, page, seek_page, sort_columns,
)
from smelter.sources.tables import (
    KEY_BUCKET, ensure_schema, ensure_table, overwrite_table, scan, truncate_table, upsert_table,
)
from smelter.streaming.ingest import collect_categories, ingest_first_copies, ingest_stream, settle
from workload.inputs import (
    FEED_CODES, defective_articles, feed_pages, land_files, land_in_latin1, order_articles, part_articles,
    part_categories, table,
)

BUDGET = 1024 * 1024

# Days between the two fetches of the feed.
LATER = 500


def shown(df: DataFrame) -> DataFrame:
    """Lists and times as text, so that results compare the same everywhere."""
    columns = []
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind == "array<string>":
            value = F.array_join(value, "|")
        elif kind.startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            value = value.cast("string")
        columns.append(value.alias(name))
    return df.select(*columns)


# Silver and gold


def trends(spark, sf_dir):
    papers = silver_papers(order_articles(spark, sf_dir))
    return publication_trends(papers, category_dim(spark))


def part_type_trends(spark, sf_dir):
    return trend_counts(part_articles(spark, sf_dir), part_dim(spark, sf_dir))


def part_dim(spark, sf_dir):
    """Names for part types; types with a brand stay unnamed."""
    types = table(spark, sf_dir, "part").select("p_type").distinct()
    return types.select(
        F.concat(F.upper("p_type"), F.lit(".GEN")).alias("category_code"),
        F.concat(F.lit("Type "), "p_type").alias("category_name"),
    )


def silver_transform(spark, sf_dir):
    return shown(silver_papers(order_articles(spark, sf_dir)))


def silver_transform_grouped(spark, sf_dir):
    articles = order_articles(spark, sf_dir)
    merged = silver_papers_merged(articles.unionByName(articles))
    return shown(merged.withColumn("categories", F.sort_array("categories")))


def silver_grouped_counts(spark, sf_dir):
    """Categories of merged papers as counts, over three copies of every article."""
    articles = order_articles(spark, sf_dir)
    counted = silver_papers_counted(articles.unionByName(articles).unionByName(articles))
    return counted.select("id", F.inline("category_counts"))


def category_normalize(spark, sf_dir):
    codes = normalize_categories(F.array(*part_categories()))
    return shown(table(spark, sf_dir, "part").select("p_partkey", codes.alias("codes")))


def category_dimension(spark, sf_dir):
    raw = order_articles(spark, sf_dir).select(F.explode("categories").alias("category_code"))
    return named_codes(raw.filter("category_code IS NOT NULL").distinct())


def left_join_fallback(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.explode(normalize_categories(F.array(*part_categories()))).alias("category_code"),
    )
    return join_names(parts, part_dim(spark, sf_dir))


def stored_fact(spark, sf_dir):
    return trend_counts(silver_papers(order_articles(spark, sf_dir)), category_dim(spark))


def fact_year_totals(spark, sf_dir):
    return year_totals(stored_fact(spark, sf_dir))


def fact_null_rate(spark, sf_dir):
    """Share of rows without a name, over labels joined to documents as the named side."""
    names = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("category_name")
    )
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.length("lang").alias("publication_year"), F.col("n_chars").alias("paper_count")
    )
    profile = fact_profile(documents.join(names, "doc_id", "left"))
    rate = null_rate(F.col("n_nameless"), F.col("n_rows"))
    return profile.withColumn("null_rate", rate)


def quality(spark, sf_dir):
    silver = silver_papers(order_articles(spark, sf_dir))
    return quality_report(silver, stored_fact(spark, sf_dir))


# Upserts: all orders as target, all orders under shifted keys as source


def stored_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.pmod("o_orderkey", F.lit(41)) != 0, F.col("o_orderdate")).alias("updated_date"),
    )


def incoming_orders(spark, sf_dir):
    """Keys overlap those of the target but for some new and some missing ones."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(F.pmod(key, F.lit(43)) != 0, key + 1000).alias("id"),
        (F.col("o_totalprice") + 1).alias("amount"),
        F.col("o_orderdate").alias("updated_date"),
    )


def shown_keys(df: DataFrame) -> DataFrame:
    """Keys that may be missing as text, too: not every reader has whole numbers with nulls."""
    return shown(df.withColumn("id", F.col("id").cast("string")))


def bronze_upsert_newer_wins(spark, sf_dir):
    source = incoming_orders(spark, sf_dir)
    return shown_keys(upsert(stored_orders(spark, sf_dir), source, ["id"], NEWER_WINS))


def silver_upsert(spark, sf_dir):
    return shown_keys(upsert(stored_orders(spark, sf_dir), incoming_orders(spark, sf_dir), ["id"]))


def upsert_small_source(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("amount"),
        F.lit("1998-01-01").cast("timestamp_ntz").alias("updated_date"),
    )
    merged = upsert(
        stored_orders(spark, sf_dir), source, ["id"], NEWER_WINS, small_source=is_small(source)
    )
    return shown_keys(merged)


def upsert_latest_source(spark, sf_dir):
    """A source with many rows per key: the last event of each user wins."""
    source = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "event_id", F.col("value").alias("amount")
    )
    target = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.lit(-1).cast("bigint").alias("event_id"),
        F.col("c_acctbal").alias("amount"),
    )
    return upsert(target, source, ["id"], on_duplicates="latest", latest_by=["event_id"])


def new_rows_only(spark, sf_dir):
    return shown_keys(new_rows(stored_orders(spark, sf_dir), incoming_orders(spark, sf_dir), ["id"]))


def upsert_action_counts(spark, sf_dir):
    source = incoming_orders(spark, sf_dir)
    return upsert_counts(
        upsert_actions(stored_orders(spark, sf_dir), source, ["id"], NEWER_WINS)
    )


# Bronze: contract, dedupe, budget, paging


def keep_first_by_key(spark, sf_dir):
    return shown(keep_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]))


def keep_last_by_key(spark, sf_dir):
    return shown(keep_last(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"]))


def contract_valid(spark, sf_dir):
    return shown(valid_rows(defective_articles(spark, sf_dir), article_rules()))


def contract_rejects(spark, sf_dir):
    rejects = rejected_rows(defective_articles(spark, sf_dir), article_rules())
    return shown(rejects.select("title", "pdf_url", F.col(VIOLATIONS).alias("violations")))


def contract_reject_counts(spark, sf_dir):
    return reject_counts(defective_articles(spark, sf_dir), article_rules())


def paged_documents(spark, sf_dir):
    """Documents in pages of fifty ids per language, in a fixed language order."""
    ordinal = F.array_position(F.array(*[F.lit(c) for c in FEED_CODES]), F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        ordinal.cast("int").alias("category_ordinal"),
        (F.col("doc_id") - F.pmod("doc_id", F.lit(50))).alias("page_start"),
        "doc_id",
        text_bytes("text").alias("n_bytes"),
    )


def page_bytes(spark, sf_dir):
    return page_sizes(paged_documents(spark, sf_dir), F.col("n_bytes"))


def pages_within_budget(spark, sf_dir):
    sizes = page_sizes(paged_documents(spark, sf_dir), F.col("n_bytes")).drop("page_rows")
    return admitted_pages(sizes, BUDGET)


def admit_by_budget(spark, sf_dir):
    return admit(paged_documents(spark, sf_dir), BUDGET, F.col("n_bytes"))


def page_by_category(spark, sf_dir):
    return shown(page(order_articles(spark, sf_dir), in_category("cs.AI"), 25, 100))


def page_beyond_top_k(spark, sf_dir):
    """A page so deep that the sort keys are numbered: the last articles of all."""
    articles = order_articles(spark, sf_dir)
    last = articles.count()
    return shown(page(articles, F.lit(True), last - 500, TOP_K_ROWS + 1))


def page_null_keys(spark, sf_dir):
    """The first articles by id, one of which has none."""
    articles = order_articles(spark, sf_dir).withColumn("id", F.expr("nullif(id, '1')"))
    return shown(page(articles, F.lit(True), 0, 50, ["id"]))


def page_seek(spark, sf_dir):
    """Two deep pages of a category from a stored index."""
    path = scratch_path(spark, "page-index")
    build_page_index(order_articles(spark, sf_dir), path, F.col("categories"), fence_rows=1000)
    pages = [seek_page(spark, path, start, 100, "cs.AI") for start in (25, 200)]
    return shown(pages[0].unionByName(pages[1]))


def page_order_numbers(spark, sf_dir):
    articles = order_articles(spark, sf_dir).select("id", "published_date")
    return shown(number_rows(articles, sort_columns(NEWEST_FIRST), "position"))


# Text


def latest_path_segment(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", last_segment(F.col("url")).alias("segment"))


def strip_text(spark, sf_dir):
    padded = F.concat(F.lit("\t  "), "text", F.lit(" \n "))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", strip(padded).alias("stripped")
    )


def lenient_times(spark, sf_dir):
    """ISO texts of several precisions among texts that are no times at all."""
    key, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    text = (
        F.when(F.pmod(key, F.lit(6)) == 0, F.concat(day, F.lit("T10:11:12Z")))
        .when(F.pmod(key, F.lit(6)) == 1, F.concat(day, F.lit("T10:11:12+02:00")))
        .when(F.pmod(key, F.lit(6)) == 2, day)
        .when(F.pmod(key, F.lit(6)) == 3, F.substring(day, 1, 4))
        .when(F.pmod(key, F.lit(6)) == 4, F.col("event_type"))
    )
    times = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return shown(
        times.select("event_id", iso_timestamp(F.col("t")).alias("at"), as_date(
            iso_timestamp(F.col("t"))).alias("on_day"))
    )


# Tables


def scratch_schema(spark: SparkSession) -> str:
    ensure_schema(spark, "workload_scratch", f"{shared_folder(spark)}/smelter/schema")
    return "workload_scratch"


def fresh_table(spark: SparkSession, label: str, columns: str, parts=()) -> str:
    """An empty table in the shared folder, under a name of its own."""
    name = f"{scratch_schema(spark)}.{label}_{uuid.uuid4().hex}"
    ensure_table(spark, name, columns, parts, scratch_path(spark, label))
    return name


ORDERS = "id bigint, amount double, status string, order_year int"


def yearly_orders(spark, sf_dir, shift=0, extra=0):
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + shift).alias("id"),
        (F.col("o_totalprice") + extra).alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("order_year"),
    )


def partitioned_roundtrip(spark, sf_dir):
    name = fresh_table(spark, "roundtrip", ORDERS, ["order_year"])
    overwrite_table(yearly_orders(spark, sf_dir), name)
    return spark.table(name)


def overwrite_twice(spark, sf_dir):
    name = fresh_table(spark, "overwrite", ORDERS)
    overwrite_table(yearly_orders(spark, sf_dir), name)
    overwrite_table(spark.table(name).withColumn("amount", F.col("amount") * 2), name)
    return scan(spark, name)


def truncate_then_upsert(spark, sf_dir):
    name = fresh_table(spark, "truncated", ORDERS, ["order_year"])
    overwrite_table(yearly_orders(spark, sf_dir), name)
    truncate_table(spark, name)
    upsert_table(name, yearly_orders(spark, sf_dir, 1000), ["id"])
    return spark.table(name)


def upsert_moves_partitions(spark, sf_dir):
    name = fresh_table(spark, "moved", ORDERS, ["order_year"])
    overwrite_table(yearly_orders(spark, sf_dir), name)
    upsert_table(name, yearly_orders(spark, sf_dir, 1000, 1), ["id"], "s.amount > t.amount")
    return spark.table(name)


def upsert_buckets(spark, sf_dir):
    """The same upsert into years that are cut by a hash of the key, in two batches."""
    name = f"{scratch_schema(spark)}.bucketed_{uuid.uuid4().hex}"
    location = scratch_path(spark, "bucketed")
    ensure_table(spark, name, ORDERS, ["order_year"], location, buckets=8, bucket_by=["id"])
    overwrite_table(yearly_orders(spark, sf_dir), name)
    changes = yearly_orders(spark, sf_dir, 1000, 1)
    for half in (0, 1):
        upsert_table(name, changes.filter(F.col("id") % 2 == half), ["id"], "s.amount > t.amount")
    return spark.table(name).drop(KEY_BUCKET)


def scan_by_view_name(spark, sf_dir):
    yearly_orders(spark, sf_dir).createOrReplaceGlobalTempView("workload_orders")
    return scan(spark, "global_temp.workload_orders").groupBy("order_year", "status").agg(
        F.count("id").alias("n_orders")
    )


# Feeds rendered from the documents


def landed_feed(spark, sf_dir):
    return land_files(feed_pages(spark, sf_dir), scratch_path(spark, "landed"))


def atom_feed_parse(spark, sf_dir):
    """All entries of landed pages, in which other vocabularies use plain names, too."""
    landed = land_files(feed_pages(spark, sf_dir, foreign=True), scratch_path(spark, "landed"))
    entries = parse_pages(read_pages(spark, landed))
    return shown(entries.drop("_malformed_page"))


def atom_entry_scan(spark, sf_dir):
    """All entries of dumps, of which those that can be are in Latin-1."""
    pages = [feed_pages(spark, sf_dir, encoding=encoding) for encoding in ("UTF-8", "ISO-8859-1")]
    landed = land_in_latin1(*pages, scratch_path(spark, "landed"))
    entries = scan_entries(spark, f"{landed}/*/*/*.txt")
    return shown(entries.drop("_malformed_page"))


def feed_reject_counts(spark, sf_dir):
    return reject_counts(parse_pages(feed_pages(spark, sf_dir)), feed_rules())


def feed_page_sizes(spark, sf_dir):
    entries = fetched_entries(feed_pages(spark, sf_dir), FEED_CODES)
    return page_sizes(valid_rows(entries, feed_rules()), article_bytes())


def bronze_batch(spark, sf_dir):
    path = scratch_path(spark, "pages")
    feed_pages(spark, sf_dir).write.parquet(path)
    entries = fetched_entries(read_page_table(spark, path), FEED_CODES)
    return shown(accepted_articles(entries).select(BRONZE_COLUMNS))


def stream_upsert(spark, sf_dir, **limits):
    source = landed_feed(spark, sf_dir)
    name = f"{scratch_schema(spark)}.streamed_{uuid.uuid4().hex}"
    pages = read_page_stream(spark, source, **(limits or {"max_bytes": 1024**3}))
    state, location = scratch_path(spark, "stream-state"), scratch_path(spark, "streamed")
    ingest_stream(pages, name, state, FEED_CODES, location).awaitTermination()
    return shown(spark.table(name).select(BRONZE_COLUMNS))


def settled(spark, sf_dir, budget_bytes=None, **limits):
    """The feed collected in small batches and settled once: the bronze table, and pages left out."""
    run, schema, folder = uuid.uuid4().hex, scratch_schema(spark), scratch_path(spark, "collected")
    collect_categories(
        spark, landed_feed(spark, sf_dir), folder, scratch_path(spark, "stream-state"), FEED_CODES, **limits
    )
    names = [f"{schema}.settled_{run}", f"{schema}.left_out_{run}"]
    settle(spark, folder, names[0], scratch_path(spark, "settled"), budget_bytes, names[1])
    return [spark.table(name) for name in names]


def stream_upsert_many_batches(spark, sf_dir):
    """The same stream in small batches: the limit must not decide which copies stay."""
    return shown(settled(spark, sf_dir, max_files=12)[0].select(BRONZE_COLUMNS))


def stream_within_budget(spark, sf_dir):
    """A budget over a whole stream: the articles of the pages that one pass would admit."""
    return shown(settled(spark, sf_dir, BUDGET, max_files=24)[0].select(BRONZE_COLUMNS))


def stream_left_out(spark, sf_dir):
    """The pages that the same budget leaves out."""
    return settled(spark, sf_dir, BUDGET, max_files=40)[1]


def stream_first_copies(spark, sf_dir):
    """The stream through keyed state, and what its batches report of broken rules."""
    pages = read_page_stream(spark, landed_feed(spark, sf_dir), max_files=60)
    run, schema = uuid.uuid4().hex, scratch_schema(spark)
    name, rejects = f"{schema}.firsts_{run}", f"{schema}.firsts_rejects_{run}"
    state, location = scratch_path(spark, "stream-state"), scratch_path(spark, "firsts")
    folder = scratch_path(spark, "collected")
    ingest_first_copies(
        pages, name, state, FEED_CODES, location, rejects, collected=folder
    ).awaitTermination()
    settle(spark, folder, name, location, rejects=rejects)
    return shown(spark.table(name).select(BRONZE_COLUMNS))


def stored_rejects(spark, sf_dir):
    """Rejects after two fetches: all pages, then those of one language again, without defects."""
    name = f"{scratch_schema(spark)}.rejects_{uuid.uuid4().hex}"
    ensure_rejects(spark, name, scratch_path(spark, "rejects"))
    pages = feed_pages(spark, sf_dir)
    with staged(fetched_entries(pages, FEED_CODES), "entries") as entries:
        store_rejects(entries, name)
        again = entries.filter(F.col("category") == "de")
        store_rejects(mended(again), name)
    rejects = spark.table(name).withColumn("violations", F.col(VIOLATIONS))
    return shown(rejects.select("category", "page_start", "entry_pos", "id", "violations"))


def mended(entries):
    """Entries whose missing fields are filled in."""
    filled = {"title": "t", "summary": "s", "pdf_url": "u"}
    authors = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.array(F.lit("a")))
    return entries.withColumns(
        {c: F.coalesce(F.when(F.length(c) > 0, F.col(c)), F.lit(v)) for c, v in filled.items()}
        | {"authors": authors, "published_date": F.coalesce("published_date", "updated_date")}
    )


def overwrite_new_schema(spark, sf_dir):
    """A table of years overwritten by a frame with a wider type and a column more."""
    orders = table(spark, sf_dir, "orders")
    name = f"{scratch_schema(spark)}.widened_{uuid.uuid4().hex}"
    ensure_table(spark, name, "k int, year int", ["year"], scratch_path(spark, "widened"))
    keyed = orders.select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("year"))
    overwrite_table(keyed, name)
    wider = keyed.select((F.col("k") + F.lit(10**10)).alias("k"), F.lit("o").alias("kind"), "year")
    overwrite_table(wider, name, replace_schema=True)
    return spark.table(name).select("k", "kind", "year")


def upsert_noop_counts(spark, sf_dir):
    """What a table reports for an upsert, and for the same one again."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year")
    )
    name = f"{scratch_schema(spark)}.again_{uuid.uuid4().hex}"
    ensure_table(spark, name, "k bigint, price double, year int", ["year"], scratch_path(spark, "again"))
    upsert_table(name, orders.filter("k % 2 = 0"), ["k"])
    changes = orders.withColumn("price", F.col("price") + F.expr("CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END"))
    rows = [upsert_table(name, changes, ["k"]) for _ in range(2)]
    return spark.createDataFrame(
        [(i, r["n_inserted"], r["n_updated"], r["n_unchanged"]) for i, r in enumerate(rows)],
        "run int, n_inserted bigint, n_updated bigint, n_unchanged bigint",
    )


def all_layers(spark, sf_dir):
    schema, run = scratch_schema(spark), uuid.uuid4().hex
    names = [f"{schema}.{t}_{run}" for t in ("bronze", "rejects", "silver", "dim", "fact")]
    layout = Layout(*names, scratch_path(spark, "layers"))
    report = run_medallion(
        feed_pages(spark, sf_dir), layout, FEED_CODES, CATEGORY_NAMES, budget_bytes=None
    )
    return layout, report


def layers_fact(spark, sf_dir):
    layout, _ = all_layers(spark, sf_dir)
    return spark.table(layout.fact).select("publication_year", "category_name", "paper_count")


def layers_increment(spark, sf_dir):
    """The feed in two fetches, the second with newer versions filed under other years."""
    layout, _ = all_layers(spark, sf_dir)
    load_increment(
        feed_pages(spark, sf_dir, LATER), layout, FEED_CODES, CATEGORY_NAMES, budget_bytes=None
    )
    return spark.table(layout.fact).select("publication_year", "category_name", "paper_count")


def layers_silver(spark, sf_dir):
    layout, _ = all_layers(spark, sf_dir)
    return shown(spark.table(layout.silver).select(SILVER_COLUMNS))


def layers_quality(spark, sf_dir):
    """The whole report after two fetches; names of tables without the number of the run."""
    layout, _ = all_layers(spark, sf_dir)
    load_increment(feed_pages(spark, sf_dir, LATER), layout, FEED_CODES, CATEGORY_NAMES)
    report = table_quality(spark, layout.dim, layout.silver, layout.fact)
    return report.withColumn("check", F.regexp_replace("check", "_[0-9a-f]{32}$", ""))


QUERIES = {
    "publication_trends": trends,
    "part_type_trends": part_type_trends,
    "silver_transform": silver_transform,
    "silver_transform_grouped": silver_transform_grouped,
    "silver_grouped_counts": silver_grouped_counts,
    "category_normalize": category_normalize,
    "category_dim": category_dimension,
    "left_join_fallback": left_join_fallback,
    "fact_year_totals": fact_year_totals,
    "fact_null_rate": fact_null_rate,
    "quality_report": quality,
    "bronze_upsert_newer_wins": bronze_upsert_newer_wins,
    "silver_upsert": silver_upsert,
    "upsert_small_source": upsert_small_source,
    "upsert_latest_source": upsert_latest_source,
    "new_rows_only": new_rows_only,
    "upsert_counts": upsert_action_counts,
    "keep_first_by_key": keep_first_by_key,
    "keep_last_by_key": keep_last_by_key,
    "contract_valid": contract_valid,
    "contract_rejects": contract_rejects,
    "reject_counts": contract_reject_counts,
    "page_bytes": page_bytes,
    "pages_within_budget": pages_within_budget,
    "admit_by_budget": admit_by_budget,
    "page_by_category": page_by_category,
    "page_beyond_top_k": page_beyond_top_k,
    "page_null_keys": page_null_keys,
    "page_seek": page_seek,
    "page_order_numbers": page_order_numbers,
    "latest_path_segment": latest_path_segment,
    "strip_text": strip_text,
    "lenient_times": lenient_times,
    "partitioned_roundtrip": partitioned_roundtrip,
    "overwrite_twice": overwrite_twice,
    "truncate_then_upsert": truncate_then_upsert,
    "upsert_moves_partitions": upsert_moves_partitions,
    "upsert_buckets": upsert_buckets,
    "scan_by_view_name": scan_by_view_name,
    "atom_feed_parse": atom_feed_parse,
    "atom_entry_scan": atom_entry_scan,
    "feed_reject_counts": feed_reject_counts,
    "feed_page_sizes": feed_page_sizes,
    "bronze_batch": bronze_batch,
    "stream_upsert": stream_upsert,
    "layers_fact": layers_fact,
    "stream_upsert_many_batches": stream_upsert_many_batches,
    "stream_within_budget": stream_within_budget,
    "stream_left_out": stream_left_out,
    "stream_first_copies": stream_first_copies,
    "stored_rejects": stored_rejects,
    "overwrite_new_schema": overwrite_new_schema,
    "upsert_noop_counts": upsert_noop_counts,
    "layers_increment": layers_increment,
    "layers_silver": layers_silver,
    "layers_quality": layers_quality,
}
