"""The same results in plain SQL over the given tables, written without the library."""

from __future__ import annotations

from smelter.functions.text import WHITESPACE
from smelter.schemas import CATEGORY_NAMES
from workload.inputs import FEED_CODES, NOT_XML
from workload.queries import BUDGET, LATER


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_CODES = _list(CATEGORY_NAMES)
_DIM = "(VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in CATEGORY_NAMES.items()) + ") d(code, name)"


def _clean(categories: str) -> str:
    """Clean-up of a category list, code by code."""
    split = (
        f"flatten(list_transform(list_filter({categories}, lambda x: x IS NOT NULL), "
        "lambda x: string_split(x, ',')))"
    )
    cut = (
        f"list_transform({split}, lambda k: lower(trim(regexp_replace(regexp_replace("
        r"k, '\s-.*', '', 'g'), '\s*\(.*\)', '', 'g'), ' ')))"
    )
    full = f"list_transform({cut}, lambda k: CASE WHEN k LIKE '%.%' THEN k ELSE k || '.gen' END)"
    return f"list_filter({full}, lambda k: k <> '.gen')"


def _time(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column}"


def _joined(column: str, name: str | None = None) -> str:
    return f"array_to_string({column}, '|') AS {name or column}"


_ARTICLES = f"""
    coded AS (
        SELECT *, {_CODES}[o_custkey % 40 + 1] AS c1, {_CODES}[(o_orderkey * 7 + 3) % 40 + 1] AS c2
        FROM orders),
    articles AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey AS title,
            o_orderpriority AS summary, ['Cust ' || o_custkey] AS authors,
            CASE o_orderkey % 10
                WHEN 0 THEN [c1 || ' (' || o_orderpriority || ')']
                WHEN 1 THEN [c1 || ' - note', c2]
                WHEN 2 THEN [c1 || ', ' || c2]
                WHEN 3 THEN [o_orderstatus]
                WHEN 4 THEN [' (junk)']
                WHEN 5 THEN [c1, NULL, '', c1]
                WHEN 6 THEN CAST([] AS VARCHAR[])
                WHEN 8 THEN ['math.CO (a) b (c)', upper(c2), '  , ']
                WHEN 9 THEN [c1, c2 || '-x']
            END AS categories,
            o_orderdate AS published_date,
            o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS updated_date,
            CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'http://x/' || o_orderkey END AS pdf_url
        FROM coded)"""

_SILVER = f"""{_ARTICLES},
    silver AS (
        SELECT * FROM (
            SELECT id, title, summary, authors, {_clean("categories")} AS categories,
                CAST(published_date AS DATE) AS published_date,
                CAST(updated_date AS DATE) AS updated_date, pdf_url,
                CAST(year(published_date) AS INTEGER) AS publication_year
            FROM articles)
        WHERE len(categories) > 0)"""

_SILVER_SHOWN = f"""id, title, summary, {_joined("authors")}, {_joined("categories")},
    CAST(published_date AS VARCHAR) AS published_date,
    CAST(updated_date AS VARCHAR) AS updated_date, pdf_url, publication_year"""

_FACT = f"""{_SILVER},
    listed AS (SELECT publication_year, id, unnest(categories) AS code FROM silver),
    fact AS (
        SELECT publication_year, coalesce(d.name, l.code) AS category_name,
            CAST(count(l.id) AS BIGINT) AS paper_count
        FROM listed l LEFT JOIN {_DIM} ON lower(d.code) = lower(l.code)
        GROUP BY ALL)"""

_PART_CATEGORIES = (
    "[p_type || '.' || p_brand || ' (legacy)', p_type || ' - ' || p_name, "
    "p_name || ' , ' || p_type || '.' || p_brand, ' (junk)']"
)
_PART_NAME = "(SELECT DISTINCT lower(p_type || '.GEN') AS code, 'Type ' || p_type AS name FROM part)"

_DEFECTIVE = f"""{_ARTICLES},
    defective AS (
        SELECT
            CASE WHEN k % 97 = 0 THEN NULL WHEN k % 101 = 0 THEN '' ELSE id END AS id,
            CASE WHEN k % 89 = 0 THEN '' WHEN k % 83 = 0 THEN ' ' ELSE title END AS title,
            CASE WHEN k % 79 = 0 THEN NULL ELSE summary END AS summary,
            CASE WHEN k % 73 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 71 = 0 THEN [CAST(NULL AS VARCHAR)]
                ELSE authors END AS authors,
            categories,
            CASE WHEN k % 67 = 0 THEN NULL ELSE published_date END AS published_date,
            CASE WHEN k % 61 = 0 THEN NULL ELSE updated_date END AS updated_date,
            CASE WHEN k % 59 = 0 THEN NULL ELSE pdf_url END AS pdf_url
        FROM (SELECT *, CAST(id AS BIGINT) AS k FROM articles))"""


def _full_list(column: str) -> str:
    return f"coalesce(len({column}) > 0 AND len(list_filter({column}, lambda x: x IS NULL)) = 0, false)"


_RULES = {
    "id_required": "coalesce(length(id) > 0, false)",
    "title_required": "coalesce(length(title) > 0, false)",
    "summary_required": "coalesce(length(summary) > 0, false)",
    "authors_not_empty": _full_list("authors"),
    "categories_not_empty": _full_list("categories"),
    "published_date_present": "published_date IS NOT NULL",
    "updated_date_present": "updated_date IS NOT NULL",
    "pdf_url_present": "pdf_url IS NOT NULL",
}
_VALID = " AND ".join(f"({rule})" for rule in _RULES.values())
_BROKEN = "concat_ws('|', " + ", ".join(
    f"CASE WHEN NOT ({rule}) THEN '{name}' END" for name, rule in _RULES.items()
) + ")"


def _rule_counts(relation: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"rule\", count(*) AS n_rows FROM {relation} WHERE NOT ({rule}) "
        "HAVING count(*) > 0"
        for name, rule in rules.items()
    )


_STORED = """
    t AS (SELECT o_orderkey AS id, o_totalprice AS amount,
            CASE WHEN o_orderkey % 41 <> 0 THEN o_orderdate END AS updated_date FROM orders)"""
_INCOMING = """
    s AS (SELECT CASE WHEN o_orderkey % 43 <> 0 THEN o_orderkey + 1000 END AS id,
            o_totalprice + 1 AS amount, o_orderdate AS updated_date FROM orders)"""
_UPSERT_SHOWN = f"CAST(id AS VARCHAR) AS id, amount, {_time('updated_date')}"


def _merged(condition: str, columns: str) -> str:
    """Target rows with winning source rows put in, then the source rows without a target."""
    chosen = ", ".join(
        f"CASE WHEN s.id IS NOT NULL AND coalesce({condition}, false) THEN s.{c} ELSE t.{c} END AS {c}"
        for c in columns.split(", ")
    )
    added = ", ".join(f"s.{c}" for c in columns.split(", "))
    return f"""
        (SELECT {chosen} FROM t LEFT JOIN s ON t.id = s.id
         UNION ALL
         SELECT {added} FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = s.id))"""


_UPSERT_COLUMNS = "id, amount, updated_date"

_PAGED = f"""
    paged AS (
        SELECT CAST(list_position({_list(FEED_CODES)}, lang) AS INTEGER) AS category_ordinal,
            CAST(doc_id // 50 * 50 AS BIGINT) AS page_start, doc_id,
            CAST(strlen(text) AS BIGINT) AS n_bytes
        FROM documents),
    sized AS (
        SELECT category_ordinal, page_start, CAST(sum(n_bytes) AS BIGINT) AS page_bytes,
            count(*) AS page_rows
        FROM paged GROUP BY ALL),
    running AS (
        SELECT *, CAST(coalesce(sum(page_bytes) OVER (ORDER BY category_ordinal, page_start
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before
        FROM sized)"""

_ORDERS_BY_YEAR = """SELECT o_orderkey + {shift} AS id, o_totalprice + {extra} AS amount,
    o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders"""

_ESCAPES = "".join(
    rf"\x{{{ord(c):x}}}" for c in WHITESPACE
)


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{_ESCAPES}]+', ''), '[{_ESCAPES}]+$', '')"


_ENTRIES = rf"""
    filed AS (
        SELECT *, unnest([lang, 'mixed']) AS category,
            CAST(TIMESTAMP '2015-01-01' + to_days(CAST(doc_id % 3650 AS INTEGER)) AS TIMESTAMP) AS d
        FROM documents),
    entries AS (
        SELECT category, CAST(doc_id // 250 * 250 AS BIGINT) AS page_start,
            CAST(row_number() OVER (PARTITION BY category, doc_id // 250 ORDER BY doc_id) - 1
                AS INTEGER) AS entry_pos,
            doc_id || 'v1' AS id,
            CASE WHEN doc_id % 50 <> 9 THEN ' Document ' || doc_id || ' via ' || category END AS title,
            CASE WHEN doc_id % 50 = 17 THEN ''
                ELSE {_strip(f"regexp_replace(text, '{NOT_XML}', '', 'g')")} END AS summary,
            CASE WHEN doc_id % 50 <> 7 THEN [source, 'A & B'] END AS authors,
            [{_CODES}[doc_id % 40 + 1] || ' (x)', lang] AS categories,
            CASE WHEN doc_id % 50 <> 11 THEN d + INTERVAL 390 MINUTE END AS published_date,
            d + INTERVAL 1050 MINUTE AS updated_date,
            CASE WHEN doc_id % 50 = 13 THEN NULL WHEN doc_id % 3 = 0 THEN ''
                ELSE 'http://x/pdf/' || doc_id END AS pdf_url
        FROM filed)"""

_ARTICLE_SHOWN = f"""id, title, summary, {_joined("authors")}, {_joined("categories")},
    {_time("published_date")}, {_time("updated_date")}, pdf_url"""

_ACCEPTED = f"""{_ENTRIES},
    accepted AS (
        SELECT * FROM entries WHERE {_VALID}
        QUALIFY row_number() OVER (PARTITION BY id
            ORDER BY list_position({_list(FEED_CODES)}, category), page_start, entry_pos) = 1)"""

_FEED_SIZES = f"""
    feed_sizes AS (
        SELECT CAST(list_position({_list(FEED_CODES)}, category) AS INTEGER) AS category_ordinal, page_start,
            CAST(sum(strlen(id) + strlen(title) + strlen(summary) + strlen(pdf_url)
                + strlen(array_to_string(authors, '')) + strlen(array_to_string(categories, ''))
                + 16) AS BIGINT) AS page_bytes,
            count(*) AS page_rows
        FROM entries WHERE {_VALID} GROUP BY ALL),
    feed_running AS (
        SELECT *, CAST(coalesce(sum(page_bytes) OVER (ORDER BY category_ordinal, page_start
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before
        FROM feed_sizes)"""

_LAYER_SILVER = f"""{_ACCEPTED},
    silver AS (
        SELECT id, title, summary, authors, {_clean("categories")} AS categories,
            CAST(published_date AS DATE) AS published_date,
            CAST(updated_date AS DATE) AS updated_date, pdf_url,
            CAST(year(published_date) AS INTEGER) AS publication_year
        FROM accepted)"""

_LAYER_FACT = f"""{_LAYER_SILVER},
    listed AS (SELECT publication_year, id, unnest(categories) AS code FROM silver),
    fact AS (
        SELECT publication_year, coalesce(d.name, l.code) AS category_name,
            CAST(count(l.id) AS BIGINT) AS paper_count
        FROM listed l LEFT JOIN {_DIM} ON lower(d.code) = lower(l.code)
        GROUP BY ALL)"""

_CHECKS = """
    SELECT CAST(1 AS INTEGER) AS check_no, 'silver_not_empty' AS "check", n > 0 AS passed,
        CAST(least(n, 1) AS DOUBLE) AS observed, CAST(1 AS DOUBLE) AS threshold
    FROM (SELECT count(*) AS n FROM silver)
    UNION ALL
    SELECT 2, 'fact_not_empty', n > 0, CAST(least(n, 1) AS DOUBLE), 1.0
    FROM (SELECT count(*) AS n FROM fact)
    UNION ALL
    SELECT 3, 'category_name_null_rate', r <= 0.05, r, CAST(0.05 AS DOUBLE)
    FROM (SELECT coalesce(CAST(count(*) FILTER (category_name IS NULL) AS DOUBLE) / nullif(count(*), 0),
            1.0) AS r FROM fact)
    UNION ALL
    SELECT 4, 'year_totals_positive', count(*) = 0, CAST(count(*) AS DOUBLE), 0.0
    FROM (SELECT sum(paper_count) AS n FROM fact GROUP BY publication_year) WHERE n <= 0"""

ORACLES = {
    "publication_trends": f"""WITH {_FACT}
        SELECT publication_year, category_name, paper_count FROM fact
        ORDER BY publication_year DESC, paper_count DESC, category_name""",
    "part_type_trends": f"""
        WITH listed AS (
            SELECT CAST(year(l_shipdate) AS INTEGER) AS publication_year, l_orderkey,
                unnest({_clean(_PART_CATEGORIES)}) AS code
            FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT publication_year, coalesce(n.name, l.code) AS category_name,
            CAST(count(l_orderkey) AS BIGINT) AS paper_count
        FROM listed l LEFT JOIN {_PART_NAME} n ON n.code = lower(l.code) GROUP BY ALL""",
    "silver_transform": f"WITH {_SILVER} SELECT {_SILVER_SHOWN} FROM silver",
    "silver_transform_grouped": f"""WITH {_SILVER},
        doubled AS (SELECT * REPLACE (list_sort(list_concat(categories, categories)) AS categories)
            FROM silver)
        SELECT {_SILVER_SHOWN} FROM doubled""",
    "silver_grouped_counts": f"""WITH {_SILVER},
        listed AS (SELECT id, unnest(categories) AS category_code FROM silver)
        SELECT id, category_code, 3 * count(*) AS n FROM listed GROUP BY ALL""",
    "category_normalize": f"""
        SELECT p_partkey, {_joined(_clean(_PART_CATEGORIES), "codes")} FROM part""",
    "category_dim": f"""WITH {_ARTICLES},
        raw AS (SELECT DISTINCT code FROM (SELECT unnest(categories) AS code FROM articles)
            WHERE code IS NOT NULL)
        SELECT raw.code AS category_code, coalesce(d.name, 'Unknown') AS category_name
        FROM raw LEFT JOIN {_DIM} ON d.code = raw.code""",
    "left_join_fallback": f"""
        WITH listed AS (SELECT p_partkey, unnest({_clean(_PART_CATEGORIES)}) AS category_code FROM part)
        SELECT p_partkey, category_code, coalesce(n.name, category_code) AS category_name
        FROM listed LEFT JOIN {_PART_NAME} n ON n.code = lower(category_code)""",
    "fact_year_totals": f"""WITH {_FACT}
        SELECT publication_year, CAST(sum(paper_count) AS BIGINT) AS n, count(*) AS n_rows,
            count(*) FILTER (category_name IS NULL) AS n_nameless
        FROM fact GROUP BY publication_year""",
    "fact_null_rate": """
        WITH fact AS (
            SELECT length(lang) AS y, n_chars, CAST(quality AS VARCHAR) AS name
            FROM documents LEFT JOIN labels USING (doc_id))
        SELECT count(*) AS n_rows, count(*) FILTER (name IS NULL) AS n_nameless,
            (SELECT count(*) FROM (SELECT sum(n_chars) AS n FROM fact GROUP BY y) WHERE n <= 0)
                AS n_bad_years,
            CAST(count(*) FILTER (name IS NULL) AS DOUBLE) / count(*) AS null_rate
        FROM fact""",
    "quality_report": f"WITH {_FACT} {_CHECKS}",
    "bronze_upsert_newer_wins": f"""WITH {_STORED}, {_INCOMING}
        SELECT {_UPSERT_SHOWN}
        FROM {_merged("s.updated_date > t.updated_date", _UPSERT_COLUMNS)}""",
    "silver_upsert": f"""WITH {_STORED}, {_INCOMING}
        SELECT {_UPSERT_SHOWN} FROM {_merged("true", _UPSERT_COLUMNS)}""",
    "upsert_small_source": f"""WITH {_STORED},
        s AS (SELECT c_custkey AS id, c_acctbal AS amount, TIMESTAMP '1998-01-01' AS updated_date
            FROM customer)
        SELECT {_UPSERT_SHOWN}
        FROM {_merged("s.updated_date > t.updated_date", _UPSERT_COLUMNS)}""",
    "upsert_latest_source": f"""
        WITH t AS (SELECT c_custkey AS id, CAST(-1 AS BIGINT) AS event_id, c_acctbal AS amount
            FROM customer),
        s AS (SELECT user_id AS id, event_id, value AS amount FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        SELECT * FROM {_merged("true", "id, event_id, amount")}""",
    "new_rows_only": f"""WITH {_STORED}, {_INCOMING}
        SELECT {_UPSERT_SHOWN} FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = s.id)""",
    "upsert_counts": f"""WITH {_STORED}, {_INCOMING},
        pairs AS (SELECT coalesce(s.updated_date > t.updated_date, false) AS wins
            FROM t LEFT JOIN s ON t.id = s.id)
        SELECT (SELECT count(*) FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = s.id))
                AS n_inserted,
            count(*) FILTER (wins) AS n_updated, count(*) FILTER (NOT wins) AS n_unchanged
        FROM pairs""",
    "keep_first_by_key": f"""
        SELECT event_id, {_time("ts")}, user_id, event_type, value, props FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "keep_last_by_key": """
        SELECT * FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1""",
    "contract_valid": f"WITH {_DEFECTIVE} SELECT {_ARTICLE_SHOWN} FROM defective WHERE {_VALID}",
    "contract_rejects": f"""WITH {_DEFECTIVE}
        SELECT title, pdf_url, {_BROKEN} AS violations FROM defective WHERE NOT ({_VALID})""",
    "reject_counts": f"WITH {_DEFECTIVE} {_rule_counts('defective', _RULES)}",
    "page_bytes": f"WITH {_PAGED} SELECT * FROM sized",
    "pages_within_budget": f"""WITH {_PAGED}
        SELECT category_ordinal, page_start, page_bytes, bytes_before FROM running
        WHERE bytes_before < {BUDGET}""",
    "admit_by_budget": f"""WITH {_PAGED}
        SELECT paged.* FROM paged JOIN running USING (category_ordinal, page_start)
        WHERE bytes_before < {BUDGET}""",
    "page_by_category": f"""WITH {_ARTICLES}
        SELECT {_ARTICLE_SHOWN} FROM (
            SELECT * FROM articles WHERE list_contains(categories, 'cs.AI')
            ORDER BY published_date DESC, id LIMIT 100 OFFSET 25)""",
    "page_beyond_top_k": f"""WITH {_ARTICLES}
        SELECT {_ARTICLE_SHOWN} FROM (
            SELECT * FROM articles ORDER BY published_date, id DESC LIMIT 500)""",
    "page_null_keys": f"""WITH {_ARTICLES}
        SELECT {_ARTICLE_SHOWN} FROM (
            SELECT * REPLACE (nullif(id, '1') AS id) FROM articles ORDER BY id NULLS FIRST LIMIT 50)""",
    "page_seek": f"""WITH {_ARTICLES},
        placed AS (SELECT *, row_number() OVER (ORDER BY articles.published_date DESC, id) AS place
            FROM articles WHERE list_contains(categories, 'cs.AI'))
        SELECT {_ARTICLE_SHOWN} FROM placed WHERE place BETWEEN 26 AND 125 OR place BETWEEN 201 AND 300""",
    "page_order_numbers": f"""WITH {_ARTICLES}
        SELECT id, {_time("published_date")},
            row_number() OVER (ORDER BY articles.published_date DESC, id) AS position
        FROM articles""",
    "latest_path_segment": "SELECT page_id, string_split(url, '/')[-1] AS segment FROM pages",
    "strip_text": f"""
        SELECT conv_id, turn, {_strip("(chr(9) || '  ' || text || ' ' || chr(10) || ' ')")} AS stripped
        FROM conversations""",
    "lenient_times": f"""
        WITH times AS (
            SELECT event_id, CASE event_id % 6
                WHEN 0 THEN date_trunc('day', ts) + INTERVAL 36672 SECOND
                WHEN 1 THEN date_trunc('day', ts) + INTERVAL 29472 SECOND
                WHEN 2 THEN date_trunc('day', ts) END AS t FROM events)
        SELECT event_id, {_time("t", "at")}, CAST(CAST(t AS DATE) AS VARCHAR) AS on_day FROM times""",
    "partitioned_roundtrip": _ORDERS_BY_YEAR.format(shift=0, extra=0),
    "overwrite_twice": f"""SELECT id, amount * 2 AS amount, status, order_year
        FROM ({_ORDERS_BY_YEAR.format(shift=0, extra=0)})""",
    "truncate_then_upsert": _ORDERS_BY_YEAR.format(shift=1000, extra=0),
    "upsert_moves_partitions": f"""
        WITH t AS ({_ORDERS_BY_YEAR.format(shift=0, extra=0)}),
        s AS ({_ORDERS_BY_YEAR.format(shift=1000, extra=1)})
        SELECT * FROM {_merged("s.amount > t.amount", "id, amount, status, order_year")}""",
    "scan_by_view_name": f"""
        SELECT order_year, status, count(*) AS n_orders
        FROM ({_ORDERS_BY_YEAR.format(shift=0, extra=0)}) GROUP BY ALL""",
    "atom_feed_parse": f"""WITH {_ENTRIES}
        SELECT category, page_start, entry_pos, {_ARTICLE_SHOWN} FROM entries""",
    "atom_entry_scan": f"WITH {_ENTRIES} SELECT {_ARTICLE_SHOWN} FROM entries",
    "feed_reject_counts": f"WITH {_ENTRIES} {_rule_counts('entries', _RULES)}",
    "feed_page_sizes": f"""WITH {_ENTRIES}
        SELECT CAST(list_position({_list(FEED_CODES)}, category) AS INTEGER) AS category_ordinal,
            page_start,
            CAST(sum(strlen(id) + strlen(title) + strlen(summary) + strlen(pdf_url)
                + strlen(array_to_string(authors, '')) + strlen(array_to_string(categories, ''))
                + 16) AS BIGINT) AS page_bytes,
            count(*) AS page_rows
        FROM entries WHERE {_VALID} GROUP BY ALL""",
    "bronze_batch": f"WITH {_ACCEPTED} SELECT {_ARTICLE_SHOWN} FROM accepted",
    "stream_upsert": f"WITH {_ACCEPTED} SELECT {_ARTICLE_SHOWN} FROM accepted",
    "stream_upsert_many_batches": f"WITH {_ACCEPTED} SELECT {_ARTICLE_SHOWN} FROM accepted",
    "stream_within_budget": f"""WITH {_ENTRIES}, {_FEED_SIZES}
        SELECT {_ARTICLE_SHOWN} FROM (
            SELECT entries.* FROM entries JOIN feed_running f ON entries.page_start = f.page_start
                AND list_position({_list(FEED_CODES)}, category) = f.category_ordinal AND bytes_before < {BUDGET}
            WHERE {_VALID}
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY category_ordinal, entries.page_start, entry_pos) = 1)""",
    "stream_left_out": f"WITH {_ENTRIES}, {_FEED_SIZES} SELECT * FROM feed_running WHERE bytes_before >= {BUDGET}",
    "stream_first_copies": f"WITH {_ACCEPTED} SELECT {_ARTICLE_SHOWN} FROM accepted",
    "stored_rejects": f"""WITH {_ENTRIES}
        SELECT category, page_start, entry_pos, id, {_BROKEN} AS violations FROM entries
        WHERE NOT ({_VALID}) AND category <> 'de'""",
    "upsert_buckets": f"""
        WITH t AS ({_ORDERS_BY_YEAR.format(shift=0, extra=0)}),
        s AS ({_ORDERS_BY_YEAR.format(shift=1000, extra=1)})
        SELECT * FROM {_merged("s.amount > t.amount", "id, amount, status, order_year")}""",
    "overwrite_new_schema": """SELECT o_orderkey + 10000000000 AS k, 'o' AS kind,
        CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
    "upsert_noop_counts": """SELECT CAST(0 AS INTEGER) AS run,
            count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS n_inserted,
            count(*) FILTER (WHERE o_orderkey % 4 = 0) AS n_updated,
            count(*) FILTER (WHERE o_orderkey % 4 = 2) AS n_unchanged
        FROM orders UNION ALL SELECT 1, 0, 0, 0""",
    "layers_fact": f"""WITH {_LAYER_FACT}
        SELECT publication_year, category_name, paper_count FROM fact""",
    "layers_increment": f"""WITH {_LAYER_FACT.replace("2015-01-01' +", f"2015-01-01' + to_days({LATER}) +")}
        SELECT publication_year, category_name, paper_count FROM fact""",
    "layers_silver": f"WITH {_LAYER_SILVER} SELECT {_SILVER_SHOWN} FROM silver",
    "layers_quality": f"""WITH {_LAYER_FACT.replace("2015-01-01' +", f"2015-01-01' + to_days({LATER}) +")} {_CHECKS}
        UNION ALL
        SELECT CAST(i AS INTEGER), 'table_exists:workload_scratch.' || name, true, 1.0, 1.0
        FROM (VALUES (-3, 'dim'), (-2, 'silver'), (-1, 'fact')) tables(i, name)""",
}
