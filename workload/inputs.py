"""The given tables, and the articles and feed pages derived from them row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smelter.functions.categories import normalize_categories
from smelter.schemas import CATEGORY_CODES

# Categories under which documents are landed as feed pages, in fetch order.
FEED_CODES = ["en", "fr", "de", "es", "mixed"]
# Documents per landed page; bounds what one page collects.
PAGE_DOCUMENTS = 250

# Characters XML 1.0 cannot carry.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: Column) -> Column:
    """One of the category codes by a number."""
    codes = F.array(*[F.lit(code) for code in CATEGORY_CODES])
    return F.element_at(codes, (F.pmod(number, F.lit(len(CATEGORY_CODES))) + 1).cast("int"))


def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per order, with every kind of dirt the category clean-up has to handle."""
    key = F.col("o_orderkey")
    first, second = pick(F.col("o_custkey")), pick(key * 7 + 3)
    none = F.lit(None).cast("string")
    shape = F.pmod(key, F.lit(10))
    dirt = [
        F.array(F.concat(first, F.lit(" ("), "o_orderpriority", F.lit(")"))),
        F.array(F.concat(first, F.lit(" - note")), second),
        F.array(F.concat(first, F.lit(", "), second)),
        F.array("o_orderstatus"),
        F.array(F.lit(" (junk)")),
        F.array(first, none, F.lit(""), first),
        F.array().cast("array<string>"),
        F.lit(None).cast("array<string>"),
        F.array(F.lit("math.CO (a) b (c)"), F.upper(second), F.lit("  , ")),
        F.array(first, F.concat(second, F.lit("-x"))),
    ]
    categories = F.lit(None).cast("array<string>")
    for number, values in enumerate(dirt):
        categories = F.when(shape == number, values).otherwise(categories)
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.concat(F.lit("Order "), key.cast("string")).alias("title"),
        F.col("o_orderpriority").alias("summary"),
        F.array(F.concat(F.lit("Cust "), F.col("o_custkey").cast("string"))).alias("authors"),
        categories.alias("categories"),
        F.col("o_orderdate").alias("published_date"),
        F.timestamp_add("DAY", F.pmod(key, F.lit(30)).cast("int"), F.col("o_orderdate")).alias(
            "updated_date"
        ),
        F.when(F.pmod(key, F.lit(3)) == 0, "")
        .otherwise(F.concat(F.lit("http://x/"), key.cast("string")))
        .alias("pdf_url"),
    )


def defective_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order articles with fields missing or empty here and there."""
    key = F.col("id").cast("bigint")

    def hit(every: int) -> Column:
        return F.pmod(key, F.lit(every)) == 0

    null = F.lit(None)
    return order_articles(spark, sf_dir).select(
        F.when(hit(97), null).when(hit(101), "").otherwise(F.col("id")).alias("id"),
        F.when(hit(89), "").when(hit(83), " ").otherwise(F.col("title")).alias("title"),
        F.when(hit(79), null).otherwise(F.col("summary")).alias("summary"),
        F.when(hit(73), F.array().cast("array<string>"))
        .when(hit(71), F.array(F.lit(None).cast("string")))
        .otherwise(F.col("authors"))
        .alias("authors"),
        "categories",
        F.when(hit(67), null).otherwise(F.col("published_date")).alias("published_date"),
        F.when(hit(61), null).otherwise(F.col("updated_date")).alias("updated_date"),
        F.when(hit(59), null).otherwise(F.col("pdf_url")).alias("pdf_url"),
    )


def part_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per order line, filed under the type and brand of its part.

    Categories are cleaned on the part side, once per part instead of once per line.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", normalize_categories(F.array(*part_categories())).alias("categories")
    )
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.year("l_shipdate").alias("publication_year"),
        "categories",
    )


def part_categories() -> list[Column]:
    """Messy categories of a part: one clean-up rule each."""
    return [
        F.concat("p_type", F.lit("."), "p_brand", F.lit(" (legacy)")),
        F.concat("p_type", F.lit(" - "), "p_name"),
        F.concat("p_name", F.lit(" , "), "p_type", F.lit("."), "p_brand"),
        F.lit(" (junk)"),
    ]


def feed_pages(
    spark: SparkSession, sf_dir: str, days_later: int = 0, foreign: bool = False, encoding: str = "UTF-8"
) -> DataFrame:
    """Documents as Atom pages: each document under its language and under ``mixed``.

    ``days_later`` moves all times, as in a later fetch of newer versions. ``foreign`` puts titles of
    another namespace, without a prefix, before those of some documents. Pages declare ``encoding``.

    A page holds a fixed range of document ids, so however large a category is, no
    page collects more than ``PAGE_DOCUMENTS`` entries. Documents travel once, by their range, and
    are listed under their categories after that.
    """
    key = F.col("doc_id")
    start = key - F.pmod(key, F.lit(PAGE_DOCUMENTS))
    ranged = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", start.alias("start"))
    documents = ranged.repartition("start").select(
        "doc_id", "lang", "start", _escaped(F.col("source")).alias("source"), _escaped(F.col("text")).alias("text")
    )
    entries = documents.withColumn(
        "category", F.explode(F.array(F.col("lang"), F.lit("mixed")))
    ).select("category", "start", "doc_id", _entry(key, days_later, foreign).alias("entry"))
    head = f'<?xml version="1.0" encoding="{encoding}"?><feed xmlns="http://www.w3.org/2005/Atom">'
    body = F.array_join(F.transform("entries", lambda e: e["entry"]), "")
    return (
        entries.groupBy("category", "start")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "entry"))).alias("entries"))
        .select(
            "category",
            F.col("start").alias("page_start"),
            F.concat(F.lit(head), body, F.lit("</feed>")).alias("payload"),
        )
    )


def _entry(key: Column, days_later: int, foreign: bool = False) -> Column:
    """One entry, well formed but with a broken field in some documents."""
    text = key.cast("string")
    case = F.pmod(key, F.lit(50))
    stamp = F.timestamp_add(
        "DAY",
        (F.pmod(key, F.lit(3650)) + days_later).cast("int"),
        F.lit("2015-01-01").cast("timestamp_ntz"),
    )
    iso = F.concat(F.date_format(stamp, "yyyy-MM-dd"), F.lit("T06:30:00Z"))
    later = F.concat(F.date_format(stamp, "yyyy-MM-dd"), F.lit("T18:30:00+01:00"))
    pdf = F.concat(F.lit('<link title="pdf" href="http://x/pdf/'), text, F.lit('"/>'))
    other = '<title xmlns="urn:other">no title</title>' if foreign else ""
    pieces = [
        F.lit("<entry><id>http://x/abs/"), text, F.lit("v1</id>"), F.when(case == 21, other).otherwise(""),
        F.when(case == 9, "<title/>").otherwise(
            F.concat(F.lit("<title> Document "), text, F.lit(" via "), "category", F.lit("</title>"))
        ),
        F.lit("<summary>\n  "),
        F.when(case == 17, " ").otherwise(F.col("text")),
        F.lit(" \n</summary>"),
        F.when(case == 7, "").otherwise(
            F.concat(
                F.lit("<author><name>"), "source",
                F.lit("</name></author><author><name>A &amp; B</name></author>"),
            )
        ),
        F.lit('<category term=" '), pick(key),
        F.lit(' (x)"/><category term=""/><category/><category term="'), "lang",
        F.lit('"/><published>'),
        F.when(case == 11, "soon").otherwise(iso),
        F.lit("</published><updated>"), later, F.lit('</updated><link href="http://x/abs/"/>'),
        F.when(case == 13, '<link title="pdf"/>')
        .when(F.pmod(key, F.lit(3)) == 0, "")
        .when(F.pmod(key, F.lit(3)) == 1, F.concat(pdf, F.lit('<link title="pdf" href="http://x/2nd"/>')))
        .otherwise(pdf),
        F.lit("</entry>"),
    ]
    return F.concat(*pieces)


def _escaped(text: Column) -> Column:
    plain = F.regexp_replace(text, NOT_XML, "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        plain = F.replace(plain, F.lit(mark), F.lit(name))
    return plain


def land_in_latin1(pages: DataFrame, latin1_pages: DataFrame, path: str) -> str:
    """The same, with pages that Latin-1 can hold in that encoding, as they then declare."""
    bytes_ = F.encode("payload", "ISO-8859-1")
    fits = F.decode(bytes_, "ISO-8859-1") == F.col("payload")
    place = ["category", "page_start"]
    latin1 = latin1_pages.filter(fits).withColumn("payload", bytes_.cast("string"))
    return land_files(latin1.unionByName(pages.join(latin1.select(*place), place, "left_anti")), path)


def land_files(pages: DataFrame, path: str) -> str:
    """Write pages as files, one per category and start, as a crawler would land them."""
    pages.select("category", F.col("page_start").alias("start"), "payload").write.partitionBy(
        "category", "start"
    ).text(path)
    return path
