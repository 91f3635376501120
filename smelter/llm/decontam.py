"""Benchmark decontamination with a positional inverted index, in DataFrame operations alone.

A window is ten consecutive words of a benchmark item (an item with fewer words is one
window). Document words inside any occurrence of a window are hit. The search goes as on
an inverted index: every window asks for its two rarest terms; the postings of such terms
(term, document, position) are stored; each list is shifted by the term's offset, so that a
start of a window stands at one position in both; the rarest list goes first and is cut by
the second. What is left is a line-up of a document with an item, and there whole
stretches are compared word by word: exact phrase matches, of window length or longer.

:func:`near` answers proximity searches on the same postings.

Defined cases: null texts have no words; items without words are never found; equal rows
are told apart from others by content and each get their result; equal items are each
counted; null ids are values like others; empty tables give no hits; other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.llm.common import ascii_lower, row_key, small_side, split_at, written

WINDOW = 10
#: What stands between words, after lower-casing: all of ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["_id", "_hash"]


def tokens(text: Column | str) -> Column:
    return split_at(ascii_lower(text), BETWEEN)


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item (its text's words as one value), length of a window, and the ids that share it."""
    return (
        benchmark.select(F.col(item_id).cast("string").alias("item_id"), tokens(text).alias("words"))
        .filter(F.size("words") > 0)
        .groupBy("words")
        .agg(F.collect_set(F.coalesce("item_id", F.lit(""))).alias("item_ids"))
        .select("words", "item_ids", F.least(F.lit(window), F.size("words")).alias("length"),
                F.xxhash64("words").alias("item"))
    )


def document_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All words of all documents with their positions from 0."""
    return docs.select(*row_key(doc_id, text), F.posexplode(tokens(text)).alias("pos", "term"))


def term_counts(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each of the terms stands in the documents; summed before it is shuffled."""
    found = document_words(docs, doc_id, text).select("term").join(small_side(terms), "term")
    return terms.join(found.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select(
        "term", F.coalesce("n", F.lit(0)).alias("n")
    )


def index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings of the given terms: term, document, position."""
    return written(document_words(docs, doc_id, text).join(small_side(terms), "term").distinct(), "postings")


def anchors_of(items: DataFrame, counts: DataFrame) -> DataFrame:
    """For every window its rarest term and the next rarest: item, first, at, second, gap.

    ``at`` is the place of the rarest term in the item, ``gap`` the way on to the other.
    Neighbouring windows mostly share their terms, so an item has few distinct pairs.
    """
    placed = items.select("item", "length", F.posexplode("words").alias("at", "term"))
    rated = placed.join(counts, "term")
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("length") + 1), F.least(F.col("at"), F.col("_last"))))
    last = items.select(F.col("item").alias("_item"), (F.size("words") - F.col("length")).alias("_last"))
    windows = rated.join(last, F.col("item") == F.col("_item")).select("item", "term", "at", "n", starts.alias("start"))
    ranked = windows.groupBy("item", "start").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "at"))), 1, 2).alias("_rare")
    )
    first = F.col("_rare")[0]
    second = F.coalesce(F.get("_rare", F.lit(1)), first)
    return ranked.select(
        "item", first["term"].alias("first"), first["at"].alias("at"),
        second["term"].alias("second"), (second["at"] - first["at"]).alias("gap"),
    ).distinct()


def line_ups(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """_id, _hash, item, shift: where a document may hold a window of an item.

    ``shift`` is document position less item position. The postings of the rarest term are
    cut by those of the second, each shifted to its place in the window.
    """
    firsts = postings.join(small_side(anchors), F.col("term") == F.col("first")).select(
        *KEY, "item", (F.col("pos") - F.col("at")).alias("shift"), "second", (F.col("pos") + F.col("gap")).alias("_want"), "gap"
    )
    alone = firsts.filter("gap = 0").select(*KEY, "item", "shift")
    paired = firsts.filter("gap <> 0")
    seconds = postings.join(
        small_side(anchors.filter("gap <> 0").select(F.col("second").alias("_second")).distinct()),
        F.col("term") == F.col("_second"),
    ).select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "term", "pos")
    met = paired.join(
        seconds,
        paired["_id"].eqNullSafe(seconds["_id2"]) & (F.col("_hash") == F.col("_hash2"))
        & (F.col("second") == F.col("term")) & (F.col("_want") == F.col("pos")),
        "left_semi",
    ).select(*KEY, "item", "shift")
    return alone.unionByName(met).distinct()


def phrase_hits(candidates: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """Verified line-ups: _id, _hash, item, item_ids and the document positions that are hit.

    ``texts`` has the words of candidate documents. An item is laid beside the document at
    its shift and compared word by word; runs of equal words of window length are hits.
    """
    i = small_side(items)
    c = candidates.join(i, "item")
    t = texts.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), F.col("words").alias("doc_words"))
    laid = c.join(t, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")))
    # The stretch of the item that lies inside the document.
    begin = F.greatest(F.lit(0), -F.col("shift"))
    size = F.least(F.size("words"), F.size("doc_words") - F.col("shift")) - begin
    equal = F.array_join(
        F.zip_with(
            F.slice("words", F.col("_begin") + 1, F.col("_size")),
            F.slice("doc_words", F.col("_begin") + F.col("shift") + 1, F.col("_size")),
            lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0")),
        ),
        "",
    )
    starts = F.filter(
        F.sequence(F.lit(1), F.col("_size") - F.col("length") + 1),
        lambda s: F.substring(F.col("_equal"), s, F.col("length")) == F.repeat(F.lit("1"), F.col("length")),
    )
    at = F.col("_begin") + F.col("shift") - 1
    return (
        laid.withColumn("_begin", begin).withColumn("_size", size)
        .filter(F.col("_size") >= F.col("length"))
        .withColumn("_equal", equal)
        .withColumn("_starts", starts)
        .filter(F.size("_starts") > 0)
        .select(
            *KEY, "item", "item_ids",
            F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(at + s, at + s + F.col("length") - 1)))).alias("hit"),
        )
    )


def near(postings: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """Documents where two indexed terms stand at most ``within`` words apart, with both positions.

    Positions fall into blocks of that many words, and only neighbouring blocks meet.
    """
    block = lambda c: F.floor(F.col(c) / F.lit(within + 1))
    a = postings.filter(F.col("term") == first).select(*KEY, F.col("pos").alias("first_pos"))
    b = postings.filter(F.col("term") == second).select(
        F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), F.col("pos").alias("second_pos")
    )
    a = a.withColumn("_block", F.explode(F.array(*[block("first_pos") + d for d in (-1, 0, 1)])))
    met = a.join(
        b, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")) & (F.col("_block") == block("second_pos"))
    )
    return met.filter(F.abs(F.col("first_pos") - F.col("second_pos")) <= within).select(
        F.col("_id").alias("doc_id"), "first_pos", "second_pos"
    )


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """_id, _hash, n_hit, n_items and item_ids of the documents that hold a window."""
    items = written(items_of(benchmark, item_id, "text", window), "items")
    terms = written(items.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = written(term_counts(docs, terms, doc_id, text), "term-counts")
    # A window with a term that no document has cannot occur.
    anchors = written(anchors_of(items, counts), "anchors")
    present = anchors.join(small_side(counts.filter("n = 0").select(F.col("term").alias("first"))), "first", "left_anti")
    wanted = written(
        present.select(F.col("first").alias("term")).unionByName(present.select(F.col("second").alias("term"))).distinct(), "wanted"
    )
    postings = index(docs, wanted, doc_id, text)
    candidates = written(line_ups(postings, present), "line-ups")
    asked = small_side(written(candidates.select(*KEY).distinct(), "asked").select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2")))
    keyed = docs.select(*row_key(doc_id, text), F.col(text).alias("_text"))
    texts = keyed.join(
        asked, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left_semi"
    ).dropDuplicates(KEY).select(*KEY, tokens("_text").alias("words"))
    found = phrase_hits(candidates, texts, items)
    return found.groupBy(*KEY).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", window: int = WINDOW, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    found = written(hits(docs, benchmark, doc_id, text, item_id, window), "hits").select(
        F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "n_hit", "item_ids"
    )
    keyed = docs.select(*row_key(doc_id, text), F.size(tokens(text)).cast("long").alias("n_words"),
                        *([F.struct(*carry).alias("row")] if carry else []))
    joined = keyed.join(
        small_side(found), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left"
    )
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        *(["row"] if carry else []),
    )
