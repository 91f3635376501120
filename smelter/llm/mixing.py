"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source takes each of its documents a whole number of
times, and once more those below a hash threshold. The threshold is found in histograms
of words by source and hash bucket: the running total names the bucket that the budget
ends in, only that bucket is split into finer ones, and so on; nothing is sorted.

Defined cases: null and blank texts have size 0 and are taken 0 words; null is a source of
its own, the last one; rows equal in id and text share a hash, and if the budget ends among
them a second hash, of the row, cuts between them in the same way; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smelter.llm.common import small_side, words, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Bits of the hash read by one histogram, and in all: 4096 buckets a source, five rounds at most.
STEP_BITS, HASH_BITS = 12, 60


def hash_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The fixed hash of a document, from its id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), docs[doc_id], docs[text]), 64 - HASH_BITS)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words, a 60-bit hash of id and text and one of the row (copy)."""
    copy = COPY if COPY in docs.columns else copy_hash()
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(words(text)).cast("long").alias("size"),
        hash_of(docs, doc_id, text).alias("hash"),
        F.col(copy).alias("copy") if isinstance(copy, str) else copy.alias("copy"),
    )


#: Column by which rows that were given a hash of their own bring it along.
COPY = "_copy"


def copy_hash() -> Column:
    """A hash of the row's place; to be written before it is used twice."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target, one row a source.

    Weights go round the sources in code point order. A target stops at ``most`` times its
    source; what that leaves over is shared among the others until none is above. The level
    at which this ends is read off the running totals over sources by their limit per weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(most)
    filled = (
        by_source.withColumn("_weight", weight)
        .withColumn("_ratio", limit / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_all_weights", F.sum("_weight").over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
                    / (F.col("_all_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
    )
    # Up to the level all sources are full; it is the first one that its own source can take.
    level = F.min_by("_level", F.when(F.col("_ratio") >= F.col("_level"), F.col("_ratio"))).over(everything)
    target = F.least(F.coalesce(level, F.lit(0.0)) * F.col("_weight"), limit)
    return filled.select("source", "source_size", target.alias("target"))


def _bucket(depth: int) -> Column:
    return F.shiftrightunsigned(F.col("_key"), HASH_BITS - STEP_BITS * depth)


def _search(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Where the budget of each source ends among its rows (source, size, _key): one round a histogram.

    ``plan`` has source, budget and the words below all rows (_low). Returns source, threshold (the key
    up to which rows are taken; the row that the budget ends in is, if that comes nearer), and for
    rows that share the key it ends in: that key (edge), budget and the words below (_low).
    """
    parts = []
    rounds = HASH_BITS // STEP_BITS
    open_ = plan.select("source", "budget", F.col("_low").cast("double").alias("_low"), F.lit(0).cast("long").alias("_prefix"))
    for depth in range(1, rounds + 1):
        open_ = written(open_, "mix-open")
        state = small_side(open_.withColumnRenamed("source", "_source"))
        inside = rows.join(
            state,
            F.col("source").eqNullSafe(F.col("_source")) & (_bucket(depth - 1) == F.col("_prefix")),
        )
        histogram = inside.groupBy("_source", "budget", "_low", _bucket(depth).alias("_bucket")).agg(
            F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows")
        )
        upto = Window.partitionBy("_source").orderBy("_bucket")
        running = histogram.withColumn("_until", F.col("_low") + F.sum("_words").over(upto))
        hit = written(
            running.filter("_until > budget AND _until - _words <= budget").select(
                F.col("_source").alias("source"), "budget", "_bucket", "_until", "_words", "_rows"
            ),
            "mix-bucket",
        )
        over = F.col("_until") - F.col("budget")
        under = F.col("budget") - (F.col("_until") - F.col("_words"))
        shift = HASH_BITS - STEP_BITS * depth
        first = F.shiftleft(F.col("_bucket"), shift)
        one, below = F.col("_rows") == 1, (F.col("_until") - F.col("_words")).cast("double").alias("_low")
        threshold = F.when(one & (over < under), first + F.lit((1 << shift) - 1)).otherwise(first - 1)
        done = hit if depth == rounds else hit.filter(one)
        parts.append(done.select(
            "source", threshold.alias("threshold"), F.when(~one, first).alias("edge"), "budget", below
        ))
        if depth == rounds:
            break
        rest = hit.filter(~one)
        if rest.isEmpty():
            break
        open_ = rest.select("source", "budget", below, F.col("_bucket").alias("_prefix"))
    return reduce(DataFrame.unionByName, parts)


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, the hash up to which (inclusive) documents are taken once more, and edge and copy_threshold.

    ``plan`` has source and budget: the words beyond the whole copies. Of rows that share the hash
    ``edge`` those with a copy hash up to ``copy_threshold`` are taken, too.
    """
    open_ = plan.filter("budget > 0").select("source", "budget", F.lit(0.0).alias("_low"))
    found = written(_search(sizes.select("source", "size", F.col("hash").alias("_key")), open_), "mix-found")
    tied = found.filter("edge IS NOT NULL")
    ends = found.select("source", "threshold", "edge")
    if tied.isEmpty():
        return ends.withColumn("copy_threshold", F.lit(None).cast("long"))
    at = tied.select(F.col("source").alias("_at"), "edge")
    copies = sizes.join(small_side(written(at, "mix-tied")), F.col("source").eqNullSafe(F.col("_at")) & (F.col("hash") == F.col("edge")))
    cut = _search(copies.select("source", "size", F.col("copy").alias("_key")), tied.select("source", "budget", "_low"))
    cut = cut.select(F.col("source").alias("_at"), F.col("threshold").alias("copy_threshold"))
    return ends.join(cut, F.col("source").eqNullSafe(F.col("_at")), "left").drop("_at")


def mix_plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """What to take of each source: a row a source, with target, whole copies and thresholds."""
    goal = written(targets(sizes, weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = goal.withColumn("_whole", whole).withColumn(
        "budget", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    cut = thresholds(sizes, plan).withColumnRenamed("source", "_cut_source")
    return written(
        plan.join(cut, F.col("source").eqNullSafe(F.col("_cut_source")), "left")
        .select(F.col("source").alias("_source"), "source_size", "target", "_whole",
                F.coalesce("threshold", F.lit(-1)).cast("long").alias("_threshold"), "edge", "copy_threshold"),
        "mix-plan",
    )


def copies_of(hash_: Column, copy: Column) -> Column:
    """How often a row is taken, beside the plan of its source."""
    once_more = (hash_ <= F.col("_threshold")) | F.coalesce(
        (hash_ == F.col("edge")) & (copy <= F.col("copy_threshold")), F.lit(False)
    )
    return F.col("_whole") + once_more.cast("long")


def mix_sizes(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows of :func:`sized` with source_size, target and copies (0, 1, 2, ...)."""
    full = mix_plan(sizes, weights, share, most)
    joined = sizes.join(small_side(full), F.col("source").eqNullSafe(F.col("_source")))
    copies = copies_of(F.col("hash"), F.col("copy"))
    return joined.select("doc_id", "source", "size", "hash", "source_size", "target", copies.alias("copies"))


def take(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
         doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    sizes = written(sized(docs, doc_id, text, source), "mix-sizes")
    plan = mix_plan(sizes, weights, share, most)
    rows = docs
    if not plan.filter("copy_threshold IS NOT NULL").isEmpty():
        # The budget ends among equal rows: their hashes must be the same when they are taken.
        rows = written(docs.withColumn(COPY, copy_hash()), "mix-rows")
        plan = mix_plan(written(sized(rows, doc_id, text, source), "mix-sizes"), weights, share, most)
    copy = F.col(COPY) if COPY in rows.columns else F.lit(0)
    keyed = rows.select(
        F.struct(*docs.columns).alias("_row"), F.col(source).alias("_from"), hash_of(rows, doc_id, text).alias("_of"), copy.alias("_nth")
    )
    joined = keyed.join(small_side(plan), F.col("_from").eqNullSafe(F.col("_source")))
    times = copies_of(F.col("_of"), F.col("_nth")).cast("int")
    taken = joined.select("_row", times.alias("_times")).filter("_times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words of each document the mix takes; texts are read once."""
    sizes = written(sized(docs, doc_id, text, source), "mix-sizes")
    return mix_sizes(sizes, weights, share, most).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
