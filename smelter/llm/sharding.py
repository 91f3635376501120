"""Sharding by a Feistel permutation of global row numbers.

Row numbers 0 to N-1 are put through a keyed permutation; shard and slot are the remainder
and the quotient of the result. Row counts of two shards differ by one at most, and place
and row number follow from each other, without a table between them.

Defined cases: null texts have size 1 and the checksum of the empty text; rows that are
equal in every column that orders them are interchangeable; null ids come first; an empty
table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.llm.common import written
from smelter.operators.numbering import number_rows

SHARDS = 16
#: One multiplier and one addend for each Feistel round; they are the key of the shuffle.
KEY = ((48271, 11), (69621, 1299709), (16807, 15485863), (39373, 32452843), (742938, 49979687), (950706, 67867967))
#: The round function works modulo this prime, so the table may have up to its square of rows.
PRIME = 2147483647
#: Steps of cycle walking written into the expression. The walk leaves the table's range with
#: a chance below 2 / sqrt(N) at each step and never more than 2 * sqrt(N) + 1 times in a row:
#: certain to suffice up to 900 rows, beyond that it fails with a chance below 1e-70, loudly.
WALK = 62


def side_of(n_rows: int) -> int:
    """Side of the smallest square of halves that holds all row numbers."""
    return max(1, math.isqrt(max(n_rows - 1, 0)) + 1)


def _round(value: Column, multiplier: int, addend: int, side: int) -> Column:
    t = (value * F.lit(multiplier).cast("long") + F.lit(addend).cast("long")) % F.lit(PRIME).cast("long")
    return (t * t + t * F.lit(multiplier).cast("long")) % F.lit(PRIME).cast("long") % F.lit(side).cast("long")


def _chain(start: Column, steps: list) -> Column:
    """Apply functions one after the other inside one lambda chain, so that nothing is written twice."""
    value = F.array(start)
    for step in steps:
        value = F.transform(value, step)
    return value[0]


def permuted(number: Column, n_rows: int) -> Column:
    """The place of a row number from 0 to ``n_rows`` - 1 under the permutation."""
    side = side_of(n_rows)

    def once(x: Column) -> Column:
        return _chain(x, [split, *(turned(m, a) for m, a in KEY), joined])

    def split(v: Column) -> Column:
        return F.struct(((v - v % side) / F.lit(side)).cast("long").alias("l"), (v % side).alias("r"))

    def turned(multiplier: int, addend: int):
        return lambda p: F.struct(
            p["r"].alias("l"),
            ((p["l"] + _round(p["r"], multiplier, addend, side)) % F.lit(side).cast("long")).alias("r"),
        )

    def joined(p: Column) -> Column:
        return p["l"] * F.lit(side).cast("long") + p["r"]

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(min(WALK, 2 * side + 1))),
        once(number),
        lambda acc, _: F.when(acc < n_rows, acc).otherwise(once(acc)),
    )
    return F.when(walked < n_rows, walked).otherwise(
        F.raise_error(F.lit("the cycle walk did not return into the table")).cast("long")
    )


def place_of(number: int, n_rows: int) -> int:
    """The same on plain integers: where a row went."""
    side, x = side_of(n_rows), number
    while True:
        left, right = divmod(x, side)
        for m, a in KEY:
            t = (right * m + a) % PRIME
            left, right = right, (left + (t * t + t * m) % PRIME) % side
        x = left * side + right
        if x < n_rows:
            return x


def number_at(place: int, n_rows: int) -> int:
    """The inverse: which row number stands at a place, that is at shard + SHARDS * slot."""
    side, x = side_of(n_rows), place
    while True:
        left, right = divmod(x, side)
        for m, a in reversed(KEY):
            t = (left * m + a) % PRIME
            left, right = (right - (t * t + t * m) % PRIME) % side, left
        x = left * side + right
        if x < n_rows:
            return x


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the global row_number from 0, in order of id and content.

    Only these narrow columns are sorted. The order decides every tie but that of equal rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("_hash"),
    )
    ordered = number_rows(
        written(narrow, "shard-sizes"),
        [F.col(c).asc() for c in ("doc_id", "text_crc32", "size", "_hash")],
        "row_number",
    )
    return ordered.withColumn("row_number", F.col("row_number") - 1).drop("_hash")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every document; counts of shards differ by one at most."""
    rows = written(numbered(docs, doc_id, text), "shard-numbers")
    n_rows = rows.count()
    placed = rows.withColumn("_place", permuted(F.col("row_number"), max(n_rows, 1)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
