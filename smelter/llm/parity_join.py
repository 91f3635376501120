"""N-gram Jaccard join with parity sketches.

A document's set is its distinct shingles (``shingle`` words each, four unless told otherwise);
sets are similar from ``percent`` on (85 unless told otherwise). Every shingle flips one bit of the
document's sketch, so two sketches differ in no more bits than their sets do in elements.
Sets that are similar enough differ in at most d elements, where d follows from their
sizes. Sketches of a size band have d + 1 blocks of bits and some to spare; of similar
sets at least one block is equal that is not empty in either (a document with more empty
blocks than are to spare also offers these). Blocks are the keys of an equality join. What
meets there is ruled out by dense sketches or verified on the sets; links are closed into
components.

No group is expanded into its pairs. Equal sets are one class from the start. In a group of
equal blocks every class meets the first one and its neighbour; links are closed; only
classes of the same group that are still in different components are compared further.
In large groups (a crowd of copies that are almost similar enough) even these are too many, and
so they are in groups of sets too large for a dense sketch to tell apart, which meet by what
is common in the language; there classes meet again under their rarest shingles only, which is
exact, too.

Defined cases: without words or text the set is empty and links with nothing, its component
is its own id; fewer words than a shingle has make one shingle; repeated rows are one class; a null
id takes part but is never a component's name, unless all ids of it are null; an empty
table gives an empty result; other columns play no part. Sets are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smelter.llm.common import discard, lean_batches, small_side, written

SHINGLE, PERCENT = 4, 85
#: Growth of size bands.
BAND_GROWTH = 1.5
#: In a group of more classes than this, rare shingles choose the pairs to compare.
SPLIT_ABOVE = 256
#: Texts whose sets a task holds at once.
TEXTS = 500
#: 64-bit words of the dense sketch that rules pairs out.
SKETCH_WORDS = 16

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WORD = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: equal in, equal out, and well spread."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _place(i: int) -> np.uint64:
    """Number of a place in a shingle."""
    return _WORD[i] if i < len(_WORD) else mixed(np.array([i], np.uint64) * _WORD[0])[0]


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text, as 64-bit hashes."""
    # bytes.lower and bytes.split know ASCII alone, as the words demand.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    if len(h) < shingle:
        whole = np.array([len(h)], np.uint64)
        for value in h:
            whole = mixed(whole * _WORD[0] + value)
        return whole
    n = len(h) - shingle + 1
    total = np.zeros(n, np.uint64)
    for i in range(shingle):
        total += mixed(h[i:i + n] + _place(i))  # the place of a word counts
    return np.unique(mixed(total))


def smallest(percent: int) -> int:
    """The smallest set that a different set can resemble: n of n + 1 elements."""
    return max(1, -(-percent // (100 - percent)))


def band_edges(up_to: int, percent: int = PERCENT) -> list[int]:
    edges = [smallest(percent)]
    while edges[-1] <= up_to:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_GROWTH)))
    return edges


def blocks_of(band: int, edges: list[int], percent: int = PERCENT) -> tuple[int, int]:
    """Blocks of a band's sketches, and how many may be empty.

    The smaller set has up to ``a`` elements, the larger up to 100 a / percent. From
    100 * both >= percent * either follows that
    (100 + percent) * difference <= (100 - percent) * (sum of sizes).
    """
    a = edges[band + 1] - 1
    differ = (100 - percent) * (a + 100 * a // percent) // (100 + percent)
    spare = 2 + differ // 16
    return differ + 1 + spare, spare


def bands_for(n: int, edges: list[int], percent: int = PERCENT) -> list[int]:
    """Bands in which a set of ``n`` may be the smaller or the larger of a pair."""
    if n < smallest(percent):
        return []
    own = int(np.searchsorted(edges, n, "right")) - 1
    least = -(-percent * n // 100)
    first = max(0, int(np.searchsorted(edges, max(least, smallest(percent)), "right")) - 1)
    return list(range(first, own + 1))


def sketch(values: np.ndarray, blocks: int) -> np.ndarray:
    """One 64-bit word for each block of a sparse parity sketch; 0 if the block is empty.

    A block has 2^40 bits. The word is the XOR of hashes of its set bits, so a bit flipped
    twice is gone, and the words of equal blocks are equal. Blocks this wide keep unrelated
    sets apart even where a block holds a single element.
    """
    h = mixed(values + _WORD[3])
    at = (h % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    filled, first = np.unique(at[order], return_index=True)
    words = np.zeros(blocks, np.uint64)
    words[filled] = np.bitwise_xor.reduceat(mixed(h[order] >> np.uint64(24)), first)
    return words


def signatures(values: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys under which a set can meet all sets similar to it."""
    found = []
    edges = band_edges(len(values), percent)
    for band in bands_for(len(values), edges, percent):
        if band + 1 >= len(edges):
            edges = band_edges(edges[-1], percent)
        blocks, spare = blocks_of(band, edges, percent)
        words = sketch(values, blocks)
        filled = words != 0
        keep = np.flatnonzero(filled) if blocks - filled.sum() <= spare else np.arange(blocks)
        place = keep.astype(np.uint64) + np.uint64(band << 32)
        found.append(mixed(mixed(place * _WORD[0]) + words[keep] * _WORD[1]))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def dense_sketch(values: np.ndarray) -> np.ndarray:
    """Parity sketch of 1024 bits; no two differ in more bits than their sets in elements."""
    at = (mixed(values ^ _WORD[2]) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)).view(np.int64)


def wide_sketch(values: np.ndarray) -> np.ndarray:
    """Parity sketch of at least two bits an element, so that it tells large sets apart, too."""
    bits = 1 << max(10, (2 * len(values) - 1).bit_length())
    at = (mixed(values ^ _WORD[1]) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few texts at a time; what a task held goes back when it ends."""
    for batch in batches:
        yield from (batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS))
    pa.default_memory_pool().release_unused()


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(own) for own in values])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *(own.view(np.int64) for own in values)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _named(values: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63) if len(values) else None


def sketches_of(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, hash of id and text, name of the set (null if empty), its size n, signatures (values), dense sketch (bits).

    A set that a task has met before has its signatures there already, and none again.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int | None] = set()
        none = np.empty(0, np.int64)
        for batch in _parts(batches):
            sets = [shingles(t, shingle) for t in batch["_text"].to_pylist()]
            names = [_named(s) for s in sets]
            new = []
            for name in names:
                new.append(name not in seen)
                seen.add(name)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"],
                "hash": batch["hash"],
                "name": pa.array(names, pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "values": _lists([signatures(s, percent) if own else none for s, own in zip(sets, new)]),
                "bits": _lists([dense_sketch(s) if own else none for s, own in zip(sets, new)]),
            })

    return _narrow(docs, doc_id, text).mapInArrow(
        read, "doc_id long, hash long, name long, n long, values array<long>, bits array<long>"
    )


def sets_of(
    docs: DataFrame, members: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    wide: bool = True,
) -> DataFrame:
    """name, n, values and (if asked for) wide sketch of the named sets, each read from one of the documents that have it.

    Sets are written where they are read; only those of rows that occur several times travel.
    """
    kinds = "name long, n long, values array<long>" + (", wide array<long>" if wide else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            sets = [shingles(t, shingle) for t in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "name": pa.array([_named(s) for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "values": _lists(sets),
                **({"wide": _lists([wide_sketch(s) for s in sets])} if wide else {}),
            })

    asked = small_side(written(names.distinct(), "names"))
    # Rows that share an id may have other texts, so a holder is named by both.
    row = F.struct("doc_id", "hash")
    rows = members.join(asked, "name").groupBy("name", "doc_id", "hash").agg(F.count(F.lit(1)).alias("times"))
    holders = rows.groupBy("name").agg(F.min_by("times", row).alias("times"), F.min(row).alias("_holder"))
    held = written(holders.select(F.col("_holder.doc_id").alias("_id"), F.col("_holder.hash").alias("_hash"), "times"), "holders")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    texts, several = _narrow(docs, doc_id, text), held.filter("times > 1")
    found = texts.join(small_side(held), same, "left_semi")
    if not several.isEmpty():
        several = small_side(several)
        once = texts.join(several, same, "left_semi").dropDuplicates(["doc_id", "hash"])
        found = found.join(several, same, "left_anti").unionByName(once)
    return written(found.mapInArrow(read, kinds), "sets")


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return lean_batches(docs).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        row_hash(doc_id, text).alias("hash"),
    )


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def met(keys: DataFrame) -> DataFrame:
    """Of (key, name, n) rows those whose key has two names or more, with first and previous name.

    One shuffle; a window reads each group as a stream, however large it is.
    """
    w = Window.partitionBy("key").orderBy("name")
    # Copies of one set are dropped where they meet: the previous row has the same name.
    once = keys.withColumn("_before", F.lag("name").over(w)).filter("_before IS NULL OR _before <> name")
    seen = once.select(
        "key", "name", "n", F.first("name").over(w).alias("first"), F.first("n").over(w).alias("first_n"),
        F.lag("name").over(w).alias("before"), F.lag("n").over(w).alias("before_n"), F.lead("name").over(w).alias("after"),
    )
    return seen.filter("before IS NOT NULL OR after IS NOT NULL").drop("after")


def distance() -> Column:
    """Bits in which two dense sketches differ."""
    return reduce(Column.__add__, (
        F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(SKETCH_WORDS)
    ))


def possible(percent: int = PERCENT) -> Column:
    """Whether sizes and sketches allow a link: more differing bits than similar sets have elements rule it out."""
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (small * 100 >= large * percent) & (
        distance() * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)
    )


def untold(percent: int = PERCENT) -> int:
    """The set size from which dense sketches rule next to nothing out.

    Sketches of sets without anything in common differ in half their bits; here similar sets may
    differ in three quarters of these.
    """
    return 3 * 64 * SKETCH_WORDS * (100 + percent) // (8 * 2 * (100 - percent))


def pairs_of(met_rows: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each class with the first of its groups and with the one before it, if a link is possible.

    ``untold`` says that the sketches were too short for the larger set.
    """
    stars = met_rows.filter("before IS NOT NULL").select(
        F.explode(F.array(
            F.struct(F.col("first").alias("a"), F.col("first_n").alias("a_n")),
            F.struct(F.col("before").alias("a"), F.col("before_n").alias("a_n")),
        )).alias("s"), F.col("name").alias("b"), F.col("n").alias("b_n"),
    ).select("s.*", "b", "b_n")
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    once = stars.filter(small * 100 >= large * percent).distinct()
    both = once.join(bits.select(F.col("name").alias("a"), F.col("bits").alias("a_bits")), "a").join(
        bits.select(F.col("name").alias("b"), F.col("bits").alias("b_bits")), "b"
    )
    return both.filter(possible(percent)).select("a", "b", (large >= untold(percent)).alias("untold"))


def folded(words: Column, to: Column) -> Column:
    """A wide sketch as the sketch of fewer words that it contains."""
    return F.transform(F.sequence(F.lit(1), to), lambda i: F.aggregate(
        F.sequence(i, F.size(words), to), F.lit(0).cast("long"), lambda word, j: word.bitwiseXOR(F.element_at(words, j))
    ))


def wide_distance(a: str = "a_wide", b: str = "b_wide") -> Column:
    """Bits in which two wide sketches differ, in the width of the narrower one."""
    width = F.least(F.size(a), F.size(b))
    x, y = (F.when(F.size(own) > width, folded(F.col(own), width)).otherwise(F.col(own)) for own in (a, b))
    differ = F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(differ, F.lit(0), lambda bits, more: bits + more)


def near(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that wide sketches do not rule out: far fewer bytes travel than with the sets."""
    a = sets.select(F.col("name").alias("a"), F.col("n").alias("a_n"), F.col("wide").alias("a_wide"))
    b = sets.select(F.col("name").alias("b"), F.col("n").alias("b_n"), F.col("wide").alias("b_wide"))
    both = small_side(pairs).join(a, "a").join(b, "b")
    allowed = (F.col("a_n") + F.col("b_n")) * (100 - percent)
    return written(both.filter(wide_distance() * (100 + percent) <= allowed).select("a", "b"), "near")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets are similar: 100 * common >= percent * all."""
    pairs = small_side(near(pairs, sets, percent))
    a = sets.select(F.col("name").alias("a"), F.col("values").alias("a_values"))
    b = sets.select(F.col("name").alias("b"), F.col("values").alias("b_values"))
    common = F.size(F.array_intersect("a_values", "b_values"))
    both = pairs.join(a, "a").join(b, "b").withColumn("_common", common)
    either = F.size("a_values") + F.size("b_values") - F.col("_common")
    return both.filter(F.col("_common") * 100 >= either * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """name and root (the smallest name reachable) for every name that has a link.

    Alternating stars: every name hands its larger neighbours, then its smaller ones, to the
    smallest neighbour; edges become stars around roots in a few rounds. A name with very
    many neighbours only takes part in aggregates and joins, which split it.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "cc-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u <> v").distinct(), "cc-edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    roots = edges.select(F.col("u").alias("name"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("name"), F.col("v").alias("root")).distinct())


def relabelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows with the root of their name; the name itself where there is no link yet."""
    if roots is None:
        return rows.withColumn("root", F.col("name"))
    return rows.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))


def open_groups(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of groups that hold more than one component, with the group's number of classes and largest set.

    Groups of the same classes stand for each other, and one of them is left: classes that have much in
    common meet under many keys.
    """
    labelled = relabelled(rows.select("key", "name", "n"), roots)
    groups = labelled.groupBy("key").agg(
        F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("size"), F.max("n").alias("largest"),
        F.bit_xor("name").alias("_all"), F.bit_xor(F.xxhash64("name")).alias("_again"),
    )
    alike = groups.filter("_lo <> _hi").groupBy("size", "largest", "_all", "_again").agg(F.min("key").alias("_key"))
    return labelled.join(alike.select("_key", "size", "largest"), F.col("key") == F.col("_key")).drop("_key")


def cross_pairs(groups: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of a group whose components differ, if a link is possible.

    The test stands in the join, so that pairs it rules out are never rows.
    """
    mine = groups.join(bits, "name").select("key", F.col("name").alias("a"), F.col("n").alias("a_n"),
                                            F.col("root").alias("a_root"), F.col("bits").alias("a_bits"))
    other = mine.select(F.col("key").alias("key2"), F.col("a").alias("b"), F.col("a_n").alias("b_n"),
                        F.col("a_root").alias("b_root"), F.col("a_bits").alias("b_bits"))
    met_ = mine.join(
        other,
        (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & possible(percent),
    )
    return met_.select("a", "b").distinct()


def by_key(sets: DataFrame) -> DataFrame:
    """A row for each key a class stands under."""
    return sets.select(F.explode("values").alias("key"), "name", "n")


def rare_keys(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Classes under their rarest shingles: as many as any similar set must share one of.

    Of sets that are similar, one shares an element with the other among the first
    n - percent of n + 1 in whatever order all keep. Rare ones first, so that what sets of a
    crowd have in common comes last; those that no other set has lead nowhere.
    """
    # One shuffle, in which a row looks at its neighbours: nearly all shingles are in one set alone, and end there.
    same = Window.partitionBy("key")
    beside = same.orderBy("name")
    met_ = by_key(sets).withColumns({"_before": F.lag("name").over(beside), "_after": F.lead("name").over(beside)})
    shared = met_.filter("_before IS NOT NULL OR _after IS NOT NULL").drop("_before", "_after")
    ranked = shared.withColumn("often", F.count("*").over(same))
    mine = Window.partitionBy("name")
    lonely = F.col("n") - F.count("*").over(mine)
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.withColumn("_place", F.row_number().over(mine.orderBy("often", "key"))).withColumn(
        "_lonely", lonely
    ).filter(F.col("_place") + F.col("_lonely") <= need).select("key", "name", "n")


def link(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, hash, name, n), links between names (a, b) and roots of linked names.

    A link is recorded where it is needed to close a component; pairs inside one component
    are not all compared.
    """
    read = written(sketches_of(docs, doc_id, text, shingle, percent), "sketches")
    members = written(read.select("doc_id", "hash", "name", "n"), "members")
    rows = written(met(by_key(read)), "met")
    wanted = written(rows.select("name").distinct(), "met-names")
    sketched = read.filter(F.size("bits") > 0).select("name", "bits")
    bits = written(sketched.join(small_side(wanted), "name", "left_semi").dropDuplicates(["name"]), "bits")
    discard(read)

    def links_among(pairs: DataFrame) -> DataFrame:
        names = pairs.select(F.explode(F.array("a", "b")).alias("name"))
        sets = sets_of(docs, members, names, doc_id, text, shingle)
        found = written(verified(pairs, sets, percent), "links")
        discard(sets)
        return found

    done = written(pairs_of(rows, bits, percent), "pairs")
    # Verifying moves whole sets. A class goes to its first partner; of the other pairs those that this
    # left apart are verified, too, but for those that sketches do not tell apart: they grow with the square
    # of a group, and meet under rare shingles.
    links = links_among(written(done.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs"))
    roots = rooted(links)
    told = done.filter("NOT untold").select("a", "b")
    apart = written(between_components(told, roots), "apart")
    if not apart.isEmpty():
        links = written(links.unionByName(links_among(apart)), "links")
        roots = rooted(links)
    left = written(open_groups(rows, roots), "open")
    crowded = (F.col("size") > SPLIT_ABOVE) | (F.col("largest") >= untold(percent))
    many = left.filter(crowded)
    more = cross_pairs(left.filter(~crowded), bits, percent)
    rare = None
    if not many.isEmpty():
        crowd = sets_of(docs, members, many.select("name"), doc_id, text, shingle, wide=False)
        rare = written(met(rare_keys(crowd, percent)), "rare")
        discard(crowd)
        more = more.unionByName(pairs_of(rare, bits, percent).select("a", "b")).distinct()
    more = written(more.join(told, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = written(links.unionByName(links_among(more)), "links")
        roots = rooted(links)
    if rare is not None:
        last = cross_pairs(open_groups(rare, roots), bits, percent)
        last = written(last.join(told.unionByName(more), ["a", "b"], "left_anti"), "pairs")
        if not last.isEmpty():
            links = written(links.unionByName(links_among(last)), "links")
            roots = rooted(links)
    return members, links, roots if roots is not None else wanted.limit(0).withColumn("root", F.col("name"))


def between_components(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs whose ends are not linked yet, by whatever way."""
    if roots is None:
        return pairs
    a = roots.select(F.col("name").alias("a"), F.col("root").alias("_a"))
    b = roots.select(F.col("name").alias("b"), F.col("root").alias("_b"))
    named = pairs.join(a, "a", "left").join(b, "b", "left")
    return named.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def rooted(links: DataFrame) -> DataFrame | None:
    return None if links.isEmpty() else written(components(links), "roots")


def place(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, hash, n and root (names the component; null without words) of every document."""
    members, _, roots = link(docs, doc_id, text, shingle, percent)
    tops = roots.withColumnRenamed("name", "_name")
    placed = members.join(tops, F.col("name") == F.col("_name"), "left").withColumn("root", F.coalesce("root", "name"))
    return written(placed.select("doc_id", "hash", "n", "root"), "placed")


def representatives(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The rows without their near copies: of each component the one with the smallest id, then hash.

    A null id comes last. Rows equal in id and text are copies, of which one stays; rows of one
    id and different texts are told apart. Rows without words have no copies and all stay. Texts
    are not shuffled, but for those that several rows of one id share.
    """
    placed = place(docs, doc_id, text, shingle, percent).filter("root IS NOT NULL")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    best = placed.groupBy(F.col("root").alias("_root")).agg(F.min(first).alias("_first"))
    other = ~F.col("_first").eqNullSafe(first)
    lost = written(
        placed.join(best, F.col("root") == F.col("_root")).filter(other).select(
            F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")
        ).distinct(), "copies",
    )
    twice = written(
        placed.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).count().filter("count > 1").drop("count"), "repeated"
    )
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).cast("long").alias("_own"), row_hash(doc_id, text).alias("_of"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_hash"))
    kept = keyed.join(small_side(lost), same, "left_anti")
    if twice.isEmpty():
        return kept.select("_row.*")
    several = small_side(twice)
    once = kept.join(several, same, "left_semi").dropDuplicates(["_own", "_of"])
    return kept.join(several, same, "left_anti").unionByName(once).select("_row.*")


def join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    placed = place(docs, doc_id, text, shingle, percent)
    least = placed.filter("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("_least"))
    return placed.join(least, F.col("root") == F.col("_root"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id")
    )
