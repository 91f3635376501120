"""Language model scores by prediction by partial matching over bytes.

A text is its lower-cased words, each spelled byte by byte and closed by a space, and one end
of text. A byte is predicted from the word so far, which is a node of a trie of all training
words; where the trie has not seen it there, the model escapes to the last four bytes, three,
two, one, none, and to all bytes alike. Short contexts count every distinct word once, since
they are asked where a word is new; the first three bytes are counted as often as they
occur. An escape costs its estimate: in the trie by the successors that were seen once, in
short contexts by the distinct ones. What the longer context could have said is excluded
from the shorter ones. These contexts end where a word begins, so a word is spelled once for
the whole corpus rather than at every occurrence.

The longest context is the whole word before (the start of text counts as one). Where it is
left for the spelling by its escape, the words that it knows are excluded. All pairs of a word
and the next are counted over all training texts.

Word counts are summed over all training documents. All words, in their order, are cut into blocks by a sample of them,
and a block makes its part of the trie. A node that reaches over a cut is a beginning of it, and what follows such
beginnings is counted over all blocks and goes to each. Where a word leaves the trie, the successors of the last
four and three bytes are joined to that step. Tables that go to every task are those after two bytes and after the beginning
of a word, which cannot pass 257 * 257 * 256 entries, and the ``HEAD_WORDS`` most frequent words (of at most 64
bytes), by which words are numbered; others are named by a 64-bit hash.

Pairs are shuffled once, packed, with the texts they stand in: a bucket counts its pairs and adds up what they
are worth to each text. Words without a number, and what is left after a word, are joined to those sums.

Defined cases: null or empty texts are one end of text; a null id counts as training;
repeated rows each count and each get their row; without training documents every byte
costs 8 bits; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smelter.llm.common import lean_batches, written
from smelter.llm.parity_join import mixed

#: Folds of the ids, and the one that is held out.
FOLDS, HELD_OUT = 5, 1
HEAD_WORDS, HEAD_BYTES = 100_000, 64
#: Pairs in a row held before they are packed; taken off every count of a pair.
HEAD_PAIRS, DISCOUNT = 1_000_000, 0.7
#: Beginning of a word as a context; the byte that ends a word, the one that ends a text.
START, SPACE, END = 256, 0x20, 0x0A
ANCHOR = 3
#: Spreads the byte that leads from a node to the next.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: A context is a number in base 257; these are four bytes before a word, and the first beyond all of four.
UNBEGUN, LONGEST = sum(START * 257 ** i for i in range(4)), 257 ** 4
#: Distinct words kept before counts are handed on.
FLUSH = 1_000_000
#: Bytes of words in a block, words of the sample in each, and bytes of a cut at most.
BLOCK_BYTES, CUT_SAMPLE, CUT_BYTES = 1 << 20, 20, 64
#: Training tokens for each bucket of pairs, and texts whose sums a task holds.
BUCKET_TOKENS, TEXT_FLUSH = 1_500_000, 1_000_000
#: Marks the name of a word that has no number.
FAR = np.int64(-2 ** 63)


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out and the text, never null."""
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (fold == HELD_OUT).alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes; the empty one is the end of text) and c, its count in training texts, over all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.record_batch({"word": pa.array(list(seen), pa.binary()), "c": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                words = _words(text)
                if held:
                    for word in set(words):
                        if word not in seen:
                            seen[word] = 0
                else:
                    seen.update(words)
                    seen[b""] += 1
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        if seen:
            yield out()

    parts = texts.select("text", "held_out").mapInArrow(count, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def successors(counts: DataFrame) -> tuple[dict, dict, DataFrame]:
    """Counts of bytes after two bytes and after the beginning of a word; context, s and c after four bytes."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: Counter = Counter()
        first: Counter = Counter()

        def out():
            for anchored, found in ((False, free), (True, first)):
                yield pa.record_batch({
                    "anchored": pa.array([anchored] * len(found), pa.bool_()), "k": pa.array(list(found), pa.int64()),
                    "c": pa.array(list(found.values()), pa.int64()),
                })
                found.clear()

        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                symbols = (*word, SPACE) if word else (END,)
                context = UNBEGUN
                for s in symbols:
                    free[context * 256 + s] += 1
                    context = context * 257 % LONGEST + s
                a = b = START
                for s in symbols[:ANCHOR]:
                    first[(a * 257 + b) * 256 + s] += c
                    a, b = b, s
                if len(free) > FLUSH:
                    yield from out()
        yield from out()

    rows = counts.filter("c > 0").mapInArrow(table, "anchored boolean, k long, c long")
    rows = written(rows.groupBy("anchored", "k").agg(F.sum("c").alias("c")), "byte-contexts")

    def after(keys, found) -> dict[int, dict[int, int]]:
        found_after: dict[int, dict[int, int]] = {}
        for k, c in zip(keys.tolist(), found.tolist()):
            found_after.setdefault(k >> 8, {})[k & 255] = c
        return found_after

    free = rows.filter("NOT anchored")
    two = free.groupBy((F.col("k") % (257 ** 2 * 256)).alias("k")).agg(F.sum("c").alias("c"))
    two, first = (after(t["k"].to_numpy(), t["c"].to_numpy()) for t in (
        df.select("k", "c").toArrow() for df in (two, rows.filter("anchored"))
    ))
    return two, first, free.select(F.shiftright("k", 8).alias("context"), (F.col("k") % 256).alias("s"), "c")


def names_of(words: list[bytes]) -> np.ndarray:
    """64-bit names of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def turned(x: np.ndarray) -> np.ndarray:
    """Names of words as the later part of a pair; a pair is named by both, joined by exclusive or."""
    return (x << 1) | ((x >> 63) & 1)


def escape(total: int, once: int) -> float:
    """Chance that a node of the trie is left for a shorter context."""
    return (once + 0.3) / (total + once + 1) if total > 1 else 0.2


class Spelling:
    """Costs in natural logarithms, from the tables."""

    def __init__(self, free: dict, first: dict, longer: list[dict] | None = None):
        self.two, self.anchored = free, first
        self.four, self.three = longer or ({}, {})
        self.one: dict[int, dict[int, int]] = {}
        self.none: dict[int, int] = {}
        for context, after in free.items():
            one = self.one.setdefault(context % 257, {})
            for s, c in after.items():
                one[s] = one.get(s, 0) + c
                self.none[s] = self.none.get(s, 0) + c
        self.known: dict[tuple, float] = {}

    def chain(self, contexts: list[dict], s: int, excluded: frozenset | set = frozenset()) -> float:
        """Cost of a byte through contexts from long to short, at last all bytes alike."""
        cost = 0.0
        for after in contexts:
            left = {k: c for k, c in after.items() if k not in excluded} if excluded else after
            if not left:
                continue
            # Every distinct successor hands half a count to the escape.
            total = 2 * sum(left.values())
            if s in left:
                return cost + math.log((2 * left[s] - 1) / total)
            cost += math.log(len(left) / total)
            excluded = excluded | left.keys() if excluded else frozenset(left)
        return cost - math.log(256 - len(excluded))

    def short(self, a: int, b: int, s: int) -> float:
        """Cost after bytes a and b without a longer context."""
        key = (a, b, s)
        if key not in self.known:
            self.known[key] = self.chain(self.contexts(a, b), s)
        return self.known[key]

    def contexts(self, a: int, b: int) -> list[dict]:
        if b == START:
            return [self.one.get(START, {}), self.none]
        return [self.two.get(a * 257 + b, {}), self.one.get(b, {}), self.none]

    def before(self, spelled: bytes, i: int) -> list[dict]:
        """Contexts of the byte at a place in a word, from four bytes to none."""
        a, b, c, d = spelled[i - 4:i] if i >= 4 else (*(START,) * (4 - i), *spelled[:i])
        three = (b * 257 + c) * 257 + d
        four = a * 257 ** 3 + three
        return [self.four.get(four, {}), self.three.get(three, {}), *self.contexts(c, d)]

    def at(self, spelled: bytes, i: int) -> float:
        """Cost of the byte at a place in a word without the trie."""
        key = (spelled[max(0, i - 4):i + 1], i < 4)
        if key not in self.known:
            self.known[key] = self.chain(self.before(spelled, i), spelled[i])
        return self.known[key]

    def opening(self, word: bytes) -> float:
        """Cost of the first ``ANCHOR`` bytes of a word, its end included."""
        symbols = [*word, SPACE][:ANCHOR] if word else [END]
        cost, a, b = 0.0, START, START
        for s in symbols:
            key = (a, b, s, True)
            if key not in self.known:
                self.known[key] = self.chain([self.anchored.get(a * 257 + b, {}), *self.contexts(a, b)], s)
            cost += self.known[key]
            a, b = b, s
        return cost

    def group(self, words: list[bytes], counts: list[int]) -> list[float]:
        """Costs of words with the same first bytes, given all of them: what ``word_costs`` does by joins, in one place."""
        through: dict[bytes, int] = {}
        after: dict[bytes, bytearray] = {}
        for word, c in zip(words, counts):
            if c and len(word) >= ANCHOR:
                spelled = word + b" "
                for i in range(ANCHOR, len(spelled) + 1):
                    node = spelled[:i]
                    if node in through:
                        through[node] += c
                    else:
                        through[node] = c
                        if i > ANCHOR:
                            after.setdefault(spelled[:i - 1], bytearray()).append(spelled[i - 1])
        away = {
            node: escape(through[node], sum(through[node + bytes((s,))] == 1 for s in found))
            for node, found in after.items()
        }
        steps: dict[bytes, float] = {}
        costs = []
        for word in words:
            cost = self.opening(word)
            if len(word) >= ANCHOR:
                spelled = word + b" "
                for i in range(ANCHOR, len(spelled)):
                    node = spelled[:i + 1]
                    step = steps.get(node)
                    if step is None:
                        parent, s = spelled[:i], spelled[i]
                        if node in through:
                            step = math.log(through[node] / through[parent] * (1 - away[parent]))
                            steps[node] = step
                        elif parent in through:
                            step = math.log(away[parent]) + self.chain(
                                self.before(spelled, i), s, frozenset(after[parent])
                            )
                        else:
                            step = self.at(spelled, i)
                    cost += step
            costs.append(cost)
        return costs


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def cuts_of(counts: DataFrame, block_bytes: int) -> list[bytes]:
    """Where the words, in order, are cut into blocks of about ``block_bytes``: some words or beginnings of words."""
    size, n = counts.agg(F.sum(F.length("word") + 1), F.count("*")).first()
    blocks = -(-(size or 0) // block_bytes)
    if blocks < 2:
        return []
    rate = max(1, n // (blocks * CUT_SAMPLE))
    rows = counts.filter(F.pmod(F.xxhash64("word"), F.lit(rate)) == 0).select(
        F.substring("word", 1, CUT_BYTES).alias("cut"), F.length("word").alias("n")
    ).collect()
    rows = sorted((bytes(r["cut"]), r["n"] + 1) for r in rows)
    if not rows:
        return []
    run = np.cumsum([n for _, n in rows])
    at = np.searchsorted(run, run[-1] * np.arange(1, blocks) / blocks)
    return sorted({rows[k][0] for k in at.tolist()})


class Trie:
    """Trained words of a block, from ``ANCHOR`` bytes on; what only one word goes through is its tail."""

    def __init__(self):
        self.roots: dict[bytes, int] = {}
        self.child: dict[int, int] = {}
        self.c: list[int] = []
        self.parent: list[int] = []
        self.after: dict[int, bytearray] = {}
        self.owner: dict[int, tuple[bytes, int, int]] = {}

    def root(self, start: bytes) -> int:
        node = self.roots.get(start)
        if node is None:
            node = self.roots[start] = len(self.c)
            self.c.append(0)
            self.parent.append(-1)
        return node

    def step(self, node: int, s: int) -> int:
        key = node << 8 | s
        found = self.child.get(key)
        if found is None:
            found = self.child[key] = len(self.c)
            self.c.append(0)
            self.parent.append(node)
            self.after.setdefault(node, bytearray()).append(s)
        return found

    def add(self, spelled: bytes, c: int, depth: int) -> int:
        """The last node of a word that is told from all others by its first ``depth`` bytes."""
        node = self.root(spelled[:ANCHOR])
        self.c[node] += c
        for s in spelled[ANCHOR:depth]:
            node = self.step(node, s)
            self.c[node] += c
        self.owner[node] = (spelled, depth, c)
        return node

    def share(self, cut: bytes, shared: dict[bytes, dict[int, int]]) -> None:
        """Nodes that reach into other blocks, with what all blocks count after them."""
        if cut[:ANCHOR] not in shared:
            return
        node = self.root(cut[:ANCHOR])
        self.c[node] = sum(shared[cut[:ANCHOR]].values())
        for k in range(ANCHOR, len(cut) + 1):
            after = shared.get(cut[:k])
            if after is None:
                return
            for s, c in after.items():
                self.c[self.step(node, s)] = c
            if k == len(cut) or cut[k] not in after:
                return
            node = self.child[node << 8 | cut[k]]

    def close(self) -> None:
        """Costs of all nodes from their roots, and of leaving them."""
        c, parent = np.array(self.c, np.float64), np.array(self.parent, np.int64)
        below = parent >= 0
        once = np.bincount(parent[below & (c == 1)], minlength=len(c))[:len(c)] if len(c) else c
        self.away = np.where(c > 1, (once + 0.3) / (c + once + 1), 0.2)
        step = np.zeros(len(c))
        step[below] = np.log(c[below] / c[parent[below]] * (1 - self.away[parent[below]]))
        self.cost = cost = step.tolist()
        # A node stands behind the one before it.
        for node, before in enumerate(self.parent):
            if before >= 0:
                cost[node] += cost[before]

    def tail(self, c: int) -> float:
        return escape(c, c == 1)

    def trained(self, node: int) -> float:
        spelled, depth, c = self.owner[node]
        return self.cost[node] + (len(spelled) - depth) * math.log(1 - self.tail(c))

    def walk(self, spelled: bytes) -> tuple[float, int, bytes]:
        """Of a new word: the cost up to where it leaves the trie, that place, and the bytes that are known there."""
        node, at = self.roots.get(spelled[:ANCHOR]), ANCHOR
        if node is None:
            return 0.0, at, b""
        while at < len(spelled):
            found = self.child.get(node << 8 | spelled[at])
            if found is None:
                break
            node, at = found, at + 1
        if node not in self.after:
            word, depth, c = self.owner[node]
            more = common(word[depth:], spelled[depth:])
            away = self.tail(c)
            return self.cost[node] + more * math.log(1 - away) + math.log(away), depth + more, word[depth + more:depth + more + 1]
        return self.cost[node] + math.log(self.away[node]), at, bytes(sorted(self.after[node]))


def spelled_words(counts: DataFrame, two: dict, first: dict, block_bytes: int) -> DataFrame:
    """word, name, c, cost (natural logarithm) and the steps that are left: four bytes before, byte, bytes known there.

    Words are cut, in their order, into blocks. A node of the trie that reaches over a cut begins the cut, so what is
    counted after the beginnings of cuts in all blocks makes each block complete.
    """
    cuts = cuts_of(counts, block_bytes)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(cuts, word) for word in batch.column("word").to_pylist()]
            yield pa.record_batch({"block": pa.array(at, pa.int64()), "word": batch.column("word"), "c": batch.column("c")})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                at = bisect_right(cuts, word)
                far = max((common(word, cut) for cut in cuts[max(at - 1, 0):at + 1] if cut[:ANCHOR] == word[:ANCHOR]), default=0)
                for k in range(ANCHOR, far + 1):
                    found[word[:k], word[k] if k < len(word) else SPACE] += c
        yield pa.record_batch({
            "node": pa.array([node for node, _ in found], pa.binary()), "s": pa.array([s for _, s in found], pa.int64()),
            "c": pa.array(list(found.values()), pa.int64()),
        })

    shared: dict[bytes, dict[int, int]] = {}
    if cuts:
        long = counts.filter((F.col("c") > 0) & (F.length("word") >= ANCHOR)).select("word", "c")
        for r in long.mapInArrow(reach, "node binary, s long, c long").groupBy("node", "s").agg(F.sum("c").alias("c")).collect():
            shared.setdefault(bytes(r["node"]), {})[r["s"]] = r["c"]
    models: list[Spelling] = []

    def spell(table: pa.Table) -> pa.Table:
        if not models:
            models.append(Spelling(two, first))
        model = models[0]
        words, cs = table["word"].to_pylist(), table["c"].to_pylist()
        order = sorted(range(len(words)), key=words.__getitem__)
        at = table["block"][0].as_py()
        near = cuts[max(at - 1, 0):at + 1]
        trie, ends = Trie(), {}
        known = [k for k in order if cs[k] and len(words[k]) >= ANCHOR]
        alike = [0, *[common(words[a], words[b]) for a, b in zip(known, known[1:])], 0]
        for k, before, after in zip(known, alike, alike[1:]):
            spelled = words[k] + b" "
            depth = max(before, after, *[common(words[k], cut) for cut in near], ANCHOR) + 1
            ends[k] = trie.add(spelled, cs[k], min(depth, len(spelled)))
        for cut in near:
            trie.share(cut, shared)
        trie.close()
        cost, offsets, fours, symbols, excluded = [], [0], [], [], []
        for k, word in enumerate(words):
            total = model.opening(word)
            if k in ends:
                total += trie.trained(ends[k])
            elif len(word) >= ANCHOR:
                spelled = word + b" "
                seen, place, bytes_there = trie.walk(spelled)
                total += seen
                padded = (START,) * 4 + tuple(spelled)
                four = ((padded[place] * 257 + padded[place + 1]) * 257 + padded[place + 2]) * 257 + padded[place + 3]
                for i in range(place, len(spelled)):
                    fours.append(four)
                    symbols.append(spelled[i])
                    excluded.append(bytes_there if i == place else b"")
                    four = four * 257 % LONGEST + spelled[i]
            cost.append(total)
            offsets.append(len(fours))
        left = pa.StructArray.from_arrays(
            [pa.array(fours, pa.int64()), pa.array(symbols, pa.int16()), pa.array(excluded, pa.binary())], ["four", "s", "excluded"]
        )
        return pa.table({
            "word": table["word"], "name": pa.array(names_of(words), pa.int64()), "c": table["c"], "cost": pa.array(cost, pa.float64()),
            "left": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left),
        })

    kinds = "word binary, name long, c long, cost double, left array<struct<four: long, s: short, excluded: binary>>"
    blocks = counts.select("word", "c").mapInArrow(block, "block long, word binary, c long")
    return blocks.groupBy("block").applyInArrow(spell, kinds)


def word_costs(counts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """word, its name, c and cost: the log10 probability of its spelling."""
    two, first, longer = successors(counts)
    words = written(spelled_words(counts, two, first, block_bytes), "spelled")
    left = words.filter("size(left) > 0").select("name", F.explode("left").alias("t")).select("name", "t.*")
    kinds = left.select("four", "s", "excluded").distinct()

    def after(n: int, name: str) -> DataFrame:
        """Successors of the last n bytes, where they are asked for."""
        wanted = left.select((F.col("four") % 257 ** n).alias(f"_{name}")).distinct()
        table = longer.groupBy((F.col("context") % 257 ** n).alias(f"_{name}"), "s").agg(F.sum("c").alias("c"))
        return table.join(wanted, f"_{name}").groupBy(f"_{name}").agg(
            F.collect_list((F.col("c") * 256 + F.col("s")).cast("long")).alias(name)
        )

    kinds = kinds.join(after(3, "after_three"), F.col("four") % 257 ** 3 == F.col("_after_three"), "left")
    kinds = kinds.join(after(4, "after_four"), F.col("four") == F.col("_after_four"), "left").select(
        "four", "s", "excluded", "after_three", "after_four"
    )

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Spelling(two, first)
        for batch in batches:
            cost = []
            for r in batch.to_pylist():
                four, three = r["four"], r["four"] % 257 ** 3
                tables = [{k & 255: k >> 8 for k in r[name] or ()} for name in ("after_four", "after_three")]
                contexts = [*tables, *model.contexts(three // 257 % 257, four % 257)]
                cost.append(model.chain(contexts, r["s"], frozenset(r["excluded"])))
            yield pa.record_batch({**{k: batch.column(k) for k in ("four", "s", "excluded")}, "step": pa.array(cost, pa.float64())})

    priced = kinds.mapInArrow(leave, "four long, s short, excluded binary, step double")
    spelled = left.join(priced, ["four", "s", "excluded"]).groupBy(F.col("name").alias("_name")).agg(F.sum("step").alias("steps"))
    return words.drop("left").join(spelled, F.col("name") == F.col("_name"), "left").select(
        "word", "name", "c", ((F.col("cost") + F.coalesce("steps", F.lit(0.0))) / math.log(10)).alias("cost")
    )


def line_of(texts: list[list[bytes]]) -> list[bytes]:
    """The words of all texts in a row, an end before and after each text."""
    flat = [b""]
    for words in texts:
        flat += words
        flat.append(b"")
    return flat


def packed(column: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which pack well where numbers are small."""
    planes = np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pair_name(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit names of pairs of numbered or named words."""
    return mixed(mixed(before.view(np.uint64) * STEP) ^ turned(after).view(np.uint64) * STEP)


def pair_lists(texts: DataFrame, ids: dict[bytes, int], buckets: int, room: int) -> DataFrame:
    """Pairs of a word and the next with the text they stand in, packed, by buckets.

    A frequent word is its number, another one its name, which is below zero. Pairs after a frequent word are
    spread by their names; those after another one stand together.
    """

    def packed_pairs(befores, afters, rows, keys, held) -> Iterator[pa.RecordBatch]:
        before, after = np.concatenate(befores), np.concatenate(afters)
        row = np.repeat(np.arange(len(rows), dtype=np.uint32), rows)
        spread = np.where(before < 0, mixed(before.view(np.uint64) * STEP), pair_name(before, after))
        bucket = (spread >> np.uint64(16)) % np.uint64(buckets)
        # One number to sort by, the place in its last bits: equal pairs of a text meet, as far as bits go.
        last, least = len(before).bit_length(), 18
        rest = 63 - last - least - buckets.bit_length()
        key = bucket.astype(np.int64) << least | np.where(before < 0, 1 << 17 | before & 0x1FFFF, before & 0x1FFFF)
        order = np.sort((key << rest | after & ((1 << rest) - 1)) << last | np.arange(len(before))) & ((1 << last) - 1)
        before, after, row, bucket = before[order], after[order], row[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (before[1:] != before[:-1]) | (after[1:] != after[:-1]) | (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(order))).astype(np.uint32)
        before, after, row, bucket = before[at], after[at], row[at], bucket[at]
        keys, held = np.array(keys, np.int64), np.array(held, bool)
        found = np.unique(bucket)
        low, high = np.searchsorted(bucket, found), np.searchsorted(bucket, found, "right")
        for b, i, k in zip(found.tolist(), low.tolist(), high.tolist()):
            own, local = np.unique(row[i:k], return_inverse=True)
            step = np.diff(before[i:k], prepend=np.int64(0))
            columns = (step, after[i:k], local.astype(np.uint32), times[i:k], keys[own], held[own].astype(np.uint8))
            yield pa.record_batch({
                "bucket": pa.array([b], pa.int64()), "n": pa.array([k - i], pa.int64()), "n_texts": pa.array([len(own)], pa.int64()),
                "columns": pa.array([[packed(c) for c in columns]], pa.list_(pa.binary())),
            })

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        befores, afters, rows, keys, held, size = [], [], [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [_words(text) for text in batch.column("text").to_pylist()]
            flat = line_of(texts)
            line = np.fromiter(map(ids.get, flat, repeat(-1)), np.int64, len(flat))
            absent = np.flatnonzero(line < 0)
            line[absent] = names_of([flat[k] for k in absent.tolist()]) | FAR
            befores.append(line[:-1])
            afters.append(line[1:])
            rows += [len(words) + 1 for words in texts]
            keys += batch.column("key").to_pylist()
            held += batch.column("held_out").to_pylist()
            size += len(line)
            if size > room:
                yield from packed_pairs(befores, afters, rows, keys, held)
                befores, afters, rows, keys, held, size = [], [], [], [], [], 0
        if size:
            yield from packed_pairs(befores, afters, rows, keys, held)

    return texts.select("key", "held_out", "text").mapInArrow(read, "bucket long, n long, n_texts long, columns array<binary>")


#: What a bucket of pairs tells: sums of a text, words and contexts to be looked up for it, known words after a word.
TEXT, WORD, LEAVE, KNOWN, AFTER = range(5)


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``head_words`` frequent words are numbered, ``head_pairs`` is the room for pairs in a row; 0 leaves the word
    before out of account.
    """
    # Rows of one id and text share a key, and their score.
    texts = texts_of(lean_batches(docs), doc_id, text).withColumn("key", F.xxhash64("doc_id", "text"))
    counts = written(word_counts(texts), "word-counts")
    n, v = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n, v = n or 0, v or 0
    costs = written(word_costs(counts), "word-costs")
    sound = costs.filter((F.col("c") > 0) & (F.length("word") <= HEAD_BYTES))
    # Every text has an end, so its cost always goes along.
    common_words = sound.orderBy((F.length("word") > 0), F.desc("c"), "word").limit(head_words + 1).select("word", "c", "cost").toArrow()
    # The end of one text is numbered 0 and stands before the next; without training it has a cost all the same.
    ids = {word: i for i, word in enumerate(common_words["word"].to_pylist())} or {b"": 0}
    c = common_words["c"].to_numpy().astype(float) if common_words.num_rows else np.zeros(1)
    cost = common_words["cost"].to_numpy() if common_words.num_rows else np.full(1, -math.log10(256))
    over, paired = n + 0.5 * (v + 1), head_pairs > 0
    size = n or texts.agg(F.sum(F.length("text"))).first()[0] or 0

    def tell_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets one after another; the sums of a text over all buckets of a task are one row."""
        sums: list[pa.Table] = []
        lists = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in ("bucket", "n", "n_texts", "columns"))))
        for _, bucket in groupby(lists, lambda row: row[0]):
            first, *others = tell([row[1:] for row in bucket])
            sums.append(first)
            for told in others:
                yield from told.to_batches()
            if sum(map(len, sums)) > 4 * TEXT_FLUSH:
                sums = [summed(sums)]
                if len(sums[0]) > TEXT_FLUSH:
                    yield from sums.pop().to_batches()
        if sums:
            yield from summed(sums).to_batches()

    def summed(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables)
        own, same = np.unique(table["a"].to_numpy(), return_inverse=True)
        return lines(TEXT, own, **{k: np.bincount(same, table[k].to_numpy(), len(own)) for k in ("x", "y", "n", "known", "tokens")})

    def lines(kind, a, b=None, x=None, y=None, n=None, known=None, tokens=None) -> pa.Table:
        given = dict(a=a, b=b, x=x, y=y, n=n, known=known, tokens=tokens)
        columns = {"kind": pa.array(np.full(len(a), kind, np.int16))}
        for name, values in given.items():
            sort = pa.float64() if name in "xy" else pa.int64()
            columns[name] = pa.nulls(len(a), sort) if values is None else pa.array(values).cast(sort)
        return pa.table(columns)

    def tell(lists: list[tuple]) -> list[pa.Table]:
        parts, first_text = [], 0
        for size, n_texts, columns in lists:
            kinds = (np.int64, np.int64, np.uint32, np.uint32, np.int64, np.uint8)
            step, after, row, times, key, held = (
                unpacked(data, k, kind) for data, k, kind in zip(columns, (size,) * 4 + (n_texts,) * 2, kinds)
            )
            parts.append((np.cumsum(step), after, row.astype(np.int64) + first_text, times, key, held))
            first_text += n_texts
        before, after, row, times, key, held = (np.concatenate(column) for column in zip(*parts))
        parts.clear()
        times = times.astype(np.float64)
        key, same = np.unique(key, return_inverse=True)
        text_held = np.zeros(len(key), bool)
        text_held[same] = held > 0
        row = same[row]
        own = ~text_held[row]
        _, at, pair = np.unique(pair_name(before, after), return_index=True, return_inverse=True)
        count = np.bincount(pair, times * own, len(at))
        # All pairs after a word without a number are here, so its count is theirs.
        named, number = np.unique(before[before < 0], return_inverse=True)
        far = before < 0
        place = np.where(far, 0, before)
        place[far] = len(c) + number
        counted = np.append(c, np.bincount(number, (times * own)[far], len(named)))
        names = np.append(np.arange(len(c)), named)
        numbered = np.maximum(after, 0)
        seen = (count[pair] > 0) & paired
        there = np.zeros(len(row))
        there[seen] = np.log10((count[pair[seen]] - DISCOUNT) / counted[place[seen]])
        plain = ~seen & (after >= 0)
        there[plain] = cost[numbered[plain]]
        base = np.log10((counted + 0.5) / over)[place]

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(row, times * x, len(key))

        def whole(x):
            return np.rint(x).astype(np.int64)

        told = [lines(
            TEXT, key, x=total(there), y=total(base), n=whole(total(before == 0)), known=whole(total(counted[place] > 0)),
            tokens=whole(total(np.ones(len(row)))),
        )]
        ask = ~seen & (after < 0)
        told.append(lines(WORD, key[row[ask]], after[ask], n=whole(times[ask])))
        if paired:
            # A word in front leaves only where it was trained.
            ask = ~seen & (counted[place] > 0)
            told.append(lines(LEAVE, key[row[ask]], before[ask], n=whole(times[ask])))
            # Of words without a number all askers are here.
            asked = np.ones(len(names), bool)
            asked[len(c):] = False
            asked[place[ask]] = True
            known = at[(count > 0) & asked[place[at]]]
            kinds = np.bincount(place[known], minlength=len(names))
            near = known[after[known] >= 0]
            excluded = np.bincount(place[near], np.power(10.0, cost[after[near]]), len(names))
            some = np.flatnonzero(kinds)
            told.append(lines(KNOWN, names[some], x=excluded[some], n=kinds[some], known=whole(counted[some])))
            away = known[after[known] < 0]
            told.append(lines(AFTER, before[away], after[away]))
        return told

    buckets = 1 + size // BUCKET_TOKENS
    told = written(
        pair_lists(texts, ids, buckets, head_pairs or HEAD_PAIRS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
            tell_all, "kind short, a long, b long, x double, y double, n long, known long, tokens long"
        ), "told-pairs"
    )

    def kind(k: int) -> DataFrame:
        return told.filter(F.col("kind") == k)

    spelled = costs.select(F.col("name").bitwiseOR(F.lit(int(FAR))).alias("b"), "cost")
    sums = kind(TEXT).select("a", "x", "y", "n", "known", "tokens")

    def more(df: DataFrame, x: Column) -> DataFrame:
        return df.select("a", x.alias("x"), F.lit(0.0).alias("y"), *[F.lit(0).cast("long").alias(k) for k in ("n", "known", "tokens")])

    sums = sums.unionByName(more(kind(WORD).select("a", "b", "n").join(spelled, "b"), F.col("n") * F.col("cost")))
    if paired:
        known = kind(KNOWN).select(F.col("a").alias("b"), "x", "n", F.col("known").alias("c")).unionByName(
            kind(AFTER).select("a", "b").join(spelled, "b").select(
                F.col("a").alias("b"), F.pow(F.lit(10.0), F.col("cost")).alias("x"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c")
            )
        ).groupBy("b").agg(F.sum("x").alias("_excluded"), F.sum("n").alias("_kinds"), F.max("c").alias("_c"))
        # What any word adds after this one: its escape, less what its known words held of the spelling.
        leave = F.log10(F.lit(DISCOUNT) * F.col("_kinds") / F.col("_c")) - F.log10(F.greatest(1 - F.col("_excluded"), F.lit(1e-9)))
        leaves = known.select("b", leave.alias("leave"))
        sums = sums.unionByName(more(kind(LEAVE).select("a", "b", "n").join(leaves, "b"), F.col("n") * F.col("leave")))
    sums = sums.groupBy(F.col("a").alias("_of")).agg(*[F.sum(k).alias(f"_{k}") for k in ("x", "y", "n", "known", "tokens")])
    # Each row of a key added to the sums.
    return texts.drop("text").join(sums, F.col("key") == F.col("_of")).select(
        "doc_id", "held_out", (F.col("_tokens") / F.col("_n")).cast("long").alias("n_tokens"),
        (F.col("_known") / F.col("_n")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_y") / F.col("_n")).alias("base_score"), (F.col("_x") / F.col("_n")).alias("score"),
    )
