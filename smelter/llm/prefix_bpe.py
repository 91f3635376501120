"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the last token of its encoding is stored. That token is unique: it
ends the prefix, and either begins it or forms with the last token of the prefix before it a pair
that encodes to itself. (An encoding is right where all its neighbours are such pairs.) So a prefix
costs a few look-ups whatever stands before it, the whole piece takes linear time however long
it is, bytes can be appended exactly, and after an edit only the prefixes near it are computed
again: once the stored tokens agree over the length of the longest token, all later ones do.

Defined results: a null text is empty and has no tokens; white space, copies and very long texts
are encoded as they stand; rows keep their number; other columns are not read. Special tokens
are ordinary text. A vocabulary without one of the 256 bytes is refused.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of text, and pairs of tokens of long pieces, that a task remembers before it forgets some.
REMEMBERED = 1 << 16

#: Longer pieces are rare and large: not remembered.
LONG = 64

#: Longest piece encoded together with others, pieces and texts that are.
WIDEST, TOGETHER, TEXTS = 32, 20_000, 1_000

#: Pairs of tokens that are remembered at once when pieces go together.
PAIRS = 1 << 20

#: Odd factor of the running sums that name longer stretches; matches are compared byte by byte.
MIXING = 0x9E3779B97F4A7C15

#: White space as Unicode has it: fixed values.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: White space with the word behind it. A pattern that starts a match at white space, if it
#: has any, and looks no farther than the next character, cuts such a unit by itself.
WORDS = f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+"

#: Units that a pattern which takes letters with a space before them leaves whole.
LETTERS = " ?[A-Za-z]+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a file with a token in base 64 and its id on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def check_bytes(ranks: dict[bytes, int]) -> None:
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no token for bytes {missing}")


class Vocabulary:
    """Tokens by their bytes, and which of them may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        check_bytes(ranks)
        self.ranks = ranks
        self._pairs: dict[int, bool] = {}
        self._reached: dict[int, bool] = {}

    # Most tasks meet no piece that is encoded by itself, and need none of these.
    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}

    @cached_property
    def lengths(self) -> dict[int, int]:
        return {rank: len(token) for token, rank in self.ranks.items()}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ranks))

    @cached_property
    def _endings(self) -> dict[bytes, int]:
        """Every ending of a token, with the token that it is itself, if any, else -1."""
        return {token[i:]: -1 for token in self.ranks for i in range(len(token))} | self.ranks

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a short piece by the definition: always join the pair of least rank."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            joined = [(ranks[both], i) for i, both in enumerate(map(bytes.__add__, parts, parts[1:])) if both in ranks]
            if not joined:
                return [ranks[part] for part in parts]
            _, i = min(joined)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins."""
        whole = self.tokens[token]
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            joined = [(self.ranks[both], i) for i, both in enumerate(map(bytes.__add__, parts, parts[1:])) if both in self.ranks]
            _, i = min(joined)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def alone(self, token: int) -> bool:
        """Whether joining the bytes of a token ever gives it."""
        if token not in self._reached:
            self._reached[token] = self.merge(self.tokens[token]) == [token]
        return self._reached[token]

    def _learnt(self, pair: int, left: int, right: int) -> bool:
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        self._pairs[pair] = stands = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return stands

    def extend(self, text: bytes, last: list[int], upto: int) -> None:
        """Add the last tokens of the prefixes of ``text`` up to a length.

        ``last[i]`` belongs to the prefix of ``i + 1`` bytes. A token fits if it ends the prefix and
        stands behind the last token of what comes before: the two encode to themselves.
        """
        ending, lengths, pair_known = self._endings.get, self.lengths, self._pairs.get
        for end in range(len(last) + 1, upto + 1):
            fits, start = [], end - 1
            while start >= 0:
                token = ending(text[start:end])
                if token is None:
                    break
                if token >= 0:
                    fits.append(token)
                start -= 1
            # The longest first: it is the right one most of the time.
            while True:
                token = fits.pop()
                before = end - lengths[token]
                if before:
                    pair = last[before - 1] << 32 | token
                    stands = pair_known(pair)
                    if stands is None:
                        stands = self._learnt(pair, last[before - 1], token)
                else:
                    stands = self.alone(token)
                if stands:
                    break
            last.append(token)


class Prefixes:
    """The bytes of one piece with the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; nothing stored changes."""
        self.text += more
        self.vocabulary.extend(self.text, self.last, len(self.text))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put bytes in the place of ``text[start:end]``; returns how many prefixes were computed.

        Prefixes before the edit stay. Behind it, the last token depends on bytes and tokens
        no farther back than the longest token, so that much agreement ends the work.
        """
        old, kept = self.last, self.text[end:]
        self.text = self.text[:start] + new + kept
        last = old[:start]
        shift = len(new) - (end - start)
        agreed, at = 0, start
        while at < len(self.text) and agreed < self.vocabulary.longest:
            self.vocabulary.extend(self.text, last, at + 1)
            behind = at >= start + len(new)
            agreed = agreed + 1 if behind and last[at] == old[at - shift] else 0
            at += 1
        self.last = last + old[at - shift :]
        return at - start

    def tokens(self) -> list[int]:
        return backwards(self.vocabulary, self.last)


def backwards(vocabulary: Vocabulary, last: list[int]) -> list[int]:
    """The tokens of a whole piece, from the last tokens of its prefixes."""
    out, end = [], len(last)
    while end:
        out.append(last[end - 1])
        end -= vocabulary.lengths[out[-1]]
    return out[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece. A piece that is a token is that token, as in the tokenizer's definition."""
    whole = vocabulary.ranks.get(piece)
    if whole is not None:
        return [whole]
    last: list[int] = []
    vocabulary.extend(piece, last, len(piece))
    return backwards(vocabulary, last)


class Tables:
    """A vocabulary as arrays: the same step for many pieces at once.

    Whether two tokens stand in a row is told from how they are built. The tokens along the right
    edge of the left one and along the left edge of the right one meet at the seam, each from the
    merge that makes it to the merge that takes it up. The pair falls apart if two of them meet
    whose join would come before either is taken up, ranks being the order of merges. At equal
    ranks the merge farther left comes first.
    """

    def __init__(self, vocabulary: Vocabulary):
        tokens = {rank: token for rank, token in vocabulary.tokens.items() if vocabulary.alone(rank)}
        size = max(vocabulary.tokens) + 1
        self.length = np.zeros(size, dtype=np.int64)
        self.bytes = np.zeros((size, WIDEST), dtype=np.uint8)
        self.born = np.full(size, -1, dtype=np.int64)
        by_length: dict[int, list[int]] = {}
        for rank, token in tokens.items():
            self.length[rank] = len(token)
            if len(token) <= WIDEST:
                by_length.setdefault(len(token), []).append(rank)
                self.bytes[rank, : len(token)] = np.frombuffer(token, dtype=np.uint8)
            if len(token) > 1:
                self.born[rank] = rank
        self.known = {n: self._sorted(np.array(ranks), n) for n, ranks in by_length.items()}
        ranks = vocabulary.ranks
        joined = {
            (ranks[token[:i]], ranks[token[i:]]): rank
            for rank, token in tokens.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        }
        pairs = np.array([left << 32 | right for left, right in joined], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.joined = pairs[order], np.array(list(joined.values()), dtype=np.int64)[order]
        halves = {rank: vocabulary.halves(rank) for rank, token in tokens.items() if len(token) > 1}
        self.right, self.left = (self._edges(size, halves, side) for side in (1, 0))
        self._forget()

    def _forget(self) -> None:
        # A direct-mapped memory of pairs: a newer pair takes the slot of an older one.
        self.slot_pair, self.slot_stands = np.full(PAIRS, -1, dtype=np.int64), np.zeros(PAIRS, dtype=bool)

    def packed(self) -> dict:
        """All that was worked out, as plain arrays to send to the tasks."""
        return {name: value for name, value in vars(self).items() if not name.startswith("slot_")}

    @classmethod
    def unpacked(cls, packed: dict) -> Tables:
        tables = cls.__new__(cls)
        vars(tables).update(packed)
        tables._forget()
        return tables

    def _sorted(self, ranks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        keys = self._keys(self._sums(self.bytes[ranks, :n], n), 0, n)
        order = np.argsort(keys)
        return keys[order], ranks[order]

    @staticmethod
    def _sums(rows: np.ndarray, n: int) -> dict[int, np.ndarray]:
        """Running sums in two bases: base 256 names up to eight bytes exactly."""
        sums = {base: np.zeros((len(rows), n + 1), dtype=np.uint64) for base in (256, MIXING)}
        for base, own in sums.items():
            for i in range(n):
                own[:, i + 1] = own[:, i] * np.uint64(base) + rows[:, i]
        return sums

    @staticmethod
    def _keys(sums: dict[int, np.ndarray], start: int, end: int, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        base = 256 if end - start <= 8 else MIXING
        power = np.uint64(pow(base, end - start, 2**64))
        return sums[base][rows, end] - sums[base][rows, start] * power

    @staticmethod
    def _edges(size: int, halves: dict[int, tuple[int, int]], side: int) -> np.ndarray:
        edges = []
        for rank in range(size):
            own = [rank]
            while own[-1] in halves:
                own.append(halves[own[-1]][side])
            edges.append(own)
        out = np.full((size, max(map(len, edges))), -1, dtype=np.int32)
        for rank, own in enumerate(edges):
            out[rank, : len(own)] = own
        return out

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two make together, or -1."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.joined[at], -1) if len(self.pairs) else np.full(len(pair), -1)

    def seams(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens in a row stay as they are."""
        never = np.iinfo(np.int64).max
        stands = np.ones(len(left), dtype=bool)
        for i in range(self.right.shape[1]):
            here = np.flatnonzero(stands & (self.right[left, i] >= 0))
            if not len(here):
                break
            x = self.right[left[here], i].astype(np.int64)
            x_end = self.right[left[here], i - 1] if i else np.full(len(here), never)
            for j in range(self.left.shape[1]):
                y = self.left[right[here], j].astype(np.int64)
                there = y >= 0
                if not there.any():
                    break
                y_end = self.left[right[here], j - 1] if j else np.full(len(here), never)
                meet = there & (np.maximum(self.born[x], self.born[y]) < np.minimum(x_end, y_end))
                made = np.full(len(here), -1)
                made[meet] = self._join(x[meet], y[meet])
                stands[here[(made >= 0) & (made < x_end) & (made <= y_end)]] = False
        return stands

    def stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        slot = ((pair.astype(np.uint64) * np.uint64(MIXING)) >> np.uint64(20)).astype(np.int64) % len(self.slot_pair)
        new = self.slot_pair[slot] != pair
        out = self.slot_stands[slot]
        if new.any():
            unknown, back = np.unique(pair[new], return_inverse=True)
            found = self.seams(unknown >> 32, unknown & 0xFFFFFFFF)
            out[new] = found[back]
            self.slot_pair[slot[new]], self.slot_stands[slot[new]] = pair[new], found[back]
        return out

    def last_tokens(self, pieces: list[bytes], width: int) -> np.ndarray:
        """The last token of every prefix of pieces of at most ``width`` bytes, longest piece first."""
        rows = np.frombuffer(b"".join([piece.ljust(width, b"\0") for piece in pieces]), dtype=np.uint8).reshape(-1, width)
        lengths = np.array([len(piece) for piece in pieces])
        sums = self._sums(rows, width)
        last = np.full((len(pieces), width), -1, dtype=np.int64)
        for end in range(1, width + 1):
            open_ = np.arange(np.searchsorted(-lengths, -end, side="right"))
            # The longest first: it is the right one most of the time.
            for n in range(end, 0, -1):
                if n not in self.known or not len(open_):
                    continue
                keys, ranks = self.known[n]
                wanted = self._keys(sums, end - n, end, open_)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == wanted)
                here, token = open_[hit], ranks[at[hit]]
                if n > 8 and len(here):
                    same = (rows[here, end - n : end] == self.bytes[token, :n]).all(axis=1)
                    hit, here, token = hit[same], here[same], token[same]
                if not len(here):
                    continue
                if n < end:
                    right = self.stand(last[here, end - n - 1], token)
                    hit, here, token = hit[right], here[right], token[right]
                last[here, end - 1] = token
                open_ = np.delete(open_, hit)
        return last

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of at most ``WIDEST`` bytes, longest first."""
        if not pieces:
            return []
        last = self.last_tokens(pieces, len(pieces[0]))
        end = np.array([len(piece) for piece in pieces])
        out, counts, all_rows = [], np.zeros(len(pieces), dtype=np.int64), np.arange(len(pieces))
        while True:
            rows = all_rows[end > 0]
            if not len(rows):
                break
            token = last[rows, end[rows] - 1]
            column = np.zeros(len(pieces), dtype=np.int32)
            column[rows] = token
            out.append(column)
            counts[rows] += 1
            end[rows] -= self.length[token]
        backward = np.stack(out, axis=1)
        return [row[:n][::-1].tobytes() for row, n in zip(backward, counts.tolist())]


class Encoder:
    """Encodes whole texts, remembering units of them.

    A unit is a stretch of text that the pattern cuts the same whatever stands around it. Units not
    met before are cut into pieces, and the pieces of a batch are encoded together; a piece longer than
    ``WIDEST`` goes by itself. When the memory is full, what was not asked for since it last was
    is forgotten. Long units are rare and large and are not kept.
    """

    def __init__(
        self, vocabulary: Vocabulary, tables: Tables, pattern: str, units: str | None = None, whole: str | None = None
    ):
        self.vocabulary, self.tables, self.cut = vocabulary, tables, regex.compile(pattern).findall
        self.is_piece = re.compile(whole).fullmatch if whole else lambda unit: None
        self.parts = re.compile(units).findall if units else lambda text: [text]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.parts(text) for text in texts]
        units = set().union(*split)
        self._learn(units - self.recent.keys())
        coded = [np.frombuffer(b"".join(map(self.recent.__getitem__, own)), dtype=np.int32) for own in split]
        for unit in [unit for unit in units if len(unit) > LONG]:
            del self.recent[unit]
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        return coded

    def _learn(self, missing: set[str]) -> None:
        """Packed ids of units that were not asked for lately."""
        older = missing & self.older.keys()
        self.recent |= {unit: self.older[unit] for unit in older}
        pieces = [(unit, [unit] if self.is_piece(unit) else self.cut(unit)) for unit in missing - older]
        coded = self._pieces(list(set().union(*[own for _, own in pieces])))
        self.recent |= {unit: b"".join(map(coded.__getitem__, own)) for unit, own in pieces}

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        ranks = self.vocabulary.ranks
        out, short = {}, []
        for piece in pieces:
            plain = piece.encode()
            whole = ranks.get(plain)
            if whole is not None:
                out[piece] = array("i", [whole]).tobytes()
            elif len(plain) <= WIDEST:
                short.append((plain, piece))
            else:
                out[piece] = array("i", encode_piece(self.vocabulary, plain)).tobytes()
        short.sort(key=lambda both: -len(both[0]))
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            out |= zip([piece for _, piece in some], self.tables.encode([plain for plain, _ in some]))
        return out


def encode(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", units: str | None = None,
    whole: str | None = None,
) -> Column:
    """Token ids of a text column of the frame, every match of the pattern by itself.

    ``units`` may name an expression whose matches make up the text and which the pattern never
    goes across nor looks beyond; most texts then consist of units met before. ``whole`` may
    name units that are a single match of the pattern, which spares the look.
    """
    sent = _sent(df, (ranks, Tables(Vocabulary(ranks)).packed()))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks, tables = sent.value
        encoder = Encoder(Vocabulary(ranks), Tables.unpacked(tables), pattern, units, whole)
        for batch in batches:
            # A few texts at a time: what is held beside them stays small.
            parts = [_lists(encoder([])), *(
                _lists(encoder([one or "" for one in batch.slice(at, TEXTS).to_pylist()])) for at in range(0, len(batch), TEXTS)
            )]
            yield pa.concat_arrays(parts)

    return ids(F.col(text))


def _lists(coded: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *coded])))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> Column:
    """Bytes of a column of token ids; none for null."""
    sent = _sent(df, ranks)

    @F.arrow_udf(T.BinaryType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = by_rank(sent.value)
        for batch in batches:
            yield pa.concat_arrays([joined(tokens, batch.slice(0, 0)), *(
                joined(tokens, batch.slice(at, TEXTS)) for at in range(0, len(batch), TEXTS)
            )])

    return text(F.col(ids))


def by_rank(ranks: dict[bytes, int]) -> pa.BinaryArray:
    """The bytes of every token at the place of its id; ids without one are null."""
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.binary())


def joined(tokens: pa.BinaryArray, ids: pa.ListArray) -> pa.BinaryArray:
    """The tokens of each row in one; they stand in a row already where they are taken."""
    flat = tokens.take(ids.flatten())
    if flat.null_count:
        raise ValueError("an id without a token")
    sizes = pc.coalesce(pc.list_value_length(ids), 0).to_numpy()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    data = flat.buffers()[2] if len(flat) else pa.py_buffer(b"")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(starts[bounds].astype(np.int32)), data])


def _sent(df: DataFrame, known):
    """A vocabulary on its way to the tasks; it is bounded by its file."""
    return df.sparkSession.sparkContext.broadcast(known)
