"""Statistics of one text, on the executors: repetition, symbols, case, and marked words."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>-_"
# Words without a small letter; each is read twice at most, however long it is.
_NO_SMALL = re.compile(r"(?<!\S)[^\sa-zß-öø-ÿ]+(?!\S)")
_TWO_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2}")

#: Text statistics that rules and the classifier may ask about, as shares where a share makes sense.
STATISTICS = (
    "n_words", "mean_word", "symbols", "pipes", "exclamations", "upper_words", "dup_lines",
    "repeat_words", "twin_words", "distinct_words", "marked",
)


def split_words(text: str) -> list[str]:
    """Words between ASCII white space (bytes split there and nowhere else)."""
    return [w.decode() for w in text.encode("utf-8", "surrogatepass").split()] if not text.isascii() else text.translate(_SEPARATORS).split()


# str.split also splits at 0x1C to 0x1F, which belong to words here.
_SEPARATORS = {c: chr(0xE000 + c) for c in range(0x1C, 0x20)}


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeated(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def dup_lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return again


def upper_words(text: str) -> int:
    """Words with two capitals in a row and no small letter."""
    return sum(1 for word in _NO_SMALL.findall(text) if _TWO_CAPITALS.search(word))


def base_of(text: str, words: list[str]) -> Base:
    return Base(
        len(words), sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)),
        dup_lines(text), repeated(words),
    )


def statistics(text: str, words: list[str], base: Base, marked: float) -> tuple[float, ...]:
    """Values of STATISTICS; ``marked`` is the strongest evidence of a marked word."""
    n = max(len(words), 1)
    return (
        float(len(words)), base.word_chars / n, base.n_symbols / n, text.count("|") / n, text.count("!") / n,
        upper_words(text) / n, base.n_dup_lines / max(text.count("\n") + 1, 1),
        base.n_repeat_words / n, sum(map(str.__eq__, words, words[1:])) / n, len(set(words)) / n, marked,
    )


def lexical_features(word: str) -> list[str]:
    """The word without marks at its edges, in lower case, and its beginnings of 4 to 6 letters."""
    word = word.strip(_EDGE).lower()
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n)] if word else []
