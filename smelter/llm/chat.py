"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the text of all turns up to it, and a
span that covers that reply alone. Turns after the last reply (or a conversation without a
reply) give one closing row without a span, so the rows hold every turn.

Defined cases: null role or text is empty; rows of the same conversation and turn are
ordered by role, then text; null is a conversation of its own; an empty text still makes
a turn, and an empty reply an empty span; an empty table gives no rows; other columns play
no part. A row of the last reply holds its conversation whole, so a task needs room for one
conversation at a time, as whoever trains on that row does; rows are made as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long"
READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")
#: Characters of examples handed over at once.
BATCH_CHARS = 8_000_000


class Template(NamedTuple):
    """Marks around a turn: ``<s>[INST] role [/INST] text</s>``.

    Inside roles and texts a backslash is doubled and one is put after the first character
    of every mark, so that marks stand in the output only where a turn begins or ends.
    """

    opening: str = "<s>[INST] "
    after_role: str = " [/INST] "
    closing: str = "</s>"
    marks: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    trainable: str = "assistant"

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for mark in self.marks:
            if mark in text:
                text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """A formatted turn, and where its text begins and ends in it."""
        head = f"{self.opening}{self.escape(role)}{self.after_role}"
        body = self.escape(text)
        return f"{head}{body}{self.closing}", len(head), len(head) + len(body)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """Role and text of every turn, read back."""
        found = []
        for piece in formatted.split(self.closing)[:-1]:
            role, text = piece.removeprefix(self.opening).split(self.after_role, 1)
            found.append((self.unescape(role), self.unescape(text)))
        return found


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _number(value) -> int | None:
    return None if value is None or value is pd.NA or value != value else int(value)


def expand(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Examples of all conversations; those of one conversation follow each other in order."""

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, chars = [], 0
        current, prefix, length, count, made, closed = None, [], 0, 0, 0, True

        def tail():
            return (current[0], made, count, "".join(prefix), None, None)

        for batch in batches:
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                key = (_number(conv),)
                if key != current:
                    if current is not None and not closed:
                        rows.append(tail())
                        chars += length
                    current, prefix, length, count, made = key, [], 0, 0, 0
                formatted, begin, end = template.turn(_text(role), _text(text))
                prefix.append(formatted)
                count += 1
                closed = role == template.trainable
                if closed:
                    prefix = ["".join(prefix)]
                    rows.append((key[0], made, count, prefix[0], length + begin, length + end))
                    made += 1
                    chars += len(prefix[0])
                length += len(formatted)
                if chars > BATCH_CHARS:
                    yield _examples(rows)
                    rows, chars = [], 0
        if current is not None and not closed:
            rows.append(tail())
        if rows:
            yield _examples(rows)

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInPandas(examples, EXAMPLES)


def _examples(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "example", "n_turns", "text", "loss_start", "loss_end"])
    return frame.astype({c: "Int64" for c in ("conv_id", "example", "n_turns", "loss_start", "loss_end")})


def read_back(examples: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation, from the formatted text and the spans alone.

    Takes the rows in the order :func:`expand` gives them, without moving them again.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, loss, chars = None, "", [], 0

        def digest():
            turns, sha = template.turns(last), hashlib.sha256()
            for role, text in turns:
                sha.update(f"{role}\n{text}\n".encode())
            trained = "".join(loss)
            return (current[0], len(turns), sha.hexdigest(), len(trained),
                    hashlib.sha256(trained.encode()).hexdigest(), chars)

        for batch in batches:
            rows = []
            for conv, text, begin, end in zip(batch["conv_id"], batch["text"], batch["loss_start"], batch["loss_end"]):
                key = (_number(conv),)
                if key != current:
                    if current is not None:
                        rows.append(digest())
                    current, loss, chars = key, [], 0
                last = text
                chars += len(text)
                if (begin := _number(begin)) is not None:
                    loss.append(template.unescape(text[begin:_number(end)]))
            yield _digests(rows)
        if current is not None:
            yield _digests([digest()])

    return examples.mapInPandas(digests, READ_BACK)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in READ_BACK.split(", ")])
    return frame.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64",
                         "turns_sha256": "object", "loss_sha256": "object"})
