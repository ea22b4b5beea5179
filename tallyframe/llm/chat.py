"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, whose context is all turns
before it and whose reply alone is trainable.

A turn is written ``### role: text</turn>`` and a line feed. Control strings inside roles and texts are broken up by
backslashes (``##`` to ``#\\#``, ``</turn>`` to ``<\\/turn>``, a backslash doubled, ``:`` in a role to ``\\:``), so ``##`` and
``</turn>`` stand in a formatted text only where the template put them, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import bound_batches, rows


@dataclass(frozen=True)
class ChatParams:
    trained_role: str = "assistant"
    batch_chars: int = 1 << 20  # examples travel in batches of about so many characters; a longer one travels alone


BEGIN, MIDDLE, END = "### ", ": ", "</turn>\n"
_SECOND, _HEADER, _ESCAPED = re.compile("(?<=#)#"), re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S), re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>")
    return _SECOND.sub(r"\\#", text) if "##" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def opening(role: str) -> str:
    return BEGIN + escape(role).replace(":", "\\:") + MIDDLE


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; a text that the template did not make is an error."""
    at = 0
    while at < len(text):
        head = _HEADER.match(text, at)
        stop = text.find(END, head.end()) if head else -1
        if stop < 0:
            raise ValueError(f"no turn at character {at}")
        yield unescape(head[1]), unescape(text[head.end() : stop])
        at = stop + len(END)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text alone; null roles and texts are empty."""
    bound_batches(conversations.sparkSession)
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def expand(conversations: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text): conv_id, example (from 0), n_turns, the formatted text, and the
    span of its characters that is trained on (end exclusive): the last turn's text.

    Turns are ordered by turn (null first), then role and text. A conversation that does not end with an assistant's turn
    has one more row, of all its turns and with an empty span, so that no turn is lost. Rows without conv_id are one
    conversation. Null role or text: empty. Repeated rows are turns like others. Empty table: no rows. Examples of a
    conversation lie in one partition, together and in order. A conversation is streamed: a task holds one formatted text,
    which its last example holds anyhow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made, chars = _Conversation(None), [], 0

        def add(row: tuple) -> None:
            nonlocal chars
            made.append(row)
            chars += len(row[3])

        def drain() -> pa.RecordBatch:
            nonlocal made, chars
            out, made, chars = made, [], 0
            return rows(EXAMPLES, list(zip(*out)))

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if own.turns and conv_id != own.conv_id:
                    if own.open:
                        add(own.row(False))
                    own = _Conversation(None)
                own.conv_id = conv_id
                own.add(role, text)
                if role == params.trained_role:
                    add(own.row(True))
                if chars >= params.batch_chars:
                    yield drain()
        if own.turns and own.open:
            add(own.row(False))
        if made:
            yield drain()

    arranged = turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")
    return arranged.mapInArrow(task, "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long")


@dataclass
class _Conversation:
    """The formatted turns so far."""

    conv_id: int | None
    turns: int = 0
    examples: int = 0
    open: bool = False  # turns follow the last example
    parts: list[str] = field(default_factory=list)

    def add(self, role: str, text: str) -> None:
        self.parts += [opening(role), escape(text), END]
        self.turns, self.open = self.turns + 1, True

    def row(self, trained: bool) -> tuple:
        """The example that ends here; its last turn's text is trained on, or nothing."""
        own, text = len(self.parts[-2]) if trained else 0, "".join(self.parts)
        self.parts, self.open, self.examples = [text], False, self.examples + 1
        stop = len(text) - len(END) if trained else len(text)
        return self.conv_id, self.examples - 1, self.turns, text, stop - own, stop


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(examples: DataFrame, *, arranged: bool = False) -> DataFrame:
    """What the examples of each conversation say, parsed from their texts: turns and their digest from the longest, the
    trained texts and their digest from all, and the characters of all.

    ``arranged``: the examples come from ``expand`` as they are; else, as from a stored table, they are brought together.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            for conv_id, text, start, stop in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end"))):
                if now is not None and now[0] != conv_id:
                    done.append(_told(*now))
                    now = None
                if now is None:
                    now = [conv_id, "", hashlib.sha256(), 0, 0]
                trained = unescape(text[start:stop])
                now[1] = text
                now[2].update(trained.encode())
                now[3] += len(trained)
                now[4] += len(text)
            if done:
                yield rows(READ, list(zip(*done)))
                done = []
        if now is not None:
            yield rows(READ, list(zip(*[_told(*now)])))

    own = examples.select("conv_id", "example", "text", "loss_start", "loss_end")
    own = own if arranged else own.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return own.mapInArrow(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _told(conv_id: int | None, text: str, trained, chars: int, formatted: int) -> tuple:
    turns, n = hashlib.sha256(), 0
    for role, said in parse(text):
        turns.update(f"{role}\n{said}\n".encode())
        n += 1
    return conv_id, n, turns.hexdigest(), chars, trained.hexdigest(), formatted
