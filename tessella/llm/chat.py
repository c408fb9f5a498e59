"""Conversations as training text, with marks of what a model is to learn.

Rows of a conversation are brought together, sorted and streamed through a compiled template
(``templates``); a task keeps one message and one part of the formatted text, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.templates import BEGIN, END, compile_template, unescape, unheader

#: Turns between marks; control strings inside texts are escaped, and what assistants say is generated.
CHAT = (
    "{% for m in messages %}<|im_start|>{{ m.role | header }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Characters after which a part of a formatted conversation ends, at the next place outside a generated part.
PART_CHARS = 1_000_000
_PART = "part int, text string, generated array<struct<start:int,stop:int>>"
_NOTHING = object()


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """The id and the rows of each run of equal ids; rows that the caller leaves unread are skipped."""
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    held = next(rows, _NOTHING)

    def run(key: Any) -> Iterator[tuple]:
        nonlocal held
        while held is not _NOTHING and held[0] == key:
            row, held = held, _NOTHING
            yield row
            held = next(rows, _NOTHING)

    while held is not _NOTHING:
        key = held[0]
        mine = run(key)
        yield key, mine
        for _ in mine:
            pass


def _parts(pieces: Iterable, part_chars: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The text of pieces in parts, with the spans between marks; a span is never cut."""
    text, spans, size, began = [], [], 0, None
    for piece in pieces:
        if piece is BEGIN:
            began = size
        elif piece is END:
            spans.append((began, size))
            began = None
        else:
            text.append(piece)
            size += len(piece)
        if size >= part_chars and began is None:
            yield "".join(text), spans
            text, spans, size = [], [], 0
    if text or spans:
        yield "".join(text), spans


def _emit(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int], limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 100
        if total >= limit:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def format_conversations(
    rows: DataFrame, template: str = CHAT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART_CHARS, **settings: Any
) -> DataFrame:
    """``(id, part, text, generated)``: formatted conversations, with the spans (code points of ``text``) of generated parts.

    A conversation is the rows of an id in the order of their turn, a null turn first; equal turns are ordered by role
    and text, and a repeated row is a turn each time.  Rows with a null id are one conversation.  A null role or text is
    empty.  Other columns are left alone, whatever their names; an empty table gives an empty one.  ``settings`` are constants of the template.

    A conversation longer than ``part_chars`` comes in several rows (``part`` from 0), cut where nothing generated is cut.
    A task's rows come by id and part.  Rows of an id are streamed through one task, in order, because a
    template may look at the loop's counters; what the task keeps does not grow with them, and the sort before it spills.
    """
    compile_template(template, **settings)  # an error of the template is the caller's
    kind = rows.schema[id_col].dataType.simpleString()
    told = rows.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, **settings)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("id", first.schema.field(0).type), ("part", pa.int32()), ("text", pa.string()), ("generated", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])

        def formatted() -> Iterator[tuple]:
            for key, mine in _conversations(_chain(first, batches)):
                messages = ({"role": r, "text": t} for _, r, t in mine)
                for part, (text, spans) in enumerate(_parts(render(messages), part_chars)):
                    yield key, part, text, [{"start": a, "stop": b} for a, b in spans]

        yield from _emit(formatted(), schema, lambda r: len(r[2]) + 60 * len(r[3]))

    arranged = told.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")
    return arranged.select("id", "role", "text").mapInArrow(run, f"id {kind}, {_PART}").withColumnRenamed("id", id_col)


def _chain(first: pa.RecordBatch, rest: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class Reader:
    """Reads the parts of one formatted conversation back: its turns and its generated text, as counts and digests."""

    def __init__(self) -> None:
        self.turns, self.chars, self.learned = 0, 0, 0
        self._turns, self._learned = hashlib.sha256(), hashlib.sha256()
        self._rest: list[str] = []

    def add(self, text: str, spans: Iterable[tuple[int, int]]) -> None:
        self.chars += len(text)
        for a, b in spans:
            said = unescape(text[a:b])
            self.learned += len(said)
            self._learned.update(said.encode())
        text = "".join([*self._rest, text])
        at = 0
        while (stop := text.find(STOP, at)) >= 0:
            head = text.find("\n", at)
            if not text.startswith(START, at) or head > stop:
                raise ValueError("a turn does not begin with its mark and role")
            role, said = unheader(text[at + len(START) : head]), unescape(text[head + 1 : stop])
            self._turns.update(f"{role}\n{said}\n".encode())
            self.turns += 1
            at = stop + len(STOP)
        self._rest = [text[at:]] if at < len(text) else []

    def result(self) -> tuple[int, str, int, str, int]:
        if self._rest:
            raise ValueError("a turn does not end")
        return self.turns, self._turns.hexdigest(), self.learned, self._learned.hexdigest(), self.chars


def read_back(formatted: DataFrame, id_col: str = "conv_id", arranged: bool = False) -> DataFrame:
    """``(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of conversations formatted by ``CHAT``.

    ``turns_sha256`` is of role, newline, text, newline a turn; ``loss_sha256`` of all generated text.  A turn and a
    part are held at a time.  ``arranged`` says that the rows come as ``format_conversations`` gives them.  Text that is not of that format raises.
    """
    if not arranged:
        formatted = formatted.repartition(id_col).sortWithinPartitions(id_col, "part")
    kind = formatted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("id", first.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def read() -> Iterator[tuple]:
            for key, mine in _conversations(_chain(first, batches)):
                reader = Reader()
                for _, text, spans in mine:
                    reader.add(text, [(s["start"], s["stop"]) for s in spans])
                yield key, *reader.result()

        yield from _emit(read(), schema, lambda r: 200)

    columns = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select(F.col(id_col).alias("id"), "text", "generated").mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
