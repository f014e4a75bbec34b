"""Chats written by a compiled template, with the spans that a model learns to generate, and read back.

The template (see ``template``) is compiled once in each task and writes a conversation turn by turn. Turns are shuffled
once by conversation and sorted by turn; each task streams through them with the turn before, the turn and the one after,
so that neither a task nor the driver ever holds a conversation. The result is a row for each turn: its piece of the
formatted text, and the generated spans as code points of the whole text; the text is the pieces in order.

``read_back`` takes such pieces, from a table in any order, and tells roles and texts apart again by the control strings
and the escapes of the default template: digests are folded turn by turn, so memory is bounded there too.

Null roles and texts are written as empty ones. Turns of one conversation are ordered by turn, role and text, nulls first;
repeated turns and rows are turns like others. A null conv_id is a conversation. An empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.template import Controls, Piece, Template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
KNOWN = {"bos": "<s>", "eos": "</s>", "learnt": "assistant"}
SOURCE = """
{#- Turns as [ROLE]role[/ROLE] and what is said: closed by eos where it is to be learnt, in [INST] marks elsewhere. -#}
{%- for message in messages -%}
{{ bos if loop.first else '' }}[ROLE]{{ message.role | escape }}[/ROLE]
{%- if message.role == learnt -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}{{ eos }}
{%- else -%}
[INST]{{ message.text | escape }}[/INST]
{%- endif -%}
{%- endfor -%}
"""
#: What the default template writes for a turn.
TURN = re.compile(r"(?:<s>)?\[ROLE\](?P<role>.*?)\[/ROLE\](?:\[INST\](?P<said>.*?)\[/INST\]|(?P<learnt>.*?)</s>)", re.S)
PIECES = "conv_id long, at long, piece string, marks array<struct<start:long,end:long>>"
ROWS = 1_000


def _formatter(source: str, controls: tuple[str, ...], known: dict[str, object]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of conv_id, role, text -> pieces."""
        template = Template(source, controls, known)
        rows: list[tuple] = []
        scope, size, index, before, now, conv = {}, 0, 0, None, None, None

        def put(after: dict | None) -> None:
            """Write the turn at hand."""
            nonlocal scope, size, index, before
            out = Piece()
            if before is None:
                scope, size, index = dict(template.known), 0, 0
                template.begin(scope, out)
            template.turn(scope, now, before, after, index, out)
            if after is None:
                template.end(scope, out)
            rows.append((conv, index, "".join(out.parts), [{"start": a + size, "end": b + size} for a, b in out.marks]))
            size, index, before = size + out.size, index + 1, None if after is None else now

        schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("piece", pa.string()), ("marks", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for batch in batches:
            for i, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                turn = {"role": role or "", "text": text or ""}
                if now is not None:
                    put(turn if i == conv else None)
                now, conv = turn, i
            while len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[:ROWS]), schema)], schema=schema)
                del rows[:ROWS]
        if now is not None:
            put(None)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return write


def format_chats(turns: DataFrame, source: str = SOURCE, controls: tuple[str, ...] = CONTROLS, known: dict[str, object] | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text -> conv_id, at, piece, marks."""
    known = KNOWN if known is None else known
    Template(source, controls, known)  # a template with an error fails before any job
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatter(source, controls, known), PIECES)


class _Digest:
    """What one conversation's pieces hold, folded piece by piece."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.learnt, self.size = 0, 0, 0

    def add(self, piece: str, marks: list[dict]) -> None:
        at = 0
        while at < len(piece):
            m = TURN.match(piece, at)
            if not m:
                raise ValueError(f"no turn at {piece[at : at + 40]!r}")
            said = m["said"] if m["said"] is not None else m["learnt"]
            self.turns.update(f"{Controls.unescape(m['role'])}\n{Controls.unescape(said)}\n".encode())
            self.n, at = self.n + 1, m.end()
        for mark in marks:
            text = Controls.unescape(piece[mark["start"] - self.size : mark["end"] - self.size])
            self.loss.update(text.encode())
            self.learnt += len(text)
        self.size += len(piece)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, held, rows = None, None, []
    row = lambda: (conv, held.n, held.turns.hexdigest(), held.learnt, held.loss.hexdigest(), held.size)
    out = lambda: pa.RecordBatch.from_pydict(dict(zip(["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], map(list, zip(*rows)))), pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
    for batch in batches:
        for i, piece, marks in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or i != conv:
                if held is not None:
                    rows.append(row())
                conv, held = i, _Digest()
            held.add(piece, marks or [])
        if len(rows) >= ROWS:
            yield out()
            rows.clear()
    if held is not None:
        rows.append(row())
    if rows:
        yield out()


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from pieces of the default template."""
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "piece", "marks")
    return dealt.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
