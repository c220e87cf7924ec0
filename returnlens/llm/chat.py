"""Chat formatting with compiled templates.

Conversations (rows conv_id, turn, role, text) are put together by conv_id and
turn and rendered as a stream: a task holds one batch of rows and one chunk of
output, however long a conversation is.  The output has a row for each chunk of
a conversation: the text and the spans (in code points) a model learns.

``read_back`` parses such rows into turns and learned texts again, also as a
stream.  A conversation's digests run over its turns in order, so one task
reads a conversation; memory stays bounded.

Edge cases: a null text or role is empty; rows of one turn are ordered by role,
then text; a null conv_id is a conversation of its own; repeated rows are turns
each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import ESCAPE, Template

#: Marks turns by control strings; what belongs to other formats is escaped in texts as well.
TURNS = (
    "{% controls '<|turn|>' '<|text|>' '<|end|>' '<s>' '</s>' '[INST]' '[/INST]' '<<SYS>>' '<</SYS>>' '<|im_start|>' '<|im_end|>' %}"
    "{% for message in messages %}{{ '<|turn|>' + (message.role | escape) + '<|text|>' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '<|end|>' }}{% endfor %}")
TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
#: Characters of a chunk of output.
CHUNK = 1 << 18

FORMATTED = "conv_id bigint, chunk int, formatted string, learned array<struct<start:int,stop:int>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def format_chats(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, chunk, formatted, learned) of all conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "chunk", "formatted", "learned"]
            types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for conv, members in groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"role": r[2] or "", "text": r[3] or ""} for r in members)
            parts, spans, at, chunk = [], [], 0, 0
            for text, learned in compiled.pieces(messages):
                if learned and text:
                    spans.append({"start": at, "stop": at + len(text)})
                parts.append(text)
                at += len(text)
                if at >= CHUNK:
                    rows.append((conv, chunk, "".join(parts), spans))
                    parts, spans, at, chunk, size = [], [], 0, chunk + 1, size + at
                if size >= 8 * CHUNK:
                    yield batch()
                    rows, size = [], 0
            if parts or not chunk:
                rows.append((conv, chunk, "".join(parts), spans))
                size += at
            if size >= 8 * CHUNK or len(rows) >= 4096:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    Template(template)          # errors show here, not in tasks
    ordered = (turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.mapInArrow(run, FORMATTED)


class _Reader:
    """Digests of one conversation's formatted chunks."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""

    def read(self, text: str, spans: list[dict]) -> None:
        for s in spans or ():
            learned = Template.unescape(text[s["start"]:s["stop"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.chars += len(text)
        self.rest += text
        end = 0
        for m in TURN.finditer(self.rest):
            if m.start() != end:
                raise ValueError("text outside of turns")
            role, said = Template.unescape(m[1]), Template.unescape(m[2])
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
            end = m.end()
        self.rest = self.rest[end:]


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars) from rows of ``format_chats`` with the template TURNS."""
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        for conv, chunks in groupby(_rows(batches), key=lambda r: r[0]):
            reader = _Reader()
            for _, _, text, spans in chunks:
                reader.read(text, spans)
            if reader.rest:
                raise ValueError("an unfinished turn")
            out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(out) >= 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    return (formatted.select("conv_id", "chunk", "formatted", "learned").repartition("conv_id")
            .sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema))


def _escapes(column: str) -> str:
    """Characters that escaping adds to a column, in SQL."""
    marks = [*Template(TURNS).controls, ESCAPE]
    return " + ".join(f"(length({column}) - length(replace({column}, '{m}', ''))) // {len(m)}" for m in marks)


CHATS_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i))
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(length('<|turn|><|text|><|end|>') + length(role) + length(text) + {_escapes('role')} + {_escapes('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
