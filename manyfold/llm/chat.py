"""Conversations formatted by a compiled template, with the spans that a model is to learn.

Control strings inside texts are escaped so that they can't be taken for the template's own, and back without loss:
a backslash is doubled, and a control string becomes a backslash and its number. No control string ends as another
begins, so none can arise where a text meets the template.

Rows of a conversation are read in order of turn (null first; equal turns by role, then text), one at a time, and
what they render to leaves in parts of about PART characters, so that a conversation of any length passes through a
task. Parts end between the template's pieces, never inside a learned one.

Defined results: null text and role count as empty; null ids make one conversation of id null; repeated rows are
turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import template

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = [TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>"]
DEFAULT = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + TEXT + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END + "{% endfor %}"
)
PART = 1 << 18
_ESCAPE = re.compile("|".join(re.escape(c) for c in ["\\", *CONTROLS]))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_NUMBER = {c: "\\" + str(i) for i, c in enumerate(CONTROLS)} | {"\\": "\\\\"}
_BACK = {str(i): c for i, c in enumerate(CONTROLS)} | {"\\": "\\"}


def escape(text: str | None) -> str:
    return _ESCAPE.sub(lambda m: _NUMBER[m[0]], text or "")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(first column, iterator of the rows with it) for rows that are sorted by it; rows aren't kept."""
    rows = (row for batch in batches for at in range(0, len(batch), 512) for row in zip(*[c.slice(at, 512).to_pylist() for c in batch.columns]))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def one() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                row = ahead
                ahead = next(rows, None)
                yield row

        yield key, one()


def formatted(conversations: DataFrame, source: str = DEFAULT) -> DataFrame:
    """conv_id, part (from 0), start (code points before it), text, spans (start and end of each learned span, in
    code points of the whole conversation)."""
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    template.parse(source, {"escape": escape})  # a wrong template fails here, not in a task
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = template.compiled(source, {"escape": escape})

        def parts() -> Iterator[tuple]:
            for conv_id, turns in _runs(batches):
                part, at, start, held, spans, was = 0, 0, 0, [], [], False
                for text, marked in render(messages=({"role": r or "", "text": t or "", "turn": k} for _, k, r, t in turns)):
                    if at - start >= PART and not (marked and was):
                        yield conv_id, part, start, "".join(held), spans
                        part, start, held, spans = part + 1, at, [], []
                    if marked and text:
                        if was and spans:
                            spans[-1]["end"] = at + len(text)
                        else:
                            spans.append({"start": at, "end": at + len(text)})
                    was = marked
                    held.append(text)
                    at += len(text)
                yield conv_id, part, start, "".join(held), spans

        held: list[tuple] = []
        size = 0
        for row in parts():
            held.append(row)
            size += len(row[3])
            if size > 4 * PART:
                yield _batch(held, span)
                held, size = [], 0
        if held:
            yield _batch(held, span)

    return rows.mapInArrow(run, "conv_id long, part int, start long, text string, spans array<struct<start:long,end:long>>")


def _batch(rows: list[tuple], span: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(span))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "part", "start", "text", "spans"])


def read_back(parts: DataFrame) -> DataFrame:
    """What the output of `formatted` by DEFAULT says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Turns are found by the control strings, learned text by the spans."""
    rows = parts.select("conv_id", "part", "start", "text", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv_id, own in _runs(batches):
            turns, loss, n, chars, learned, left = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for _, _, start, text, spans in own:
                chars += len(text)
                for s in spans:
                    plain = unescape(text[s["start"] - start : s["end"] - start])
                    learned += len(plain)
                    loss.update(plain.encode())
                *whole, left = (left + text).split(END)
                for turn in whole:
                    role, _, said = turn.removeprefix(TURN).partition(TEXT)
                    turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                    n += 1
            out.append((conv_id, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
