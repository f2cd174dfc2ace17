"""Several values packed in one field: a quote-aware finite-state tokenizer.

The tokenizer walks once over the signs that mean something (separators, quotes, escapes, brackets)
and is in one of four states: before a value, in a plain value, in a quoted one, behind a closing
quote. Nesting is known beforehand: one walk with a stack gives every bracket its partner, and those
without one are ordinary characters. A quote that turns out not to close a value is an ordinary
character too; the walk then goes on from it as from a plain value's beginning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = "\t\n/|;／｜‖¦"
QUOTES = "\"'"
OPENING, CLOSING = "（(〔【", "）)〕】"
ESCAPE = "\\"

_BEFORE, _PLAIN, _QUOTED, _BEHIND = range(4)
_SIGN = re.compile(f"\r\n|{re.escape(ESCAPE)}[{QUOTES}]|\"\"|''|[{re.escape(SEPARATORS + QUOTES + OPENING)}]")
_ROUND = re.compile(f"[{re.escape(OPENING + CLOSING)}]")


def _notes(text: str) -> dict[int, int]:
    """Where each bracketed note ends, by the place where it opens; brackets of any shape close each other."""
    ends, stack = {}, []
    for m in _ROUND.finditer(text):
        if m[0] in OPENING:
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    return ends


def tokenize(text: str) -> list[str]:
    """All places of an element in order, empty ones included; quotes and notes protect separators."""
    notes = _notes(text)
    places: list[str] = []
    state, begin, quote, opened, value = _BEFORE, 0, "", 0, []
    at = seen = 0  # where to look for the next sign; where the current stretch of characters began
    while True:
        m = _SIGN.search(text, at)
        sign, start, end = (m[0], m.start(), m.end()) if m else (None, len(text), len(text))
        separator = sign is None or sign == "\r\n" or sign in SEPARATORS
        if state == _BEFORE:
            if not separator and text[start] in QUOTES and not text[begin:start].strip():
                state, quote, opened, value = _QUOTED, text[start], start, []
                at = seen = start + 1  # the second of two quotes may close an empty value
                continue
            state = _PLAIN
        if state == _PLAIN:
            if separator:
                places.append(text[begin:start].strip())
            else:
                at = notes.get(start, start + 1)
                continue
        elif state == _QUOTED:
            if sign is None:
                state, at = _PLAIN, opened + 1
                continue
            if sign == quote:
                value.append(text[seen:start])
                state, at, seen = _BEHIND, end, end
            elif sign == quote * 2 or sign[0] == ESCAPE:
                value.append(text[seen:start] + sign[1])
                at = seen = end
            else:
                at = start + 1 if sign[0] in QUOTES else end
            continue
        elif state == _BEHIND:
            if not separator or text[seen:start].strip():
                state, at = _PLAIN, opened + 1
                continue
            places.append("".join(value).strip())
        if sign is None:
            return places
        state, begin, at = _BEFORE, end, end


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rec, elem, at, value = [], [], [], []
        for r, e, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            places = tokenize(text)
            if sum(map(bool, places)) > 1:
                for k, v in enumerate(places):
                    if v:
                        rec.append(r)
                        elem.append(e)
                        at.append(k)
                        value.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(elem, pa.int64()), pa.array(at, pa.int64()), pa.array(value, pa.string())], names=["rec_id", "elem_pos", "value_pos", "value"])


def split_values(df: DataFrame) -> DataFrame:
    """rec_id, elem_pos, value_pos, value of every element that packs at least two values.

    Null and empty elements keep their position but hold no value; an empty place between two
    separators takes a position and isn't returned. A quote that isn't closed before a separator or
    the end, and a bracket that isn't closed, are ordinary characters. Repeated rows of a record
    count once; rows with a null rec_id or null paragraphs are left out; other columns are ignored.
    Elements without any separator are dropped before Python sees them.
    """
    elements = df.where("rec_id is not null").select("rec_id", F.posexplode("paragraphs").alias("elem_pos", "element"))
    elements = elements.where(F.col("element").rlike(f"[{re.escape(SEPARATORS)}]")).dropDuplicates(["rec_id", "elem_pos"])
    return elements.select("rec_id", F.col("elem_pos").cast("long"), "element").mapInArrow(_split, "rec_id long, elem_pos long, value_pos long, value string")
