"""Offsets of pattern matches: Spark marks the matches in the text, a task counts the characters before the marks.

The patterns run in Spark's own generated code; what travels to Python (Arrow) are marked texts, and what
comes back are places, worked out for all rows of a part at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from maskwright.functions.arrays import sql_string

OPEN, CLOSE = "\x01", "\x02"
#: Stands before each copy where a text has several.
COPY = "\x04"
#: Bytes of marked text that are worked on at once.
PART = 4 << 20


def safe_sql(text: str) -> str:
    """The text without marks of its own; those become another control character, which all patterns treat alike."""
    own = " or ".join(f"contains({text}, '{sign}')" for sign in (OPEN, CLOSE, COPY))
    return f"case when {own} then translate({text}, '{OPEN}{CLOSE}{COPY}', '\x03\x03\x03') else {text} end"


def marked_sql(text: str, pattern: str) -> str:
    """The text with every match of a pattern, which matches no empty text, between marks."""
    return f"regexp_replace({safe_sql(text)}, {sql_string(pattern)}, '{OPEN}$0{CLOSE}')"


@dataclass(frozen=True)
class _Marks:
    """Places in characters from the start of the part: matches' starts and ends, and each row's start (and the last's end)."""

    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray
    offsets: np.ndarray  # of each row's matches
    copies: np.ndarray  # which of its row's copies, from 0, a match is in


def _marks(marked: pa.Array) -> _Marks:
    large = marked.cast(pa.large_string())
    edges = np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + len(large) + 1]
    data = large.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    opening, closing = np.flatnonzero(raw == ord(OPEN)), np.flatnonzero(raw == ord(CLOSE))
    counted = (raw & 0xC0) != 0x80  # the first byte of a character
    copies = np.flatnonzero(raw == ord(COPY))
    counted[opening] = counted[closing] = counted[copies] = False
    seen = np.concatenate([[0], np.cumsum(counted)])
    offsets, first = np.searchsorted(opening, edges), np.searchsorted(copies, edges[:-1])
    return _Marks(seen[opening], seen[closing], seen[edges], offsets, np.searchsorted(copies, opening) - np.repeat(first, np.diff(offsets)) - 1)


def lists(offsets: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    missing = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=missing)


def _wrapped(found: _Marks, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of matches in a text of this length of which a row holds any number of copies."""
    row = np.repeat(np.arange(len(lengths)), np.diff(found.offsets))
    length, base = lengths[row], found.before[row]
    return row, (found.starts - base) % length, (found.ends - base - 1) % length + 1


def in_parts(kernel: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """The kernel's result, worked out over rows that hold about PART bytes at a time."""
    size = sum(c.nbytes for c in columns)
    if size <= PART or len(columns[0]) < 2:
        return kernel(*columns)
    half = len(columns[0]) // 2
    return pa.concat_arrays([in_parts(kernel, *[c.slice(*at) for c in columns]) for at in ((0, half), (half, len(columns[0]) - half))])


def _span_lists(marked: pa.Array, lengths: pa.Array) -> pa.Array:
    found = _marks(marked)
    _, start, end = _wrapped(found, lengths.fill_null(0).to_numpy(zero_copy_only=False))
    return lists(found.offsets, pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int32)) for x in (start, end, found.copies)], ["start", "end", "copy"]), marked)


def _label_lists(words: pa.Array, matches: pa.Array) -> pa.Array:
    word, match = _marks(words), _marks(matches)
    row, start, end = _wrapped(match, np.diff(word.before))
    base = word.before[row]
    # words lie in order, so those that share a character with a match are a run of them
    first, last = np.searchsorted(word.ends, start + base, "right"), np.searchsorted(word.starts, end + base, "left")
    size = len(word.starts) + 1
    open_matches = np.cumsum(np.bincount(first, minlength=size) - np.bincount(last, minlength=size))[:-1]
    return lists(word.offsets, pa.array((open_matches > 0).astype(np.int32)), words)


@F.arrow_udf(ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("copy", IntegerType())))
def _spans(marked: pa.Array, lengths: pa.Array) -> pa.Array:
    return in_parts(_span_lists, marked, lengths)


@F.arrow_udf(ArrayType(IntegerType()))
def _labels(words: pa.Array, matches: pa.Array) -> pa.Array:
    return in_parts(_label_lists, words, matches)


def spans(marked: str, text: str) -> Column:
    """Half-open character offsets of the marked matches, in order, and the copy each is in, if ``marked`` holds several copies of the text."""
    return _spans(F.expr(marked), F.length(F.expr(text)))


def labels(words: str, matches: str) -> Column:
    """1 for every marked word that shares a character with a match in one of the marked copies, else 0."""
    return _labels(F.expr(words), F.expr(matches))
