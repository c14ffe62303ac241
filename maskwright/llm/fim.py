"""Fill-in-middle: each text's unit boundaries form a compressed set, and select gives the two places to cut."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from maskwright.session import with_once

#: Prefix, suffix and middle follow these.
SENTINELS = ("<P>", "<S>", "<M>")
SPAN = 1 << 16
WORDS = SPAN // 64


class BoundarySet:
    """Ascending, distinct offsets in containers of 65,536, each of the kind that takes the least room.

    array: the low 16 bits of each offset (2 bytes an offset); bitmap: 1,024 words of 64 bits with the number
    of bits set before each word; run: starts of runs of consecutive offsets with the number of
    offsets before each run. `before` has the number of offsets ahead of each container, so that select finds the
    container, then the place in it, by two binary searches, and nothing is unpacked.
    """

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(offsets) else np.zeros(0, np.int64)
        self.keys = high[first]
        self.before = np.concatenate([first, [len(offsets)]])
        cuts = self.before.tolist()
        self.containers = [self._container((offsets[a:b] & (SPAN - 1)).astype(np.int64)) for a, b in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _container(low: np.ndarray) -> tuple[str, np.ndarray, np.ndarray | None]:
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1] + 1]))
        if 4 * len(starts) < min(2 * len(low), 8 * WORDS):
            return "run", low[starts].astype(np.uint16), starts.astype(np.uint32)
        if 2 * len(low) <= 8 * WORDS:
            return "array", low.astype(np.uint16), None
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        ahead = np.concatenate([[0], np.cumsum(bits.reshape(WORDS, 64).sum(axis=1, dtype=np.int64))[:-1]])
        return "bitmap", np.packbits(bits, bitorder="little").view("<u8"), ahead.astype(np.uint32)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """The offset with `rank` offsets before it."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        kind, values, ahead = self.containers[at]
        rest = rank - int(self.before[at])
        if kind == "array":
            low = int(values[rest])
        elif kind == "run":
            run = int(np.searchsorted(ahead, rest, "right")) - 1
            low = int(values[run]) + rest - int(ahead[run])
        else:
            word = int(np.searchsorted(ahead, rest, "right")) - 1
            bits = np.unpackbits(values[word:word + 1].view(np.uint8), bitorder="little")
            low = 64 * word + int(np.flatnonzero(bits)[rest - int(ahead[word])])
        return (int(self.keys[at]) << 16) + low


def line_ends(text: str) -> np.ndarray:
    """Offsets in code points at which the lines of text end; a last line needs no line feed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    return ends if not len(points) or (len(ends) and ends[-1] == len(points)) else np.concatenate([ends, [len(points)]])


CUTS = StructType([StructField("n", LongType()), StructField("first", LongType()), StructField("second", LongType())])


def cut_offsets(text: Column, one: Column, other: Column, ends: Callable[[str], np.ndarray] = line_ends) -> Column:
    """Struct of the number of units n and the two offsets, in order, after `one` and `other` mod n + 1 units of text."""

    @F.pandas_udf(CUTS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ones, others in batches:
            rows = []
            for value, a, b in zip(texts, ones, others, strict=True):
                boundaries = BoundarySet(np.concatenate([[0], ends(value)]))
                n = len(boundaries) - 1
                a, b = sorted((int(a) % (n + 1), int(b) % (n + 1)))
                rows.append((n, boundaries.select(a), boundaries.select(b)))
            yield pd.DataFrame(rows, columns=["n", "first", "second"], dtype="int64")

    return cut(text, one, other)


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(documents: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, sentinels: Sequence[str] = SENTINELS,
                   ends: Callable[[str], np.ndarray] = line_ends) -> DataFrame:
    """Cut each whole text after two drawn numbers of units and put the middle last.

    Returns doc_id, n (units), form, prefix, middle, suffix and output. form is plain (output is the text, the three
    parts are null) for empty texts, texts that hold a sentinel, and those whose draw is at or over
    rate percent; of the rest spm percent are spm (suffix, prefix, middle), the others psm (prefix, suffix, middle). The
    draws depend on seed and doc_id alone: rows of one id are cut by the same draws, null ids as the id `-`. A null
    text counts as empty. Any part may be empty. A map: nothing is shuffled, repeated rows stay, other columns are
    not read, no rows give none.
    """
    for mark in sentinels:
        if not mark or any(mark != s and mark in s for s in sentinels) or len(set(sentinels)) < 3:
            raise ValueError("sentinels must be three different texts of which none holds another")
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_once(documents.select("doc_id", text.alias("text")), h1=h1, h2=h2, h3=h3, h4=h4)
    rows = rows.withColumn("cuts", cut_offsets(F.col("text"), F.col("h1"), F.col("h2"), ends))
    held = F.lit(False)
    for mark in sentinels:
        held = held | F.contains("text", F.lit(mark))
    form = (F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= rate), "plain")
            .when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    first, second = F.col("cuts.first").cast("int"), F.col("cuts.second").cast("int")
    cut = F.col("form") != "plain"
    rows = rows.withColumn("form", form).select(
        "doc_id", F.col("cuts.n").alias("n"), "form", "text", F.when(cut, F.substring("text", F.lit(1), first)).alias("prefix"),
        F.when(cut, F.substring("text", first + 1, second - first)).alias("middle"),
        F.when(cut, F.substring("text", second + 1, F.length("text"))).alias("suffix"))
    before, after, last = (F.lit(s) for s in sentinels)
    output = (F.when(F.col("form") == "psm", F.concat(before, "prefix", after, "suffix", last, "middle"))
              .when(F.col("form") == "spm", F.concat(after, "suffix", before, "prefix", last, "middle")).otherwise(F.col("text")))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that fill_in_middle cut, from its output and form alone."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "psm", F.concat(at(1), at(3), at(2)))
            .when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output))


def cut_documents(documents: DataFrame) -> DataFrame:
    """fill_in_middle as digests: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return fill_in_middle(documents).select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
