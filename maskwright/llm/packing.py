"""Best-fit decreasing packing of tokenised documents into windows."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices, stored

#: End of a document.
END = 1


#: Fixed value: how the byte-level tokenizer cuts a text before it merges.
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of(char: str) -> int:
    """The byte that a byte-level vocabulary writes as this character."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    code = ord(char)
    return code if code in shown else [b for b in range(256) if b not in shown][code - 256]


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, as the tokenizer file gives them.

    A word and the space before it are encoded alike wherever they stand between single white-space
    characters, so they are looked up. New words and texts with longer runs of white space are merged from
    the file's vocabulary, whose ids rank the merges; texts with a special token go to the tokenizer itself.
    At most `limit` words are remembered.
    """

    def __init__(self, path: str, limit: int = 500_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = {chr(c): byte_of(chr(c)) for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x144)]}
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        self.merge = tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.joins = re.compile(r"\s\s|^\s|\s$|^$")
        self.limit = limit
        self.known: dict[str, bytes | None] = {}

    def plain(self, text: str) -> bytes:
        return array("I", self.merge(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(rest).difference(known):
            known[w] = None if self.joins.search(w) else self.plain(" " + w)
        try:
            return self.plain(first) + b"".join(map(known.__getitem__, rest)) if not self.joins.search(first) else self.plain(text)
        except TypeError:  # a word next to more white space
            return self.plain(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, part long"


def pieces(documents: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """Cut each document (its ids, then the end id) into full windows and a rest: (doc_id, start, length, ids_crc32, doc_tokens, part)."""
    kind = dict(documents.dtypes)["doc_id"]
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start:4 * (start + window)]
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
            long = pa.int64()
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, long)), pa.array(starts, long), pa.array(lengths, long), pa.array(sums, long),
                 pa.array(totals, long), pa.array(np.full(len(rows), part))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"])

    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, {PIECES}")


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that says which capacities occur."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, window: int) -> None:
        if not self.stacks[capacity]:
            at = capacity + self.size
            while at and not self.tree[at]:
                self.tree[at] = 1
                at >>= 1
        self.stacks[capacity].append(window)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity of at least length: (capacity, window)."""
        tree, at = self.tree, length + self.size
        if not tree[at]:
            while at & 1 or not tree[at + 1]:  # up, until something to the right occurs
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.size
        window = self.stacks[capacity].pop()
        if not self.stacks[capacity]:
            while at:
                tree[at] = 0 if at >= self.size else tree[2 * at] | tree[2 * at + 1]
                if tree[at]:
                    break
                at >>= 1
        return capacity, window


def best_fit(lengths: Sequence[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) for each length, which must come in descending order and fit."""
    free, numbers, offsets, n = OpenWindows(window), [], [], 0
    for length in lengths:
        found = free.tightest(length) if length < window else None
        capacity, number = found or (window, n)
        n += found is None
        numbers.append(number)
        offsets.append(window - capacity)
        if capacity > length:
            free.put(capacity - length, number)
    return numbers, offsets


def pack(documents: DataFrame, tokenizer: str, window: int = 2048, pool: int = 8192) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens: one row per piece.

    Overlong documents are cut into full windows; what is left is packed best-fit decreasing. Pieces are
    dealt by hash, whatever their source, into pools of about `pool` pieces, which are packed apart, so a
    task holds one pool's lengths and the loss is under one window or so a pool. Returns doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id (unique, pool * 2^32 + number), offset. A null text counts as
    empty and has its end id alone; null ids and equal rows are packed like any others; no rows give none.
    """
    kind = dict(documents.dtypes)["doc_id"]
    cut = stored(pieces(documents, tokenizer, window))
    pools = slices(cut.count(), pool, least=1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            numbers, offsets = best_fit(rows["length"].to_pylist(), window)
            ids = rows["pool"].to_numpy() * (1 << 32) + np.array(numbers, np.int64)
            out = rows.drop_columns(["pool"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                numbers = batch.column(0).to_numpy(zero_copy_only=False)
                if held and held[0].column(0)[0].as_py() != numbers[0]:
                    yield packed()
                    held = []
                same = int(np.searchsorted(numbers, numbers[0], "right"))
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
        if held:
            yield packed()

    dealt = cut.select(
        F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "part", F.monotonically_increasing_id()), F.lit(pools)).alias("pool"),
        "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    sorted_ = dealt.repartition("pool").sortWithinPartitions(
        "pool", F.desc("length"), F.asc_nulls_last("doc_id"), "start", "ids_crc32")
    return sorted_.mapInArrow(
        fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
