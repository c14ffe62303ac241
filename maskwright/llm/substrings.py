"""Substring deduplication: Rabin-Karp hashes of all word windows are counted, repeated windows merge into intervals."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import repeat_rows, slices, stored

WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Places hashed at a time.
STRIDE = 1 << 16
TIE = 17


def words_of(data: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about `piece` bytes."""
    start = 0
    while len(data) - start > piece:
        found = WHITE.search(data, start + piece)
        if not found:
            break
        yield data[start:found.start()].split()
        start = found.end()
    yield data[start:].split()


def word_hashes(data: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word: an array of shape (words, 2)."""
    digest = xxhash.xxh3_128_digest
    return np.concatenate([np.frombuffer(b"".join([digest(w) for w in words]), "<u8").reshape(-1, 2) for words in words_of(data)])


def _powers(base: int, length: int) -> np.ndarray:
    steps = np.full(length, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class RollingHash:
    """Polynomial hash modulo 2^64 of every window of `window` values: the sum of value * base^place over the window.

    Prefix sums weighted by powers of the base roll it on: a window's is the difference of two, divided by the power
    of its first place (an odd base has an inverse).
    """

    def __init__(self, base: int, window: int):
        self.window = window
        self.powers = _powers(base, STRIDE + window)
        self.inverse = _powers(pow(base, -1, 1 << 64), STRIDE)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        k, n = self.window, len(values) - self.window + 1
        out = np.zeros(max(n, 0), np.uint64)
        for start in range(0, n, STRIDE):
            stop = min(start + STRIDE, n)
            part = values[start:stop + k - 1]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * self.powers[:len(part)], dtype=np.uint64)])
            out[start:stop] = (sums[k:] - sums[:-k]) * self.inverse[:stop - start]
        return out


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest unsigned type that holds them all, after a byte with its width."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: memoryview, count: int, at: int) -> tuple[np.ndarray, int]:
    width = data[at]
    stop = at + 1 + width * count
    return np.frombuffer(data[at + 1:stop], f"<u{width}").astype(np.int64), stop


def pack_places(ids: np.ndarray, ties: np.ndarray | None, counts: np.ndarray, places: np.ndarray) -> bytes:
    """Places in documents: `counts` of them, ascending, for each of the documents, which come in ascending order.

    Ids and places are kept as differences in the narrowest type; a difference of 255 or more is written aside.
    """
    start = np.zeros(len(places), bool)
    start[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    steps = np.where(start, places, np.diff(places, prepend=0))
    wide = np.flatnonzero(steps >= 255)
    short = steps.astype(np.uint8)
    short[wide] = 255
    gaps = np.diff(ids.view(np.uint64), prepend=ids[:1].view(np.uint64)).view(np.int64)
    head = np.array([len(ids), len(places), len(wide), ties is not None, ids[0]], "<i8").tobytes()
    return b"".join([head, _narrow(gaps.view(np.uint64)), _narrow(counts), short.tobytes(), _narrow(steps[wide]),
                     b"".join(t.ljust(TIE, b"\0") for t in ties.tolist()) if ties is not None else b""])


def unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    n, total, wides, tied, first = np.frombuffer(data, "<i8", 5).tolist()
    view, at = memoryview(data), 40
    gaps, at = _wide(view, n, at)
    counts, at = _wide(view, n, at)
    steps = np.frombuffer(view[at:at + total], np.uint8).astype(np.int64)
    more, at = _wide(view, wides, at + total)
    steps[steps == 255] = more
    ids = (np.uint64(first & (2**64 - 1)) + np.cumsum(gaps.view(np.uint64), dtype=np.uint64)).view(np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    sums = np.cumsum(steps)
    places = sums - np.repeat(sums[begins] - steps[begins], counts)
    ties = np.frombuffer(view[at:at + TIE * n], f"S{TIE}") if tied else None
    return ids, ties, counts, places


def _fresh(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Whether each row is of another document than the row before."""
    out = np.ones(len(ids), bool)
    out[1:] = (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])
    return out


def _repeats(hashes: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices in runs of equal hashes of two or more, number of each one's run)."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if more is not None and (same & (more[order[1:]] != more[order[:-1]])).any():
        order = np.lexsort((more, hashes))
        same = (hashes[order[1:]] == hashes[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
    run = np.concatenate([[0], np.cumsum(~same)])
    member = np.zeros(len(order), bool)
    member[1:] |= same
    member[:-1] |= same
    return order[member], run[member]


def _blobs(ids: np.ndarray, ties: np.ndarray, places: np.ndarray, bucket: np.ndarray, hashes: np.ndarray | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, packed places, hashes) for each bucket of rows that ascend by document and place."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
    tied = bool((ties != b"").any())
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        at = order[a:b]
        first = np.flatnonzero(_fresh(ids[at], ties[at]))
        counts = np.diff(first, append=b - a)
        data = pack_places(ids[at][first], ties[at][first] if tied else None, counts, places[at])
        yield int(bucket[at[0]]), data, b"" if hashes is None else hashes[at].astype("<u8").tobytes()


BLOB = "bucket int, kind int, places binary, hashes binary"


def _table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "places", "hashes"])


def _slice_of(ids: np.ndarray, slices_: int) -> np.ndarray:
    return ((ids.view(np.uint64) * np.uint64(BASES[0])) >> np.uint64(33)).astype(np.int64) % slices_


def repeated_windows(texts: DataFrame, window: int, bits: int, marks: int, flush: int) -> DataFrame:
    """(bucket, places): the windows of texts (doc_id long, tie binary, text) whose words also start earlier.

    Map: the windows of `flush` words or more are hashed together. Of equal ones only the first, by (doc_id, tie, place),
    goes on, in a blob for each of the 2^bits ranges of hashes; the others are repeats whatever other tasks hold, so a
    passage that a third of all documents share costs a task one window a flush. Reduce: of equal hashes
    of a range all but the first are repeats. A blob holds 64 bits of hash beside the range's, and about two bytes more a window.
    """

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = [RollingHash(b, window) for b in BASES]
        held: dict[tuple[int, bytes], np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            keys = sorted(held)
            sizes = np.array([len(held[k]) for k in keys])
            values = np.concatenate([held[k] for k in keys])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            places = np.arange(len(values)) - np.repeat(begins, sizes)
            valid = np.flatnonzero(places <= np.repeat(sizes, sizes) - window)
            places = places[valid]
            low, high = (rolling[i](np.ascontiguousarray(values[:, i]))[valid] for i in (0, 1))
            ids = np.repeat(np.array([k[0] for k in keys], np.int64), sizes)[valid]
            ties = np.repeat(np.array([k[1] for k in keys], f"S{TIE}"), sizes)[valid] if any(k[1] for k in keys) else np.full(len(valid), b"", "S1")
            at, run = _repeats(low, high)
            later = np.zeros(len(low), bool)
            later[at[1:][run[1:] == run[:-1]]] = True
            rows = []
            heads = ~later
            bucket = (low[heads] >> np.uint64(64 - bits)).astype(np.int64)
            rest = (low[heads] << np.uint64(bits)) | (high[heads] >> np.uint64(64 - bits))
            for number, data, hashes in _blobs(ids[heads], ties[heads], places[heads], bucket, rest):
                rows.append((number, -1, data, hashes))
            if later.any():
                for number, data, _ in _blobs(ids[later], ties[later], places[later], _slice_of(ids[later], marks)):
                    rows.append((number % (1 << bits), number, data, b""))
            for i in range(0, len(rows), 64):
                yield _table(rows[i:i + 64])

        words = 0
        for batch in batches:
            for i, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (i, tie or b"")
                if key in held:  # an equal row
                    continue
                hashes = word_hashes(text)
                if len(hashes) >= window:
                    held[key] = hashes
                    words += len(hashes)
                if words >= flush:
                    yield from emit()
                    held.clear()
                    words = 0
        if held:
            yield from emit()

    def compare(rows: pa.Table) -> pa.Table:
        kinds, blobs = rows["kind"].to_pylist(), rows["places"].to_pylist()
        out = [(k, p) for k, p in zip(kinds, blobs, strict=True) if k >= 0]
        parts = [unpack_places(p) for k, p in zip(kinds, blobs, strict=True) if k < 0]
        if parts:
            hashes = np.frombuffer(b"".join(h for k, h in zip(kinds, rows["hashes"].to_pylist(), strict=True) if k < 0), "<u8")
            at, run = _repeats(hashes)
            if len(at):
                ids, ties, places = _spread(parts)
                ids, ties, places = ids[at], ties[at], places[at]
                order = np.lexsort((places, ties, ids, run))
                ids, ties, places, run = ids[order], ties[order], places[order], run[order]
                begin = np.flatnonzero(np.diff(run, prepend=-1))
                first = np.repeat(begin, np.diff(begin, append=len(run)))
                later = np.flatnonzero((ids != ids[first]) | (ties != ties[first]) | (places != places[first]))
                order = later[np.lexsort((places[later], ties[later], ids[later]))]
                out += [(b, p) for b, p, _ in _blobs(ids[order], ties[order], places[order], _slice_of(ids[order], marks))] if len(order) else []
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "places": pa.array([p for _, p in out], pa.binary())})

    hashed = texts.select("doc_id", "tie", F.col("text").cast("binary")).mapInArrow(hash_windows, BLOB)
    return hashed.groupBy("bucket").applyInArrow(compare, "bucket int, places binary")


def _spread(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, tie, place) of each place of the unpacked parts."""
    tied = any(t is not None for _, t, _, _ in parts)
    ids = np.concatenate([np.repeat(i, n) for i, _, n, _ in parts])
    if tied:
        ties = np.concatenate([np.repeat(np.full(len(i), b"", f"S{TIE}") if t is None else t, n) for i, t, n, _ in parts])
    else:
        ties = np.full(len(ids), b"", "S1")
    return ids, ties, np.concatenate([p for _, _, _, p in parts])


SPANS = "array<struct<start: int, stop: int>>"


def removal_intervals(repeated: DataFrame, window: int) -> DataFrame:
    """(doc_id, tie, spans): the words that windows (bucket, places) cover, as maximal intervals [start, stop) in order."""

    def merge(rows: pa.Table) -> pa.Table:
        ids, ties, places = _spread([unpack_places(p) for p in rows["places"].to_pylist()])
        order = np.lexsort((places, ties, ids))
        ids, ties, places = ids[order], ties[order], places[order]
        fresh = _fresh(ids, ties)
        opens = fresh.copy()
        opens[1:] |= places[1:] > places[:-1] + window
        start = np.flatnonzero(opens)
        stop = places[np.append(start[1:], len(places)) - 1] + window
        first = np.flatnonzero(fresh)
        spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (places[start], stop)], names=["start", "stop"])
        cuts = pa.array(np.searchsorted(start, np.append(first, len(ids))).astype(np.int32))
        tie = pa.array([t.ljust(TIE, b"\0") if t else b"" for t in ties[first].tolist()], pa.binary())
        return pa.table({"doc_id": pa.array(ids[first]), "tie": tie, "spans": pa.ListArray.from_arrays(cuts, spans)})

    return repeated.groupBy("bucket").applyInArrow(merge, f"doc_id long, tie binary, spans {SPANS}")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply spans to texts: (doc_id, text, spans, copies) -> (doc_id, n_words, spans, kept, copies)."""
    for batch in batches:
        counts, kept = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = [w for part in words_of(text) for w in part]
            counts.append(len(words))
            for span in reversed(spans or ()):
                del words[span["start"]:span["stop"]]
            kept.append(b" ".join(words).decode())
        yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), batch.column(2), pa.array(kept, pa.string()), batch.column(3)],
                              names=["doc_id", "n_words", "spans", "kept", "copies"])


def drop_repeated_substrings(documents: DataFrame, window: int = 20, per_range: int = 1_000_000, flush: int = 1_000_000) -> DataFrame:
    """Remove the words that lie in a window of `window` words which also starts earlier.

    Earlier: in a document of smaller doc_id (an integer; null ids first), or in the same one, further ahead. Rows that
    share an id stand in the order of their texts' SHA-256; equal rows are one text, of which the first row is judged and the
    others lose all their windows. Windows are judged on the input. Returns doc_id, n_words, spans (maximal
    removed intervals [start, stop) of word numbers) and kept (the other words joined by one space). A null text has no
    words; other columns are not read; no rows give none.

    Tasks hold about `flush` words, or one longer document, and the windows of one of the ranges of hashes, about
    per_range; equality is by 64 bits of hash and the number of the range.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = slices(size // 6, per_range)  # a word and its space take some six bytes
    bits = (ranges - 1).bit_length()
    shared = stored(rows.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("__shared")))
    many = F.coalesce(F.col("__shared"), F.col("doc_id").isNull()) | F.coalesce(F.col("doc_id") == -(1 << 63), F.lit(False))
    digest = F.substring(F.unhex(F.sha2("text", 256)), 1, TIE - 1)
    flag = F.when(F.col("doc_id").isNull(), F.lit(b"\x01")).otherwise(F.lit(b"\x02"))
    keyed = rows.join(shared, "doc_id", "left").select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.when(many, F.concat(flag, digest)).alias("tie"), "text")
    spans = removal_intervals(repeated_windows(keyed, window, bits, ranges, flush), window)
    one = F.lit(1).cast("long")
    lone = keyed.filter("tie is null").withColumn("copies", one)
    equal = keyed.filter("tie is not null").groupBy("doc_id", "tie", "text").agg(F.count("*").alias("copies"))
    found = lone.unionByName(equal).withColumn("tie", F.coalesce("tie", F.lit(b""))).join(spans.hint("merge"), ["doc_id", "tie"], "left")
    restored = F.when(F.substring("tie", 1, 1) != F.lit(b"\x01"), F.col("doc_id")).otherwise(F.lit(None))
    cut = found.select(restored.alias("doc_id"), F.col("text").cast("binary"), "spans", "copies").mapInArrow(
        _cut, f"doc_id long, n_words long, spans {SPANS}, kept string, copies long")
    whole = F.lit(0).cast("int"), F.col("n_words").cast("int")
    again = (F.col("__copy") > 0) & (F.col("n_words") >= window)
    return repeat_rows(cut, "copies", "__copy").select(
        "doc_id", "n_words", F.when(again, F.array(F.struct(whole[0].alias("start"), whole[1].alias("stop")))).otherwise(F.col("spans")).alias("spans"),
        F.when(again, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def deduplicated_documents(documents: DataFrame) -> DataFrame:
    """drop_repeated_substrings as digests: doc_id, n_words, n_removed, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return drop_repeated_substrings(documents).select(
        "doc_id", "n_words", F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
