"""Document fingerprints that keep edit distance: random walks over characters, sampled, banded and verified."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import slices

#: Steps after which the table of moves comes round again.
PERIOD = 1 << 14
SLOTS = 128
#: Walks over a text, each with its share of the slots: one that does not fall in step again after an edit costs its share only.
WALKS = 4
#: Characters of each text walked between two looks at the sampled places.
BLOCK = 1024
#: A symbol holds a walk for stretches of 2 ** k steps, 1 in 2 ** k of its stretches for each of these k: while the walk ahead is
#: held, the one behind may come up, and from there on they are one.
HOLDS = range(2, 9)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _moves() -> np.ndarray:
    """[symbol, step of the period]: whether a walk moves on to the next character."""
    bits = _mixed(np.arange(PERIOD * 256, dtype=np.uint64) + np.uint64(1)) >> np.uint64(40)
    moves = (bits & np.uint64(1)).astype(bool).reshape(256, PERIOD)
    for k in HOLDS:
        held = _mixed(np.arange(256 * PERIOD >> k, dtype=np.uint64) + np.uint64((k << 40) + 1)) >> np.uint64(40)
        moves &= ~np.repeat((held % np.uint64(1 << k) == 0).reshape(256, PERIOD >> k), 1 << k, axis=1)
    return moves


def _stays() -> np.ndarray:
    """[symbol, step of the period]: the steps a walk spends on a symbol that it comes to at that step."""
    moves = _moves()
    stays = np.ones((256, PERIOD), np.uint16)
    for _ in range(2):  # the second round carries waits over the end of the period
        for step in range(PERIOD - 1, -1, -1):
            stays[:, step] = np.where(moves[:, step], 1, stays[:, (step + 1) % PERIOD] + 1)
    return stays


def _positions(longest: int = 1 << 42) -> np.ndarray:
    """Per slot, ascending: the sampled place of an output of N symbols is the last entry below N.

    Each place is as likely as any other, and outputs of lengths N < M share a slot's place with
    probability N / M: entries are the record positions of independent draws.
    """
    rows = []
    for slot in range(SLOTS):
        at, row, turn = 1, [0], 0
        while at < longest:
            turn += 1
            u = (int(_mixed(np.array([slot * 1000 + turn + 77_000_001], np.uint64))[0] >> np.uint64(11)) + 0.5) / (1 << 53)
            at = int(at / u) + 1
            row.append(at - 1)
        rows.append(row)
    wide = max(map(len, rows))
    return np.array([r + [1 << 62] * (wide - len(r)) for r in rows], np.int64)


_tables: dict[str, object] = {}


def _table(name: str, make):
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def _symbols(text: str) -> np.ndarray:
    """0 to 255 for each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.uint8)


class Walks(NamedTuple):
    """Where the walks over each text stand: steps made [text, walk], and the last sampled place passed and its symbol [text, slot]."""

    steps: np.ndarray
    places: np.ndarray
    symbols: np.ndarray

    @staticmethod
    def begin(texts: int) -> Walks:
        return Walks(np.zeros((texts, WALKS), np.int64), np.full((texts, SLOTS), -1, np.int64), np.zeros((texts, SLOTS), np.uint8))

    def prints(self) -> np.ndarray:
        """SLOTS bytes a text, each hashed from slot, place and the symbol there; zeros if nothing was walked."""
        slot = np.arange(SLOTS, dtype=np.uint64)
        mixed = _mixed((self.places.astype(np.uint64) * np.uint64(SLOTS) + slot) * np.uint64(256) + self.symbols.astype(np.uint64))
        return np.where(self.places < 0, np.uint8(0), (mixed >> np.uint64(33)).astype(np.uint8))


def _ends(symbols: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[character, text, walk]: the step at which each walk leaves each character of a block.

    symbols is [character, text], texts from the longest to the shortest; at the steps before, changed to those after.
    """
    stays = _table("stays", _stays)
    ends = np.full((len(symbols), *at.shape), 1 << 62, np.int64)
    if len(lengths) > 6:
        flat, rows = stays.reshape(-1), symbols.astype(np.int64) * PERIOD
        for i, n in enumerate(np.searchsorted(-lengths, -np.arange(1, len(symbols) + 1), "right").tolist()):
            walks = at[:n]
            walks += flat[(walks & (PERIOD - 1)) + rows[i, :n, None]]
            ends[i, :n] = walks
    else:  # few texts: a plain loop is faster than short arrays
        bytes_of = _table("rows", lambda: [array("H", row.tobytes()) for row in stays])
        for t, n in enumerate(lengths.tolist()):
            rows = [bytes_of[s] for s in symbols[:n, t].tolist()]
            for w in range(WALKS):
                j = int(at[t, w])
                ends[:n, t, w] = [j := j + row[j & (PERIOD - 1)] for row in rows]
                at[t, w] = j
    return ends


def walk_on(texts: list[str], start: Walks) -> Walks:
    """The walks carried on from `start` over the whole of one more piece of each text.

    At each step a walk writes the symbol it stands on, and a bit hashed from step and symbol says whether it
    moves on: after an edit, two walks that meet again at one step and character write the same from there on.
    Walks over all texts go in step, block by block; what they write is looked at where a slot samples it.
    """
    positions, phase = _table("positions", _positions), np.arange(WALKS) * PERIOD // WALKS  # each walk reads the moves from its own place
    walk_of = np.arange(SLOTS) * WALKS // SLOTS
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    symbols = [_symbols(texts[i]) for i in order]
    steps, places, found = start.steps[order], start.places[order], start.symbols[order]
    for low in range(0, int(lengths[0]) if len(texts) else 0, BLOCK):
        n = int(np.searchsorted(-lengths, -low, "left"))
        sizes = np.minimum(lengths[:n] - low, BLOCK)
        block = np.zeros((int(sizes[0]), n), np.uint8)
        for t in range(n):
            block[:sizes[t], t] = symbols[t][low:low + BLOCK]
        before, at = steps[:n].copy(), steps[:n] + phase
        ends = _ends(block, sizes, at)
        steps[:n] = at - phase
        which = (positions[None] < steps[:n, walk_of, None]).sum(2) - 1
        last = positions[np.arange(SLOTS)[None], which]
        text, slot = np.nonzero(last >= before[:, walk_of])
        place, walk = last[text, slot], walk_of[slot]
        first, beyond = np.zeros(len(text), np.int64), sizes[text]
        while (first < beyond).any():  # the first character that its walk leaves after the place
            middle = np.minimum((first + beyond) // 2, sizes[text] - 1)
            left = ends[middle, text, walk] <= place + phase[walk]
            first, beyond = np.where(left & (first < beyond), middle + 1, first), np.where(left, beyond, np.minimum(middle, beyond))
        places[text, slot], found[text, slot] = place, block[first, text]
    back = np.argsort(order, kind="stable")
    return Walks(steps[back], places[back], found[back])


def parts_of(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts of about `most` characters, or of one longer text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def embed(texts: list[str]) -> np.ndarray:
    """Fingerprints of whole texts, one row of SLOTS bytes per text; zeros for the empty text."""
    none = np.zeros((0, SLOTS), np.uint8)
    return np.concatenate([none, *(walk_on(texts[a:b], Walks.begin(b - a)).prints() for a, b in parts_of(texts))])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes, per row."""
    return (a == b).mean(axis=1)


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SLOTS)


def _binary(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in prints], pa.binary())


def fingerprints(documents: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns and fp (SLOTS bytes) of every document's whole text; null counts as empty."""
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], _binary(embed(texts))], names=[*columns, "fp"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return documents.select(*columns, "text").mapInArrow(run, f"{schema}, fp binary")


def cut_by_key(rows: DataFrame, per_slice: int, most: int = 20_000) -> DataFrame:
    """rows (with a long column key, none null) dealt into slices of the key's order.

    Adds slice, and ahead: the rows of the first key after a slice (after the last the first of all) are in it too,
    with ahead = true. Slices hold about per_slice rows, but there are at most `most`; their first keys are all that
    comes to the driver and is broadcast.
    """
    n = min(most, slices(rows.count(), per_slice, least=16))
    keys = rows.select("key", F.col("key").cast("double").alias("__at"))
    edges = sorted(set(keys.approxQuantile("__at", [i / n for i in range(1, n)], max(0.1 / n, 1e-5))))
    cuts = [float("-inf"), *edges, float("inf")]

    def sliced(frame: DataFrame) -> DataFrame:
        if len(cuts) == 2:
            return frame.withColumn("slice", F.lit(0))
        cut = Bucketizer(splits=cuts, inputCol="__at", outputCol="__slice")
        return cut.transform(frame.withColumn("__at", F.col("key").cast("double"))).withColumn("slice", F.col("__slice").cast("int")).drop("__at", "__slice")

    firsts = sorted((r["slice"], r["first"]) for r in sliced(keys.drop("__at")).groupBy("slice").agg(F.min("key").alias("first")).collect())
    moves = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    ahead = rows.sparkSession.createDataFrame(moves, "key long, __before int")
    both = F.array(F.struct(F.col("slice"), F.lit(False).alias("ahead")), F.struct(F.col("__before").alias("slice"), F.lit(True).alias("ahead")))
    placed = sliced(rows).join(F.broadcast(ahead), "key", "left")
    each = F.explode(F.when(F.col("__before").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("__put")
    return placed.select(*rows.columns, each).select(*rows.columns, "__put.slice", "__put.ahead")


def edited_fingerprints(documents: DataFrame, share: int = 4, per_slice: int = 2_000) -> DataFrame:
    """Fingerprints of each document and of its text with the last quarter replaced by the next document's start.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next
    (share of equal bytes). The next document is that with the next larger doc_id, after the last the first;
    of rows that share an id, the smallest text stands for it. Rows without an id come first, as one id. Null texts
    count as empty, whose fingerprint is all zeros; no rows give no rows. Texts move once, to slices of the id's
    order, and stream through their task from the largest id down, so that the next document is the one before.
    The edited text's walks start where the document's own stand after the part that both share.
    """
    kind = dict(documents.dtypes)["doc_id"]
    texts = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None  # (slice, ahead, key) of the last row
        # the first text of the group at hand and of the one before, each with its fingerprint
        first: tuple[str, np.ndarray] = ("", np.zeros(SLOTS, np.uint8))
        follower = first
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for low, high in parts_of(columns[3]):
                own = columns[3][low:high]
                cuts = [len(t) - len(t) // share for t in own]
                shared = walk_on([t[:cut] for t, cut in zip(own, cuts, strict=True)], Walks.begin(len(own)))
                prints = walk_on([t[cut:] for t, cut in zip(own, cuts, strict=True)], shared).prints()
                kept, ends, next_prints = [], [], []
                for i, (part, ahead, key, text) in enumerate(zip(*(c[low:high] for c in columns), strict=True)):
                    if group != (part, ahead, key):
                        follower, first, group = first, (text, prints[i]), (part, ahead, key)
                    if not ahead:
                        kept.append(i)
                        ends.append(follower[0][:len(text) - cuts[i]])
                        next_prints.append(follower[1])
                if kept:
                    mine, after = prints[kept], walk_on(ends, Walks(*(state[kept] for state in shared))).prints()
                    hashes = [hashlib.sha256((own[i][:cuts[i]] + end).encode("utf-8", "surrogatepass")).hexdigest() for i, end in zip(kept, ends, strict=True)]
                    yield pa.record_batch(
                        [batch.column(3).slice(low, high - low).take(pa.array(kept)), pa.array([len(own[i]) for i in kept], pa.int64()), pa.array(hashes),
                         _binary(mine), _binary(after), pa.array(likeness(mine, after)), pa.array(likeness(mine, np.array(next_prints)))], names=names)

    dealt = cut_by_key(texts, per_slice).select("slice", "ahead", "key", "doc_id", "text")
    ordered = dealt.repartition("slice").sortWithinPartitions("slice", F.desc("ahead"), F.desc("key"), "text")
    prints = ordered.mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double")
    return prints.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"),
                         F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def alike_forest(prints: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, index) that join exactly what pairs alike in `least` or more join; who is joined leaves the comparison."""
    firsts, seconds = [], []
    open_ = np.arange(len(prints))
    while len(open_):
        reached, open_ = [open_[0]], open_[1:]
        while reached and len(open_):
            at = reached.pop()
            near = (prints[open_] == prints[at]).mean(axis=1) >= least
            new, open_ = open_[near], open_[~near]
            firsts.append(np.full(len(new), at))
            seconds.append(new)
            reached += new.tolist()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *seconds])


def near_links(prints: DataFrame, least: float = 0.8, bands: int = 32, tile: int = 2048) -> DataFrame:
    """(fp, near_fp, likeness), fp > near_fp: links that connect exactly the distinct fingerprints alike in `least` or more that meet in a band.

    A band is SLOTS / bands bytes; all its members are compared, and give a spanning forest of their links, never
    their pairs. Bands of more than `tile` fingerprints are cut into tiles by hash and every two tiles are compared in a
    task of their own. Pairs alike in 0.8 of their bytes miss all 32 bands with a chance of (1 - 0.8 ** 4) ** 32 < 1e-7
    if equal bytes fall independently.
    """
    width = SLOTS // bands

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def links() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), SLOTS)
            a, b = alike_forest(values, least)
            low, high = np.minimum(a, b), np.maximum(a, b)  # members come in ascending order
            return pa.record_batch([_binary(values[high]), _binary(values[low]), pa.array(likeness(values[high], values[low]), pa.float64())], names=["fp", "near_fp", "likeness"])

        for batch in batches:
            for own, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != bucket:
                    if len(held) > 1:
                        yield links()
                    bucket, held = own, []
                held.append(fp)
        if len(held) > 1:
            yield links()

    keyed = prints.select("fp").distinct().select("fp", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    keyed = keyed.withColumn("key", F.expr(f"substring(fp, band * {width} + 1, {width})"))
    met = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = keyed.join(met.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")), ["band", "key"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    placed = placed.select("band", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    buckets = placed.select(F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp")
    ordered = buckets.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return ordered.mapInArrow(compare, "fp binary, near_fp binary, likeness double").distinct()
