"""Merkle manifest of a dataset: compressed bitmaps of ids give leaf places by rank, slot arrays reduce the levels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import stored, sums_before
from maskwright.session import with_once

BITS = 12
SPAN = 1 << BITS
WORDS = SPAN // 64
#: Rows without an id stand in a container of their own, before all others.
NO_ID = -(1 << 63)
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(**columns: Column) -> Column:
    """SHA-256 of the fields, each as UTF-8 byte count, colon and value, or `-` where null."""
    parts = []
    for name in FIELDS:
        value = columns.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class RankBitmap:
    """Multiset of 12-bit numbers: an array of those that occur or a bitmap with a popcount directory, and a table of repeats.

    rank(x) is the number of elements below x. With at most 256 different numbers they are kept as an
    array, else as 64 words with the number of bits set before each.
    """

    HEAD = np.dtype([("kind", "<u4"), ("distinct", "<u4"), ("repeated", "<u4")])

    @staticmethod
    def pack(low: np.ndarray, counts: np.ndarray) -> bytes:
        """low: ascending and distinct; counts: at least 1."""
        head = np.zeros(1, RankBitmap.HEAD)
        many = np.flatnonzero(counts > 1)
        head["kind"], head["distinct"], head["repeated"] = int(len(low) > SPAN // 16), len(low), len(many)
        if head["kind"][0]:
            bits = np.zeros(SPAN, np.uint8)
            bits[low] = 1
            body = np.packbits(bits, bitorder="little").tobytes()
        else:
            body = low.astype("<u2").tobytes()
        return head.tobytes() + low[many].astype("<u2").tobytes() + (counts[many] - 1).astype("<u8").tobytes() + body

    def __init__(self, data: bytes):
        head = np.frombuffer(data, self.HEAD, 1)[0]
        self.dense, distinct, repeated = bool(head["kind"]), int(head["distinct"]), int(head["repeated"])
        at = self.HEAD.itemsize
        self.again = np.frombuffer(data, "<u2", repeated, at).astype(np.int64)
        self.extra = np.frombuffer(data, "<u8", repeated, at + 2 * repeated).astype(np.int64)
        self.extra_before = np.concatenate([[0], np.cumsum(self.extra)])
        at += 10 * repeated
        if self.dense:
            self.words = np.frombuffer(data, "<u8", WORDS, at)
            self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        else:
            self.array = np.frombuffer(data, "<u2", distinct, at).astype(np.int64)

    def elements(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers ascending, counts)."""
        low = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little")) if self.dense else self.array
        counts = np.ones(len(low), np.int64)
        counts[np.searchsorted(low, self.again)] += self.extra
        return low, counts

    def rank(self, low: np.ndarray) -> np.ndarray:
        if self.dense:
            word, bit = low >> 6, (low & 63).astype(np.uint64)
            below = (np.uint64(1) << bit) - np.uint64(1)
            place = self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)
        else:
            place = np.searchsorted(self.array, low)
        return place + self.extra_before[np.searchsorted(self.again, low)]

    def repeats(self, low: np.ndarray) -> np.ndarray:
        """Whether each number occurs more than once."""
        if not len(self.again):
            return np.zeros(len(low), bool)
        return self.again[np.minimum(np.searchsorted(self.again, low), len(self.again) - 1)] == low

    @staticmethod
    def merge(parts: list[bytes]) -> tuple[bytes, int]:
        """The bitmap of all parts, and its number of elements."""
        low, counts = zip(*(RankBitmap(p).elements() for p in parts), strict=True)
        values, at = np.unique(np.concatenate(low), return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        return RankBitmap.pack(values, total), int(total.sum())


def id_bitmaps(ids: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """(grp, chunk, bits, base): bitmaps of the ids of each group by their upper 52 bits, and the leaves before each.

    Each task builds bitmaps of its own rows (at most `flush` at a time); those of one group and chunk are
    merged, so a group that holds most rows is cut by ids and a repeated id is one count. The bases are
    the popcount directory over chunks, summed up in blocks of 1,024 chunks.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> pa.RecordBatch:
            frame = pa.Table.from_batches(held).to_pandas()
            keys, chunks, parts = [], [], []
            for (grp, chunk), low in frame.groupby(["grp", "chunk"])["low"]:
                values, counts = np.unique(low.to_numpy(), return_counts=True)
                keys.append(grp)
                chunks.append(chunk)
                parts.append(RankBitmap.pack(values, counts))
            return pa.record_batch([pa.array(keys, pa.string()), pa.array(chunks, pa.int64()), pa.array(parts, pa.binary())], names=["grp", "chunk", "bits"])

        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= flush:
                yield emit()
                held, rows = [], 0
        if held:
            yield emit()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        bits, leaves = RankBitmap.merge(rows["bits"].tolist())
        return pd.DataFrame({"grp": rows["grp"].iloc[:1].tolist(), "chunk": rows["chunk"].iloc[:1].tolist(), "bits": [bits], "leaves": [leaves]})

    parts = ids.select("grp", "chunk", "low").mapInArrow(build, "grp string, chunk long, bits binary")
    merged = stored(parts.groupBy("grp", "chunk").applyInPandas(merge, "grp string, chunk long, bits binary, leaves long"))
    blocks = merged.select("grp", "chunk", "leaves", F.expr("chunk >> 10").alias("__block"))
    bases = sums_before(blocks, ["grp"], "__block", [F.col("chunk")], "leaves", "base")
    return stored(merged.join(bases.select("grp", "chunk", "base"), ["grp", "chunk"]))


def ranked(leaves: DataFrame, bitmaps: DataFrame, hot_share: float = 0.001, salts: int = 64) -> DataFrame:
    """leaves (grp, chunk, low, leaf, ...) with `at`, the leaves of the group with smaller ids, and `again`, whether the id repeats.

    Rows meet their bitmap in one task and look their ranks up; they are not sorted by id. A task holds one
    bitmap. A chunk with more than hot_share of all leaves (repeated ids; so at most 1 / hot_share chunks,
    which bounds the broadcast) is spread over `salts` tasks, each with a copy of its bitmap.
    """
    names = [c for c in leaves.columns if c not in ("grp", "chunk", "low")]
    total = bitmaps.agg(F.sum("leaves")).first()[0] or 0
    limit = max(4.0 * SPAN, hot_share * total)
    hot = F.broadcast(bitmaps.filter(F.col("leaves") > limit).select("grp", "chunk", F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), (F.monotonically_increasing_id() % salts).cast("int")).otherwise(0)
    rows = leaves.join(hot, ["grp", "chunk"], "left").withColumn("__salt", salt)
    every = F.when(F.col("leaves") > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    queries = rows.select("grp", "chunk", "__salt", "low", *names, F.lit(None).cast("binary").alias("bits"), F.lit(0).cast("long").alias("base"))
    kinds = dict(leaves.dtypes)
    maps = bitmaps.select("grp", "chunk", F.explode(every).alias("__salt"), F.lit(-1).cast("int").alias("low"),
                          *[F.lit(None).cast(kinds[n]).alias(n) for n in names], "bits", "base")
    at_low, at_bits = 3, 4 + len(names)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, base = None, 0
        for batch in batches:
            low = batch.column(at_low).to_numpy(zero_copy_only=False).astype(np.int64)
            heads = np.flatnonzero(low < 0).tolist()
            places, again = np.zeros(len(low), np.int64), np.zeros(len(low), bool)
            for start, stop in zip([-1, *heads], [*heads, len(low)], strict=True):
                if start >= 0:
                    bitmap, base = RankBitmap(batch.column(at_bits)[start].as_py()), batch.column(at_bits + 1)[start].as_py()
                part = slice(start + 1, stop)
                if start + 1 < stop:
                    places[part] = base + bitmap.rank(low[part])
                    again[part] = bitmap.repeats(low[part])
            kept = pa.array(low >= 0)
            columns = [batch.column(0), *[batch.column(4 + i) for i in range(len(names))], pa.array(places), pa.array(again)]
            yield pa.record_batch([c.filter(kept) for c in columns], names=["grp", *names, "at", "again"])

    both = maps.unionByName(queries).repartition("grp", "chunk", "__salt").sortWithinPartitions("grp", "chunk", "__salt", "low")
    return both.mapInArrow(look_up, ", ".join(["grp string", *[f"`{n}` {kinds[n]}" for n in names], "at long", "again boolean"]))


def placed(leaves: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, bent, at, copies): leaves at places at .. at + copies - 1 of their group.

    Leaves of one id stand in the order of their digests, equal ones together; they alone are grouped. Digests
    are cut by their first 16 bits, so that a task orders a slice of an id's leaves.
    """
    rows = stored(ranked(leaves, bitmaps))
    same = rows.filter("again").groupBy("grp", "doc_id", "leaf", "bent", "at").agg(F.count("*").alias("copies"))
    cut = same.withColumn("__cut", F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int"))
    tied = sums_before(cut, ["grp", "at"], "__cut", [F.col("leaf")], "copies", "__before")
    tied = tied.select("grp", "doc_id", "leaf", "bent", (F.col("at") + F.col("__before")).alias("at"), "copies")
    return rows.filter("not again").select("grp", "doc_id", "leaf", "bent", "at", F.lit(1).cast("long").alias("copies")).unionByName(tied)


def parent(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run)).hexdigest().encode()


def depth(nodes: int) -> int:
    """Levels above that many nodes until one remains."""
    return (nodes - 1).bit_length()


class Slots:
    """One block of consecutive nodes of a level, filled by place, and the levels above it inside the block."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            last = self.levels[-1]
            self.levels.append([parent(last[i:i + 2]) for i in range(0, len(last), 2)])

    def siblings(self, slot: int) -> list[bytes]:
        """The other node of each run on the way up; empty where a node is alone in its run."""
        out = []
        for level in self.levels[:-1]:
            out.append(level[slot ^ 1] if slot ^ 1 < len(level) else b"")
            slot >>= 1
        return out


def fold(node: bytes, at: int, siblings: list[bytes]) -> bytes:
    """The root over a node at place `at` with its siblings from the lowest level up."""
    for other in siblings:
        node = parent([node] if not other else [other, node] if at & 1 else [node, other])
        at >>= 1
    return node


def _filled(rows: pd.DataFrame, block: int, bits: int) -> list[tuple[int, int]]:
    """(row, slot) of each place of the block that the rows (at, copies) cover."""
    start, stop = block << bits, (block + 1) << bits
    out = []
    for i, (at, copies) in enumerate(zip(rows["at"].tolist(), rows["copies"].tolist(), strict=True)):
        out.extend((i, place - start) for place in range(max(at, start), min(at + copies, stop)))
    return out


def _in_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes (at, copies) once for each block of 2^bits places that they reach into."""
    first, last = F.expr(f"at >> {bits}"), F.expr(f"(at + copies - 1) >> {bits}")
    return nodes.withColumn("block", F.explode(F.sequence(first, last)))


def _slots(rows: pd.DataFrame, bits: int) -> tuple[Slots, list[tuple[int, int]]]:
    """The block's nodes in their slots, reduced to one node, and which row fills which slot."""
    where = _filled(rows, int(rows["block"].iloc[0]), bits)
    nodes = [b""] * len(where)
    leaves = [x.encode() for x in rows["node"]]
    for i, slot in where:
        nodes[slot] = leaves[i]
    return Slots(nodes, min(bits, depth(int(rows["size"].iloc[0])))), where


def reduced(nodes: DataFrame, bits: int) -> DataFrame:
    """One node (grp, size, node, at, copies) for each block of 2^bits places of nodes of the same columns."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        slots, _ = _slots(rows, bits)
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "size": [(int(rows["size"].iloc[0]) + (1 << bits) - 1) >> bits],
                             "node": [slots.levels[-1][0].decode()], "at": [int(rows["block"].iloc[0])], "copies": [1]})

    parts = _in_blocks(nodes.select("grp", "size", "node", "at", "copies"), bits)
    return parts.groupBy("grp", "block").applyInPandas(reduce, "grp string, size long, node string, at long, copies long")


def passes(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """nodes (grp, size, node, at, copies) and the levels above them by steps of `bits`, up to one node a group.

    size is the group's number of places. A step divides it by 2^bits, so steps are few; each is written to the
    shared folder.
    """
    out = [nodes]
    while out[-1].filter("size > 1").limit(1).count():
        out.append(stored(reduced(out[-1], bits)))
    return out


#: What the row of a block hands down: siblings above the block, the lang's place, the lang's root and the root.
ABOVE = "path array<string>, lang_at long, subroot string, root string"


def descended(nodes: DataFrame, upper: DataFrame, bits: int, carry: str = "") -> DataFrame:
    """(grp, at, node, carried, path, ...): a row for each place of nodes; upper: (grp, at, ABOVE) for each block."""
    names = _names(carry)

    def expand(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        slots, where = _slots(rows, bits)
        start, block = int(rows["block"].iloc[0]) << bits, above.iloc[0]
        rest = list(block["path"])
        out = rows.iloc[[i for i, _ in where]][["grp", "node", *names]].reset_index(drop=True)
        out["at"] = [start + slot for _, slot in where]
        out["path"] = [[x.decode() for x in slots.siblings(slot)] + rest for _, slot in where]
        return out.assign(lang_at=block["lang_at"], subroot=block["subroot"], root=block["root"])

    schema = f"grp string, node string, {carry}{', ' if carry else ''}at long, {ABOVE}"
    return _met(nodes, upper, bits, names).applyInPandas(expand, schema)


def _names(columns: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in columns.split(",") if c]


def _met(nodes: DataFrame, upper: DataFrame, bits: int, names: list[str]):
    parts = _in_blocks(nodes.select("grp", "size", "node", "at", "copies", *names), bits)
    return parts.groupBy("grp", "block").cogroup(upper.groupBy("grp", "at"))


def proven(leaves: DataFrame, upper: DataFrame, bits: int, kind: str) -> DataFrame:
    """The manifest's rows from leaves (grp, size, node, at, copies, doc_id, bent) and the row of each block above them."""

    def prove(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        slots, where = _slots(rows, bits)
        start, block = int(rows["block"].iloc[0]) << bits, above.iloc[0]
        out = rows.iloc[[i for i, _ in where]][["doc_id", "node"]].reset_index(drop=True).rename(columns={"node": "leaf"})
        bent, leaf = rows["bent"].tolist(), rows["node"].tolist()
        rest = [x.encode() for x in block["path"]]
        below = depth(int(rows["size"].iloc[0]))
        proofs, found = [], []
        for i, slot in where:
            path = slots.siblings(slot) + rest
            proofs.append([x.decode() for x in path if x])
            own = fold((bent[i] or leaf[i]).encode(), start + slot, path[:below])
            found.append(fold(own, int(block["lang_at"]), path[below:]).decode())
        out["at"] = [start + slot for _, slot in where]
        out["lang"] = None if rows["grp"].iloc[0] == "-" else rows["grp"].iloc[0][1:]
        out = out.assign(subroot=block["subroot"], root=block["root"])
        out["proof"], out["folded_root"] = proofs, found
        out["verified"] = out["folded_root"] == out["root"]
        return out

    return _met(leaves, upper, bits, ["doc_id", "bent"]).applyInPandas(
        prove, f"doc_id {kind}, lang string, at long, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")


def ordered(names: DataFrame) -> DataFrame:
    """names (grp) with `at`, its place in ascending byte order, by range partitions that are written with their numbers."""
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = names.repartitionByRange(tasks, "grp").sortWithinPartitions("grp").withColumn("__id", F.monotonically_increasing_id())
    ranged = stored(ranged).withColumns({"__one": F.lit(1), "__part": F.expr("__id >> 33")})
    return sums_before(ranged.withColumn("__all", F.lit(0)), ["__all"], "__part", [F.col("__id")], "__one", "at").select("grp", "at")


def manifest(documents: DataFrame, altered: Column | None = None, bits: int = 12) -> DataFrame:
    """A leaf, its proof and the check of the proof for each document, under one root.

    Trees are binary; a last node without a partner is hashed alone. Each lang has a tree over its leaves, ascending by
    doc_id; the langs' roots, ascending by lang, have one more. `altered` (default: n_chars) takes the place of n_chars
    when the check recomputes the leaf. Returns doc_id, lang, at (place in the lang), leaf, subroot, root, proof (the
    siblings' digests from the leaf up), folded_root (from the recomputed leaf and the proof) and verified.

    doc_id is an integer; null ids come first, null langs are the first lang. Rows that share an id in a lang
    stand in the order of their leaves' digests, and equal rows are leaves of their own. Null values are leaves' `-`.
    Extra columns are not read; no rows give none. A task holds a block of 2^bits nodes, a bitmap or a slice of ties.
    """
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    number = F.col("doc_id").cast("long")
    ids = {"grp": key, "chunk": F.coalesce(F.shiftright(number, BITS), F.lit(NO_ID)),
           "low": F.coalesce(number.bitwiseAND(F.lit(SPAN - 1).cast("long")).cast("int"), F.lit(0))}
    bitmaps = id_bitmaps(documents.select(*[c.alias(n) for n, c in ids.items()]))
    bent = leaf_digest() if altered is None else leaf_digest(n_chars=altered)
    whole = with_once(documents.select(*FIELDS), leaf=leaf_digest(), bent=bent)
    leaves = whole.select(*[c.alias(n) for n, c in ids.items()], "doc_id", "leaf", F.when(F.col("bent") != F.col("leaf"), F.col("bent")).alias("bent"))
    sizes = bitmaps.groupBy("grp").agg(F.sum("leaves").alias("size"))
    at = placed(leaves, bitmaps)
    kind = dict(documents.dtypes)["doc_id"]
    nodes = stored(at.join(sizes, "grp").select("grp", "size", F.col("leaf").alias("node"), "at", "copies", "doc_id", "bent"))
    steps = passes(nodes, bits)
    tops = steps.pop()
    langs = stored(tops.select(F.col("grp").alias("name"), "node").join(ordered(tops.select("grp")).withColumnRenamed("grp", "name"), "name"))
    one = F.lit(1).cast("long")
    langs = langs.select(F.lit("").alias("grp"), F.lit(langs.count()).cast("long").alias("size"), "node", "at", one.alias("copies"), "name")
    above = passes(langs, bits)
    none = F.array().cast("array<string>")
    upper = above.pop().select("grp", F.lit(0).cast("long").alias("at"), none.alias("path"), F.lit(0).cast("long").alias("lang_at"),
                               F.lit("").alias("subroot"), F.col("node").alias("root"))
    for level in reversed(above):
        upper = descended(level, upper, bits, "name string" if level is langs else "")
    if not above:  # one lang
        upper = upper.join(langs.select("grp", "name", "node"), "grp")
    upper = stored(upper.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("at"), "path", F.col("at").alias("lang_at"),
                                F.col("node").alias("subroot"), "root"))
    steps = steps or [nodes]  # where each lang has one leaf, its root is the leaf
    for level in reversed(steps[1:]):
        upper = descended(level, upper, bits).select("grp", "at", "path", "lang_at", "subroot", "root")
    return proven(steps[0], upper, bits, kind)


def verified_documents(documents: DataFrame) -> DataFrame:
    """manifest of documents where those whose CRC-32 of the id is divisible by 7 are checked with n_chars + 1."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(documents, F.when(struck, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")
