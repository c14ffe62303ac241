"""SimHash near-duplicates, linked exactly by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import stored
from maskwright.llm.components import connected
from maskwright.llm.overlap import first_of_groups, overlap, shingles, similar_links, text_key

BITS = 64


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits, each set when over half of the XXH64 hashes of the text's shingles set it; 0 without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    rows = np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), shingles)), np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 255 * 64):  # sums of 255 bits fit a byte
        bits = np.unpackbits(rows[at:at + 255 * 64], axis=1)
        whole = len(bits) // 255 * 255
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""
    kind = dict(documents.dtypes)["doc_id"]

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known: dict = {}
            for t in texts:
                if t not in known:
                    known[t] = simhash(t, words)
            prints = np.array([known[t] for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(hash_texts, f"doc_id {kind}, fp long")


def _bit_rows(prints: np.ndarray) -> np.ndarray:
    """0/1 per bit, least significant first."""
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have each pair of bits set: one 64 x 64 table, summed over all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 16):
                bits = _bit_rows(np.ascontiguousarray(values[at:at + (1 << 16)])).astype(np.float32)
                both += bits.T @ bits
            total += len(values)
        cells = np.concatenate([[total], both.reshape(-1).astype(np.int64)])
        yield pa.record_batch([pa.array(np.arange(len(cells))), pa.array(cells.astype(np.int64))], names=["cell", "n"])

    cells = {r["cell"]: r["n"] for r in prints.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    table = np.array([cells.get(i + 1, 0) for i in range(BITS * BITS)], np.float64).reshape(BITS, BITS)
    return cells.get(0, 0), table


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of near equal width; bits that go together share a part."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        part = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (tie[b, part].sum(), -b)))
            left.remove(part[-1])
        out.append(sorted(part))
    return out


def part_key(prints: np.ndarray, part: list[int]) -> np.ndarray:
    """The part's bits as a number."""
    out = np.zeros(len(prints), np.uint64)
    for to, bit in enumerate(part):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out


def equal_pairs(prints: DataFrame, schemes: list[list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each (scheme, part): the pairs of fingerprints that agree on the whole part."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for s, scheme in enumerate(schemes):
                for i, part in enumerate(scheme):
                    yield pa.record_batch([pa.array(np.full(len(values), s * 16 + i, np.int32)), pa.array(part_key(values, part).view(np.int64))], names=["part", "key"])

    counts = prints.select("fp").mapInArrow(keys, "part int, key long").groupBy("part", "key").agg(F.count("*").alias("n"))
    found = counts.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()
    return {(r["part"] // 16, r["part"] % 16): r["pairs"] for r in found}


def differing(p: np.ndarray, part: list[int]) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, 2, ... bits of the part, bits taken as independent."""
    out = np.ones(1)
    for b in part:
        d = 2 * p[b] * (1 - p[b])
        out = np.convolve(out, [1 - d, d])
    return out


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Threshold of each part (-1: not probed) with the least total cost.

    If the thresholds plus one add up to `units` (the distance plus one), fingerprints within the distance
    must be within the threshold of some part: otherwise each part would add at least its threshold plus
    one to their distance. costs[i][u]: part i at threshold u - 1.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (so_far, chosen) in best.items():
            for u in range(units - used + 1):
                if used + u not in step or so_far + cost[u] < step[used + u][0]:
                    step[used + u] = (so_far + cost[u], [*chosen, u - 1])
        best = step
    return best[units]


def choose_scheme(prints: DataFrame, distance: int, pair_cost: float = 0.01) -> list[tuple[list[int], int]]:
    """Parts with their thresholds: the cheapest over 2 to distance + 1 parts.

    A probed key costs one shuffled row, a candidate pair pair_cost of that. Candidates at threshold 0 are
    counted over all fingerprints; at higher thresholds they are scaled by the bits' statistics.
    """
    n, both = bit_statistics(prints)
    p = np.diag(both) / max(n, 1)
    schemes = [group_bits(n, both, m) for m in range(min(2, distance + 1), distance + 2)]
    equal = equal_pairs(prints, schemes)
    choices = []
    for s, scheme in enumerate(schemes):
        costs = []
        for i, part in enumerate(scheme):
            chance = np.cumsum(differing(p, part))
            row = [0.0]
            for t in range(distance + 1):
                reach = chance[min(t, len(chance) - 1)]
                pairs = max(equal.get((s, i), 0.0) * reach / max(chance[0], 1e-30), n * (n - 1) / 2 * reach) if t else equal.get((s, i), 0.0)
                row.append(n * sum(comb(len(part), k) for k in range(t + 1)) + pair_cost * pairs)
            costs.append(row)
        cost, thresholds = allocate(costs, distance + 1)
        choices.append((cost, [(part, t) for part, t in zip(scheme, thresholds, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _roots(values: np.ndarray, distance: int) -> np.ndarray:
    """Index of each value's root when values within the distance are joined; rows are compared in blocks."""
    n = len(values)
    label = np.arange(n)
    for at in range(0, n, 256):
        near = np.bitwise_count(values[at:at + 256, None] ^ values[None, at:]) <= distance
        for i in range(len(near)):
            own = np.unique(label[at + np.flatnonzero(near[i])])
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    return label


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links a-b."""
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def bucket_links(group: np.ndarray, values: np.ndarray, distance: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, root) that join, within each run of equal groups, exactly what lies within the distance."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    label = np.arange(len(values))
    for s, g in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        label[s:s + g] = s + _roots(values[s:s + g], distance)
    left = np.repeat(np.where(sizes <= small, sizes, 0), sizes) - (np.arange(len(values)) - np.repeat(starts, sizes)) - 1
    firsts, seconds = [], []
    at = np.flatnonzero(left > 0)
    step = 1
    while len(at):
        near = at[np.bitwise_count(values[at] ^ values[at + step]) <= distance]
        firsts.append(near)
        seconds.append(near + step)
        step += 1
        at = at[left[at] >= step]
    if firsts:
        label = _settle(label, np.concatenate(firsts), np.concatenate(seconds))
    moved = np.flatnonzero((label != np.arange(len(values))) & (values[label] != values))
    return values[moved], values[label[moved]]


def near_links(prints: DataFrame, distance: int = 3, tile: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within the distance.

    Each fingerprint probes every key within its part's threshold; those that meet on a key are compared
    in full, and a bucket gives a spanning forest of its links, never its pairs. Buckets of more than
    `tile` fingerprints are cut into tiles by hash and every two tiles are compared in a task of their own.
    """
    scheme = choose_scheme(prints, distance)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            values = signed.view(np.uint64)
            for i, (part, threshold) in enumerate(scheme):
                base = part_key(values, part)
                for k in range(threshold + 1):
                    for flipped in combinations(range(len(part)), k):
                        key = base ^ np.uint64(sum(1 << b for b in flipped))
                        yield pa.record_batch([pa.array(np.full(len(values), i, np.int32)), pa.array(key.view(np.int64)), pa.array(signed)], names=["part", "key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = bucket_links(np.concatenate([g for g, _ in parts]), np.concatenate([v for _, v in parts]).view(np.uint64), distance)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
            if cut:  # every group before the batch's last one is whole now
                yield links([*held, (group[:cut], values[:cut])])
                held = []
            elif held and held[-1][0][-1] != group[0]:
                yield links(held)
                held = []
            held.append((group[cut:], values[cut:]))
        if held:
            yield links(held)

    keyed = prints.select("fp").mapInArrow(probe, "part int, key long, fp long")
    large = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    tiles = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")
    placed = keyed.join(large, ["part", "key"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
    placed = placed.select("part", "key", "fp", "own", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    bucket = F.xxhash64("part", "key", F.least("own", "other"), F.greatest("own", "other"))
    buckets = placed.select(bucket.alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return buckets.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Texts are lower-cased in A-Z and cut at ASCII white space; fewer words than a shingle form one. Documents
    whose fingerprints differ in at most `distance` bits are linked, and component_id is the smallest doc_id
    reachable. Null texts count as empty: without words the fingerprint is zero, linked like any other. Null
    ids never name a component unless it has no other. Equal rows stay separate rows; no rows give no rows.
    """
    prints = stored(fingerprints(documents, words))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected(near_links(distinct, distance))
    rooted = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """Of each group one document with all its columns: the smallest doc_id (null ids last), of equal rows one."""
    texts = documents.select(text_key().alias("doc_id"), "text")
    named = near_duplicates(texts, distance, words).select(F.col("doc_id").alias("node"), F.col("component_id").alias("root"))
    return first_of_groups(documents, named.distinct())


def checked_links(documents: DataFrame, distance: int = 3, words: int = 3, least: float = 0.8) -> DataFrame:
    """Links (a, b) between text keys whose fingerprints are within `distance` bits and whose five-word shingles overlap by `least` or more.

    Texts of one fingerprint meet its smallest text key, linked fingerprints meet by theirs; each pair is compared exactly.
    """
    texts = stored(documents.select(text_key().alias("node"), "text").dropDuplicates(["node"]))
    prints = stored(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), words))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    name = lambda side: distinct.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node"))
    across = near_links(distinct, distance).join(name("a"), "a").join(name("b"), "b").select("a_node", "b_node")
    within = prints.join(distinct, "fp").filter("doc_id <> first").select(F.col("first").alias("a_node"), F.col("doc_id").alias("b_node"))
    text = lambda side: texts.select(F.col("node").alias(f"{side}_node"), F.col("text").alias(f"{side}_text"))
    pairs = stored(across.unionByName(within)).join(text("a").hint("merge"), "a_node").join(text("b").hint("merge"), "b_node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two = (c.to_pylist() for c in batch.columns)
            near = [i for i in range(len(a)) if overlap(shingles(one[i]), shingles(two[i])) >= least]
            yield pa.record_batch([pa.array([side[i] for i in near], pa.binary()) for side in (a, b)], names=["a", "b"])

    return pairs.select("a_node", "b_node", "a_text", "b_text").mapInArrow(check, "a binary, b binary")


def drop_near_copies(documents: DataFrame, distance: int = 3, words: int = 3, least: float = 0.8) -> DataFrame:
    """One document of each group linked by an overlap of `least` or more between their five-word shingles; the smallest doc_id stays.

    SimHash gives the first links, each checked on the whole texts. An overlap of 0.8 moves most fingerprints by more than
    3 bits; the links that those bits cannot reach are added, and groups are formed over both.
    """
    found = stored(checked_links(documents, distance, words, least).unionByName(similar_links(documents, least)))
    nodes = documents.select(text_key().alias("node")).distinct()
    groups = nodes.join(connected(found.distinct()), "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    return first_of_groups(documents, groups)
