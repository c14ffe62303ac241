"""Near copies by exact shingle overlap: MinHash bands give candidates, every bucket is compared in full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.llm.common import stored
from maskwright.llm.components import connected

BANDS, WIDTH = 20, 5
_rng = np.random.default_rng(20)
_TURN = _rng.integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Ascending distinct XXH64 hashes of the text's shingles; fewer words than a shingle form one."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    runs = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs)), ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed long per band, equal for two texts with the chance of (their overlap) ** WIDTH."""
    least = np.full(BANDS * WIDTH, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        turned = (hashes[None, at:at + 2048] ^ _TURN[:, None]) * _FACTOR[:, None]
        least = np.minimum(least, (turned ^ (turned >> np.uint64(32))).min(axis=1))
    rows = least.reshape(BANDS, WIDTH)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=b) - (1 << 63) for b, row in enumerate(rows)]


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles over all shingles of two ascending sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def forest(sets: list[np.ndarray], least: float, roots: list[object] | None = None) -> list[tuple[int, int]]:
    """Links that join exactly what pairs of overlap `least` or more join; pairs already joined are not compared.

    roots: what each set is joined with already; those of one root are joined without a link.
    """
    groups: list[tuple[set[object], list[int]]] = []
    links = []
    for i, own in enumerate(sets):
        joined, apart = ({i if roots is None else roots[i]}, [i]), []
        for group in sorted(groups, key=lambda g: g[0].isdisjoint(joined[0])):  # its own group first
            near = not group[0].isdisjoint(joined[0])
            if not near:
                for j in group[1]:
                    small, large = sorted((len(own), len(sets[j])))
                    if small >= least * large and overlap(own, sets[j]) >= least:
                        links.append((i, j))
                        near = True
                        break
            if near:
                joined = (group[0] | joined[0], group[1] + joined[1])
            else:
                apart.append(group)
        groups = [*apart, joined]
    return links


def text_key() -> F.Column:
    """128 bits for the text; equal texts share them. Null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def similar_links(documents: DataFrame, least: float = 0.8, words: int = 5, tile: int = 512) -> DataFrame:
    """Links (a, b) between text keys that connect the texts whose shingles overlap by `least` or more.

    Texts meet in BANDS bands of WIDTH minima each: at an overlap of 0.8 all but (1 - 0.8 ** 5) ** 20 = 0.04% of the
    pairs do. All members of a bucket are compared on their whole sets, in a spanning forest; buckets with the same
    members count once. Buckets of more than `tile` are cut into tiles. First each tile is compared with itself and
    with its bucket's smallest member, which most near copies join. Then only members of different groups have to
    meet: those outside their bucket's largest group are compared with every tile, those inside with none of their own.
    Null texts are empty ones; rows without any pair, and empty tables, give no links.
    """
    texts = documents.select(text_key().alias("node"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(shingles(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, roots, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            pairs = forest(sets, least, roots)
            return pa.record_batch([pa.array([nodes[i] for i, _ in pairs], pa.binary()), pa.array([nodes[j] for _, j in pairs], pa.binary())], names=["a", "b"])

        for batch in batches:
            for own, node, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    if len(nodes) > 1:
                        yield links()
                    bucket, nodes, roots, sets = own, [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(shingles(text, words))
        if len(nodes) > 1:
            yield links()

    def met(placed: DataFrame) -> DataFrame:
        rows = placed.join(company, "node").select("bucket", "node", "root", "text")
        return rows.repartition("bucket").sortWithinPartitions("bucket", "root", "node").mapInArrow(compare, "a binary, b binary")

    signed = stored(texts.mapInArrow(sign, "node binary, keys array<long>").dropDuplicates(["node"]))
    keyed = signed.select("node", F.explode("keys").alias("key"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head"), *members).filter("n > 1")
    chosen = buckets.groupBy("n", "m1", "m2").agg(F.min("key").alias("key"), F.min("head").alias("head"))
    chosen = stored(chosen.select("key", "head", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("own")
    placed = stored(keyed.join(chosen.drop("head"), "key").select("key", "node", "tiles", own))
    heads = chosen.filter("tiles > 1").select("key", F.col("head").alias("node"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("own"))
    company = stored(texts.join(placed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    tiled = placed.select("key", "node", "own").unionByName(heads).distinct()
    first = stored(met(tiled.select(F.xxhash64("key", "own").alias("bucket"), "node", F.col("node").alias("root"))).distinct())

    groups = connected(first)
    wide = placed.filter("tiles > 1").join(groups, "node", "left").select("key", "node", "tiles", "own", F.coalesce("component", "node").alias("root"))
    wide = stored(wide)
    most = wide.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key").agg(
        F.max(F.struct("size", F.col("root").alias("main"))).alias("top"), F.count("*").alias("groups"))
    rest = wide.join(most.filter("groups > 1").select("key", "top.main"), "key").withColumn("open", F.col("root") != F.col("main"))
    left = rest.filter("open").groupBy("key", "own").agg(F.lit(True).alias("has")).select("key", F.col("own").alias("other"))
    # the rest of a tile meets every other tile of its bucket; two tiles without any rest never meet
    pairs = rest.filter("open").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).filter("own <> other")
    inside = rest.filter("not open").join(left, "key").filter("own <> other")
    both = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    again = pairs.select("key", "node", "root", *both).unionByName(inside.select("key", "node", "root", *both))
    second = met(again.select(F.xxhash64("key", "low", "high").alias("bucket"), "node", "root"))
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second).distinct()


def first_of_groups(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: the smallest doc_id (null ids last), of equal rows one.

    groups: (node, root), the group of every text key.
    """
    rows = documents.withColumns({"__node": text_key(), "__id": F.xxhash64("doc_id", F.col("doc_id").isNull())})
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__node", "__id")
    placed = rows.select("doc_id", F.col("__node"), "__id").join(groups, F.col("__node") == groups["node"])
    heads = placed.groupBy("root").agg(F.min(order).alias("head")).select("head.__node", "head.__id")
    same = Window.partitionBy("__node", "__id").orderBy("__node")
    kept = rows.join(heads, ["__node", "__id"]).withColumn("__copy", F.row_number().over(same)).filter("__copy = 1")
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])


def drop_similar(documents: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """One document of each group linked by an overlap of `least` or more between their distinct shingles of `words` words.

    Texts are lower-cased in A-Z and cut at ASCII white space. The smallest doc_id of a group stays; texts without
    words are one group.
    """
    labels = connected(similar_links(documents, least, words))
    nodes = documents.select(text_key().alias("node")).distinct()
    groups = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    return first_of_groups(documents, groups)
