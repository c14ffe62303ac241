"""The pipeline's stages on planted cases and edge rows, and its registered queries."""

import random
from collections import defaultdict

import __spark_entry__
import corpus_pipeline
from maskwright.llm import exact, overlap, toxicity
from maskwright.llm.common import read, stored
from maskwright.llm.components import connected
from tests.conftest import SMALL


def test_stages_take_effect(spark):
    folder = f"{SMALL[:-5]}0.01"
    docs = read(spark, folder, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder))
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns, name
        docs = out
    before, clean = seen["toxicity"]
    model = toxicity.train(before, read(spark, folder, "labels"))
    rejected = {r["doc_id"] for r in toxicity.score_documents(before, model).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()} - rejected
    before, after = seen["exact dedup"]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in exact.exact_duplicates(before).filter("kept").collect()}
    before, after = seen["SimHash near-dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == set(first_of_overlaps(texts).values())
    before, after = seen["mixing"]
    assert after.count() > 0 and {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    copies = after.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert copies <= 3
    pieces = defaultdict(list)
    for r in seen["packing"][1].collect():
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in pieces.values():
        assert [o for o, _ in sorted(parts)] == [sum(x for _, x in sorted(parts)[:i]) for i in range(len(parts))]


def test_stages_on_empty_tables(spark):
    folder = f"{SMALL[:-5]}0.01"
    docs = read(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == [], name


def test_registration():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def shingle_set(text):
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else {tuple(words)}


def share(a, b):
    return len(a & b) / len(a | b)


def first_of_overlaps(texts, least=0.8):
    """The smallest id linked to each id by shingle overlaps of `least` or more; only texts that share a shingle are compared."""
    sets = {i: shingle_set(t or "") for i, t in texts.items()}
    root, holders = {i: i for i in sets}, defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in {j for s in sets[i] for j in holders[s]}:
            if share(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: find(i) for i in sets}


def test_near_dedup_finds_planted_overlaps(spark):
    """Pairs planted at an overlap of 0.8 to 0.95, pairs just below, and many that only share a passage."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(120))
    rows, near, below = [], [], []
    for i in range(0, 400, 2):
        words = [word() for _ in range(300)]
        other, goal = list(words), rng.uniform(0.7, 0.95)
        while share(shingle_set(" ".join(words)), shingle_set(" ".join(other))) > goal:
            other[rng.randrange(300)] = word()
        overlap = share(shingle_set(" ".join(words)), shingle_set(" ".join(other)))
        (near if overlap >= 0.8 else below).append(i)
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(60)]  # overlap of about a half
    rows += [(2000, "a few words"), (2001, "A few\nwords"), (2002, "a few word"), (3000, "one id, two texts"), (3000, "the other text of that id"),
             (None, "no id at all here"), (None, "no id  at all here"), (3001, rows[0][1]), (3002, ""), (3003, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    ids = [r["doc_id"] for r in kept]
    assert all(i in ids for i in range(0, 400, 2)) and all(i + 1 in ids for i in below) and all(1000 + i in ids for i in range(60))
    assert len(near) > 80 and len(below) > 40 and not any(i + 1 in ids for i in near)
    assert ids.count(2000) == 1 and 2001 not in ids and 2002 in ids and ids.count(3000) == 2 and ids.count(None) == 1 and 3001 not in ids
    assert 3002 in ids and 3003 not in ids


def test_near_dedup_large_buckets(spark):
    """A group over many tiles, linked in chains, against brute force."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        own = list(rng.choice(texts).split()) if texts else list(base)
        own[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if share(sets[a], sets[b]) >= 0.8 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keys = {r["node"]: r["doc_id"] for r in docs.select("doc_id", overlap.text_key().alias("node")).collect()}
    found = {keys[r["node"]]: r["component"] for r in connected(overlap.similar_links(docs, tile=20)).collect()}
    mine = [found.get(i, f"own {i}") for i in range(len(texts))]
    for node, i in keys.items():
        mine[i] = node if i not in found else mine[i]
    assert len(set(zip(mine, label, strict=True))) == len(set(mine)) == len(set(label))


def test_near_dedup_rest_of_a_bucket(spark):
    """One bucket of a large group, a smaller one and texts of their own: tiles find the groups, the rest meets every tile."""
    rng = random.Random(14)
    words = [f"w{i}" for i in range(200)]
    edits = [0] * 90 + [45] * 60  # few changed words, and so many that a text is near to few others
    texts = []
    for e in edits:
        changed = set(rng.sample(range(200), 1 + e // 8))
        texts.append(" ".join(f"x{rng.randrange(10**6)}" if k in changed else w for k, w in enumerate(words)))
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if share(sets[a], sets[b]) >= 0.8 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r["node"]: r["doc_id"] for r in docs.select("doc_id", overlap.text_key().alias("node")).collect()}
    found = {keys[r["node"]]: r["component"] for r in connected(overlap.similar_links(docs, tile=10)).collect()}
    mine = [found.get(i, node) for node, i in sorted(keys.items(), key=lambda x: x[1])]
    assert len(set(zip(mine, label, strict=True))) == len(set(mine)) == len(set(label))
    hashes = [overlap.shingles(t) for t in texts[:40]]
    assert overlap.forest(hashes, 0.8, [0] * 40) == [] and len(overlap.forest(hashes, 0.8, [i % 2 for i in range(40)])) <= 1
