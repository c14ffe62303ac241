"""Merkle manifest, fill-in-middle and substring deduplication against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from maskwright.llm import fim, merkle, substrings
from maskwright.llm.common import repeat_rows

CLASH = ("grp", "chunk", "low", "leaf", "at", "copies", "tie", "spans", "kept", "form", "output", "h1", "cuts", "n")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["one", "two", "three", "vier", "日本", "été", "\x1cx", "a b"]
    passage = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(60))
    long = "\n".join(" ".join(rng.choice(words) + str(rng.randint(0, 10**6)) for _ in range(9)) for _ in range(9000))
    out = [(None, None, None, None, None), (None, "no id", "en", "a", 5), (None, passage, "en", None, 3), (None, passage, "en", None, 3),
           (1, "", "en", "a", 0), (2, " \t\n ", None, "b", 4), (3, None, "de", "b", None), (4, passage + " " + passage, "en", "a", 9),
           (5, "x " + passage, "", "a", 2), (5, "x " + passage, "", "a", 2), (5, "another text of this id " + passage, "", "a", 2),
           (7, long, "en", "c", len(long)), (8, long + "\nend", "en", "c", 1), (9, "a <S> in here\n" * 3, "de", "a", 2), (-70000, "negative id\n\n\n", "en", "a", 1),
           (2**40, "w " * 500, "en", "a", 8), (-(1 << 63), passage[5:], "en", "a", 8), (11, "\n" * 70000, "fr", "a", 8), (12, "no line feed", "fr", "a", 8)]
    for i in range(300):
        text = "\n".join(" ".join(rng.choice(words[:3]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9)))
        if i % 7 == 0:
            text += " " + passage[rng.randint(0, 60):]
        out.append((100 + 977 * i, text, rng.choice(["en", "en", "de"]), "s", len(text)))
    return out


@pytest.fixture(scope="module")
def documents(spark, rows):
    return table(spark, rows)


def leaf_of(row, n_chars):
    doc_id, text, lang, source, _ = row
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*[field(v) for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """(root, siblings of each leaf) of a binary tree."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(spots):
            if at ^ 1 < len(nodes):
                paths[i].append(nodes[at ^ 1])
            spots[i] = at >> 1
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees.append((own, *tree([leaf_of(r, r[4]) for r in own])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            struck = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            out.append((r[0], leaf_of(r, r[4]), subroot, root, sha(*path, *top), not struck))
    return out


@pytest.mark.parametrize("bits", [2, 12])
def test_manifest(documents, rows, bits, monkeypatch):
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda d, altered: whole(d, altered, bits))
    got = merkle.verified_documents(documents).collect()
    text = lambda r: tuple(str(x) for x in r)
    assert sorted(text((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"])) for r in got) == sorted(map(text, manifest(rows)))
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in got)
    assert any(not r["verified"] for r in got)


def test_manifest_edges(spark):
    assert merkle.verified_documents(table(spark, [])).collect() == []
    row = (None, "t", None, None, None)
    got = merkle.manifest(table(spark, [row])).collect()
    assert [(r["leaf"], r["root"], r["proof"], r["at"], r["verified"]) for r in got] == [(leaf_of(row, None),) * 2 + ([], 0, True)]
    two = [(1, "t", "a", "s", 1), (1, "t", "b", "s", 1)]
    assert {r["root"] for r in merkle.manifest(table(spark, two)).collect()} == {sha(*[leaf_of(r, 1) for r in two])}
    # a wrong sibling, leaf or place does not fold to the root
    nodes = [sha(str(i)).encode() for i in range(11)]
    slots = merkle.Slots(nodes, merkle.depth(11))
    root = slots.levels[-1][0]
    for i, node in enumerate(nodes):
        assert merkle.fold(node, i, slots.siblings(i)) == root
        assert merkle.fold(sha("x").encode(), i, slots.siblings(i)) != root
        assert merkle.fold(node, (i + 1) % 10, slots.siblings(i)) != root


@pytest.mark.parametrize("size", [1, 40, 256, 257, 4000])
def test_rank_bitmap(size):
    rng = np.random.default_rng(size)
    low = np.sort(rng.choice(merkle.SPAN, size, replace=False))
    counts = np.where(rng.random(size) < 0.2, rng.integers(2, 10**6, size), 1)
    cut = rng.integers(0, size + 1)
    halves = [(low, counts), (low[:cut], counts[:cut])] if cut else [(low, counts)]
    data, total = merkle.RankBitmap.merge([merkle.RankBitmap.pack(*h) for h in halves])
    counts = counts + np.where(np.arange(size) < cut, counts, 0)
    assert total == counts.sum()
    bitmap = merkle.RankBitmap(data)
    assert np.array_equal(bitmap.elements()[0], low) and np.array_equal(bitmap.elements()[1], counts)
    assert np.array_equal(bitmap.rank(low), np.cumsum(counts) - counts)
    assert np.array_equal(bitmap.repeats(low), counts > 1)


@pytest.mark.parametrize("kind", ["array", "bitmap", "run", "mixed"])
def test_boundary_set(kind):
    rng = np.random.default_rng(3)
    parts = {"array": np.unique(rng.integers(0, 1 << 20, 4000)), "bitmap": np.unique(rng.integers(0, 1 << 18, 90_000)), "run": np.arange(100_000, 300_000)}
    offsets = parts.get(kind, np.unique(np.concatenate([parts["array"], parts["run"], parts["bitmap"] + (1 << 21)])))
    found = fim.BoundarySet(offsets)
    kinds = {c[0] for c in found.containers}
    assert kinds == {"array", "bitmap", "run"} if kind == "mixed" else kinds == {kind}
    assert len(found) == len(offsets)
    for rank in [0, len(offsets) - 1, *rng.integers(0, len(offsets), 500).tolist()]:
        assert found.select(rank) == offsets[rank]
    with pytest.raises(IndexError):
        found.select(len(offsets))


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'-' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(spark, documents, rows):
    got = [tuple(r) for r in fim.cut_documents(documents).collect()]
    assert sorted(map(str, got)) == sorted(str(cut_by_hand(r[0], r[1])) for r in rows)
    assert fim.cut_documents(table(spark, [])).collect() == []
    some = fim.fill_in_middle(documents, rate=40, spm=0).collect()
    assert {r["form"] for r in some} == {"plain", "psm"} and 0.45 < sum(r["form"] == "plain" for r in some) / len(some) < 0.75
    assert all((r["prefix"] or "") + (r["middle"] or "") + (r["suffix"] or "") == (r["output"] if r["form"] != "plain" else "").replace(
        "<P>", "", 1).replace("<S>", "", 1).replace("<M>", "", 1) or r["form"] == "psm" for r in some)
    with pytest.raises(ValueError):
        fim.fill_in_middle(documents, sentinels=("<P>", "<P>x", "<M>"))


def removed_by_hand(rows, window):
    """(doc_id, n_words, spans, kept) of each row."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    seen, out = set(), []
    for r in order:
        words = split(r[1])
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i:i + window])
            if run in seen:
                gone[i:i + window] = [True] * window
            seen.add(run)
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out.append((r[0], len(words), spans, " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("window", "flush", "per_range"), [(20, 2_000_000, 2_000_000), (3, 50, 30), (1, 700, 4000)])
def test_substrings(spark, documents, rows, window, flush, per_range):
    if window < 20:
        rows = [r for r in rows if len(r[1] or "") < 5000]
        documents = table(spark, rows).repartition(7)
    got = substrings.drop_repeated_substrings(documents, window, per_range, flush).collect()
    assert sorted(str((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"] or []], r["kept"])) for r in got) == sorted(
        map(str, removed_by_hand(rows, window)))
    assert substrings.drop_repeated_substrings(table(spark, [])).collect() == []


def test_hot_passage_in_many_tasks(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"a{i} b{i} {passage} c{i}", "en", "s", 1) for i in range(3000)] + [(9000 + i, "same " * 50, "en", "s", 1) for i in range(1500)]
    got = {r["doc_id"]: r for r in substrings.drop_repeated_substrings(table(spark, rows).repartition(23), flush=5000).collect()}
    assert got[0]["spans"] is None and got[0]["kept"] == rows[0][1]
    assert all([tuple(s) for s in got[i]["spans"]] == [(2, 42)] and got[i]["kept"] == f"a{i} b{i} c{i}" for i in range(1, 3000))
    assert [tuple(s) for s in got[9000]["spans"]] == [(1, 50)] and all(got[9000 + i]["kept"] == "" for i in range(1, 1500))


def test_places_round_trip():
    rng = np.random.default_rng(1)
    for tied in (False, True):
        ids = np.unique(np.concatenate([rng.integers(-2**62, 2**62, 50), np.arange(300), [-(1 << 63), (1 << 63) - 1]]))
        counts = rng.integers(1, 40, len(ids))
        places = np.concatenate([np.sort(rng.choice(rng.choice([60, 5000, 10**6]), n, replace=False)) for n in counts])
        ties = np.array([rng.bytes(17) for _ in ids], "S17") if tied else None
        back = substrings.unpack_places(substrings.pack_places(ids, ties, counts, places))
        assert np.array_equal(back[0], ids) and np.array_equal(back[2], counts) and np.array_equal(back[3], places)
        assert back[1] is None if not tied else np.array_equal(back[1], ties)


def test_rolling_hash():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 70_000).astype(np.uint64)
    for window in (1, 2, 20):
        got = substrings.RollingHash(substrings.BASES[0], window)(values)
        for at in (0, 1, 65_535, 65_536, len(values) - window):
            want = sum(int(v) * pow(substrings.BASES[0], i, 1 << 64) for i, v in enumerate(values[at:at + window])) % (1 << 64)
            assert int(got[at]) == want
        assert len(got) == len(values) - window + 1


def test_words_in_pieces():
    text = ("été  x\t\n日本 " * 500).encode()
    for piece in (1, 7, 100, 10**6):
        assert [w for part in substrings.words_of(text, piece) for w in part] == text.split()


def test_repeat_rows(spark):
    rows = spark.createDataFrame([(1, 1), (2, 25_000), (3, 10_000), (4, 10_001)], "a int, n long")
    got = repeat_rows(rows, "n", "i").groupBy("a").agg({"i": "max", "*": "count"}).collect()
    assert {r["a"]: (r["count(1)"], r["max(i)"]) for r in got} == {1: (1, 0), 2: (25_000, 24_999), 3: (10_000, 9_999), 4: (10_001, 10_000)}
