import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import perturb as N

PYTHON_TOKEN = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")


def labelled(spark, *rows):
    df = spark.createDataFrame(
        [(str(i), text, labels, "d") for i, (text, labels) in enumerate(rows)],
        "id string, text string, labels array<int>, dataset_name string")
    return df.withColumn("words", X.words(F.col("text")))


def pairs_of(spark, group, *rows):
    return {(r.source_id, r.noise_type): r for r in N.build_pairs(labelled(spark, *rows), group).collect()}


def test_double_space_keeps_gold(spark):
    got = pairs_of(spark, "seen", ("She has blurred vision today.", [0, 0, 1, 1, 0, 0]))[("0", "double_space")]
    assert "blurred  vision" in got.text
    assert [w for w, l in zip(got.words, got.labels) if l] == ["blurred", "vision"]


def test_dosage_join(spark):
    got = pairs_of(spark, "seen", ("Paxil 25 mg daily.", [1, 1, 1, 0, 0]))[("0", "dosage_join")]
    assert got.text == "Paxil 25mg daily."
    assert [w for w, l in zip(got.words, got.labels) if l] == ["Paxil", "25mg"]
    assert got.edit["number"] == "25" and got.edit["unit"] == "mg"


def test_c1_apostrophe(spark):
    got = pairs_of(spark, "seen", ("Andrew's chart.", [1, 0, 0]))[("0", "c1_apostrophe")]
    assert got.text.count("\x92") == 1 and len(got.text) == len(got.clean_text)
    assert got.labels[:3] == [1, 1, 1]


def test_zero_width(spark):
    got = pairs_of(spark, "unseen", ("Phentermine works.", [1, 0, 0]))[("0", "zero_width_inside")]
    assert got.words[:3] == ["Phent", "​", "ermine"] and got.labels[:3] == [1, 0, 1]
    assert got.edit["new"] == "U+200B"


def test_groups():
    seen, unseen = ({n.name for n in N.noises(g)} for g in ("seen", "unseen"))
    assert (len(seen), len(unseen)) == (5, 7) and not seen & unseen
    assert {n.name for n in N.noises("all")} == seen | unseen
    assert len(N.noises("future")) == 7
    with pytest.raises(ValueError):
        N.noises("other")


def test_catalog_agrees(spark):
    both = N.catalog(spark)
    assert N.catalog_mismatches(both, both).count() == 0
    assert N.catalog_mismatches(both, both.filter("noise_type <> 'nbsp'")).count() == 1


def brute(text, words, labels, noise):
    """Independent character-mask version used only to check the operator."""
    spots = [(m.start(), m.end()) for m in PYTHON_TOKEN.finditer(text)]
    mask = [0] * len(text)
    for (s, e), l in zip(spots, labels):
        for k in range(s, e):
            mask[k] = l
    cut = None
    for i, ((s, e), w, l) in enumerate(zip(spots, words, labels)):
        nxt = spots[i + 1] if i + 1 < len(spots) else None
        both = nxt and l and labels[i + 1] and nxt[0] > e
        if noise.family == "space" and both:
            cut = (e, nxt[0], s, nxt[1])
        if noise.family == "dosage" and both and re.fullmatch(r"\d+", w) and words[i + 1].lower().rstrip(".") in (
                "mg", "mcg", "g", "kg", "ml", "l", "iu", "units", "unit", "mm", "cm"):
            cut = (e, nxt[0], s, nxt[1])
        if noise.family == "apostrophe" and l and re.search("['’]", w):
            at = s + re.search("['’]", w).start()
            cut = (at, at + 1, s, e)
        if noise.family == "punctuation" and l and any(c.isdigit() for c in w) and text[e:e + 1] not in tuple(",;:"):
            cut = (e, e, s, e)
        if noise.family == "inside" and l and len(w) >= 5 and w.isalpha():
            cut = (s + len(w) // 2, s + len(w) // 2, s, e)
        if cut:
            break
    if not cut:
        return None
    a, b, ts, te = cut
    new = text[:a] + noise.replacement + text[b:]
    new_mask = mask[:a] + [noise.masked] * len(noise.replacement) + mask[b:]
    toks = [(m.group(), int(any(new_mask[m.start():m.end()]))) for m in PYTHON_TOKEN.finditer(new)]
    grow = len(noise.replacement) - (b - a)
    return new, [t[0] for t in toks], [t[1] for t in toks], (ts, te + grow if a < te else te)


@pytest.mark.parametrize("group", ["all", "future"])
def test_pairs_match_character_masks(spark, group):
    import random
    rng = random.Random(7)
    pieces = ["Andrew's", "dogs'", "'quote'", "cat-'x", "25", "mg", "2.5", "mL.", "5-10", "(7)", "blurred", "vision",
              "naïve", "٣٣", "x²", "ab’s-c", "-", "’tis", "units,", "12;", "Müller", "​zero", "é", "日本語テキスト", "a'-'b"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "  ", " ", "", ", ", "\n"]) for _ in range(rng.randint(1, 14)))
        n = len(PYTHON_TOKEN.findall(text))
        rows.append((text, [rng.randint(0, 1) for _ in range(n)]))
    got = pairs_of(spark, group, *rows)
    expected = {}
    for i, (text, labels) in enumerate(rows):
        words = PYTHON_TOKEN.findall(text)
        for noise in N.noises(group):
            made = brute(text, words, labels, noise)
            if made:
                expected[(str(i), noise.name)] = made
    assert got.keys() == expected.keys() and len(expected) > 300
    for key, (text, words, labels, target) in expected.items():
        r = got[key]
        assert (r.text, r.words, r.labels) == (text, words, labels), key
        assert (r.noisy_target.start, r.noisy_target.end) == target, key
        spots = [(m.start(), m.end()) for m in PYTHON_TOKEN.finditer(text)]
        assert r.target_words == [i for i, ((s, e), l) in enumerate(zip(spots, labels)) if l and s < target[1] and target[0] < e]


def test_cap(spark):
    rows = labelled(spark, *[("blurred vision", [1, 1])] * 4)
    pairs = N.build_pairs(rows, "seen")
    assert N.cap_per_noise(pairs, 0, "source_id").count() == 4
    assert [r.source_id for r in N.cap_per_noise(pairs, 3, "source_id").orderBy("source_id").collect()] == ["0", "1", "2"]
