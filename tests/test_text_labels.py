import re

from pyspark.sql import functions as F

from maskwright.functions import labels as L
from maskwright.functions import text as X
from maskwright.operators import dictionaries as D
from maskwright.operators import rules as R


def one(spark, ddl, row, **columns):
    return spark.createDataFrame([row], ddl).select(*[v.alias(k) for k, v in columns.items()]).first()


def test_tokenize_label_render(spark):
    rows = spark.createDataFrame([("It's absolutely wonderful!",)], "text string").withColumn("words", X.words(F.col("text")))
    rows = rows.withColumn("labels", D.lexicon_labels("words"))
    got = rows.select("words", "labels", X.redact(F.col("words"), F.col("labels")).alias("shown"),
                      X.redact(F.col("words"), F.col("labels"), None).alias("kept")).first()
    assert got.words == ["It's", "absolutely", "wonderful", "!"]
    assert got.labels == [0, 1, 1, 0]
    assert got.shown == "It's [REDACTED] [REDACTED]!" and got.kept == "It's!"


def test_offsets(spark):
    got = one(spark, "text string", ("I took Lexapro for anxiety.",), w=X.word_offsets("text")).w
    assert (got[2].start, got[2].end) == (7, 14)


def test_offsets_tile_long_and_odd_texts(spark):
    pattern = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]")
    texts = ["", "   ", "a", " ".join(f"w{i}" for i in range(5000)), "日本語 テキスト, naïve ’x", "x\u0085y z​", "\n\ta  b\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in rows.select("text", X.word_offsets("text").alias("w")).collect():
        assert [tuple(x) for x in r.w] == [(m.group(), m.start(), m.end()) for m in pattern.finditer(r.text)]


def test_spans_and_errors(spark):
    got = one(spark, "l array<int>, w array<string>", ([0, 0, 1, 0, 1, 0], ["a"] * 6), s=L.labels_to_spans("l"), e=L.label_error("w", "l"))
    assert [tuple(s) for s in got.s] == [(2, 3), (4, 5)] and got.e is None
    assert one(spark, "l array<int>, w array<string>", ([0, 2], ["a", "b"]), e=L.label_error("w", "l")).e == "every label must be integer 0 or 1"
    assert one(spark, "l array<int>, w array<string>", ([0], ["a", "b"]), e=L.label_error("w", "l")).e == "expected 2 labels, got 1"


def test_label_words_matches_brute_force(spark):
    import random
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words, at = [], 0
        for _ in range(rng.randint(0, 300)):
            at += rng.randint(0, 2)
            end = at + rng.randint(1, 6)
            words.append(("w", at, end))
            at = end
        spans = [(s, s + rng.randint(1, 15), f"t{k}") for k, s in enumerate(rng.sample(range(at + 20), min(at, 25)))]
        rows.append((i, words, spans))
    df = spark.createDataFrame(rows, "i int, w array<struct<word:string,start:int,end:int>>, s array<struct<start:int,end:int,type:string>>")
    for r in df.select("*", L.label_words("w", "s").alias("l"), L.type_words("w", "s").alias("t")).collect():
        first = [next((s.type for s in r.s if w.start < s.end and s.start < w.end), "O") for w in r.w]
        assert r.t == first and r.l == [int(t != "O") for t in first]


def test_rules_find_every_kind(spark):
    text = ("Andrew's 25mg dose, id 1234567 or 555-1234, a.b@c.org, https://x.org/q?a=1, @handle_x, 12345-6789, 3/4/2001, bad\x92char, 5%x")
    got = one(spark, "text string", (text,), s=R.rule_spans("text"), old=R.rule_spans("text", R.rules_as_of("1.3")))
    kinds = {s.type for s in got.s}
    assert kinds == {r.name for r in R.RULES}
    assert all(text[s.start:s.end] == s.hit for s in got.s)
    assert {s.type for s in got.old} == {"glued_dosage", "c1_control", "possessive", "long_identifier"}
    assert len(R.policy_id("m", "1.4").split("@")[1]) == 16 and R.policy_id("m", "1.3") != R.policy_id("m", "1.4")


def test_outcomes(spark):
    cases = [([1, 0], [0, 1], "missed+overmask"), ([1], [0], "missed"), ([0], [1], "overmask"), ([1], [1], "agreement"), ([1, 0], [1, None], "truncated")]
    df = spark.createDataFrame([(g, p, o) for g, p, o in cases], "g array<int>, p array<int>, o string")
    assert all(r.o == r.x for r in df.select("o", L.outcome("g", "p").alias("x")).collect())


def test_clean_text(spark):
    got = one(spark, "text string", ('  "Tom &amp;\n Jerry&#39;s"  ',), t=X.clean_text(F.col("text")), v=X.code_point(F.lit("​")))
    assert got.t == "Tom & Jerry's" and got.v == "U+200B"


def test_signature_is_full_case_folding(spark):
    letters = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i)]
    texts = ["Straße ﬁn ŉ ΟΔΟΣ", *["".join(letters[i:i + 40]) for i in range(0, len(letters), 40)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.signature(F.col("t")).alias("s")).collect()
    differing = {c for r in rows for c, d in [(r["t"], r["s"])] if d != c.casefold()}
    assert not differing
