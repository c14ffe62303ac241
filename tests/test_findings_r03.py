"""One test for each finding of round 3 that was right."""

import re

from pyspark.sql import functions as F

from maskwright.functions import arrays, text as X
from maskwright.operators import perturb, review, robustness, rules, sampling, temporal

c = F.col


def test_rule_spans_compile_no_pattern_per_text_and_keep_offsets(spark):
    assert "split(" not in rules.rule_spans_sql("text")
    texts = ["Mail a.b@x.org, 50mg\nor 1234567 and\n\n3mg", "none", "", "𝔘 😀 7654321 Ann's 2kg" * 30, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for row in rows.select("text", rules.rule_spans("text").alias("s")).collect():
        for s in row.s or []:
            assert row.text[s.start:s.end] == s.hit
    numbers = rows.select("text", X.regex_spans("text", r"\p{Nd}+").alias("s")).filter("text is not null").collect()
    for row in numbers:
        assert [(s.start, s.end) for s in row.s] == [m.span() for m in re.finditer(r"\d+", row.text)]


def test_prefix_sums_of_short_and_long_arrays(spark):
    rows = spark.range(0, 2300, 31).selectExpr("transform(sequence(0, cast(id as int)), x -> x % 7) as v")
    empty = spark.range(1).selectExpr("cast(array() as array<int>) as v")
    for v, sums in rows.union(empty).select("v", F.expr(arrays.prefix_sums("v"))).collect():
        assert sums == [sum(v[:i + 1]) for i in range(min(len(v), 40))] + [s for s in sums[40:]] and (not v or sums[-1] == sum(v))


def test_near_dedup_gets_links_from_simhash(spark, monkeypatch):
    import corpus_pipeline
    from maskwright.llm import overlap, simhash

    base = " ".join(f"w{i}" for i in range(12))
    long, longer = " ".join([base] * 60), " ".join([base] * 60 + [f"t{i}" for i in range(8)])  # few bits, little overlap
    text = [f"u{i}" for i in range(900)]
    copy = [*text[:-1], "other"]
    apart, hashes = lambda a, b: bin(simhash.simhash(a) ^ simhash.simhash(b)).count("1"), lambda t: overlap.shingles(t)
    assert apart(long, longer) <= 3 and overlap.overlap(hashes(long), hashes(longer)) < 0.8 and apart(" ".join(text), " ".join(copy)) <= 3
    rows = [(1, long), (2, longer), (3, " ".join(text)), (4, " ".join(copy)), (5, "alone on its own here"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "a binary, b binary")
    for module in (overlap, simhash):
        monkeypatch.setattr(module, "similar_links", lambda *_, **__: none, raising=False)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 2, 3, 5, 6}


def _broadcasts(spark, rows):
    return [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoop" in line]


def test_joins_per_pair_and_document_do_not_pass_through_the_driver(spark):
    from workloads import QUERIES

    from tests.conftest import SMALL

    for name in ("joined_systems", "review_candidates", "source_predictions"):
        assert _broadcasts(spark, QUERIES[name](spark, SMALL)) == [], name
    # the smallest ids, one a noise type, are what is broadcast
    found = _broadcasts(spark, QUERIES["noise_examples"](spark, SMALL))
    assert len(found) == 1 and "BuildRight" in found[0]


def test_clean_text_of_a_source_is_kept_once(spark):
    rows = [(f"{s}::{n}", s, n, f"text {s}", ["text", s]) for s in "abc" for n in ("x", "y")]
    pairs = spark.createDataFrame(rows, "pair_id string, source_id string, noise_type string, clean_text string, clean_words array<string>")
    assert sorted(r.clean_text for r in robustness.sources_to_predict(pairs).collect()) == ["text a", "text b", "text c"]


def test_references_cut_before_their_semicolon_stay(spark):
    texts = ["a &amp; b &copy; &#65;&#x42; &quot;", "<title>the&amp;&amp</title>", "&am &nosuch; &ampx; &amp;quot;", None, "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", X.unescape_html(c("t"), closed=True).alias("closed"), X.unescape_html(c("t")).alias("all")).orderBy("i").collect()
    assert [r.closed for r in rows] == ["a & b © AB \"", "<title>the&&amp</title>", "&am &nosuch; &ampx; &quot;", None, "plain"]
    assert rows[1]["all"] == "<title>the&&</title>"


def test_a_cap_stores_few_rows_and_keeps_the_first(spark, monkeypatch):
    rows = spark.range(6000).selectExpr(
        "case when id % 3 = 0 then 'a' when id % 3 = 1 then null else 'b' end as g", "case when id < 4 then null else id * 7919 % 6007 end as o", "id")
    rows = rows.unionByName(spark.sql("select 'small' as g, 5L as o, -1L as id"))
    stored, cut = [], sampling.cut_lineage
    monkeypatch.setattr(sampling, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    found = sampling.cap_rows(rows, ["g"], "o", 9, part=16).collect()
    assert max(s.count() for s in stored) < 600
    wanted = []
    for g in ("a", None, "b", "small"):
        own = sorted((r for r in rows.collect() if r.g == g), key=lambda r: (r.o is not None, r.o))
        wanted += [(g, r.o) for r in own[:9]]
    assert sorted(map(str, wanted)) == sorted(str((r.g, r.o)) for r in found)


ODD = ["Mail Andrew’s a.b@x.org, 50 mg, 1234567; Ann's", "none", "", " \n ", "𝔘 😀 7654321 Ann's 2 kg. " * 20, None, "a\x01b\x02 5mg\x01", "x\x92y ’s 1/2/2020, 5 mg",
       "Velvet Copper", "x-5mg-y 12345-6789 @abc.d http://x.y/z", "\x02 \x01 1234567", "Thomas, Miriam; 1234567,"]


def _odd(spark):
    return spark.createDataFrame([(str(i), t, "d") for i, t in enumerate(ODD)], "id string, text string, dataset_name string")


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_places_from_marks_are_those_of_sums_over_arrays(spark, monkeypatch):
    from maskwright.functions import marks
    from workloads.robustness import SYSTEM

    monkeypatch.setattr(marks, "PART", 64)
    for chosen in (rules.RULES, SYSTEM, rules.rules_as_of("1.3"), ()):
        got = _odd(spark).select(
            rules.rule_labels("text", chosen).alias("a"), F.expr(rules.rule_labels_sql("text", chosen)).alias("b"),
            rules.rule_spans("text", chosen).alias("p"), F.expr(rules.rule_spans_sql("text", chosen)).alias("q"),
            X.word_offsets("text").alias("v"), F.expr(X.word_offsets_sql("text")).alias("w")).collect()
        assert all(r.a == r.b and r.p == r.q and r.v == r.w for r in got)
    parts = marks.in_parts(marks._label_lists, *[marks.pa.array([t, None, "", t] * 9) for t in ("\x01a\x02 \x01b\x02", "a \x01b\x02")])
    assert parts.to_pylist() == [[0, 1], None, [], [0, 1]] * 9


def test_keys_of_pairs_are_those_of_the_pairs(spark):
    from maskwright.session import with_once
    from workloads.robustness import SYSTEM

    rows = with_once(_odd(spark), words=X.words(c("text")), labels=rules.rule_labels("text", SYSTEM))
    for group in ("all", "seen", "future"):
        keys, pairs = perturb.pair_keys(rows, group), perturb.build_pairs(rows, group)
        assert keys.count() > 0 and sorted(keys.collect()) == sorted(pairs.select(*keys.columns).collect())


def test_a_source_is_moved_once_for_the_summary_of_its_pairs(spark):
    pairs = spark.createDataFrame([("a", "nbsp"), ("a", "nbsp"), ("b", "nbsp"), ("b", "dosage_join"), (None, "nbsp")], "source_id string, noise_type string")
    got = perturb.pair_summary(pairs)
    assert {(r.noise_type, r.pairs, r.unique_sources) for r in got.collect()} == {("nbsp", 4, 2), ("dosage_join", 1, 1), (None, 5, 2)}
    assert "Expand" not in _plan(got) and perturb.pair_summary(pairs.limit(0)).collect() == []


def test_a_short_list_per_group_reads_its_rows_once(spark):
    from workloads import QUERIES

    from tests.conftest import SMALL

    for name in ("disagreement_outcomes", "light_heavy_sample"):
        plan = _plan(QUERIES[name](spark, SMALL))
        assert plan.count("Scan parquet") == 1 and "WindowGroupLimit" in plan, name


def test_versions_of_a_text_stay_in_its_row_and_are_answered_once(spark):
    from maskwright.operators import leakage
    from workloads import QUERIES
    from workloads.metrics import versions

    from tests.conftest import SMALL

    rows = versions(spark, SMALL).limit(40)
    listed = leakage.condition_arrays(rows, 2, 42).select("id", "task_label", F.inline("versions"))
    assert sorted(listed.collect()) == sorted(leakage.conditions(rows, 2, 42).select(*listed.columns).collect())
    assert "Scan parquet" not in _plan(QUERIES["leakage_table"](spark, SMALL))  # only the checkpointed cells are read more than once


def test_spans_meet_their_note_where_both_lie(spark, monkeypatch):
    from maskwright.sources import tables
    from workloads import QUERIES

    from tests.conftest import SMALL

    plan = _plan(QUERIES["policy_labels_medical"](spark, SMALL))
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 2
    monkeypatch.setattr(tables, "PART_ROWS", 100)  # tasks grow in number with the rows, not in length
    assert "hashpartitioning(id#" in (plan := _plan(tables.order_notes(spark, SMALL))) and ", 15)" in plan


def test_features_of_words_are_hashed_as_sql_does(spark):
    from maskwright.operators import student

    lists = [["Ann's", "50", "mg", "of", "Of", "𝔘x", "Straße"], ["one"], [], None, ["a", "a", "a"], ["İI", "Σας", "x1-Y2"] * 9]
    rows = spark.createDataFrame([(str(i), w, [0] * len(w or [])) for i, w in enumerate(lists)], "id string, words array<string>, labels array<int>")
    at = lambda step: f"coalesce(lower(get(words, i + {step})), '<pad>')"
    shape = r"regexp_replace(regexp_replace(regexp_replace(w, '\\p{Lu}+', 'X'), '[\\p{L}&&[^\\p{Lu}]]+', 'x'), '\\p{Nd}+', '9')"
    parts = {"w=": "lower(w)", "s=": shape, "p=": "left(lower(w), 3)", "e=": "right(lower(w), 3)", "-1=": at(-1), "-2=": at(-2), "+1=": at(1), "+2=": at(2)}
    wanted = "transform(words, (w, i) -> array_distinct(array(" + ", ".join(
        student.linear.bucket_sql(f"concat('{n}', {v})", 997) for n, v in parts.items()) + ")))"
    got = student.student_examples(rows, 997).withColumnRenamed("labels", "l").join(rows, "id").select("places", F.expr(wanted).alias("wanted")).collect()
    assert len(got) == len(lists) and all(r.places == r.wanted for r in got)


def test_texts_are_scanned_once_for_candidates_and_cached_labels(spark):
    from workloads import QUERIES

    from tests.conftest import SMALL

    # a task's Python work is one step over the notes for the replay, one for each side of the cache
    for name, steps in (("temporal_token_audit", 2), ("cached_rule_labels", 2)):
        assert 1 <= _plan(QUERIES[name](spark, SMALL)).count("ArrowEvalPython") <= steps, name
    got = temporal.scan_candidates(_odd(spark), [r.name for r in rules.RULES]).collect()
    assert all(r.text[r.target.start:r.target.end] == r.target_text for r in got)
    assert len({r.id for r in got}) == len(got) == sum(len(r.s) for r in _odd(spark).select(rules.rule_spans("text").alias("s")).collect())
