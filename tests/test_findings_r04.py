"""One test for each finding of round 4 that was right."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import augment, perturb, robustness, rules, temporal, windows
from maskwright.session import with_once
from workloads import robustness as WR

c = F.col
ODD = ["Mail Andrew’s a.b@x.org, 50 mg, 1234567; Ann's", "none", "", " \n ", "𝔘 😀 7654321 Ann's 2 kg. " * 20, None, "a\x01b\x02 5mg\x01", "x\x92y ’s 1/2/2020, 5 mg",
       "Velvet Copper", "x-5mg-y 12345-6789 @abc.d http://x.y/z", "\x02 \x01 1234567", "a\x85b Andrew’s 50 mg, \x92 Miriam Velvet Copper \x85",
       "\x85abc Thomas 5 kg Andrew's", "٣٤٥ mg and ٣٤٥٦٧٨٩ 5 Kg 5 Kg Älvet Vélvet 12² m²g Andrew Thomas", "\x05\x06\x07 5 mg \x06\x06\x06\x06\x06 Andrew\x07"]
BITS = ("Andrew", "Andrew's", "Miriam’s", "50", "mg", "kg", "5mg", "1234567", ",", ";", ".", "-", "’", "'", " ", " ", "\x85", "\x92", "@ab_1", "a.b@c.org", "www.x.y",
        "12345-6789", "1/2/2020", "Velvet", "Copper", "Silver Walnut", "éclair", "٣٤", "²", "K", "units", "x", "(", "​", "😀", "\x1f", "\n")


def _odd(spark):
    draw = random.Random(4)
    made = ["".join(draw.choice(BITS) + draw.choice(("", " ")) for _ in range(draw.randint(1, 25))) for _ in range(150)]
    return spark.createDataFrame([(str(i), t, f"d{i % 3}") for i, t in enumerate([*ODD, *made])], "id string, text string, dataset_name string").repartition(4)


def _labelled(rows):
    return with_once(rows, words=X.words(c("text")), labels=rules.rule_labels("text", WR.SYSTEM))


def _built(rows):
    """Scores of the pairs with all their texts, words and labels."""
    pairs = perturb.build_pairs(_labelled(rows), "all", reach=rules.reach(WR.SYSTEM))
    known = with_once(pairs, rule_noisy=rules.labels_after_edit("text", "clean_labels", "scan", WR.SYSTEM)).select(
        "*", WR.student_labels("clean_words").alias("student_clean"), WR.student_labels("words").alias("student_noisy"))
    both = robustness.with_combinations(known, ("clean_labels", "rule_noisy"), ("student_clean", "student_noisy"))
    return robustness.score_pairs(both, {
        "rule": ("clean_labels", "rule_noisy"), "student": ("student_clean", "student_noisy"),
        "or": ("or_clean_labels", "or_noisy_labels"), "and": ("and_clean_labels", "and_noisy_labels")}, ["dataset_name"])


def test_pairs_scored_in_windows_score_as_those_built(spark):
    rows = _odd(spark)
    made = windows.scored_pairs(rows, perturb.noises("all"), WR.SYSTEM, WR.TERMS, ["dataset_name"])
    by_id = lambda df: {r.pair_id: r.asDict(True) for r in df.collect()}
    wanted, found = by_id(_built(rows)), by_id(made)
    assert len(wanted) > 500 and wanted == found
    # the texts, words and labels of pairs are not made in lambdas over arrays
    assert "transform(" not in made._jdf.queryExecution().optimizedPlan().toString()


def _keys(rows, group):
    return windows.pair_keys(rows, perturb.noises(group), WR.SYSTEM, WR.TERMS)


def test_a_source_is_predicted_where_its_pairs_are_made(spark):
    rows = _odd(spark)
    masked = _labelled(rows).select("id", WR.student_labels("words").alias("k")).select(
        "id", F.expr("aggregate(k, 0, (a, x) -> a + x)").alias("masked"))
    wanted = perturb.pair_keys(_labelled(rows), "all").select(c("source_id").alias("id"), "noise_type").join(masked, "id")
    assert sorted(map(tuple, wanted.collect())) == sorted(map(tuple, _keys(rows, "all").select("id", "noise_type", "masked").collect()))
    from tests.conftest import SMALL
    from workloads import QUERIES

    assert "Join" not in QUERIES["source_predictions"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def _replays(rows):
    """Targets with the labels of their texts, and the same worked out once a text."""
    known = with_once(rows, old_labels=rules.rule_labels("text", rules.rules_as_of("1.3")), latest_labels=rules.rule_labels("text"), words=X.words(c("text")))
    found = temporal.scan_candidates(known.withColumn("student_labels", WR.student_labels("words")), WR._DEFECTS, carry=("old_labels", "latest_labels", "student_labels"))
    return temporal.validated_targets(found), windows.replayed(rows, WR._DEFECTS, rules.rules_as_of("1.3"), rules.RULES, WR.TERMS)


def test_token_audit_counts_the_words_of_a_text_once(spark):
    targets, notes = _replays(_odd(spark))
    scores = lambda df: {r.system: (r.tp, r.fp, r.fn, r.tn, r.f2) for r in df.collect()}
    assert scores(temporal.token_audit(targets)) == scores(windows.replayed_audit(notes))
    assert scores(windows.replayed_audit(notes.limit(0)))["latest"][:4] == (0, 0, 0, 0)


def test_targets_carry_the_verdict_of_all_systems(spark):
    targets, notes = _replays(_odd(spark))
    names = ("id", "source_id", "temporal_defect", "introduced_in", "old_hit", "student_hit")
    found = windows.replayed_targets(notes, rules.RULES)
    wanted = targets.select(*names, "target.start", "target.end")
    assert wanted.count() > 100 and sorted(map(str, wanted.collect())) == sorted(map(str, found.select(*names, "start", "end").collect()))
    from tests.conftest import SMALL
    from workloads import QUERIES

    assert "Join" not in QUERIES["joined_systems"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_balanced_picks_read_keys_only(spark):
    keys = _keys(_odd(spark), "seen").select("id", "noise_type")
    allowed = {}
    for r in keys.collect():
        allowed.setdefault(r.id, set()).add(r.noise_type)
    for per_row in (1, 2):
        picked = {}
        for r in augment.pick_balanced(keys, per_row).collect():
            picked.setdefault(r.id, []).append(r.noise_type)
        assert set(picked) == set(allowed)
        assert all(len(set(p)) == len(p) == min(per_row, len(allowed[i])) and set(p) <= allowed[i] for i, p in picked.items())
    built = perturb.pair_keys(_labelled(_odd(spark)), "seen").select(c("source_id").alias("id"), "noise_type")
    count = lambda df: {tuple(r) for r in augment.pick_balanced(df, 1).groupBy("noise_type").count().collect()}
    assert count(keys) == count(built)


@pytest.mark.parametrize("name", ("acceptance_gates", "combine_or_and_by_noise", "delta_f2_ci", "shared_ci", "shared_ci_by_noise", "system_robustness"))
def test_queries_over_scored_pairs_build_none(spark, name):
    from tests.conftest import SMALL
    from workloads import QUERIES

    assert "transform(" not in QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
