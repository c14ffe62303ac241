"""Replay of rule versions: what would an old rule or an old student miss today?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import labels as L
from maskwright.functions.text import stable_key, word_offsets, words
from maskwright.operators.bootstrap import cluster_mean_delta_by
from maskwright.operators.metrics import with_scores
from maskwright.operators.rules import RULES, named_rules, rule_spans
from maskwright.operators.sampling import first_n
from maskwright.session import cut_lineage, with_once


def scan_candidates(docs: DataFrame, defects: Sequence[str], dataset: str = "corpus", carry: Sequence[str] = ()) -> DataFrame:
    """Every match of the listed rules, one row each. Works inside each document.

    ``carry`` names document columns to keep, for example labels worked out once per
    document and shared by all of its candidates.
    """
    rules = named_rules(*defects)
    versions = F.create_map(*[F.lit(x) for r in RULES for x in (r.name, r.introduced_in)])
    optional = {"task_label": None, "source": dataset, "source_split": "test"}
    extra = [F.col(c) if c in docs.columns else F.lit(v).cast("string").alias(c) for c, v in optional.items()]
    names = F.array(*[F.lit(r.name) for r in rules])
    per_rule = F.transform(names, lambda n: F.filter("_all", lambda s: s["type"] == n))
    found = with_once(docs, _all=rule_spans("text", rules)).select(
        F.col("id").cast("string").alias("source_id"), "text", *extra, *carry, F.explode(per_rule).alias("_spans")
    ).select("*", F.posexplode("_spans").alias("occurrence", "_s"))
    return found.select(
        F.concat_ws("::", "source_id", F.lit("temporal"), F.col("_s.type"), F.col("_s.start").cast("string"),
                    F.col("occurrence").cast("string")).alias("id"),
        "source_id", "text", "task_label", "source", "source_split", *carry,
        F.col("_s.type").alias("temporal_defect"), versions[F.col("_s.type")].alias("introduced_in"),
        F.struct(F.col("_s.start").alias("start"), F.col("_s.end").alias("end")).alias("target"),
        F.col("_s.hit").alias("target_text"))


def cap_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """First n candidates per defect in digest order."""
    keyed = candidates.withColumn("_key", stable_key(F.col("id"), F.col("target_text")))
    return first_n(keyed, ["temporal_defect"], "_key", "id", n, "_rank").drop("_key", "_rank")


def candidate_counts(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """Candidates per defect, and how many a cap of n leaves (all without one)."""
    available = F.col("available")
    return candidates.groupBy("temporal_defect").agg(F.count(F.lit(1)).alias("available")).withColumn(
        "selected", available if n is None else F.least(available, F.lit(n)))


def join_systems(candidates: DataFrame, old: DataFrame, latest: DataFrame, student: DataFrame) -> DataFrame:
    """Attach the labels of three systems (id, labels) by candidate id.

    Each side holds one row per candidate and many come out of one document, which size
    estimates do not see: a merge join is asked for, as a broadcast would pass through the driver.
    """
    out = candidates
    for name, df in (("old", old), ("latest", latest), ("student", student)):
        out = out.join(df.select("id", F.col("labels").alias(f"{name}_labels")).hint("merge"), "id")
    return out


def validated_targets(candidates: DataFrame, offsets: str | None = None) -> DataFrame:
    """Candidates whose target holds a word of the latest rule, with detection flags.

    Needs old_labels, latest_labels and student_labels. ``offsets`` names a column of word offsets, where the
    candidates of a document carry it.
    """
    known = with_once(candidates, _words=word_offsets("text")) if offsets is None else candidates.withColumnRenamed(offsets, "_words")
    indexed = with_once(known, _at=L.target_words("_words", "latest_labels", "target.start", "target.end")).drop("_words")
    hit = lambda c: L.detected("_at", c).cast("int")
    return indexed.filter(F.size("_at") > 0).select(
        "*", hit("old_labels").alias("old_hit"), hit("student_labels").alias("student_hit"),
        hit("latest_labels").alias("latest_hit")).drop("_at")


def mismatched_words(candidates: DataFrame, stored: str = "words") -> DataFrame:
    return candidates.filter(F.col(stored) != words(F.col("text"))).select("id")


def by_defect(targets: DataFrame, repeats: int = 2000, seed: int = 42) -> DataFrame:
    """Per defect and overall (temporal_defect ``all``): detection of each system and the interval of student - old.

    Targets are counted under their defect and once more under ``all``. Only the flags are
    read twice; they are checkpointed. Any kind of defect counts, also those of no known rule.
    """
    targets = cut_lineage(targets.select("source_id", "temporal_defect", "introduced_in", "old_hit", "student_hit", "latest_hit"))
    flat = targets.select("source_id", "introduced_in", "old_hit", "student_hit", "latest_hit",
                          F.explode(F.array(F.col("temporal_defect"), F.lit("all"))).alias("temporal_defect"))
    per_source = flat.groupBy("temporal_defect", "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("introduced_in").alias("introduced_in"),
        *[F.sum(c).alias(c) for c in ("old_hit", "student_hit", "latest_hit")])
    n = F.sum("n")
    point = per_source.groupBy("temporal_defect").agg(
        F.min("introduced_in").alias("introduced_in"), n.alias("targets"), F.count(F.lit(1)).alias("unique_sources"),
        (F.sum("old_hit") / n).alias("past_rule_detection"), (F.sum("student_hit") / n).alias("past_student_detection"),
        (F.sum("latest_hit") / n).alias("latest_rule_detection"),
        ((F.sum("student_hit") - F.sum("old_hit")) / n).alias("student_minus_rule"))
    ci = cluster_mean_delta_by(targets, "old_hit", "student_hit", "temporal_defect", "all", repeats, seed)
    return point.join(ci, "temporal_defect", "left")


def token_audit(targets: DataFrame) -> DataFrame:
    """Token metrics of each system against the latest rule, in one pass."""
    long = targets.select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("system"), L.confusion("latest_labels", f"{name}_labels").alias("c"))
        for name in ("old", "student", "latest")])))
    return with_scores(long.groupBy("system").agg(*[F.sum(f"c.{k}").alias(k) for k in ("tp", "fp", "fn", "tn")]))
