"""Entity-span policies: which words an external recogniser's spans make sensitive."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import labels as L
from maskwright.functions import lexicons as lx
from maskwright.functions import predicates as P
from maskwright.functions.text import selected_words, word_offsets, word_offsets_sql

ENTITY_SPAN = "struct<start:int,end:int,type:string>"


@dataclass(frozen=True)
class Policy:
    """Entity types kept, DATE handling, word filter, and whether places share one type."""

    name: str
    types: tuple[str, ...]
    dates: bool
    medical_words: bool
    strict: bool
    merge_places: bool


# The policies.
POLICIES = {
    "piiclean-v1": Policy("piiclean-v1", lx.FULL_ENTITY_TYPES, True, False, False, False),
    "piiclean-strict-v1": Policy("piiclean-strict-v1", lx.STRICT_ENTITY_TYPES, False, False, True, False),
    "entityclean-v1": Policy("entityclean-v1", lx.FULL_ENTITY_TYPES, True, False, False, False),
    "medical": Policy("medical", lx.FULL_ENTITY_TYPES, True, True, False, True),
}


def link_concepts(spans: DataFrame, concepts: DataFrame, types: Sequence[str] = lx.SENSITIVE_CONCEPT_TYPES) -> DataFrame:
    """Spans (…, term) whose concept (term, types ARRAY) has a sensitive type, typed MEDICAL.

    The concept table is reduced to distinct sensitive terms first. Whether that list is
    broadcast is left to Spark, which measures it (autoBroadcastJoinThreshold, AQE).
    """
    wanted = concepts.filter(F.arrays_overlap("types", F.array(*[F.lit(t) for t in types]))).select("term").distinct()
    return spans.join(wanted, "term", "left_semi").withColumn("type", F.lit("MEDICAL"))


def admitted_spans(spans: DataFrame, policy: Policy) -> DataFrame:
    """Entity spans (id, start, end, type, span_order, surface) that the policy keeps."""
    keep = F.col("type").isin(*policy.types, "MEDICAL")
    if policy.dates:
        keep = keep | ((F.col("type") == "DATE") & P.dated(F.col("surface")))
    kept = spans.filter(keep)
    if policy.merge_places:
        kept = kept.withColumn("type", F.when(F.col("type").isin(*lx.PLACE_TYPES), "LOCATION").otherwise(F.col("type")))
    return kept


def collect_spans(spans: DataFrame) -> DataFrame:
    """(id, spans) in recogniser order. A group is the spans of one document."""
    return spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("span_order", "start", "end", "type"))).alias("_s")).select(
        "id", F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))).alias("spans"))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Add words, labels and types to rows with text and admitted ``spans``."""
    keep = P.keep_medical_word if policy.medical_words else (lambda w: P.keep_entity_word(w, policy.strict))
    offsets = rows.withColumn("_w", word_offsets("text")).withColumn("_t", L.type_words("_w", "spans"))
    typed = offsets.withColumn("types", F.zip_with("_w", "_t", lambda w, t: F.when(
        (t != "O") & keep(w["word"]), t).otherwise("O")))
    return typed.withColumn("words", F.expr("transform(_w, w -> w.word)")).withColumn(
        "labels", F.expr("transform(types, t -> cast(t <> 'O' as int))")).drop("_w", "_t")


def label_entities(docs: DataFrame, spans: DataFrame, policy: Policy) -> DataFrame:
    """Documents (id, text, …) with words, labels, types, selected words and policy name."""
    grouped = collect_spans(admitted_spans(spans, policy))
    joined = docs.join(grouped, "id", "left").withColumn(
        "spans", F.coalesce("spans", F.expr(f"cast(array() as array<{ENTITY_SPAN}>)")))
    return apply_policy(joined, policy).select(
        *docs.columns, "words", "labels", "types",
        selected_words(F.col("words"), F.col("labels")).alias("selected_words"), F.lit(policy.name).alias("teacher_policy"))


def subtoken_labels(text: str, subtokens: str) -> Column:
    """Word labels from sub-word pieces struct<start,end,label>; empty pieces are ignored."""
    hits = f"filter({subtokens}, t -> t.label = 1 and t.end > t.start)"
    return F.expr(L.label_words_sql(word_offsets_sql(text), hits))
