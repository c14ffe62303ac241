"""Versioned pattern rules as word labels, and the rule refinements built on them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import labels as L
from maskwright.functions import lexicons as lx
from maskwright.functions import marks
from maskwright.functions import predicates as P
from maskwright.functions.arrays import let, sql_string
from maskwright.session import with_once
from maskwright.functions.text import SPACE, SPACED_TOKEN, TOKEN, WORD, tile, tiled_spans_sql, word_offsets_sql, words, words_sql

SPAN = "struct<start:int,end:int,type:string,hit:string>"

# \b, \w and \d written out for Unicode, independent of the JVM version.
_B = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_START, _END = rf"(?<![{WORD}])", rf"(?![{WORD}])"  # \b next to a letter or digit
_W = rf"[{WORD}.+-]"
_D = r"\p{Nd}"


@dataclass(frozen=True)
class Rule:
    """A pattern, the rule version that introduced it, and a cheap necessary condition.

    ``guard`` is a literal substring or, with ``guard_is_pattern``, a pattern that is
    much cheaper than the rule; texts without it are never scanned by the rule. ``reach``
    is how many whitespace-delimited runs of characters a match can span.
    """

    name: str
    introduced_in: str
    pattern: str
    guard: str
    guard_is_pattern: bool = True
    reach: int = 1

    def applies(self, text: str) -> str:
        test = "rlike" if self.guard_is_pattern else "contains"
        return f"{test}({text}, {sql_string(self.guard)})"


# The nine rules and the version that added each.
RULES = (
    Rule("glued_dosage", "1.3",
         rf"(?i){_START}{_D}+(?:[.,]{_D}+)?(?:mg|mcg|ug|ml|l|g|kg|cc|units?|iu|mmol|meq|%|mmhg|bpm|cm|mm){_B}",
         rf"{_D}[a-zA-Z%]"),
    Rule("c1_control", "1.3", rf"[^{SPACE}]*[\x80-\x9f][^{SPACE}]*", r"[\x80-\x9f]"),
    Rule("possessive", "1.3", rf"{_START}[A-Z][A-Za-z-]+(?:['’]{{1,2}}s){_END}", r"['’]s"),
    Rule("long_identifier", "1.3",
         rf"{_START}(?:{_D}{{7,}}|{_D}{{3}}-{_D}{{4}}|{_D}{{3}}-{_D}{{3}}-{_D}{{4}}|{_D}{{3}}\.{_D}{{3}}\.{_D}{{4}}"
         rf"|{_D}{{3}}-{_D}{{2}}-{_D}{{4}}|{_D}{{2,3}}-{_D}{{2,3}}-{_D}{{2,3}}){_END}",
         rf"{_D}{{7}}|{_D}{{2}}[-.]{_D}{{2}}"),
    Rule("email", "1.4", rf"{_W}+@[{WORD}-]+\.[A-Za-z]{{2,}}", "@", False),
    Rule("url", "1.4", rf"(?i)(?:https?://|www\.)[{WORD}./%\-?=&#+~]+", r"(?i)http|www"),
    Rule("social_handle", "1.4", rf"(?<![{WORD}.@])@[A-Za-z][{WORD}.]{{2,}}", "@", False),
    Rule("zip4", "1.4", rf"{_START}{_D}{{5}}-{_D}{{4}}{_END}", rf"{_D}-{_D}"),
    Rule("numeric_date", "1.4",
         rf"{_START}(?:0?[1-9]|[12]{_D}|3[01])[/.-](?:0?[1-9]|[12]{_D}|3[01])[/.-](?:{_D}{{4}}|{_D}{{2}}){_END}",
         rf"{_D}[/.-]{_D}"),
)

# Which rules a replay looks for in each kind of corpus.
CLINICAL_DEFECTS = ("glued_dosage",)
BIOGRAPHY_DEFECTS = (
    "c1_control", "possessive", "long_identifier", "email", "url", "social_handle", "zip4", "numeric_date",
)


def _version(value: str) -> tuple[int, ...]:
    return tuple(int(part) for part in value.split("."))


def rules_as_of(version: str, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules introduced in ``version`` or earlier; decided while planning."""
    return tuple(r for r in rules if _version(r.introduced_in) <= _version(version))


def named_rules(*names: str) -> tuple[Rule, ...]:
    return tuple(r for r in RULES if r.name in names)


def rule_spans_sql(text: str, rules: tuple[Rule, ...] = RULES) -> str:
    """Spans of all rules, in rule order: array<struct<start,end,type,hit>>.

    Each rule contributes its matches, alone and with the gap before each; the offsets are
    then worked out by one shared expression, only for rules that matched. The second pattern
    goes on where the last match ended (``\\G``), so no gap is searched
    twice.
    """
    if not rules:
        return f"cast(array() as array<{SPAN}>)"
    scans = ", ".join(
        f"case when {r.applies(text)} then named_struct('type', '{r.name}', "
        f"'hits', regexp_extract_all({text}, {sql_string(r.pattern)}, 0), 'tiles', regexp_extract_all({text}, {sql_string(tile(r.pattern))}, 0)) end"
        for r in rules)
    typed = "m -> named_struct('start', m.start, 'end', m.end, 'type', rule.type, 'hit', m.word)"
    return (f"flatten(transform(filter(array({scans}), rule -> size(rule.hits) > 0), "
            f"rule -> transform({tiled_spans_sql('rule.hits', 'rule.tiles')}, {typed})))")


def rule_labels_sql(text: str, rules: tuple[Rule, ...] = RULES, spans: str | None = None) -> str:
    """Labels from rule spans; offsets are only computed for texts in which some rule fires."""
    return let("rs", spans or rule_spans_sql(text, rules), (
        f"case when size(rs) = 0 then transform({words_sql(text)}, x -> 0) "
        f"else {L.label_words_sql(word_offsets_sql(text), 'rs')} end"))


def marked_copies_sql(text: str, rules: tuple[Rule, ...]) -> str:
    """One copy of the text for each rule that applies, in rule order, with the rule's matches between marks."""
    if not rules:
        return f"left({text}, 0)"
    copies = ", ".join(f"'{marks.COPY}', case when {r.applies(text)} then {marks.marked_sql(text, r.pattern)} else '' end" for r in rules)
    return f"concat(left({text}, 0), {copies})"


def rule_spans(text: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """rule_spans_sql for a column: the offsets come from marks, without sums over arrays."""
    if not rules:
        return F.expr(rule_spans_sql(text, rules))
    known = f"coalesce({text}, '')"
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.transform(marks.spans(marked_copies_sql(known, rules), known), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["copy"]).alias("type"),
        F.substring(F.expr(text), s["start"] + 1, s["end"] - s["start"]).alias("hit")))


def rule_counts(text: str, rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Number of matches per rule."""
    return {r.name: F.expr(f"case when {r.applies(text)} then regexp_count({text}, {sql_string(r.pattern)}) else 0 end")
            for r in rules}


def rule_labels(text: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Word labels of a text under a set of rules, one label per word of the text."""
    return marks.labels(marks.marked_sql(text, TOKEN), marked_copies_sql(text, rules))


def labels_after_edit(text: str, base: str, scan: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """rule_labels(text) of an edited text, given the labels ``base`` of the text before the edit.

    Matches stay within ``reach`` runs, so only the runs around the edit are scanned
    (``scan`` of perturb.variants, made with the same reach); all other labels stay. U+0085 is a
    space to the tokenizer but joins runs for one rule: texts that hold it are scanned whole.
    """
    near = let("near", rule_labels_sql(f"{scan}.text", rules), (
        f"concat(slice({base}, 1, {scan}.lo), slice(near, {scan}.skip + 1, size(near) - {scan}.skip - {scan}.drop), "
        f"slice({base}, {scan}.hi + 2, size({base}) - {scan}.hi - 1))"))
    return F.expr(f"case when contains({text}, '\u0085') then {rule_labels_sql(text, rules)} else {near} end")


def reach(rules: tuple[Rule, ...]) -> int:
    return max((r.reach for r in rules), default=1)


def rule_types(text: str, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.expr(let("rs", rule_spans_sql(text, rules), (
        f"case when size(rs) = 0 then transform({words_sql(text)}, x -> 'O') "
        f"else {L.type_words_sql(word_offsets_sql(text), 'rs')} end")))


def policy_id(masker: str, version: str) -> str:
    """``masker-rule-vV@`` plus 16 digits of the SHA-256 over the rules in force."""
    text = "\n".join(f"{r.name}\t{r.introduced_in}\t{r.pattern}" for r in rules_as_of(version))
    return f"{masker}-rule-v{version}@{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def rule_manifest(masker: str, version: str, task: str, max_length: int = 256) -> Column:
    digest = policy_id(masker, version).split("@")[1]
    return F.struct(
        F.lit(version).alias("version"), F.lit(masker).alias("masker"), F.lit(digest).alias("code_sha256"),
        F.lit(task).alias("task"), F.lit(max_length).alias("max_length"),
    )


def annotate(docs: DataFrame, version: str = "1.4", masker: str = "pattern", task: str = "text",
             types: bool = False) -> DataFrame:
    """Add words, labels (and types) of the rules in force, and the policy that made them."""
    rules = rules_as_of(version)
    made = {"words": words(F.col("text")), "labels": rule_labels("text", rules)}
    if types:
        made["types"] = rule_types("text", rules)
    return with_once(docs, **made).select(
        "*", F.lit(policy_id(masker, version)).alias("teacher_policy"),
        rule_manifest(masker, version, task).alias("rule_manifest"))


# Broken control characters U+0091..U+0097 and what they stand for.
C1_CHARACTERS = "\u0091\u0092\u0093\u0094\u0095\u0096\u0097"
C1_ASCII = "''\"\"*--"


def normalise_c1(text: Column) -> Column:
    """Replace broken C1 punctuation one for one, so offsets stay valid."""
    return F.translate(text, C1_CHARACTERS, C1_ASCII)


def expand_quantities(tokens: str, labels: str, steps: int = 2) -> Column:
    """Extend a mask to adjacent numbers and units, at most ``steps`` words away.

    Every word between the masked one and the one reached must be a quantity too.
    """
    units = ", ".join(f"'{u}'" for u in lx.DOSAGE_UNITS)
    quantity = f"transform({tokens}, w -> rlike(w, '^\\\\p{{Nd}}+$') or trim(trailing '.' from lower(w)) in ({units}))"
    near = []
    for side in (-1, 1):
        for step in range(1, steps + 1):
            between = [f"coalesce(get(q, i + {side * k}), false)" for k in range(1, step)]
            near.append(" and ".join([f"coalesce(get(l, i + {side * step}), 0) = 1", *between]))
    reached = " or ".join(f"({n})" for n in near)
    return F.expr(let("q", quantity, let(
        "l", labels, f"transform(l, (x, i) -> cast(x = 1 or (get(q, i) and ({reached})) as int))")))


def symmetrise(tokens: str, labels: str) -> Column:
    """A surface form masked once is masked everywhere in the document."""
    masked = (f"array_distinct(filter(zip_with({tokens}, {labels}, (w, l) -> case when l = 1 then lower(w) end), "
              "w -> w is not null))")
    return F.expr(let("masked", masked, (
        f"case when size(masked) = 0 then {labels} "
        f"else transform({tokens}, w -> cast(array_contains(masked, lower(w)) as int)) end")))


def drop_excluded(tokens: Column, labels: Column) -> Column:
    """Unmask contractions, single characters and figure labels."""
    return F.zip_with(tokens, labels, lambda w, l: F.when(P.rule_exclusion(w), 0).otherwise(l))


def _second_look(text: str, changed: str, rules: tuple[Rule, ...]) -> Column:
    """Labels of the text OR of an equally long variant of it."""
    both = f"concat({rule_spans_sql(text, rules)}, case when alt = {text} then cast(array() as array<{SPAN}>) else {rule_spans_sql('alt', rules)} end)"
    return F.expr(let("alt", changed, rule_labels_sql(text, rules, both)))


def possessive_pass(text: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Labels of the text OR of the text with 's blanked out (same offsets)."""
    pattern = sql_string(rf"['’]s(?![{WORD}])")
    return _second_look(text, f"regexp_replace({text}, {pattern}, '  ')", rules)


def hyphen_union(text: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Labels of the text OR of the text with inner hyphens turned to spaces (same offsets)."""
    pattern = sql_string(rf"(?<=[{WORD}])-(?=[{WORD}])")
    return _second_look(text, f"regexp_replace({text}, {pattern}, ' ')", rules)


def split_run_on(text: Column) -> Column:
    """``DIAGNOSES:,1. Pneumonia`` -> units separated by spaces."""
    return F.regexp_replace(text, r"([:;,.])(?=[,\p{Nd}]+\.)", "$1 ")


def squeeze_spaces(text: Column) -> Column:
    """Drop a space only where another one follows."""
    return F.regexp_replace(text, r" +(?= )", "")


def merge_spans_sql(spans: str) -> str:
    """Union of overlapping or touching character spans, sorted: array<struct<start,end>>."""
    pair = "struct<start:int,end:int>"
    pairs = f"array_sort(transform({spans}, s -> cast(named_struct('start', s.start, 'end', s.end) as {pair})))"
    step = (
        "case when size(acc) > 0 and get(acc, size(acc) - 1).end >= s.start then concat(slice(acc, 1, greatest(size(acc) - 1, 0)), "
        f"array(cast(named_struct('start', get(acc, size(acc) - 1).start, 'end', greatest(get(acc, size(acc) - 1).end, s.end)) as {pair}))) "
        "else concat(acc, array(s)) end")
    return f"aggregate({pairs}, cast(array() as array<{pair}>), (acc, s) -> {step})"


def merge_spans(spans: str) -> Column:
    return F.expr(merge_spans_sql(spans))


def char_confusion(gold: str, pred: str) -> Column:
    """Character-level tp/fp/fn of two merged span lists (|A∩B| = |A| + |B| - |A∪B|)."""
    size = lambda spans: f"aggregate({spans}, 0, (a, s) -> a + s.end - s.start)"
    sizes = (f"named_struct('g', {size(gold)}, 'p', {size(pred)}, "
             f"'u', {size(merge_spans_sql(f'concat({gold}, {pred})'))})")
    return F.expr(let("z", sizes, (
        "named_struct('tp', cast(z.g + z.p - z.u as bigint), 'fp', cast(z.u - z.g as bigint), 'fn', cast(z.u - z.p as bigint))")))


def visible_text(text: str, labels: str, cover: str = "█") -> Column:
    """The text with masked words covered and everything between words kept as it is."""
    masked = f"zip_with({words_sql(text)}, {labels}, (w, l) -> case when l = 1 then w end)"
    return F.expr(
        f"array_join(zip_with(regexp_extract_all({text}, {sql_string(SPACED_TOKEN)}, 0), {masked}, (t, w) -> "
        f"case when w is null then t else concat(left(t, length(t) - length(w)), '{cover}') end), '')")


def leak_hits(docs: DataFrame, text: str = "text", labels: str = "labels", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``leaks``: rule matches still found in the text that masking leaves visible (should be 0)."""
    shown = docs.withColumn("visible", visible_text(text, labels))
    return shown.withColumn("leaks", sum(rule_counts("visible", rules).values(), F.lit(0)))
