"""Paired surface perturbations with gold labels projected through the edit.

A row gets at most one edit per noise type, at its first eligible sensitive site.
Finding the site, editing, retokenizing and projecting labels all happen inside the
row, so building pairs is a map: no shuffle, and skew cannot arise.

Whitespace never belongs to a word, so an edit can only change the words of the
whitespace-delimited run it falls into. Only that run is retokenized; the word and
label arrays before and after it are reused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.arrays import let, sql_string
from maskwright.functions.lexicons import DOSAGE_UNITS
from maskwright.functions.predicates import DIGIT
from maskwright.functions.text import code_point, word_offsets, word_offsets_sql, words
from maskwright.operators.sampling import cap_rows
from maskwright.session import with_once


@dataclass(frozen=True)
class Noise:
    catalog_id: str
    name: str
    group: str
    family: str
    replacement: str
    masked: int
    code_point: str
    rule_coverage: str


# The nineteen noise types.
NOISES = (
    Noise("WS-01", "double_space", "seen", "space", "  ", 0, "U+0020 x2", "partial"),
    Noise("AP-01", "curly_apostrophe", "seen", "apostrophe", "\u2019", 1, "U+2019", "partial"),
    Noise("AP-02", "c1_apostrophe", "seen", "apostrophe", "\u0092", 1, "U+0092", "direct"),
    Noise("DS-01", "dosage_join", "seen", "dosage", "", 1, "U+0020 removed", "direct"),
    Noise("PT-01", "comma_after_number", "seen", "punctuation", ",", 0, "U+002C", "none"),
    Noise("WS-02", "triple_space", "unseen", "space", "   ", 0, "U+0020 x3", "none"),
    Noise("WS-03", "nbsp", "unseen", "space", "\u00A0", 0, "U+00A0", "none"),
    Noise("AP-03", "modifier_apostrophe", "unseen", "apostrophe", "\u02BC", 1, "U+02BC", "none"),
    Noise("DS-02", "dosage_hyphen", "unseen", "dosage", "-", 1, "U+002D", "none"),
    Noise("DS-03", "dosage_thin_space", "unseen", "dosage", "\u2009", 1, "U+2009", "none"),
    Noise("PT-02", "semicolon_after_number", "unseen", "punctuation", ";", 0, "U+003B", "none"),
    Noise("IC-01", "zero_width_inside", "unseen", "inside", "\u200B", 0, "U+200B", "none"),
    Noise("F-01", "zwnj_inside", "future", "inside", "\u200C", 0, "U+200C", "none"),
    Noise("F-02", "word_joiner_inside", "future", "inside", "\u2060", 0, "U+2060", "none"),
    Noise("F-03", "soft_hyphen_inside", "future", "inside", "\u00AD", 0, "U+00AD", "none"),
    Noise("F-04", "fullwidth_apostrophe", "future", "apostrophe", "\uFF07", 1, "U+FF07", "none"),
    Noise("F-05", "dosage_nb_hyphen", "future", "dosage", "\u2011", 1, "U+2011", "none"),
    Noise("F-06", "narrow_nbsp", "future", "space", "\u202F", 0, "U+202F", "none"),
    Noise("F-07", "right_paren_after_number", "future", "punctuation", ")", 0, "U+0029", "none"),
)
# Which seen noise prepares a model for which unseen one.
GENERALISES = {
    "space": "more and other spaces", "apostrophe": "look-alike apostrophes",
    "dosage": "other joins between number and unit", "punctuation": "other marks after a number",
    "inside": "no seen counterpart",
}


def noises(group: str = "all") -> tuple[Noise, ...]:
    """Noise types of a group; ``all`` means seen and unseen, never future."""
    groups = {n.group for n in NOISES}
    if group != "all" and group not in groups:
        raise ValueError(f"unknown noise group: {group}")
    wanted = {"seen", "unseen"} if group == "all" else {group}
    return tuple(n for n in NOISES if n.group in wanted)


def catalog(spark: SparkSession) -> DataFrame:
    """The noise types as a dimension table."""
    return spark.createDataFrame(
        [(n.catalog_id, n.name, n.group, n.family, n.code_point, n.masked, n.rule_coverage, GENERALISES[n.family])
         for n in NOISES],
        "id string, noise_type string, noise_group string, family string, code_point string, "
        "replacement_masked int, rule_coverage string, generalises string",
    )


def catalog_mismatches(registry: DataFrame, documented: DataFrame) -> DataFrame:
    """(noise_type, noise_group) found on one side only; empty when both agree."""
    left = registry.select("noise_type", "noise_group", F.lit(1).alias("registered"))
    right = documented.select("noise_type", "noise_group", F.lit(1).alias("documented"))
    return left.join(right, ["noise_type", "noise_group"], "full_outer").filter(
        F.col("registered").isNull() | F.col("documented").isNull())


# A step is a sensitive word x of the row being edited and the word y after it; what makes a step a family's site.
_BOTH = "p.y.l = 1 and p.y.start > p.x.end"
_UNITS = ", ".join(f"'{u}'" for u in DOSAGE_UNITS)
_UNIT = "trim(trailing '.' from lower(p.y.word))"
_MARK = "coalesce(p.y.start = p.x.end and p.y.word in (',', ';', ':'), false)"
_TESTS = {
    "space": _BOTH,
    "dosage": f"{_BOTH} and rlike(p.x.word, {sql_string(r'^\p{Nd}+$')}) and {_UNIT} in ({_UNITS})",
    "punctuation": f"rlike(p.x.word, {sql_string(f'[{DIGIT}]')}) and not {_MARK}",
    "apostrophe": """rlike(p.x.word, "['’]")""",
    "inside": f"rlike(p.x.word, {sql_string(r'^\p{L}{5,}$')})",
}


def _site(family: str, last: str, cut: tuple[str, str], edit: str) -> str:
    return (
        f"named_struct('family', '{family}', 'first', p.x.i, 'last', {last}.i, 'cut_start', {cut[0]}, 'cut_end', {cut[1]}, "
        f"'target_start', p.x.start, 'target_end', {last}.end, 'edit', {edit})")


def _site_sql(family: str) -> str:
    """First eligible site of a family (null when there is none), over the steps ``st`` of text ``txt``."""
    gap = ("p.x.end", "p.y.start")
    word_index = "map('word_index', cast(p.x.i as string))"
    at = """(p.x.start + regexp_instr(p.x.word, "['’]") - 1)"""
    middle = "(p.x.start + cast(floor(length(p.x.word) / 2) as int))"
    made = {
        "space": ("p.y", gap, "map('old', substring(txt, p.x.end + 1, p.y.start - p.x.end))"),
        "dosage": ("p.y", gap, f"map('number', p.x.word, 'unit', {_UNIT})"),
        "punctuation": ("p.x", ("p.x.end", "p.x.end"), word_index),
        "apostrophe": ("p.x", (at, f"{at} + 1"), f"map('word_index', cast(p.x.i as string), 'old', substring(txt, {at} + 1, 1))"),
        "inside": ("p.x", (middle, middle), word_index),
    }[family]
    return let("p", f"get(filter(st, p -> {_TESTS[family]}), 0)", f"case when p is not null then {_site(family, *made)} end")


def _steps_sql(offsets: str, labels: str) -> str:
    """The steps of a row, in order."""
    word = lambda i: f"'i', {i}, 'word', get({offsets}, {i}).word, 'start', get({offsets}, {i}).start, 'end', get({offsets}, {i}).end"
    return (f"transform(filter(sequence(0, size({offsets}) - 1), i -> get({labels}, i) = 1), "
            f"i -> named_struct('x', named_struct({word('i')}), 'y', named_struct({word('i + 1')}, 'l', get({labels}, i + 1))))")


def _sensitive_sql(offsets: str, labels: str) -> str:
    return f"size({offsets}) > 0 and exists({labels}, v -> v = 1)"


def _sites_sql(text: str, offsets: str, labels: str, families: set[str], reach: int) -> str:
    """First eligible site per family, with the whitespace-delimited run around it.

    ``take`` and ``scan`` are the words that a rule over ``reach`` runs can label anew and
    those it has to see for that. Rows without a sensitive word have no site.
    """
    r = reach - 1
    found = f"filter(array({', '.join(_site_sql(f) for f in sorted(families))}), f -> f is not null)"
    # word positions that start a run
    breaks = "filter(sequence(0, size(t) - 1), i -> i = 0 or get(t, i).start > get(t, i - 1).end)"
    fields = ("family", "first", "last", "cut_start", "cut_end", "target_start", "target_end", "edit")
    lo = "array_max(filter(br, k -> k <= f.first))"
    hi = "coalesce(array_min(filter(br, k -> k > f.last)), size(t)) - 1"
    masked = ("transform(filter(sequence(r.lo, r.hi), i -> get(lb, i) = 1), "
              "i -> named_struct('start', get(t, i).start, 'end', get(t, i).end))")
    first_run, last_run = (f"(size(filter(br, k -> k <= f.{end})) - 1)" for end in ("first", "last"))
    start = lambda back: f"get(br, greatest({first_run} - {back}, 0))"
    stop = lambda on: f"coalesce(get(br, {last_run} + {on + 1}), size(t)) - 1"
    full = let("r", (f"named_struct('lo', {lo}, 'hi', {hi}, 'take_lo', {start(r)}, 'take_hi', {stop(r)}, "
                     f"'scan_lo', {start(2 * r)}, 'scan_hi', {stop(2 * r)})"), (
        "named_struct(" + ", ".join(f"'{n}', f.{n}" for n in fields)
        + f", 'lo', r.lo, 'hi', r.hi, 'run_start', get(t, r.lo).start, 'run_end', get(t, r.hi).end, 'masked_spans', {masked}, "
        "'take_lo', r.take_lo, 'take_hi', r.take_hi, 'scan_lo', r.scan_lo, 'scan_hi', r.scan_hi, "
        "'scan_start', get(t, r.scan_lo).start, 'scan_end', get(t, r.scan_hi).end)"))
    body = let("t", offsets, let("lb", labels, let("st", _steps_sql("t", "lb"), let("br", breaks, f"transform({found}, f -> {full})"))))
    return f"case when {_sensitive_sql(offsets, labels)} then {let('txt', text, body)} end"


def _with_offsets(rows: DataFrame, columns: list[str]) -> DataFrame:
    return with_once(rows.select(*dict.fromkeys([*columns, "text", "labels"])), _w=word_offsets("text"))


def _kinds_sql(chosen: tuple[Noise, ...]) -> str:
    """The noise types of each family, as a map."""
    return "map(" + ", ".join(
        f"'{family}', array(" + ", ".join(
            f"named_struct('noise_type', '{n.name}', 'noise_group', '{n.group}', 'replacement', {sql_string(n.replacement)}, 'masked', {n.masked})"
            for n in chosen if n.family == family) + ")" for family in sorted({n.family for n in chosen})) + ")"


def variant_keys(rows: DataFrame, chosen: tuple[Noise, ...], keep: list[str]) -> DataFrame:
    """The kept columns, noise_type and noise_group of ``variants``, without the edits: only whether a family has a site."""
    tests = ", ".join(f"case when exists(st, p -> {_TESTS[f]}) then '{f}' end" for f in sorted({n.family for n in chosen}))
    families = (f"case when {_sensitive_sql('_w', 'labels')} then "
                f"{let('st', _steps_sql('_w', 'labels'), f'filter(array({tests}), f -> f is not null)')} end")
    found = _with_offsets(rows, keep).select(*keep, F.expr(f"explode({families}) as family"))
    return found.select(*keep, F.expr(f"inline(element_at({_kinds_sql(chosen)}, family))")).drop("replacement", "masked")


def variants(rows: DataFrame, chosen: tuple[Noise, ...], keep: list[str], reach: int = 1) -> DataFrame:
    """One row per (input row, applicable noise) with the edited text, words and labels.

    ``rows`` needs text, words, labels; ``keep`` names the input columns to carry along.
    Words and labels of the input appear as clean_words and clean_labels. ``scan`` is what
    rules over at most ``reach`` whitespace-delimited runs need to label the new text from
    the labels of the old (see rules.labels_after_edit).
    """
    families = {n.family for n in chosen}
    found = _with_offsets(rows, [*keep, "words"]).select(
        *keep, F.col("text").alias("clean_text"), F.col("words").alias("clean_words"),
        F.col("labels").alias("clean_labels"), F.expr(f"explode({_sites_sql('text', '_w', 'labels', families, reach)}) as site"))
    edited = found.select("*", F.expr(f"inline(element_at({_kinds_sql(chosen)}, site.family))")).select(
        "*",
        F.expr("concat(substring(clean_text, 1, site.cut_start), replacement, substring(clean_text, site.cut_end + 1))").alias("text"),
        F.expr("length(replacement) - (site.cut_end - site.cut_start)").alias("_shift"),
        F.expr("site.cut_start + length(replacement)").alias("_fresh_end"))
    windowed = edited.select(
        "*",
        F.expr("substring(text, site.run_start + 1, site.run_end - site.run_start + _shift)").alias("_run_text"),
        F.expr("site.target_end + case when site.cut_start < site.target_end then _shift else 0 end").alias("_noisy_end"))
    # a character of the new text is sensitive when it comes from a sensitive character
    # before or after the cut, or from a replacement that counts as sensitive
    touch = lambda lo, hi: f"({lo} < {hi} and exists(site.masked_spans, m -> m.start < {hi} and {lo} < m.end))"
    label = (
        f"{touch('w.start', 'least(w.end, site.cut_start)')} "
        "or (masked = 1 and w.start < _fresh_end and site.cut_start < w.end) "
        f"or {touch('(greatest(w.start, _fresh_end) - _shift)', '(w.end - _shift)')}")
    moved = (f"transform({word_offsets_sql('_run_text')}, w -> named_struct('word', w.word, "
             "'start', w.start + site.run_start, 'end', w.end + site.run_start))")
    spliced = windowed.withColumn("_run", F.expr(
        f"transform({moved}, w -> named_struct('word', w.word, 'start', w.start, 'end', w.end, 'label', cast({label} as int)))"))

    def splice(before: str, middle: str) -> Column:
        return F.expr(f"concat(slice({before}, 1, site.lo), transform(_run, w -> w.{middle}), "
                      f"slice({before}, site.hi + 2, size({before}) - site.hi - 1))")

    scan = F.expr(
        "named_struct('text', substring(text, site.scan_start + 1, site.scan_end - site.scan_start + _shift), "
        "'skip', site.take_lo - site.scan_lo, 'drop', site.scan_hi - site.take_hi, 'lo', site.take_lo, 'hi', site.take_hi)")
    hit = "case when w.label = 1 and w.start < _noisy_end and site.target_start < w.end then i + site.lo end"
    shown = F.when(F.col("site.family") == "inside", code_point(F.col("replacement"))).otherwise(F.col("replacement"))
    return spliced.select(
        *keep, "noise_type", "noise_group", "clean_text", "clean_words", "clean_labels",
        F.expr("named_struct('start', site.target_start, 'end', site.target_end)").alias("clean_target"),
        F.sequence("site.first", "site.last").alias("clean_target_words"),
        "text", splice("clean_words", "word").alias("words"), splice("clean_labels", "label").alias("labels"),
        F.expr("named_struct('start', site.target_start, 'end', _noisy_end)").alias("noisy_target"),
        F.expr(f"filter(transform(_run, (w, i) -> {hit}), i -> i is not null)").alias("target_words"),
        F.map_concat(F.create_map(F.lit("kind"), F.col("noise_type"), F.lit("new"), shown), F.col("site.edit")).alias("edit"),
        scan.alias("scan"))


def build_pairs(rows: DataFrame, group: str = "all", dataset: str = "dataset_name", reach: int = 1) -> DataFrame:
    """All clean/noisy pairs of labelled rows (id, text, words, labels, dataset, teacher_policy)."""
    rows = rows if "teacher_policy" in rows.columns else rows.withColumn("teacher_policy", F.lit(None).cast("string"))
    made = variants(rows, noises(group), ["id", dataset, "teacher_policy"], reach)
    pair_id = F.concat_ws("::", F.col("id").cast("string"), "noise_type")
    return made.select(
        pair_id.alias("id"), pair_id.alias("pair_id"), F.col("id").cast("string").alias("source_id"),
        F.col(dataset).alias("dataset_name"), *[c for c in made.columns if c not in ("id", dataset)])


def pair_keys(rows: DataFrame, group: str = "all", dataset: str = "dataset_name") -> DataFrame:
    """(pair_id, source_id, dataset_name, noise_type, noise_group) of ``build_pairs``, for counts and caps, which read no text."""
    made = variant_keys(rows, noises(group), ["id", dataset])
    return made.select(
        F.concat_ws("::", F.col("id").cast("string"), "noise_type").alias("pair_id"), F.col("id").cast("string").alias("source_id"),
        F.col(dataset).alias("dataset_name"), "noise_type", "noise_group")


def check_words(rows: DataFrame) -> DataFrame:
    """Rows whose stored words differ from the tokenizer's; must be empty before building pairs."""
    return rows.filter(F.col("words") != words(F.col("text")))


def cap_per_noise(pairs: DataFrame, cap: int, order: str) -> DataFrame:
    """First ``cap`` pairs per noise type in input order; 0 keeps all."""
    return cap_rows(pairs, ["noise_type"], order, cap)


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs and distinct sources per noise type, and over all (noise_type null).

    A source's pairs are counted by noise type first, in one row, so that a source and not each of its pairs is moved.
    """
    names = [n.name for n in NOISES]
    of_type = [F.count_if(F.col("noise_type") == n).alias(n) for n in names]
    other = F.count_if(~F.coalesce(F.col("noise_type").isin(names), F.lit(False))).alias("_other")
    per_source = pairs.groupBy("source_id").agg(*of_type, other, F.count(F.lit(1)).alias("_all"))
    sums = per_source.agg(
        F.max(F.when(F.col("_other") > 0, F.raise_error(F.lit("pairs of an unknown noise type")))).alias("_known"),
        *[F.struct(F.sum(n).alias("pairs"), F.count_if((F.col(n) > 0) & F.col("source_id").isNotNull()).alias("unique_sources")).alias(n)
          for n in (*names, "_all")])
    row = lambda n: F.struct(F.lit(None if n == "_all" else n).cast("string").alias("noise_type"), F.col(f"{n}.pairs").alias("pairs"),
                             F.col(f"{n}.unique_sources").alias("unique_sources"))
    return sums.select(F.inline(F.array(*[row(n) for n in (*names, "_all")])), "_known").filter("pairs > 0 and _known is null").drop("_known")


def examples(pairs: DataFrame) -> DataFrame:
    """One example per noise type: the smallest pair id.

    There are as many smallest ids as noise types, so they are the side to broadcast; the
    pairs, whose number Spark cannot tell before they are made, never are.
    """
    smallest = pairs.groupBy("noise_type").agg(F.min("pair_id").alias("pair_id"))
    return pairs.drop("noise_type").join(F.broadcast(smallest), "pair_id")
