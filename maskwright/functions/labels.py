"""0/1 word labels: spans, projection of spans onto words, comparison.

Functions ending in ``_sql`` take and return SQL expressions; the others take column
names and return Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.arrays import chunked, let, total

WINDOW = 64


def labels_to_spans_sql(labels: str) -> str:
    """Runs of label 1 as half-open word spans: array<struct<start,end>>."""
    at = "transform(ls, (x, i) -> i)"
    starts = f"filter({at}, i -> get(ls, i) = 1 and coalesce(get(ls, i - 1), 0) = 0)"
    ends = f"filter({at}, i -> get(ls, i) = 1 and coalesce(get(ls, i + 1), 0) = 0)"
    return let("ls", labels, f"zip_with({starts}, {ends}, (s, e) -> named_struct('start', s, 'end', e + 1))")


_OVERLAP = "(w.start < s.end and s.start < w.end)"


def _per_window(offsets: str, spans: str, pick: str, blank: str) -> str:
    """Apply ``pick`` (word ``w``, nearby spans ``near``) to each word.

    Words are cut into windows and the span list is narrowed to each window first, so
    a document with many words and many spans does not compare all against all.
    """
    near = "filter(sp, s -> s.end > element_at(part, 1).start and s.start < element_at(part, -1).end)"
    body = (f"flatten(transform({chunked('wo', WINDOW)}, part -> "
            + let("near", near, f"transform(part, w -> {pick})") + "))")
    return let("sp", spans, let("wo", offsets, f"case when size(sp) = 0 or size(wo) = 0 then {blank} else {body} end"))


def label_words_sql(offsets: str, spans: str) -> str:
    """1 for every word that shares a character with a span."""
    return _per_window(offsets, spans, f"cast(exists(near, s -> {_OVERLAP}) as int)", "array_repeat(0, size(wo))")


def type_words_sql(offsets: str, spans: str) -> str:
    """Type of the first span in list order that overlaps each word, else ``O``."""
    return _per_window(offsets, spans, f"coalesce(get(filter(near, s -> {_OVERLAP}), 0).type, 'O')",
                       "array_repeat('O', size(wo))")


def target_words_sql(offsets: str, gold: str, start: str, end: str) -> str:
    """Indices of the gold words that overlap a target."""
    near = f"get(go, i) = 1 and get(wo, i).start < {end} and {start} < get(wo, i).end"
    return let("go", gold, let("wo", offsets, (
        f"case when size(wo) > 0 then filter(sequence(0, size(wo) - 1), i -> {near}) else cast(array() as array<int>) end")))


def labels_to_spans(labels: str) -> Column:
    return F.expr(labels_to_spans_sql(labels))


def label_words(offsets: str, spans: str) -> Column:
    return F.expr(label_words_sql(offsets, spans))


def type_words(offsets: str, spans: str) -> Column:
    return F.expr(type_words_sql(offsets, spans))


def target_words(offsets: str, gold: str, start: str, end: str) -> Column:
    return F.expr(target_words_sql(offsets, gold, start, end))


def sensitive_spans(offsets: str, labels: str) -> Column:
    """Character intervals of the label-1 words."""
    return F.expr(
        f"filter(zip_with({offsets}, {labels}, (w, l) -> case when l = 1 then "
        "named_struct('start', w.start, 'end', w.end) end), s -> s is not null)")


def combine(left: str, right: str, mode: str) -> Column:
    """Word-wise OR / AND of two label arrays; lengths must agree."""
    if mode not in ("or", "and"):
        raise ValueError(f"unsupported combination mode: {mode}")
    merge = "greatest" if mode == "or" else "least"
    return F.expr(
        f"case when size({left}) = size({right}) then zip_with({left}, {right}, (a, b) -> {merge}(a, b)) "
        "else cast(raise_error('cannot combine masks with different lengths') as array<int>) end")


def confusion(gold: str, pred: str) -> Column:
    """struct<tp,fp,fn,tn> of two equally long label arrays; anything else is an error, never a lost row."""
    sums = (f"named_struct('tp', {total(f'zip_with({gold}, {pred}, (g, p) -> g * p)')}, 'g', {total(gold)}, "
            f"'p', {total(pred)}, 'n', size({gold}))")
    counts = let("cs", sums, (
        "named_struct('tp', cast(cs.tp as bigint), 'fp', cast(cs.p - cs.tp as bigint), "
        "'fn', cast(cs.g - cs.tp as bigint), 'tn', cast(cs.n - cs.g - cs.p + cs.tp as bigint))"))
    return F.expr(f"case when size({gold}) = size({pred}) and not exists({pred}, p -> p is null) then {counts} "
                  f"else raise_error(concat('labels do not fit: ', size({gold}), ' gold, ', coalesce(size({pred}), 'no'), ' predicted')) end")


def detected(indices: str, pred: str) -> Column:
    """A target is detected when it has gold words and all of them are predicted; a missing prediction is an error."""
    return F.expr(f"case when {pred} is null then cast(raise_error('no predicted labels for a target') as boolean) "
                  f"else size({indices}) > 0 and forall({indices}, i -> coalesce(get({pred}, i), 0) = 1) end")


def label_error(words: str, labels: str) -> Column:
    """Why labels are unusable (null when fine)."""
    return F.expr(
        f"case when {labels} is null then 'labels missing' "
        f"when size({words}) <> size({labels}) then concat('expected ', size({words}), ' labels, got ', size({labels})) "
        f"when not forall({labels}, l -> coalesce(l in (0, 1), false)) then 'every label must be integer 0 or 1' end")


def outcome(gold: str, pred: str) -> Column:
    """Disagreement class of one example; a null prediction means truncated."""
    bits = (f"zip_with({gold}, {pred}, (g, p) -> case when p is null then 4 when g = 1 and p = 0 then 1 "
            "when g = 0 and p = 1 then 2 else 0 end)")
    return F.expr(let("bits", bits, (
        "case when array_contains(bits, 4) then 'truncated' "
        "when array_contains(bits, 1) and array_contains(bits, 2) then 'missed+overmask' "
        "when array_contains(bits, 1) then 'missed' when array_contains(bits, 2) then 'overmask' else 'agreement' end")))
