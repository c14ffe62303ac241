"""Pieces of the checking SQL. They restate the semantics with joins and windows over
exploded words, independently of how the library computes them."""

from __future__ import annotations

import math

import numpy as np

from maskwright.sources import tables as T

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
TOKEN = rf"[{WORD}]+(?:[''’-][{WORD}]+)*|[^{WORD}{SPACE}]"

NOTES = f"select {', '.join(T.NOTE_COLUMNS)} from orders"
DOCS = "select doc_id as id, text, lang, source from documents"
SCORED = f"select {', '.join(T.SCORE_COLUMNS)} from events"
ENTITIES = " union all ".join(
    f"select cast(o_orderkey as varchar) as id, {NOTE} as text, {order} as span_order, cast(({surface}) as varchar) as surface, {kind} as type from orders"
    for NOTE in [T.NOTE] for order, surface, kind in T.ENTITIES)

# The nine patterns as this engine's regex dialect writes them.
PATTERNS = {
    "glued_dosage": ("1.3", r"(?i)\b\d+(?:[.,]\d+)?(?:mg|mcg|ug|ml|l|g|kg|cc|units?|iu|mmol|meq|%|mmhg|bpm|cm|mm)\b"),
    "c1_control": ("1.3", rf"[^{SPACE}]*[\x{{80}}-\x{{9f}}][^{SPACE}]*"),
    "possessive": ("1.3", r"\b[A-Z][A-Za-z-]+(?:[''’]{1,2}s)\b"),
    "long_identifier": ("1.3", r"\b(?:\d{7,}|\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{2}-\d{4}|\d{2,3}-\d{2,3}-\d{2,3})\b"),
    "email": ("1.4", rf"[{WORD}.+-]+@[{WORD}-]+\.[A-Za-z]{{2,}}"),
    "url": ("1.4", rf"(?i)(?:https?://|www\.)[{WORD}./%\-?=&#+~]+"),
    "social_handle": ("1.4", rf"(?:^|[^{WORD}.@])@[A-Za-z][{WORD}.]{{2,}}"),
    "zip4": ("1.4", r"\b\d{5}-\d{4}\b"),
    "numeric_date": ("1.4", r"\b(?:0?[1-9]|[12]\d|3[01])[/.-](?:0?[1-9]|[12]\d|3[01])[/.-](?:\d{4}|\d{2})\b"),
}


def tokens(source: str, key: str = "id", text: str = "text") -> str:
    """(key, pos, word, s, e) of a relation: pos from 0, offsets half open."""
    return f"""
        select {key}, pos, word, cast(e - length(word) as bigint) as s, cast(e as bigint) as e from (
            select {key}, pos, word, sum(length(spaced)) over (partition by {key} order by pos) as e from (
                select {key}, unnest(regexp_extract_all({text}, '{TOKEN}')) as word,
                       unnest(regexp_extract_all({text}, '[{SPACE}]*(?:{TOKEN})')) as spaced,
                       unnest(range(len(regexp_extract_all({text}, '{TOKEN}')))) as pos
                from ({source})))"""


def spans(source: str, version: str = "1.4", names: tuple[str, ...] | None = None, key: str = "id",
          extra: dict[str, str] | None = None) -> str:
    """(key, rule, introduced_in, hit, occurrence, s, e) of the pattern rules up to a version."""
    chosen = [(n, v, p) for n, (v, p) in PATTERNS.items()
              if (n in names if names else v <= version)]
    chosen += [(n, "1.0", p) for n, p in (extra or {}).items()]
    parts = []
    for name, introduced, pattern in chosen:
        # a social handle is matched with the character before it, which is then dropped
        hit = "regexp_replace(m, '^[^@]+', '')" if name == "social_handle" else "m"
        parts.append(f"""
            select {key}, '{name}' as rule, '{introduced}' as introduced_in, {hit} as hit, occurrence,
                   cast(e - length({hit}) as bigint) as s, cast(e as bigint) as e from (
                select {key}, m, occurrence, sum(length(m) + length(g)) over (partition by {key} order by occurrence) as e from (
                    select {key}, unnest(regexp_extract_all(text, '{pattern}')) as m,
                           unnest(list_slice(regexp_split_to_array(text, '{pattern}'), 1, len(regexp_extract_all(text, '{pattern}')))) as g,
                           unnest(range(len(regexp_extract_all(text, '{pattern}')))) as occurrence
                    from ({source}) where regexp_matches(text, '{pattern}')))""")
    return " union all ".join(parts)


def labelled(source: str, version: str = "1.4", key: str = "id", tok: str | None = None, extra: dict[str, str] | None = None) -> str:
    """(key, pos, word, s, e, label) under the rules up to a version."""
    tok = tok or f"({tokens(source, key)})"
    return f"""
        select t.{key}, t.pos, t.word, t.s, t.e, cast(x.pos is not null as bigint) as label
        from {tok} t left join (
            select distinct t.{key}, t.pos from {tok} t join ({spans(source, version, key=key, extra=extra)}) r
            on r.{key} = t.{key} and t.s < r.e and r.s < t.e) x
        on x.{key} = t.{key} and x.pos = t.pos"""


def render(words: str) -> str:
    return f"regexp_replace({words}, '\\s+([.,!?;:])', '\\1', 'g')"


def scores(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> str:
    """Metric columns from counts, rounded."""
    def ratio(top: str, bottom: str) -> str:
        return f"coalesce(({top})::double / nullif({bottom}, 0), 0)"
    n = f"({tp} + {fp} + {fn} + {tn})"
    recall = ratio(tp, f"{tp} + {fn}")
    columns = {
        "precision": ratio(tp, f"{tp} + {fp}"), "recall": recall, "f1": ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"),
        "f2": ratio(f"5 * {tp}", f"5 * {tp} + 4 * {fn} + {fp}"), "gold_mask_rate": ratio(f"{tp} + {fn}", n),
        "predicted_mask_rate": ratio(f"{tp} + {fp}", n), "residual_sensitive_rate": f"1 - {recall}",
        "overmask_rate": f"{fp}::double / greatest({fp} + {tn}, 1)",
    }
    return f"cast({n} as bigint) as tokens, " + ", ".join(f"round({v}, 9) as \"{k}\"" for k, v in columns.items())


def confusion(gold: str, pred: str) -> str:
    return ", ".join(f"count_if({g} = {a} and {p} = {b}) as {n}" for n, a, b in (
        ("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)) for g, p in ((gold, pred),))


# Fixed values, stated here on their own: the noise types (name, group, family, replacement code points, counts as
# sensitive), the units of a dosage, the thresholds and the steps of a Poisson(1) weight.
NOISES = (
    ("double_space", "seen", "space", (0x20, 0x20), 0), ("curly_apostrophe", "seen", "apostrophe", (0x2019,), 1),
    ("c1_apostrophe", "seen", "apostrophe", (0x92,), 1), ("dosage_join", "seen", "dosage", (), 1), ("comma_after_number", "seen", "punctuation", (0x2C,), 0),
    ("triple_space", "unseen", "space", (0x20, 0x20, 0x20), 0), ("nbsp", "unseen", "space", (0xA0,), 0), ("modifier_apostrophe", "unseen", "apostrophe", (0x2BC,), 1),
    ("dosage_hyphen", "unseen", "dosage", (0x2D,), 1), ("dosage_thin_space", "unseen", "dosage", (0x2009,), 1),
    ("semicolon_after_number", "unseen", "punctuation", (0x3B,), 0), ("zero_width_inside", "unseen", "inside", (0x200B,), 0),
    ("zwnj_inside", "future", "inside", (0x200C,), 0), ("word_joiner_inside", "future", "inside", (0x2060,), 0), ("soft_hyphen_inside", "future", "inside", (0xAD,), 0),
    ("fullwidth_apostrophe", "future", "apostrophe", (0xFF07,), 1), ("dosage_nb_hyphen", "future", "dosage", (0x2011,), 1),
    ("narrow_nbsp", "future", "space", (0x202F,), 0), ("right_paren_after_number", "future", "punctuation", (0x29,), 0),
)
THRESHOLDS = tuple(float(t) for t in np.linspace(0.05, 0.95, 91))
POISSON = tuple(x for k in range(30) if (x := round(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**20)) < 2**20)


def noise_values(group: str) -> str:
    wanted = ("seen", "unseen") if group == "all" else (group,)
    rows = ", ".join(
        "('{}', '{}', '{}', {}, {})".format(name, kind, family, " || ".join(f"chr({code})" for code in codes) or "''", masked)
        for name, kind, family, codes, masked in NOISES if kind in wanted)
    return f"(values {rows}) as z(noise_type, noise_group, family, repl, masked)"
