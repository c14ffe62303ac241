"""Tokenizing, offsets, rendering and text normalisation."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from maskwright.functions import marks
from maskwright.functions.arrays import let, prefix_sums, sql_string

# The word and space classes spelled out, so that the result does not
# depend on a regex engine's Unicode flags.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
TOKEN = rf"[{WORD}]+(?:['’-][{WORD}]+)*|[^{WORD}{SPACE}]"
SPACED_TOKEN = rf"[{SPACE}]*(?:{TOKEN})"
MASK = "[REDACTED]"
PAIR_SEPARATOR = "[PAIR]"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {sql_string(TOKEN)}, 0)"


def tile(pattern: str) -> str:
    """A pattern, which matches no empty text, together with all that lies between two matches of it."""
    return rf"(?s)\G.*?(?-s:{pattern})"


def tiled_spans_sql(hits: str, tiles: str) -> str:
    """Offsets of matches from the matches with the gap before each: array<struct<word,start,end>>.

    The tiles follow on one another from the start of the text, so a match ends at the
    prefix sum of their lengths.
    """
    return (f"zip_with({hits}, {prefix_sums(f'transform({tiles}, x -> length(x))')}, "
            "(hit, stop) -> named_struct('word', hit, 'start', stop - length(hit), 'end', stop))")


def regex_spans_sql(text: str, pattern: str) -> str:
    """All matches of a pattern, which matches no empty text, with half-open code-point offsets."""
    matches = lambda p: f"regexp_extract_all({text}, {sql_string(p)}, 0)"
    return tiled_spans_sql(matches(pattern), matches(tile(pattern)))


def word_offsets_sql(text: str) -> str:
    """Words with offsets: array<struct<word,start,end>>.

    Only whitespace lies between words, so matching each word together with the
    whitespace before it gives the lengths to sum, without a split.
    """
    return tiled_spans_sql(words_sql(text), f"regexp_extract_all({text}, {sql_string(SPACED_TOKEN)}, 0)")


def words(text: Column) -> Column:
    """Words of a text: letter/digit runs joined by ' ’ or -, or one other visible character."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def word_offsets(text: str) -> Column:
    """Words with half-open code-point offsets of a column (or SQL expression)."""
    return regex_spans(text, TOKEN)


def regex_spans(text: str, pattern: str) -> Column:
    """regex_spans_sql for a column: the offsets come from marks, without sums over arrays."""
    hits = F.regexp_extract_all(F.expr(text), F.lit(pattern), F.lit(0))
    return F.zip_with(hits, marks.spans(marks.marked_sql(text, pattern), text), lambda hit, s: F.struct(
        hit.alias("word"), s["start"].alias("start"), s["end"].alias("end")))


def join_words(tokens: Column) -> Column:
    """Words joined by spaces, with no space before . , ! ? ; :"""
    return F.regexp_replace(F.array_join(tokens, " "), r"\s+([.,!?;:])", "$1")


def redact(tokens: Column, labels: Column, replacement: str | None = MASK) -> Column:
    """Replace label-1 words by ``replacement``, or drop them when it is None."""
    if replacement is None:
        kept = F.filter(
            F.zip_with(tokens, labels, lambda w, l: F.when(l == 0, w)), lambda w: w.isNotNull()
        )
        return join_words(kept)
    return join_words(F.zip_with(tokens, labels, lambda w, l: F.when(l == 1, F.lit(replacement)).otherwise(w)))


def selected_words(tokens: Column, labels: Column) -> Column:
    """Words with label 1, in order, repeats kept."""
    return F.filter(
        F.zip_with(tokens, labels, lambda w, l: F.when(l == 1, w)), lambda w: w.isNotNull()
    )


# a character reference with its semicolon, as HTML 5 writes names and numbers
_CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")


def _closed_reference(match: re.Match[str]) -> str:
    name = match[1]
    return html.unescape(match[0]) if name is None else html5.get(f"{name};", match[0])


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_closed(values: pd.Series) -> pd.Series:
    return values.map(lambda t: _CLOSED.sub(_closed_reference, t), na_action="ignore")


def unescape_html(text: Column, closed: bool = False) -> Column:
    """Resolve HTML entities; with ``closed`` only those that end in a semicolon, so that a text cut
    inside a reference (``&amp``) keeps what is left of it. Only texts that hold an ampersand travel to Python."""
    resolve = _unescape_closed if closed else _unescape
    return F.coalesce(resolve(F.when(F.contains(text, F.lit("&")), text)), text)


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, outer spaces and then outer double quotes removed."""
    return F.btrim(F.btrim(F.regexp_replace(text, rf"[{SPACE}]+", " "), F.lit(" ")), F.lit('"'))


def clean_text(text: Column, closed: bool = False) -> Column:
    return squeeze(unescape_html(text, closed))


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Full case folding beyond lower case, worked out from Unicode: (one to one, one to several)."""
    folded = {c: c.casefold() for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c and c.casefold() != c}
    return {c: f for c, f in folded.items() if len(f) == 1}, {c: f for c, f in folded.items() if len(f) > 1}


ONE_TO_ONE, ONE_TO_MANY = _foldings()


def _special() -> str:
    """A character class of what lower case and a replaced sharp s do not fold; low letters are ruled out by one range test."""
    folds = set(ONE_TO_ONE) | set(ONE_TO_MANY) - {"ß"}
    codes = sorted({ord(c) for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and folds & {c, *c.lower()}})
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    listed = lambda pairs: "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in pairs)
    low = [r for r in runs if r[1] < 0x100]
    return f"[{listed(low)}\\x{{100}}-\\x{{{codes[-1]:x}}}&&[{listed(runs)}]]"


SPECIAL = _special()


def signature(text: Column) -> Column:
    """Case-folded text, the key for duplicate detection.

    Letters that fold beyond lower case are rare, the sharp s aside; the raw text is searched for them once, and only
    texts that hold one take the longer way.
    """
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    full = F.translate(plain, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))
    for letter, letters in ONE_TO_MANY.items():
        full = F.replace(full, F.lit(letter), F.lit(letters))
    return F.when(text.rlike(SPECIAL), full).otherwise(plain)


def pair_text(left: Column, right: Column) -> Column:
    return F.concat_ws(f" {PAIR_SEPARATOR} ", left, right)


def row_id(task: Column | str, split: Column | str, index: Column) -> Column:
    """``task-split-index``."""
    task = F.lit(task) if isinstance(task, str) else task
    split = F.lit(split) if isinstance(split, str) else split
    return F.concat_ws("-", task, split, index.cast("string"))


def stable_key(*values: Column | str | int) -> Column:
    """SHA-256 of the ``::``-joined values, the order key of every deterministic draw."""
    parts = [v.cast("string") if isinstance(v, Column) else F.lit(str(v)) for v in values]
    return F.sha2(F.concat_ws("::", *parts), 256)


def code_point(char: Column) -> Column:
    """``U+XXXX`` of the first character."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), "0"))


def visible(text: Column) -> Column:
    """Show characters that are otherwise invisible."""
    # Character -> shown form.
    shown = {
        " ": "·",
        "\u00a0": "⟨NBSP:U+00A0⟩",
        "\u2009": "⟨THIN:U+2009⟩",
        "\u200b": "⟨ZWSP:U+200B⟩",
        "\x92": "⟨C1:U+0092⟩",
    }
    for char, form in shown.items():
        text = F.replace(text, F.lit(char), F.lit(form))
    return text


def excerpt(text: Column, start: Column, end: Column, context: int = 42, marks: tuple[str, str] = ("<mark>", "</mark>")) -> Column:
    """The target with ``context`` characters on each side, marked, cut sides shown by …"""
    lo = F.greatest(start - context, F.lit(0))
    hi = F.least(end + context, F.length(text))
    return F.concat(
        F.when(lo > 0, "…").otherwise(""),
        F.substring(text, lo + 1, start - lo),
        F.lit(marks[0]), F.substring(text, start + 1, end - start), F.lit(marks[1]),
        F.substring(text, end + 1, hi - end),
        F.when(hi < F.length(text), "…").otherwise(""),
    )
