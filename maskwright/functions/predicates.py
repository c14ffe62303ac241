"""Row and word predicates (Column -> boolean Column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import lexicons as lx
from maskwright.functions.text import signature

DIGIT = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"
EDGE_PUNCTUATION = ".,:;!?()[]{}\"'`-/\\"


def usable(text: Column, longest: int = 1000, spaced: bool = True) -> Column:
    """10..longest characters and not a deleted-post marker."""
    markers = lx.DELETED_SPACED if spaced else lx.DELETED
    return F.length(text).between(10, longest) & ~F.btrim(signature(text), F.lit(" ")).isin(*markers)


def _has_substance(low: Column) -> Column:
    """Holds a letter or digit and is not one single letter."""
    return low.rlike(r"[\p{L}\p{N}]") & ~low.rlike(r"^\p{L}$")


def keep_medical_word(word: Column, stop_words: Sequence[str] = lx.STOP_WORDS) -> Column:
    low = F.lower(word)
    bare = F.btrim(low, F.lit(EDGE_PUNCTUATION))
    return (
        (low != "") & ~low.isin(*stop_words) & ~low.isin(*lx.CLINICAL_STOP)
        & ~bare.isin(*lx.CLINICAL_STOP) & _has_substance(low)
    )


def keep_entity_word(word: Column, strict: bool, stop_words: Sequence[str] = lx.STOP_WORDS) -> Column:
    low = F.lower(word)
    keep = (low != "") & ~low.isin(*stop_words) & _has_substance(low)
    return keep & low.rlike(r"\p{L}") if strict else keep


def dated(text: Column) -> Column:
    """A DATE entity with a 19xx/20xx year that is not a duration."""
    return text.rlike(lx.YEAR_PATTERN) & ~text.rlike(lx.DURATION_PATTERN)


def is_long_word(word: Column) -> Column:
    return word.rlike(r"^\p{L}{5,}$")


def has_digit(word: Column) -> Column:
    return word.rlike(f"[{DIGIT}]")


def is_number(word: Column) -> Column:
    return word.rlike(r"^\p{Nd}+$")


def is_dosage_unit(word: Column) -> Column:
    return F.rtrim(F.lower(word), F.lit(".")).isin(*lx.DOSAGE_UNITS)


def is_contraction(word: Column) -> Column:
    """I'm, can't, they've ... but not O'Hara or patient's."""
    return word.rlike(r"(?i)^\p{L}+(?:n['’]t|['’](?:m|re|ve|ll|d))$")


def is_figure_label(word: Column) -> Column:
    """A lower-case word glued to a number, such as fig1."""
    return word.rlike(r"^\p{Ll}+\p{Nd}+$")


def rule_exclusion(word: Column) -> Column:
    """Words no rule masks: contractions, single characters, figure labels."""
    return is_contraction(word) | (F.length(word) == 1) | is_figure_label(word)
