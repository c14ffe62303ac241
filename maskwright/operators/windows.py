"""Pairs scored and replayed from marks, without building their texts, words and labels.

Spark's patterns mark the words and the rules' matches of a text (``functions.marks``). What follows is worked out for all rows
of an Arrow batch at once: labels, the sites of the noise families, the words that rules can label anew after an edit and the
word-level student. Only the scanned window around an edit is marked again; the words outside it count as in the clean text.
The results are those of perturb.build_pairs, rules.labels_after_edit and robustness.score_pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from maskwright.functions import marks
from maskwright.functions.arrays import sql_string
from maskwright.functions.lexicons import DOSAGE_UNITS
from maskwright.functions.marks import CLOSE, COPY, OPEN
from maskwright.functions.predicates import DIGIT
from maskwright.functions.text import TOKEN
from maskwright.operators.metrics import with_scores
from maskwright.operators.perturb import Noise
from maskwright.operators.rules import Rule, marked_copies_sql, reach
from maskwright.session import with_once

#: Stand for letters and digits beyond ASCII in marked words, whose kinds only Spark's patterns know.
LETTER, NUMBER, SIGN = "\x05", "\x06", "\x07"
FAMILIES = ("apostrophe", "dosage", "inside", "punctuation", "space")
_IS_SIGN, _IS_NUMBER, _IS_LETTER = 1, 2, 4


def marked_words_sql(text: str) -> str:
    """The text with every word between marks and every letter or digit beyond ASCII as its kind; a Kelvin sign is a k, as in lower case."""
    own = f"rlike({text}, {sql_string(f'[{OPEN}{CLOSE}{COPY}{LETTER}{NUMBER}{SIGN}]')})"
    safe = f"case when {own} then translate({text}, '{OPEN}{CLOSE}{COPY}{LETTER}{NUMBER}{SIGN}', '{chr(3) * 6}') else {text} end"
    marked = f"regexp_replace({safe}, {sql_string(TOKEN)}, '{OPEN}$0{CLOSE}')"
    kinds = f"replace({marked}, 'K', 'k')"
    for pattern, kind in ((r"[\p{Nd}&&[^\x00-\x7f]]", NUMBER), (rf"[{DIGIT}&&[^\x00-\x7f]]", SIGN), (r"[\p{L}&&[^\x00-\x7f]]", LETTER)):
        kinds = f"regexp_replace({kinds}, {sql_string(pattern)}, '{kind}')"
    return f"case when rlike({text}, {sql_string(r'[\p{L}\p{N}&&[^\x00-\x7f]]')}) then {kinds} else {marked} end"


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[ord("0"):ord("9") + 1] = out[ord(NUMBER)] = _IS_NUMBER | _IS_SIGN
    out[ord(SIGN)] = _IS_SIGN
    out[ord("A"):ord("Z") + 1] = out[ord("a"):ord("z") + 1] = out[ord(LETTER)] = _IS_LETTER
    return out


_KINDS = _kinds()


def _shifted(values: np.ndarray, blank) -> np.ndarray:
    """Each place's next value."""
    out = np.full_like(values, blank)
    out[:-1] = values[1:]
    return out


def _ranges(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after the other."""
    size = stop - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def _rows_of(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of the lists of items that lie in order of their rows."""
    return np.searchsorted(row, np.arange(rows + 1))


@dataclass(frozen=True)
class _Touched:
    """Marked matches: their rows, places in the row and copies, and the words (half open) that share a character with each."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    last: np.ndarray
    words: int

    def labels(self, copies: Sequence[int] | None = None) -> np.ndarray:
        """1 for every word that shares a character with a match (in one of the copies)."""
        size = self.words + 1
        some = slice(None) if copies is None else np.isin(self.copies, copies)
        count = lambda at: np.bincount(at[some], minlength=size)
        return (np.cumsum(count(self.first) - count(self.last))[:-1] > 0).astype(np.int64)


def _touched(matches: pa.Array, length: np.ndarray, base: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> _Touched:
    """``length`` is that of each row's text, ``base`` where it starts in the line of places that the words' starts and ends count in."""
    found = marks._marks(matches)
    row, start, end = marks._wrapped(found, length)
    # words lie in order, so those that share a character with a match are a run of them
    first, last = np.searchsorted(ends, start + base[row], "right"), np.searchsorted(starts, end + base[row], "left")
    return _Touched(row, start, end, found.copies, first, last, len(starts))


class _Words:
    """The words of marked texts; places count characters from the start of the batch, ``base`` is where each row starts."""

    def __init__(self, marked: pa.Array):
        large = marked.cast(pa.large_string())
        self.rows = len(large)
        edges = np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + self.rows + 1]
        data = large.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        self.raw, self.opening, self.closing = raw, np.flatnonzero(raw == ord(OPEN)), np.flatnonzero(raw == ord(CLOSE))
        counted = (raw & 0xC0) != 0x80
        counted[self.opening] = counted[self.closing] = False
        self.seen = np.concatenate([[0], np.cumsum(counted)])
        self.offsets = np.searchsorted(self.opening, edges)
        self.start, self.end, before = self.seen[self.opening], self.seen[self.closing], self.seen[edges]
        self.base, self.length = before[:-1], np.diff(before)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.offsets))
        self.size = len(self.start)
        self.edges = edges

    def touched(self, matches: pa.Array) -> _Touched:
        return _touched(matches, self.length, self.base, self.start, self.end)

    @functools.cached_property
    def _kind_sums(self) -> np.ndarray:
        return _KINDS[self.raw]

    def _having(self, kind: int) -> np.ndarray:
        """How many of a word's characters are of a kind; each takes one byte."""
        sums = np.concatenate([[0], np.cumsum((self._kind_sums & kind) != 0)])
        return sums[self.closing] - sums[self.opening]

    @functools.cached_property
    def lower(self) -> pa.Array:
        """The words in lower case, as far as ASCII goes."""
        depth = np.zeros(len(self.raw) + 1, np.int8)
        depth[self.opening + 1], depth[self.closing] = 1, -1
        body = self.raw[np.cumsum(depth, dtype=np.int8)[:-1] == 1]
        body = np.where((body >= ord("A")) & (body <= ord("Z")), body | 0x20, body)
        offsets = np.concatenate([[0], np.cumsum(self.closing - self.opening - 1)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.size, [None, pa.py_buffer(offsets), pa.py_buffer(body)])

    def among(self, terms: Sequence[str], at: np.ndarray | None = None) -> np.ndarray:
        words = self.lower if at is None else self.lower.take(pa.array(at))
        return pc.is_in(words, value_set=pa.array([t.encode() for t in terms], pa.large_binary())).to_numpy(zero_copy_only=False)

    @functools.cached_property
    def has_digit(self) -> np.ndarray:
        return self._having(_IS_SIGN) > 0

    def student(self, terms: Sequence[str]) -> np.ndarray:
        """1 for words that hold a digit or are listed."""
        return (self.has_digit | self.among(terms)).astype(np.int64)

    def sites(self, label: np.ndarray, families: Sequence[str]) -> dict[str, tuple[np.ndarray, ...]]:
        """First eligible site a row of each family: (first word, last word, cut start, cut end), as _site_sql of perturb finds it."""
        on = label == 1
        same = _shifted(self.row, -1) == self.row
        after, closed = _shifted(self.start, 0), np.append(self.raw, 0)
        both = on & same & _shifted(on, False) & (after > self.end)
        out = {}
        for family in families:
            if family == "space":
                at = np.flatnonzero(both)
            elif family == "dosage":
                at = np.flatnonzero(both & (self._having(_IS_NUMBER) == self.closing - self.opening - 1))
                at = at[self.among(DOSAGE_UNITS, at + 1)]
            elif family == "punctuation":
                sign = closed[_shifted(self.opening, len(self.raw) - 1) + 1]
                single = _shifted(self.closing - self.opening, 0) == 2
                mark = same & (after == self.end) & single & ((sign == ord(",")) | (sign == ord(";")) | (sign == ord(":")))
                at = np.flatnonzero(on & self.has_digit & ~mark)
            elif family == "apostrophe":
                signs = self._apostrophes
                next_sign = np.append(signs, len(self.raw) + 1)[np.searchsorted(signs, self.opening)]
                at = np.flatnonzero(on & (next_sign < self.closing))
            else:
                at = np.flatnonzero(on & (self._having(_IS_LETTER) == self.closing - self.opening - 1) & (self.end - self.start >= 5))
            at = at[np.unique(self.row[at], return_index=True)[1]]
            last = at + 1 if family in ("space", "dosage") else at
            if family in ("space", "dosage"):
                cut = self.end[at], self.start[last]
            elif family == "punctuation":
                cut = self.end[at], self.end[at]
            elif family == "apostrophe":
                cut = self.seen[next_sign[at]], self.seen[next_sign[at]] + 1
            else:
                cut = (self.start[at] + (self.end[at] - self.start[at]) // 2,) * 2
            out[family] = (at, last, *cut)
        return out

    @functools.cached_property
    def _apostrophes(self) -> np.ndarray:
        plain = self.raw == ord("'")
        curly = np.zeros(len(self.raw), bool)
        if len(self.raw) > 2:
            curly[:-2] = (self.raw[:-2] == 0xE2) & (self.raw[1:-1] == 0x80) & (self.raw[2:] == 0x99)
        return np.flatnonzero(plain | curly)

    def holding_next_line(self) -> np.ndarray:
        """Rows that hold U+0085, which is a space to the tokenizer but joins runs for one rule."""
        found = np.flatnonzero((self.raw[:-1] == 0xC2) & (self.raw[1:] == 0x85)) if len(self.raw) > 1 else np.zeros(0, np.int64)
        out = np.zeros(self.rows, bool)
        out[np.searchsorted(self.edges, found, "right") - 1] = True
        return out


@dataclass(frozen=True)
class _Windows:
    """Words around sites: of the whitespace-delimited runs the edit touches, those labelled anew and those scanned (half open)."""

    run: tuple[np.ndarray, np.ndarray]
    take: tuple[np.ndarray, np.ndarray]
    scan: tuple[np.ndarray, np.ndarray]


def _windows(w: _Words, first: np.ndarray, last: np.ndarray, spans: int) -> _Windows:
    starts_row = np.ones(w.size, bool)
    starts_row[1:] = w.row[1:] != w.row[:-1]
    breaks = starts_row.copy()
    breaks[1:] |= w.start[1:] > w.end[:-1]
    at, run = np.append(np.flatnonzero(breaks), w.size), np.cumsum(breaks) - 1
    row = w.row[first]
    low, high = run[w.offsets[row]], run[w.offsets[row + 1] - 1]  # the row's first and last run
    back = lambda n: at[np.maximum(run[first] - n, low)]
    on = lambda n: at[np.minimum(run[last] + n, high) + 1]
    near, far = spans - 1, 2 * (spans - 1)
    whole = w.holding_next_line()[row]
    wide = lambda n: (np.where(whole, w.offsets[row], back(n)), np.where(whole, w.offsets[row + 1], on(n)))
    return _Windows((back(0), on(0)), wide(near), wide(far))


#: The systems as functions of the rule's and the student's label of a word.
SYSTEMS = {"rule": lambda r, s: r, "student": lambda r, s: s, "or": max, "and": min}
#: Numbers 4 gold + 2 rule + student of a clean word, whose gold is the rule's label.
SAME = (0, 1, 6, 7)
_PLACES = ("cut_start", "cut_end", "target_start", "target_end", "scan_start", "scan_end", "near_start", "near_end", "near_front", "near_back",
           "run_front", "run_back", "take_front", "take_back")


def _ints(*names: str) -> StructType:
    out = StructType()
    for name in names:
        out = out.add(name, IntegerType())
    return out


_SITE = _ints("s_family", *[f"s_{p}" for p in _PLACES], *[f"s_o{k}" for k in SAME], *[f"s_{name}" for name in SYSTEMS]).add("s_words", ArrayType(LongType()))
_NOTE = _ints(*[f"k{k}" for k in SAME]).add("sites", ArrayType(_SITE))
_NOISY = _ints(*[f"n_{name}" for name in SYSTEMS], *[f"j{k}" for k in range(8)])


def _clean_sites(words: pa.Array, matches: pa.Array, families: Sequence[str], terms: Sequence[str], spans: int,
                 near_rules: Sequence[int]) -> pa.Array:
    w = _Words(words)
    touched = w.touched(matches)
    label, short = touched.labels(), touched.labels(near_rules)
    student = w.student(terms)
    found = w.sites(label, families)
    order = np.argsort(np.concatenate([w.row[f[0]] for f in found.values()]), kind="stable")
    joined = lambda i: np.concatenate([f[i] for f in found.values()])[order]
    first, last, cut_start, cut_end = (joined(i) for i in range(4))
    family = np.repeat([FAMILIES.index(f) for f in found], [len(f[0]) for f in found.values()])[order]
    row, v = w.row[first], _windows(w, first, last, spans)
    base = w.base[row]
    whole = w.holding_next_line()[row]
    scan_start = np.where(whole, base, w.start[v.scan[0]] if w.size else base)
    scan_end = np.where(whole, base + w.length[row], w.end[v.scan[1] - 1] if w.size else base)
    code = label * 6 + student  # gold and rule are one and the same in the clean text
    within = np.stack([np.concatenate([[0], np.cumsum(code == k)]) for k in SAME])
    totals = within[:, w.offsets[1:]] - within[:, w.offsets[:-1]]
    outside = totals[:, row] - (within[:, v.scan[1]] - within[:, v.scan[0]])
    near = [np.where(whole, *both) for both in zip((w.offsets[row], w.offsets[row + 1]), v.run, strict=True)]
    near_start = np.where(whole, base, w.start[v.run[0]] if w.size else base)
    near_end = np.where(whole, base + w.length[row], w.end[v.run[1] - 1] if w.size else base)
    size = v.scan[1] - v.scan[0]
    at = _ranges(*v.scan)
    start = np.repeat(scan_start, size)
    packed = ((w.start[at] - start) << 32) | ((w.end[at] - start) << 3) | (student[at] << 2) | (short[at] << 1) | label[at]
    hit = lambda labels: labels[first] & labels[last]
    shown = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(packed.astype(np.int64)))
    places = (cut_start - base, cut_end - base, w.start[first] - base, w.end[last] - base, scan_start - base, scan_end - base,
              near_start - base, near_end - base, near[0] - v.scan[0], v.scan[1] - near[1],
              v.run[0] - v.scan[0], v.scan[1] - v.run[1], v.take[0] - v.scan[0], v.scan[1] - v.take[1])
    flat = (family, *places, *outside, hit(label), hit(student), hit(label | student), hit(label & student))
    sites = pa.StructArray.from_arrays([*[pa.array(x.astype(np.int32)) for x in flat], shown], _SITE.names)
    lists = pa.ListArray.from_arrays(pa.array(_rows_of(row, w.rows).astype(np.int32)), sites)
    return pa.StructArray.from_arrays([*[pa.array(t.astype(np.int32)) for t in totals], lists], _NOTE.names)


def _noisy_scores(words: pa.Array, short: pa.Array, wide: pa.Array, site: pa.Array, terms: Sequence[str]) -> pa.Array:
    w = _Words(words)
    known = {f.name: site.field(i) for i, f in enumerate(site.type)}
    n = {k: v.to_numpy(zero_copy_only=False).astype(np.int64) for k, v in known.items() if k != "words"}
    packed = known["words"].flatten().to_numpy(zero_copy_only=False)
    many = pc.list_value_length(known["words"]).to_numpy(zero_copy_only=False).astype(np.int64)
    lo = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64)
    start, end, label = packed >> 32, (packed & 0xFFFFFFFF) >> 3, packed & 1
    moved = n["size"] - (n["cut_end"] - n["cut_start"])
    # the scanned words: those before the marked text from the clean text, the marked ones, and those after it, moved
    size = n["near_front"] + np.diff(w.offsets) + n["near_back"]
    row = np.repeat(np.arange(w.rows), size)
    of = lambda k: n[k][row]
    shift = moved[row]
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    left = size[row] - place  # words from this one on
    back, in_near = left <= of("near_back"), (place >= of("near_front")) & (left > of("near_back"))
    in_run = (place >= of("run_front")) & (left > of("run_back"))
    in_take = (place >= of("take_front")) & (left > of("take_back"))
    clean = lo[row] + np.where(back, many[row] - left, place)

    def mixed(made: np.ndarray, before: np.ndarray, later: int | np.ndarray = 0) -> np.ndarray:
        """Marked words' values, others' values in the clean text; the marked words lie in order."""
        out = np.empty(len(row), np.int64)
        out[in_near] = made
        out[~in_near] = before[clean[~in_near]] + (later[~in_near] if isinstance(later, np.ndarray) else later)
        return out

    place_of = (n["near_start"] - n["scan_start"] - w.base)[w.row]
    s, e = (mixed(x + place_of, y, np.where(back, shift, 0)) for x, y in ((w.start, start), (w.end, end)))
    student = mixed(w.student(terms), packed >> 2 & 1)
    # a line of places for all rows
    room = n["scan_end"] - n["scan_start"] + np.abs(moved) + 2
    line = np.concatenate([[0], np.cumsum(room)[:-1]]).astype(np.int64)
    far = _touched(wide, n["scan_end"] - n["scan_start"] + moved, line, s + line[row], e + line[row]).labels()
    near = mixed(w.touched(short).labels(), packed >> 1 & 1) | far
    # sensitive words of the clean text's run
    owner, index = np.repeat(np.arange(w.rows), many), np.arange(len(packed)) - np.repeat(lo, many)
    masked = (label == 1) & (index >= n["run_front"][owner]) & (index < (many - n["run_back"])[owner])
    mask_start, mask_end = (start + line[owner])[masked], (end + line[owner])[masked]

    def touch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cap = room[row] - 1
        at = lambda x: np.clip(x, 0, cap) + line[row]
        return (a < b) & (np.searchsorted(mask_start, at(b), "left") > np.searchsorted(mask_end, at(a), "right"))

    cut, fresh = of("cut_start") - of("scan_start"), of("cut_start") - of("scan_start") + of("size")
    made = (touch(s, np.minimum(e, cut)) | ((of("masked") == 1) & (s < fresh) & (cut < e)) | touch(np.maximum(s, fresh) - shift, e - shift))
    # words outside the runs that the edit touches have the clean text's labels
    kept = label[np.where(in_run, 0, lo[row] + np.where(place < of("run_front"), place, many[row] - left))]
    gold = np.where(in_run, made, kept)
    rule = np.where(in_take, near, kept)
    target_start = of("target_start") - of("scan_start")
    target_end = of("target_end") - of("scan_start") + np.where(of("cut_start") < of("target_end"), shift, 0)
    target = in_run & (gold == 1) & (s < target_end) & (target_start < e)
    aims = np.bincount(row[target], minlength=w.rows)
    hit = lambda labels: (aims > 0) & (np.bincount(row[target & (labels == 1)], minlength=w.rows) == aims)
    joint = np.bincount(row * 8 + gold * 4 + rule * 2 + student, minlength=w.rows * 8).reshape(w.rows, 8)
    for k in SAME:
        joint[:, k] += n[f"o{k}"]
    flat = (hit(rule), hit(student), hit(rule | student), hit(rule & student), *joint.T)
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in flat], _NOISY.names)


def _counts(joint: str, known: Sequence[int], pred: Callable[[int, int], int]) -> Column:
    """struct<tp,fp,fn,tn> of a system that is a function of the rule's and the student's label, from the counts by gold, rule and student."""
    total = lambda gold, wanted: " + ".join(["0L", *[f"cast({joint}{k} as bigint)" for k in known if k // 4 == gold and pred(k // 2 % 2, k % 2) == wanted]])
    return F.expr(f"named_struct('tp', {total(1, 1)}, 'fp', {total(0, 1)}, 'fn', {total(1, 0)}, 'tn', {total(0, 0)})")


def _checked(terms: Sequence[str]) -> tuple[str, ...]:
    if not all(t.isascii() and t == t.lower() for t in terms):
        raise ValueError("terms are words in lower case of ASCII letters")
    return tuple(terms)


def _families(chosen: Sequence[Noise]) -> tuple[str, ...]:
    return tuple(f for f in FAMILIES if any(n.family == f for n in chosen))


def scored_pairs(rows: DataFrame, chosen: Sequence[Noise], rules: tuple[Rule, ...], terms: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """robustness.score_pairs of all pairs of ``rows`` (id, text) for the rules, whose labels are the gold, the student and both combined.

    The student masks the words of ``terms`` (lower case, ASCII) and those with a digit.
    """
    terms, families, spans = _checked(terms), _families(chosen), reach(rules)

    # a match of most rules lies within a run, so what these rules see of an edit is the runs it touches
    near_rules, wide_rules = tuple(r for r in rules if r.reach == 1), tuple(r for r in rules if r.reach > 1)
    near_copies = [i for i, r in enumerate(rules) if r.reach == 1]

    @F.arrow_udf(_NOTE)
    def clean(words: pa.Array, matches: pa.Array) -> pa.Array:
        kernel = functools.partial(_clean_sites, families=families, terms=terms, spans=spans, near_rules=near_copies)
        return marks.in_parts(kernel, words, matches)

    @F.arrow_udf(_NOISY)
    def noisy(words: pa.Array, short: pa.Array, wide: pa.Array, site: pa.Array) -> pa.Array:
        return marks.in_parts(functools.partial(_noisy_scores, terms=terms), words, short, wide, site)

    kinds = "array(" + ", ".join("array(" + ", ".join(
        f"named_struct('noise_type', '{n.name}', 'replacement', {sql_string(n.replacement)}, 'masked', {n.masked})"
        for n in chosen if n.family == f) + ")" if f in families else "null" for f in FAMILIES) + ")"
    text = "coalesce(text, '')"
    # structs are taken apart by generators: one that is passed on whole would be narrowed by the optimizer where it is used, at times wrongly
    notes = rows.select("id", *carry, "text", F.inline(F.array(clean(F.expr(marked_words_sql(text)), F.expr(marked_copies_sql(text, rules))))))
    sites = notes.select("id", *carry, "text", *[f"k{k}" for k in SAME], F.inline("sites"))
    edits = sites.select("*", F.expr(f"inline(get({kinds}, s_family))"))
    part = lambda p: (f"concat(substring(text, s_{p}_start + 1, s_cut_start - s_{p}_start), replacement, "
                      f"substring(text, s_cut_end + 1, s_{p}_end - s_cut_end))")
    made = with_once(edits, near=F.expr(part("near")), scan=F.expr(part("scan"))).drop("text")
    site = F.struct(*[F.col(f"s_{f}").alias(f) for f in (*_PLACES, *[f"o{k}" for k in SAME], "words")], "masked", F.length("replacement").alias("size"))
    scored = made.select(
        F.col("id").cast("string").alias("source_id"), *carry, "noise_type", *[f"k{k}" for k in SAME], *[f"s_{name}" for name in SYSTEMS],
        F.inline(F.array(noisy(F.expr(marked_words_sql("near")), F.expr(marked_copies_sql("near", near_rules)),
                             F.expr(marked_copies_sql("scan", wide_rules)), site))))
    return scored.select(
        F.concat_ws("::", "source_id", "noise_type").alias("pair_id"), "source_id", "noise_type", *carry,
        *[column for name, pred in SYSTEMS.items() for column in (
            F.col(f"s_{name}").alias(f"{name}_clean"), F.col(f"n_{name}").alias(f"{name}_noisy"),
            _counts("k", SAME, pred).alias(f"{name}_c"), _counts("j", range(8), pred).alias(f"{name}_n"))])


_KEYS = StructType().add("families", ArrayType(IntegerType())).add("masked", IntegerType())


def _key_sites(words: pa.Array, matches: pa.Array, families: Sequence[str], terms: Sequence[str]) -> pa.Array:
    w = _Words(words)
    found = w.sites(w.touched(matches).labels(), families)
    row = np.concatenate([w.row[f[0]] for f in found.values()])
    order = np.argsort(row, kind="stable")
    family = np.repeat([FAMILIES.index(f) for f in found], [len(f[0]) for f in found.values()])[order]
    lists = pa.ListArray.from_arrays(pa.array(_rows_of(row[order], w.rows).astype(np.int32)), pa.array(family.astype(np.int32)))
    masked = np.bincount(w.row[w.student(terms) == 1], minlength=w.rows)
    return pa.StructArray.from_arrays([lists, pa.array(masked.astype(np.int32))], _KEYS.names)


def pair_keys(rows: DataFrame, chosen: Sequence[Noise], rules: tuple[Rule, ...], terms: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """(id, noise_type, masked) of all pairs of ``rows`` (id, text), whose labels are the rules', without the edits.

    ``masked`` is how many words the student masks in the clean text: a source is predicted once and its pairs carry what came out.
    """
    terms, families = _checked(terms), _families(chosen)

    @F.arrow_udf(_KEYS)
    def keys(words: pa.Array, matches: pa.Array) -> pa.Array:
        return marks.in_parts(functools.partial(_key_sites, families=families, terms=terms), words, matches)

    kinds = "array(" + ", ".join("array(" + ", ".join(sql_string(n.name) for n in chosen if n.family == f) + ")" for f in FAMILIES) + ")"
    text = "coalesce(text, '')"
    found = rows.select("id", *carry, F.inline(F.array(keys(F.expr(marked_words_sql(text)), F.expr(marked_copies_sql(text, rules))))))
    return found.select("id", *carry, "masked", F.explode(F.expr(f"flatten(transform(families, f -> get({kinds}, f)))")).alias("noise_type"))


_TARGET = _ints("rule", "start", "end", "occurrence", "old_hit", "student_hit")
_REPLAY = _ints(*[f"j{k}" for k in range(8)]).add("targets", ArrayType(_TARGET))


def _replayed(words: pa.Array, matches: pa.Array, old_rules: Sequence[int], sought: Sequence[int], terms: Sequence[str]) -> pa.Array:
    w = _Words(words)
    found = w.touched(matches)
    first, last, row = found.first, found.last, found.row
    student, latest, old = w.student(terms), found.labels(), found.labels(old_rules)
    joint = np.bincount(w.row * 8 + latest * 4 + old * 2 + student, minlength=w.rows * 8).reshape(w.rows, 8)
    # a rule's matches in a text follow on one another
    key = row * (1 + int(found.copies.max(initial=0))) + found.copies
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    occurrence = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
    # every word of a match is one of the latest rules
    whole = lambda labels: (lambda sums: sums[last] - sums[first] == last - first)(np.concatenate([[0], np.cumsum(labels)]))
    keep = np.flatnonzero((last > first) & np.isin(found.copies, sought))
    targets = pa.StructArray.from_arrays(
        [pa.array(x[keep].astype(np.int32)) for x in (found.copies, found.start, found.end, occurrence, whole(old), whole(student))], _TARGET.names)
    lists = pa.ListArray.from_arrays(pa.array(_rows_of(row[keep], w.rows).astype(np.int32)), targets)
    return pa.StructArray.from_arrays([*[pa.array(j.astype(np.int32)) for j in joint.T], lists], _REPLAY.names)


def replayed(rows: DataFrame, defects: Sequence[str], old: tuple[Rule, ...], latest: tuple[Rule, ...], terms: Sequence[str]) -> DataFrame:
    """What temporal.validated_targets holds, one row a text of ``rows`` (id, text): (source_id, j0..j7, targets).

    A match of a listed rule that holds a word is a target; targets tell their place and whether the old rules and the student detect
    them. Every candidate counts the words of its whole text, which are counted once: ``j`` by 4 latest + 2 old + student label.
    """
    terms = _checked(terms)
    names = [r.name for r in latest]
    if not {r.name for r in old} <= set(names) or not set(defects) <= set(names):
        raise ValueError("old rules and defects must be among the latest rules")
    old_rules, sought = [names.index(r.name) for r in old], [names.index(d) for d in defects]

    @F.arrow_udf(_REPLAY)
    def replay(words: pa.Array, matches: pa.Array) -> pa.Array:
        return marks.in_parts(functools.partial(_replayed, old_rules=old_rules, sought=sought, terms=terms), words, matches)

    text = "coalesce(text, '')"
    return rows.select(F.col("id").cast("string").alias("source_id"), F.inline(F.array(
        replay(F.expr(marked_words_sql(text)), F.expr(marked_copies_sql(text, latest))))))


def replayed_targets(notes: DataFrame, latest: tuple[Rule, ...]) -> DataFrame:
    """The targets of ``replayed``, one row each: (id, source_id, temporal_defect, introduced_in, start, end, old_hit, student_hit)."""
    rules = "array(" + ", ".join(f"named_struct('name', '{r.name}', 'introduced_in', '{r.introduced_in}')" for r in latest) + ")"
    made = notes.select("source_id", F.inline("targets")).select("*", F.expr(f"get({rules}, rule)").alias("_r"))
    return made.select(
        F.concat_ws("::", "source_id", F.lit("temporal"), "_r.name", "start", "occurrence").alias("id"), "source_id",
        F.col("_r.name").alias("temporal_defect"), F.col("_r.introduced_in").alias("introduced_in"), "start", "end", "old_hit", "student_hit")


def replayed_audit(notes: DataFrame) -> DataFrame:
    """temporal.token_audit of the targets of ``replayed``."""
    times = F.size("targets").cast("bigint")
    sums = notes.agg(*[F.coalesce(F.sum(times * F.col(f"j{k}")), F.lit(0)).alias(f"j{k}") for k in range(8)])
    preds = {"old": lambda o, s: o, "student": lambda o, s: s}
    systems = [F.struct(F.lit(name).alias("system"), _counts("j", range(8), pred).alias("c")) for name, pred in preds.items()]
    same = F.expr("named_struct('tp', j4 + j5 + j6 + j7, 'fp', 0L, 'fn', 0L, 'tn', j0 + j1 + j2 + j3)")
    long = sums.select(F.inline(F.array(*systems, F.struct(F.lit("latest").alias("system"), same.alias("c")))))
    return with_scores(long.select("system", "c.*"))
