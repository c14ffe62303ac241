"""Toxicity by a learned weighted lexicon, matched with Aho-Corasick after folding look-alikes."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import stored

# Characters that look like Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d", "ß": "ss",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "!": "i", "€": "e"}
# Phrases in which a listed word is meant harmlessly.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "take out the trash", "take the trash out", "clown fish", "circus clown",
    "sore loser", "pond scum", "soap scum", "idiot proof", "moron river", "worthless check",
)


def fold_table() -> dict[int, str | None]:
    """Lower case, accents off, look-alikes to Latin, l to i (so that 1, l and i agree); invisible characters go; other ASCII becomes a space."""
    table: dict[int, str | None] = {}
    for code in [*range(0x80, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF00, 0xFF5F), *range(0x1D400, 0x1D800)]:
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c))
        plain = "".join(LOOK_ALIKES.get(c, c) for c in plain)
        if plain != char:
            table[code] = plain
    for char, plain in LOOK_ALIKES.items():
        table[ord(char)] = plain
        for upper in {char.upper(), char.title()} - {char}:
            if len(upper) == 1:
                table[ord(upper)] = plain
    for code in (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0x300, 0x370)):
        table[code] = None
    for code in range(128):
        char = chr(code)
        table[code] = char.lower() if char.isalpha() else SUBSTITUTES.get(char, " ") if char in "01345789@$|" else " "
    for code in (0xA0, *range(0x2000, 0x200B), *range(0x2010, 0x2060), 0x3000, 0x85, 0x2028, 0x2029, 0xBF, 0xA1, 0xAB, 0xBB):
        table[code] = " "
    return {k: v.replace("l", "i") if v else v for k, v in table.items()}


_TABLE = fold_table()
_INNER = re.compile(r"(?<=\w)[!€](?=\w)")


def fold(text: str) -> str:
    """The folded text with a space at each end."""
    if "!" in text or "€" in text:
        text = _INNER.sub(lambda m: SUBSTITUTES[m.group()], text)
    return f" {text.translate(_TABLE)} "


def _bare(text: str) -> str:
    """A phrase folded, single-spaced."""
    return " ".join(fold(text).split())


def training_rows(documents: DataFrame, labels: DataFrame, sample: int, label: str = "toxic", folds: int = 5) -> DataFrame:
    """(text, label) of about `sample` labelled documents outside the held-out fold, drawn by hash; of all if there are fewer.

    The bound holds for the ids that are broadcast and for the texts, so no text is shuffled for its label.
    """
    fold_ = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_ != 0)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    share = min(1.0, sample / max(known.count(), 1))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "label")


def terms_of(word: str, stems: Sequence[int]) -> list[str]:
    """The word with a space at either end, and its starts with a space before."""
    return [f" {word} ", *(f" {word[:n]}" for n in stems if len(word) > n)]


def term_counts(rows: DataFrame, among: Sequence[str] | None = None, stems: Sequence[int] = (4, 5, 6, 7, 8), most: int = 3, flush: int = 400_000) -> DataFrame:
    """(term, n): how often each folded word or word start occurs in the texts, at most `most` times a text for a word.

    among: only these terms. The empty term has the number of all words. Words are counted once per task.
    """
    wanted = None if among is None else frozenset(among)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        total = 0

        def emit() -> pa.RecordBatch:
            terms: Counter = Counter({"": total})
            for word, n in held.items():
                for term in terms_of(word, stems):
                    if wanted is None or term in wanted:
                        terms[term] += n
            held.clear()
            return pa.record_batch([pa.array(list(terms), pa.string()), pa.array(list(terms.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = fold(text).split()
                total += len(words)
                for word, n in Counter(words).items():
                    if len(word) >= 3:
                        held[word] += min(n, most)
            if len(held) > flush:
                yield emit()
                total = 0
        yield emit()

    return rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame, size: int = 2000, candidates: int = 20_000, support: int = 6, least: float = 1.5, heaviest: float = 4.0) -> list[tuple[str, float]]:
    """At most `size` terms with the log of their rate in toxic over that in clean texts, from `least` to `heaviest`.

    Counts cover all rows. Candidates are the `candidates` most frequent terms of the toxic texts with a count of at
    least `support`, or of one in 100,000 words if that is more. Of a word and its starts the one
    that tells most, count times weight, is taken: a start only where it stands for more than one word. The numbers
    bound the lexicon, which every task gets.
    """
    toxic_rows, clean_rows = rows.filter("label = 1"), rows.filter("label <> 1")
    counted = term_counts(toxic_rows)
    total = counted.filter("term = ''").agg(F.sum("n")).first()[0] or 0
    floor = max(support, total * 1e-5)
    toxic = {r["term"]: r["n"] for r in counted.filter((F.col("term") != "") & (F.col("n") >= floor)).orderBy(F.desc("n"), "term").limit(candidates).collect()}
    clean = {r["term"]: r["n"] for r in term_counts(clean_rows, sorted(toxic)).collect()}
    words = max(clean.get("", 0), 1)
    weights = {t: float(np.log((n + 0.5) / max(total, 1)) - np.log((clean.get(t, 0) + 2.0) / words)) for t, n in toxic.items()}
    chosen: dict[str, float] = {}
    starts: set[str] = set()
    for term in sorted((t for t in weights if weights[t] >= least), key=lambda t: (-toxic[t] * min(weights[t], heaviest), -len(t), t)):
        if len(chosen) == size:
            break
        if term not in starts and not any(term[:k] in chosen for k in range(3, len(term))):
            chosen[term] = min(weights[term], heaviest)
            starts.update(term[:k] for k in range(3, len(term)))
    return sorted(chosen.items())


class Matcher:
    """An Aho-Corasick automaton over lexicon terms and exception phrases."""

    def __init__(self, lexicon: Sequence[tuple[str, float]], exceptions: Sequence[str] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            if _bare(phrase):
                self.automaton.add_word(f" {_bare(phrase)} ", (len(_bare(phrase)) + 2, None))
        for term, weight in lexicon:
            self.automaton.add_word(term, (len(term), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def total(self, text: str) -> tuple[float, int]:
        """(weight matched outside exception phrases, words or so). Of matches at one word the heaviest counts."""
        folded = fold(text)
        if not len(self.automaton):
            return 0.0, len(folded)
        heaviest: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(folded):
            start = end - n + 1
            if weight is None:
                excused.append((start, end))
            else:
                heaviest[start] = max(weight, heaviest.get(start, 0.0))
        if excused:
            heaviest = {s: w for s, w in heaviest.items() if not any(a <= s < b for a, b in excused)}
        return sum(heaviest.values()), len(folded)


def measure(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Matched weight per stretch of text: of 400 characters, in short texts of what there is and 400 more."""
    return total / (1.0 + length / 400.0)


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps."""
    w = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


class Model:
    """lexicon: weighted terms; slope and intercept: of the logistic curve over measure()."""

    def __init__(self, lexicon: Sequence[tuple[str, float]], slope: float, intercept: float):
        self.lexicon, self.slope, self.intercept = list(lexicon), slope, intercept

    def score(self, total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * measure(total, length) + self.intercept, -30, 30)))


def matched(rows: DataFrame, lexicon: Sequence[tuple[str, float]], keep: Sequence[str]) -> DataFrame:
    """rows' keep columns with the matched weight and folded length of their whole text."""
    kinds = dict(rows.dtypes)
    terms = list(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            found = [matcher.total(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.record_batch([*batch.columns[:-1], *columns], names=[*keep, "weight", "length"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", weight double, length long")


def train(documents: DataFrame, labels: DataFrame, sample: int = 100_000) -> Model:
    """Learn lexicon and curve from about `sample` labelled documents outside the held-out fold, or all there are.

    Without labels of both kinds the model says a little under 0.5 for everything.
    """
    rows = stored(training_rows(documents, labels, sample))
    lexicon = learn_lexicon(rows)
    values = matched(rows, lexicon, ["label"]).groupBy("label", "weight", "length").agg(F.count("*").alias("n")).collect()
    y = np.array([float(r["label"]) for r in values])
    if not len(y) or y.min() == y.max():
        return Model(lexicon, 1.0, -1.0)
    x = measure(np.array([r["weight"] for r in values]), np.array([float(r["length"]) for r in values]))
    repeat = np.array([r["n"] for r in values])
    return Model(lexicon, *fit_scale(np.repeat(x, repeat), np.repeat(y, repeat)))


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Null texts count as empty; a text without any match scores as low as its curve starts, so it is clean.
    Null ids are not held out. Equal rows get equal scores; no rows give none; other columns are not read.
    """
    kind = dict(documents.dtypes)["doc_id"]
    found = matched(documents, model.lexicon, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(float))
            out = [held_out(d) for d in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    return found.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not call toxic, all columns. A map: texts are scored where they are read."""
    schema = documents.schema
    terms = model.lexicon
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            found = [matcher.total(t or "") for t in batch.column(at).to_pylist()]
            score = model.score(np.array([w for w, _ in found], float), np.array([n for _, n in found], float))
            yield batch.filter(pa.array(score < 0.5))

    return documents.mapInArrow(run, schema)

