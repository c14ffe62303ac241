"""Dictionary and lexicon teachers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import lexicons as lx
from maskwright.functions.arrays import let, sql_string
from maskwright.functions.text import words


def lexicon_labels(tokens: str) -> Column:
    """Sentiment words, and negators/intensifiers with a sentiment word in the next two."""
    quoted = lambda values: ", ".join(sql_string(v) for v in values)
    hits = f"transform(low, w -> w in ({quoted(lx.SENTIMENT_WORDS)}))"
    mark = (f"transform(low, (w, i) -> cast(get(hit, i) or (w in ({quoted(lx.NEGATORS + lx.INTENSIFIERS)}) and "
            "(coalesce(get(hit, i + 1), false) or coalesce(get(hit, i + 2), false))) as int))")
    return F.expr(let("low", f"transform({tokens}, w -> lower(w))", let("hit", hits, mark)))


def term_labels(tokens: Column, terms: Sequence[str]) -> Column:
    """1 for words whose lower-case form is in a short list of terms (hash lookup)."""
    return F.transform(tokens, lambda w: F.lower(w).isin(*terms).cast("int"))


def word_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, zipf): corpus counts of lower-case words and log10 of their rate per billion."""
    counts = docs.select(F.explode(words(F.col(text))).alias("w")).groupBy(F.lower("w").alias("word")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("word", "n", F.log10(F.col("n") * F.lit(1e9) / total).alias("zipf"))


def rare_terms(terms: DataFrame, frequencies: DataFrame, below: float = 3.8) -> DataFrame:
    """Dictionary terms (column word) that are rare in the corpus; unseen terms count as rare."""
    return terms.select("word").distinct().join(frequencies, "word", "left").filter(
        F.coalesce(F.col("zipf"), F.lit(0.0)) < below).select("word")


def label_by_dictionary(docs: DataFrame, terms: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """Add words and labels, 1 where the lower-case word is a dictionary term (column word).

    Every distinct word of a document is looked up once, so a frequent word costs one row
    per document, and only hits are regrouped. Spark broadcasts the dictionary when it
    measures it as small; a large one is a shuffled join whose hot words AQE splits.
    """
    tokens = docs.withColumn("words", words(F.col(text)))
    lookup = terms.select("word").distinct()
    distinct = tokens.select(id_col, F.explode(F.array_distinct(F.transform("words", F.lower))).alias("word"))
    hits = distinct.join(lookup, "word", "left_semi").groupBy(id_col).agg(F.collect_list("word").alias("_hits"))
    return tokens.join(hits, id_col, "left").withColumn("labels", F.expr(
        "transform(words, w -> cast(coalesce(array_contains(_hits, lower(w)), false) as int))")).drop("_hits")
