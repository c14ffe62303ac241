"""Dictionary terms of several words: longest match from the left, by an index of first words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import words
from maskwright.session import with_once


def phrase_table(terms: DataFrame, term: str = "term", longest: int = 5) -> DataFrame:
    """(phrase, first, n): the distinct lower-case words of each term, joined by spaces, its first word and their number.

    Terms without words or of more than `longest` words are refused: a term that can never match is a mistake.
    """
    listed = terms.select(F.transform(words(F.col(term)), F.lower).alias("w")).select(
        F.array_join("w", " ").alias("phrase"), F.get("w", F.lit(0)).alias("first"), F.size("w").alias("n")).distinct()
    wrong = F.raise_error(F.concat(F.lit("term of no words or too many: "), F.coalesce("phrase", F.lit("null")))).cast("boolean")
    return listed.filter(F.when(F.col("n").between(1, longest), True).otherwise(wrong))


def phrase_hits(tokens: DataFrame, phrases: DataFrame, id_col: str = "id", longest: int = 5) -> DataFrame:
    """(id, hits): where phrases (phrase, first, n) start in tokens (id, words): array<struct<start, n>>, by start, the longest first.

    Each place carries its next `longest` words. The index of first words, with the lengths that follow them, lets
    few places through; their runs of words are looked up as whole phrases. Both joins are on equality, so Spark
    broadcasts the sides that it measures as small, and nothing is compared phrase by phrase.
    """
    place = F.transform(F.col("_low"), lambda w, i: F.struct(i.alias("start"), w.alias("first"), F.slice("_low", i + 1, longest).alias("next")))
    places = tokens.select(F.col(id_col), F.transform("words", F.lower).alias("_low")).select(id_col, F.inline(place))
    index = phrases.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    runs = places.join(index, "first").select(id_col, "start", "next", F.explode("lengths").alias("n")).filter("n <= size(next)")
    found = runs.select(id_col, "start", "n", F.array_join(F.slice("next", 1, F.col("n")), " ").alias("phrase")).join(phrases.select("phrase"), "phrase", "left_semi")
    order = F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("less"))))
    return found.groupBy(id_col).agg(order.alias("h")).select(id_col, F.transform("h", lambda h: F.struct(h["start"].alias("start"), (-h["less"]).alias("n"))).alias("hits"))


#: The first hit, of equal starts the longest, then the first that starts after its end, and so on.
_CHOSEN = """aggregate(coalesce(hits, array()), named_struct('stop', 0, 'spans', cast(array() as array<struct<start: int, stop: int>>)),
    (a, h) -> if(h.start >= a.stop, named_struct('stop', h.start + h.n, 'spans', array_append(a.spans, named_struct('start', h.start, 'stop', h.start + h.n))), a),
    a -> a.spans)"""

_LABELS = """concat(
    flatten(transform(spans, (s, k) -> concat(array_repeat(0, s.start - coalesce(get(spans, k - 1).stop, 0)), array_repeat(1, s.stop - s.start)))),
    array_repeat(0, size(words) - coalesce(get(spans, size(spans) - 1).stop, 0)))"""


def label_by_phrases(tokens: DataFrame, terms: DataFrame, term: str = "term", id_col: str = "id", longest: int = 5) -> DataFrame:
    """tokens (id, words, ...) with spans of the matched terms, [start, stop) in words, and labels, 1 inside a span.

    Matches are case-blind, on whole words, and do not overlap: the leftmost first, the longest of those that start
    together. Ids must be unique. Only the hits are grouped; tokens move once, to meet them.
    """
    hits = phrase_hits(tokens, phrase_table(terms, term, longest), id_col, longest)
    joined = tokens.join(hits, id_col, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    return with_once(joined, spans=F.expr(_CHOSEN)).withColumn("labels", F.expr(_LABELS)).drop("hits")
