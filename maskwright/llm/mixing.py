"""Mixing sources to target weights by Pareto order sampling, in column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.llm.common import WORD, join_small, repeat_rows, stored, sums_before
from maskwright.session import with_once


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the MD5 of seed and keys; null reads as '-'."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("-")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[float], max_copies: int = 3, share: float = 1.0) -> DataFrame:
    """Targets of (source, has_source, source_size): share of all sizes by weight, at most max_copies times each source's size.

    Sources take the weights in turn by code point, null last. What a capped source cannot take goes to
    the others by weight; the level at which that settles is the largest of (total - capped) / (weights
    left) over the sources ordered by the level at which they are full. One row per source is sorted in
    one task; documents are not.
    """
    by_name = Window.orderBy(F.col("has_source").desc(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    sized = sizes.withColumn("__weight", weight)
    sized = sized.withColumn("__most", F.lit(float(max_copies)) * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("__most") / F.col("__weight"), F.col("has_source").desc(), "source")
    before = F.coalesce(F.sum("__most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = sized.withColumn("__level", (total - before) / left)
    level = level.withColumn("__level", F.max("__level").over(everything))
    return level.select("source", "has_source", "source_size", F.least("__most", F.col("__weight") * F.col("__level")).alias("target"))


def inclusion(classes: DataFrame) -> DataFrame:
    """Inclusion probabilities of (source, has_source, __class, __words, __due): p = min(1, level * 2 ** (class / 2)).

    Longer documents are likelier; the level of a source makes the expected words equal those due. It is the largest of
    (due - words of longer classes) / (weighted words of the rest) over its classes, of which there are at most 63.
    """
    weight = F.sqrt(F.expr("shiftleft(1L, __class)").cast("double"))
    of_source = Window.partitionBy("source", "has_source")
    longest_first = of_source.orderBy(F.desc("__class"))
    longer = F.coalesce(F.sum("__words").over(longest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight * F.col("__words")).over(longest_first.rowsBetween(0, Window.unboundedFollowing))
    level = classes.withColumn("__level", (F.col("__due") - longer) / rest)
    level = level.withColumn("__level", F.max("__level").over(of_source))
    return level.withColumn("__p", F.least(F.lit(1.0), F.col("__level") * weight)).drop("__level")


def choose(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: int = 3, seed: int = 17,
           large_share: float = 0.005, per_slice: int = 5_000) -> DataFrame:
    """How many copies of each document the mix takes, so that each source's words come near its target.

    rows has doc_id, source, size. The whole part of target / source size is certain for each document of a source.
    For one copy more, a document has the inclusion probability p of its class, the power of two in its size
    (`inclusion`); classes with p = 1 get it for certain. The other documents of a source are ranked by random odds u/(1-u)
    over inclusion odds p/(1-p) (Pareto order sampling) and taken in that order up to the words still due, so that the
    size of the sample is fixed in words. Documents over large_share of their source's target are drawn first among
    themselves, so that the many small ones make up for what the few large ones miss; the miss is then about half a
    small document. Ranks are found per slice of the order, of about per_slice rows: a slice is cut from the distribution
    of the ranked odds, which the classes' shares give. A source that holds much of all rows is spread over
    many tasks of each join.

    Returns doc_id, source, size, source_size, target, __copies (equal rows), __whole (copies of each),
    __extra (how many of the equal rows get one more) and __p. Null ids are one id; documents without words
    are taken as they come and count nothing; no rows give no rows. Texts are read once: ids and sizes are written to the
    shared folder, as are the plans of the classes and the draws.
    """
    size_class = F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(-1)
    counted = stored(rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNotNull().alias("has_source"), "size")
                     .groupBy("doc_id", "source", "has_source", "size").agg(F.count("*").alias("__copies")).withColumn("__class", size_class))
    words = F.col("size") * F.col("__copies")
    source = ["source", "has_source"]
    classes = stored(counted.groupBy(*source, "__class").agg(F.sum(words).alias("__words"), F.count("*").alias("__rows")))
    targets = source_targets(classes.groupBy(*source).agg(F.sum("__words").alias("source_size")), weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = with_once(targets, __ratio=ratio).withColumn("__whole", F.floor("__ratio").cast("long"))
    targets = targets.withColumn("__due", F.when(F.col("__ratio") > F.col("__whole"), F.col("target") - F.col("__whole") * F.col("source_size")).otherwise(0.0))
    chances = inclusion(classes.filter("__class >= 0").join(targets.select(*source, "__due"), source)).select(*source, "__class", "__p")
    plans = classes.join(targets, source).join(chances, [*source, "__class"], "left")
    plans = plans.withColumn("__certain", F.coalesce(F.col("__p") >= 1, F.lit(False)))
    plans = plans.withColumn("__p", F.when(F.col("__certain"), 0.0).otherwise(F.coalesce("__p", F.lit(0.0))))
    plans = plans.withColumn("__c", F.col("__p") / (1 - F.col("__p")))
    of_source = Window.partitionBy(*source)
    open_rows = F.sum(F.when(F.col("__p") > 0, F.col("__rows"))).over(of_source)
    plans = stored(plans.select(
        *source, "__class", "source_size", "target", "__p", "__c", (F.col("__whole") + F.col("__certain").cast("long")).alias("__whole"),
        (F.col("__due") - F.coalesce(F.sum(F.when(F.col("__certain"), F.col("__words"))).over(of_source), F.lit(0))).alias("__due"),
        F.greatest(F.lit(1), F.ceil(F.coalesce(open_rows, F.lit(0)) / per_slice)).cast("long").alias("__slices"),
        F.collect_list(F.when(F.col("__p") > 0, F.struct((F.col("__rows") / open_rows).alias("share"), F.col("__c").alias("c")))).over(of_source).alias("__parts")))
    drawn = join_small(counted, plans, [*source, "__class"], F.col("doc_id"))
    u, p = F.col("__u"), F.col("__p")
    drawn = with_once(drawn, __u=draw(seed, F.col("doc_id"), F.col("size")))
    drawn = with_once(drawn, __odds=F.when(p > 0, u / (1 - u) / F.col("__c")))
    below = F.expr("aggregate(__parts, 0D, (a, part) -> a + part.share * (1 - 1 / (1 + __odds * part.c)))")  # share of ranked odds below these
    drawn = stored(with_once(
        drawn, __large=(F.col("size") > large_share * F.col("target")), __words=words,
        __slice=F.least(F.floor(below * F.col("__slices")), F.col("__slices") - 1)).drop("__parts", "__u", "__c"))
    order = [F.col("__odds"), F.col("doc_id").asc_nulls_last(), F.col("size")]

    def take(part: DataFrame, due: Column) -> DataFrame:
        part = sums_before(part, ["source", "has_source"], "__slice", order, "__words", "__before")
        extra = F.when(F.col("size") > 0, F.floor((due - F.col("__before")) / F.col("size") + 0.5)).otherwise(F.lit(0))
        return part.withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__copies"), extra.cast("long"))))

    closed = drawn.filter("__p = 0").withColumn("__extra", F.lit(0).cast("long"))
    large, small = drawn.filter("__p > 0 and __large"), drawn.filter("__p > 0 and not __large")
    expected = large.groupBy("source", "has_source").agg(F.sum(F.col("__words") * p).alias("__expected"))
    large = take(join_small(large, expected, ["source", "has_source"], F.col("doc_id")), F.col("__expected")).drop("__expected")
    large = stored(large)
    got = large.groupBy("source", "has_source").agg(F.sum(F.col("__extra") * F.col("size")).alias("__got"))
    small = take(join_small(small, got, ["source", "has_source"], F.col("doc_id"), "left"), F.col("__due") - F.coalesce("__got", F.lit(0))).drop("__got")
    return closed.unionByName(large.drop("__before")).unionByName(small.drop("__before")).select(
        "doc_id", F.when(F.col("has_source"), F.col("source")).alias("source"), "size", "source_size", "target",
        "__copies", "__whole", "__extra", "__p")


def mix_table(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), one row per document."""
    rows = with_once(documents.select("doc_id", "source", "text"), size=word_count(F.col("text"))).drop("text")
    chosen = repeat_rows(choose(rows, **options), "__copies", "__copy")
    copies = F.col("__whole") + (F.col("__copy") < F.col("__extra")).cast("long")
    return chosen.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as often as it is taken, with all its columns. Nulls and empty tables: as in `choose`."""
    columns = documents.columns
    key = F.to_json(F.struct("doc_id", "source", F.col("__size").alias("size")))
    sized = with_once(documents, __size=word_count(F.col("text"))).withColumn("__key", key)
    chosen = choose(sized.select("doc_id", "source", F.col("__size").alias("size")), **options)
    chosen = chosen.select(F.to_json(F.struct("doc_id", "source", "size")).alias("__key"), "__copies", "__whole", "__extra")
    turn = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    times = (F.col("__whole") + (F.col("__turn") <= F.col("__extra")).cast("long")).cast("int")
    once = sized.join(chosen.filter("__copies = 1"), "__key").withColumn("__turn", F.lit(1))
    more = sized.join(chosen.filter("__copies > 1"), "__key").withColumn("__turn", turn)
    return (once.unionByName(more).withColumn("__times", times).filter("__times > 0")
            .select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__again")).drop("__again"))
