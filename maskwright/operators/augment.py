"""Training augmentation: a few seen perturbations per row, spread over the noise types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import stable_key
from maskwright.operators.perturb import noises
from maskwright.session import written


def _tied(variants: DataFrame) -> DataFrame:
    return variants.withColumn("_tie", stable_key(F.col("id"), F.col("noise_type")))


def select_by_hash(variants: DataFrame, per_row: int) -> DataFrame:
    """At most ``per_row`` variants of a row, in digest order. A row has at most five variants."""
    window = Window.partitionBy("id").orderBy("_tie")
    return _tied(variants).withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= per_row).drop("_r", "_tie")


def water_fill(counts: dict[frozenset[str], int], names: list[str]) -> dict[frozenset[str], dict[str, int]]:
    """Quotas per eligibility set that level the totals: the scarcest set chooses first."""
    load = dict.fromkeys(names, 0)
    quotas: dict[frozenset[str], dict[str, int]] = {}
    for allowed in sorted(counts, key=lambda s: (len(s), sorted(s))):
        left, share = counts[allowed], dict.fromkeys(sorted(allowed), 0)
        while left:
            low = min(load[n] for n in share)
            lowest = [n for n in share if load[n] == low]
            above = [load[n] for n in share if load[n] > low]
            room = (min(above) - low) * len(lowest) if above else left
            step = min(left, room) if room else left
            for i, n in enumerate(lowest):
                take = step // len(lowest) + (i < step % len(lowest))
                share[n] += take
                load[n] += take
            left -= step
        quotas[allowed] = share
    return quotas


def pick_balanced(keys: DataFrame, per_row: int) -> DataFrame:
    """(id, noise_type) of at most ``per_row`` variants per row with the noise types used as evenly as possible.

    ``keys`` holds id and noise_type of all variants. A running greedy choice depends on row order and cannot be distributed.
    Instead rows are grouped by the set of noise types they allow (at most 31 sets), which is worked out once and written, quotas are
    worked out from those counts on the driver, and a row's place in its set, read off its digest rank, decides its noise
    type, which is taken out of its set. Runs one small counting job per pick.
    """
    from maskwright.operators.sampling import rank_in_group

    names = [n.name for n in noises("seen")]
    sets = keys.filter("id is not null").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("noise_type")), ",").alias("_allowed"))
    picked = None
    for pick in range(per_row):
        sets = written(sets)
        counts = {frozenset(r["_allowed"].split(",")): r["n"] for r in
                  sets.groupBy("_allowed").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            break
        bounds = []
        for allowed, share in water_fill(counts, names).items():
            upto = 0
            for noise, quota in share.items():
                if quota:
                    bounds.append((",".join(sorted(allowed)), upto, upto + quota, noise))
                    upto += quota
        table = sets.sparkSession.createDataFrame(bounds, "_set string, _from bigint, _to bigint, noise_type string")
        keyed = sets.select("id", "_allowed", stable_key(pick, F.col("id")).alias("_key"))
        ranked = rank_in_group(keyed, ["_allowed"], "_key", "id", "_rank", "_size")
        chosen = ranked.join(F.broadcast(table), (F.col("_allowed") == F.col("_set")) & (F.col("_rank") > F.col("_from"))
                             & (F.col("_rank") <= F.col("_to")))
        if pick + 1 < per_row:
            chosen = written(chosen.select("id", "_allowed", "noise_type"))
            sets = chosen.select("id", F.array_join(F.array_remove(F.split("_allowed", ","), F.col("noise_type")), ",").alias("_allowed")).filter("_allowed <> ''")
        chosen = chosen.select("id", "noise_type")
        picked = chosen if picked is None else picked.unionByName(chosen)
    return picked if picked is not None else keys.select("id", "noise_type").limit(0)


def select_balanced(variants: DataFrame, per_row: int) -> DataFrame:
    """The variants that ``pick_balanced`` picks."""
    return variants.join(pick_balanced(variants.select("id", "noise_type"), per_row), ["id", "noise_type"], "left_semi")


def augmented_rows(rows: DataFrame, selected: DataFrame, clean: bool = True) -> DataFrame:
    """Training rows: the clean rows (unless dropped) and the selected variants with projected gold."""
    keep = [c for c in rows.columns if c not in ("id", "text", "words", "labels")]
    mark = lambda group, noise, edit, how: F.struct(
        group.alias("group"), noise.alias("noise_type"), edit.alias("edit"), how.alias("gold_projection"))
    none = F.lit(None)
    noisy = selected.select(
        F.col("id").alias("source_id"), "text", "words", "labels",
        mark(F.lit("seen"), F.col("noise_type"), F.col("edit"), F.lit("clean_character_spans")).alias("augmentation"))
    made = noisy.join(rows.select(F.col("id").alias("source_id"), *keep), "source_id").select(
        F.concat_ws("::", F.col("source_id").cast("string"), F.lit("aug"), "augmentation.noise_type").alias("id"),
        F.col("source_id").cast("string").alias("source_id"), "text", "words", "labels", *keep, "augmentation")
    if not clean:
        return made
    untouched = rows.select(
        F.col("id").cast("string").alias("id"), none.cast("string").alias("source_id"), "text", "words", "labels", *keep,
        mark(F.lit("clean"), F.lit("none"), none.cast("map<string,string>"), none.cast("string")).alias("augmentation"))
    return untouched.unionByName(made)


def augment_summary(variants: DataFrame, selected: DataFrame) -> DataFrame:
    """Eligible and selected rows per noise type."""
    marked = variants.select("noise_type", F.lit(0).alias("s")).unionByName(selected.select("noise_type", F.lit(1).alias("s")))
    return marked.groupBy("noise_type").agg(F.count_if(F.col("s") == 0).alias("eligible"), F.count_if(F.col("s") == 1).alias("selected"))
