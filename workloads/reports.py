"""Roll-ups of a metric table that Spark derives from the scored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import lodo
from maskwright.operators import metrics as M
from maskwright.operators import reports as RP
from maskwright.sources import tables as T
from workloads import sqlparts as Q
from workloads.registry import query

c = F.col
rounded = lambda *names: [F.round(n, 9).alias(n) for n in names]
MODELS = ("click", "error", "purchase", "signup", "view")
_GROUP = "case when dataset in ('d0', 'd1', 'd2', 'd3') then 'medical' when dataset in ('d4', 'd5', 'd6') then 'pii' else 'entity' end"

_RUNS = f"""s as ({Q.SCORED}), z as (select * from (values ('budget_matched', 0.40e0), ('f2_optimized', 0.30e0)) v(mode, threshold)),
    k as (select dataset, model, seed, mode, threshold, {Q.confusion('gold', 'cast(score >= threshold as int)')} from s, z group by all),
    runs as (select dataset, model, seed, mode, threshold, tp + fp + fn + tn as n, coalesce(tp::double / nullif(tp + fp, 0), 0) as precision,
        coalesce(tp::double / nullif(tp + fn, 0), 0) as recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::double as f1,
        coalesce(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0)::double as f2, (tp + fn)::double / (tp + fp + fn + tn) as gold_mask_rate,
        (tp + fp)::double / (tp + fp + fn + tn) as predicted_mask_rate, {_GROUP} as grp from k)"""


def runs(spark, folder):
    scored = T.scored_tokens(spark, folder)
    by = ["dataset", "model", "seed"]
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(t).alias("threshold")) for m, t in (("budget_matched", 0.40), ("f2_optimized", 0.30))])
    hit = scored.select(*by, "gold", "score", F.inline(modes)).withColumn("pred", (c("score") >= c("threshold")).cast("int"))
    sums = hit.groupBy(*by, "mode", "threshold").agg(*[F.count_if((c("gold") == g) & (c("pred") == p)).alias(n) for n, g, p in (
        ("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    return M.with_scores(sums).withColumn("group", F.expr(_GROUP))


_M = ("precision", "recall", "f1", "f2", "predicted_mask_rate")


@query(f"with {_RUNS} select dataset, model, mode, count(*) as seeds, {', '.join(f'round(avg({m}), 9) as {m}_mean, round(stddev_samp({m}), 9) as {m}_std' for m in _M)} from runs group by all")
def seed_repeats(spark, folder):
    got = RP.seed_repeats(runs(spark, folder), _M)
    return got.select("dataset", "model", "mode", "seeds", *rounded(*[f"{m}_{s}" for m in _M for s in ("mean", "std")]))


@query(f"""with {_RUNS}, p as (select model, mode, seed, count(distinct dataset) as datasets, {', '.join(f'avg({m}) as {m}' for m in _M)} from runs group by all)
    select model, mode, max(datasets) as datasets, count(*) as seeds, {', '.join(f'round(avg({m}), 9) as {m}_mean, round(stddev_samp({m}), 9) as {m}_std' for m in _M)} from p group by all""")
def macro_over_datasets(spark, folder):
    got = RP.macro(runs(spark, folder), _M)
    return got.select("model", "mode", "datasets", "seeds", *rounded(*[f"{m}_{s}" for m in _M for s in ("mean", "std")]))


@query(f"""with {_RUNS}, d as (select grp, model, mode, dataset, {', '.join(f'avg({m}) as {m}' for m in _M)} from runs group by all)
    select grp as "group", model, mode, count(*) as datasets, {', '.join(f'round(avg({m}), 9) as {m}' for m in _M)} from d group by all""")
def macro_by_group(spark, folder):
    return RP.macro_within_group(runs(spark, folder), _M).select("group", "model", "mode", "datasets", *rounded(*_M))


@query(f"with {_RUNS} select model as noise_type, cast(sum(n) as bigint) as tokens, round(sum(n * recall) / sum(n), 9) as recall, round(sum(n * f2) / sum(n), 9) as f2 from runs group by 1 having sum(n) > 0")
def pooled_by_noise(spark, folder):
    return RP.pooled(runs(spark, folder).withColumn("noise_type", c("model")), "tokens", ["recall", "f2"]).select(
        "noise_type", "tokens", *rounded("recall", "f2"))


@query(f"""with {_RUNS} select dataset, {', '.join(f"round(avg(case when mode = 'f2_optimized' then {m} end), 9) as {m}_f2_optimized, round(avg(case when mode = 'budget_matched' then {m} end), 9) as {m}_budget_matched, round(avg(case when mode = 'f2_optimized' then {m} end) - avg(case when mode = 'budget_matched' then {m} end), 9) as {m}_difference" for m in ('f2', 'recall'))} from runs group by 1""")
def ablation_arms(spark, folder):
    got = RP.arm_difference(runs(spark, folder), ["f2", "recall"], "f2_optimized", "budget_matched", "dataset", "mode")
    return got.select("dataset", *rounded(*[x for x in got.columns if x != "dataset"]))


@query(f"with {_RUNS} select dataset, mode, bool_and(f1 >= 0.9) as quality_all_seeds, count_if(f1 >= 0.9) as quality_pass_seeds from runs group by all")
def gate_rollup(spark, folder):
    return RP.gate_rollup(runs(spark, folder).withColumn("quality", c("f1") >= 0.9), ["quality"], ["dataset", "mode"])


@query(f"""with {_RUNS}, d as (select dataset, model, avg(f1) - 0.95 as delta, min(f1) - 0.95 as low, max(f1) - 0.95 as high, count_if(f1 >= 0.93) as g, count_if(recall >= 0.97) as q, count(*) as n, avg(f2) - 0.96 as dr from runs group by all)
    select dataset, model, case when low > 0 then 'student' when high < 0 then 'rule' when delta = 0 then 'tie' else 'uncertain' end as interval_verdict,
           case when g = n then 'strict_win' when q < n then 'quality_fail' when delta > 0 and dr > 0 then 'mean_win' else 'rule_better' end as overall_verdict from d""")
def verdicts(spark, folder):
    d = runs(spark, folder).groupBy("dataset", "model").agg(
        (F.avg("f1") - 0.95).alias("delta"), (F.min("f1") - 0.95).alias("low"), (F.max("f1") - 0.95).alias("high"),
        F.count_if(c("f1") >= 0.93).alias("g"), F.count_if(c("recall") >= 0.97).alias("q"), F.count(F.lit(1)).alias("n"), (F.avg("f2") - 0.96).alias("dr"))
    return d.select("dataset", "model", RP.interval_verdict(c("delta"), c("low"), c("high")).alias("interval_verdict"),
                    RP.strict_verdict(c("g"), c("n"), c("q"), c("delta"), c("dr")).alias("overall_verdict"))


_WIDE = """w as (select dataset, model, max(case when mode = 'f2_optimized' then f2 end) as clean_f2, max(case when mode = 'budget_matched' then f2 end) as noisy_f2, avg(recall) as rule_noisy_f2 from runs group by all)"""


def _wide(spark, folder):
    pick = lambda mode: F.max(F.when(c("mode") == mode, c("f2")))
    return runs(spark, folder).groupBy("dataset", "model").agg(
        pick("f2_optimized").alias("clean_f2"), pick("budget_matched").alias("noisy_f2"), F.avg("recall").alias("rule_noisy_f2"))


@query(f"""with {_RUNS}, {_WIDE}, m as (select *, noisy_f2 = max(noisy_f2) over (partition by dataset) as best from w)
    select model, count(*) as datasets, round(avg(clean_f2), 9) as clean_f2, round(avg(noisy_f2), 9) as noisy_f2, round(avg(clean_f2 - noisy_f2), 9) as f2_drop,
           round(avg(noisy_f2 / clean_f2), 9) as retention, round(avg(rule_noisy_f2), 9) as rule_noisy_f2, round(avg(noisy_f2) - avg(rule_noisy_f2), 9) as rule_gap, count_if(best) as best_datasets from m group by 1""")
def model_analysis(spark, folder):
    got = RP.model_analysis(_wide(spark, folder))
    return got.select("model", "datasets", "best_datasets", *rounded("clean_f2", "noisy_f2", "f2_drop", "retention", "rule_noisy_f2", "rule_gap"))


@query(f"""with {_RUNS}, {_WIDE}, p as (select dataset, max(case when model = 'click' then noisy_f2 end) as a, max(case when model = 'error' then noisy_f2 end) as b from w group by 1),
    t as (select dataset, model, seed, {' and '.join(f"max(case when mode = 'f2_optimized' then {m} end) >= max(case when mode = 'budget_matched' then {m} end)" for m in ('recall', 'f2', 'predicted_mask_rate'))} as ok from runs group by all)
    select (select count(*) from p) as datasets, (select count_if(a < b) from p) as monotonic_datasets, (select count(*) from t) as runs, (select count_if(ok) from t) as privacy_tradeoff_runs""")
def monotonic_and_tradeoff(spark, folder):
    tradeoff = RP.privacy_tradeoffs(runs(spark, folder))
    return RP.monotonic_datasets(_wide(spark, folder), "noisy_f2", ["click", "error"]).select(
        "datasets", "monotonic_datasets", tradeoff.select("runs").scalar().alias("runs"),
        tradeoff.select("privacy_tradeoff_runs").scalar().alias("privacy_tradeoff_runs"))


@query(f"with {_RUNS}, {_WIDE} select dataset, model, round(noisy_f2, 9) as noisy_f2 from (select *, row_number() over (partition by dataset order by noisy_f2 desc, model) as r from w) where r = 1")
def best_model(spark, folder):
    return RP.best_model(_wide(spark, folder), "noisy_f2").select("dataset", "model", *rounded("noisy_f2"))


@query(f"""with {_RUNS}, d as (select dataset, avg(f1) - 0.95 as delta, avg(f2) - 0.95 as dr, count_if(f1 > 0.9) as g, count_if(recall > 0.95) as q, sum(n) as pairs, count(*) as sources from runs group by 1)
    select coalesce(string_agg(case when delta > 0 and dr > 0 then dataset end, ',' order by dataset), '') as mean_wins, coalesce(string_agg(case when g = 30 then dataset end, ',' order by dataset), '') as strict_wins,
           coalesce(string_agg(case when q = 30 then dataset end, ',' order by dataset), '') as clean_passes, cast(sum(pairs) as bigint) as pairs, cast(sum(sources) as bigint) as sources from d""")
def wins_summary(spark, folder):
    d = runs(spark, folder).groupBy("dataset").agg(
        (F.avg("f1") - 0.95).alias("delta"), (F.avg("f2") - 0.95).alias("drop"), F.count_if(c("f1") > 0.9).alias("gate_seeds"),
        F.count_if(c("recall") > 0.95).alias("quality_seeds"), F.sum("tokens").alias("pairs"), F.count(F.lit(1)).alias("sources"))
    got = RP.wins_summary(d, 30)
    return got.select(*[F.array_join(x, ",").alias(x) for x in ("mean_wins", "strict_wins", "clean_passes")], "pairs", "sources")


_SYS = "case model when 'click' then 'rule' when 'error' then 'student' when 'view' then 'or' when 'signup' then 'and' else 'other' end"


@query(f"""with {_RUNS}, m as (select dataset, {_SYS} as system, avg(recall) as recall, avg(f2) as f2 from runs group by all)
    select dataset, system, round(recall, 9) as recall, round(f2, 9) as f2, round(recall - max(case when system = 'rule' then recall end) over (partition by dataset), 9) as delta_to_rule from m""")
def combination_table(spark, folder):
    long = runs(spark, folder).withColumn("system", F.expr(_SYS))
    return RP.combination_table(long, ["f2"], "recall").select("dataset", "system", *rounded("recall", "f2", "delta_to_rule"))


@query(f"""with {_RUNS}, t as (select dataset, mode, 'rule' as model, 0 as seeds, 1.0::double as precision_mean, 1.0::double as recall_mean, 1.0::double as f1_mean, 1.0::double as f2_mean, avg(gold_mask_rate) as mr from runs group by all
      union all select dataset, mode, model, count(*), avg(precision), avg(recall), avg(f1), avg(f2), avg(predicted_mask_rate) from runs group by dataset, mode, model),
    e as (select model, round(avg(score), 9) as mean_score from s group by 1)
    select dataset, mode, model, cast(seeds as bigint) as seeds, {', '.join(f'round({m}_mean, 9) as {m}_mean' for m in ('precision', 'recall', 'f1', 'f2'))}, round(mr, 9) as predicted_mask_rate_mean, mean_score from t left join e using (model)""")
def comparison_table(spark, folder):
    efficiency = T.scored_tokens(spark, folder).groupBy("model").agg(F.round(F.avg("score"), 9).alias("mean_score"))
    got = RP.comparison_table(runs(spark, folder), efficiency)
    return got.select("dataset", "mode", "model", "seeds", "mean_score", *rounded(*[f"{m}_mean" for m in ("precision", "recall", "f1", "f2", "predicted_mask_rate")]))


@query(f"""with {_RUNS}, a as (select distinct dataset, model, seed from runs where not (dataset = 'd2' and seed = 43) and not (model = 'view' and dataset = 'd7'))
    select d.dataset, m.model, cast(z.seed as bigint) as seed from (select distinct dataset from runs) d, (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) m(model), (values (42), (43), (44)) z(seed)
    where (d.dataset, m.model, z.seed) not in (select (dataset, model, seed) from a)""")
def missing_runs(spark, folder):
    scored = T.scored_tokens(spark, folder)
    available = scored.filter("not (dataset = 'd2' and seed = 43) and not (model = 'view' and dataset = 'd7')")
    return lodo.missing_runs(scored, available, MODELS, (42, 43, 44)).withColumn("seed", c("seed").cast("bigint"))


@query("""with d as (select lang as dataset, count(*) as all_examples, count_if(doc_id % 10 < 8) as train_examples, count_if(doc_id % 10 = 8) as validation_examples, count_if(doc_id % 10 = 9) as test_examples from documents group by 1)
    select dataset, cast(sum(all_examples) as bigint) as all_examples, cast(sum(train_examples) as bigint) as train_examples, cast(sum(validation_examples) as bigint) as validation_examples, cast(sum(test_examples) as bigint) as test_examples from d group by rollup (dataset)""")
def split_table(spark, folder):
    sizes = T.table(spark, folder, "documents").groupBy(c("lang").alias("dataset")).agg(
        F.count(F.lit(1)).alias("all_examples"), F.count_if(c("doc_id") % 10 < 8).alias("train_examples"),
        F.count_if(c("doc_id") % 10 == 8).alias("validation_examples"), F.count_if(c("doc_id") % 10 == 9).alias("test_examples"))
    return RP.split_table(sizes)


@query(f"with {_RUNS} select mode, precision, dataset, model, seed from (select mode, round(precision, 9) as precision, dataset, model, seed::bigint as seed from runs)")
def results_long(spark, folder):
    pick = lambda mode: F.max(F.when(c("mode") == mode, c("precision"))).alias(f"{mode}_precision")
    wide = runs(spark, folder).groupBy("dataset", "model", "seed").agg(pick("budget_matched"), pick("f2_optimized"))
    return RP.wide_to_long(wide, ["budget_matched", "f2_optimized"], ["precision"], ["dataset", "model", c("seed").cast("bigint").alias("seed")]).withColumn(
        "precision", F.round("precision", 9))
