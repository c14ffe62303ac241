"""Token, span, threshold and leakage metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import labels as L
from maskwright.functions import text as X
from maskwright.functions.arrays import total
from maskwright.operators import leakage as LK
from maskwright.operators import metrics as M
from maskwright.operators import review as RV
from maskwright.operators import rules as R
from maskwright.operators import sampling as S
from maskwright.session import with_once
from maskwright.sources import tables as T
from workloads import sqlparts as Q
from workloads.registry import query

c = F.col
SCORES = ("precision", "recall", "f1", "f2", "gold_mask_rate", "predicted_mask_rate", "residual_sensitive_rate", "overmask_rate")
rounded = lambda *names: [F.round(n, 9).alias(n) for n in names]


def versions(spark, folder):
    """Notes with gold labels of the latest rules and predictions of the older ones."""
    notes = T.order_notes(spark, folder)
    return with_once(notes, words=X.words(c("text")), labels=R.rule_labels("text", R.rules_as_of("1.4")),
                     pred=R.rule_labels("text", R.rules_as_of("1.3")))


_J = f"""tok as ({Q.tokens(Q.NOTES)}),
    j as (select a.id, a.pos, a.word, a.label as gold, b.label as pred, n.dataset_name, n.task_label, n.source_index
          from ({Q.labelled(Q.NOTES, '1.4', tok='tok')}) a join ({Q.labelled(Q.NOTES, '1.3', tok='tok')}) b using (id, pos) join ({Q.NOTES}) n using (id))"""


@query(f"with {_J}, k as (select {Q.confusion('gold', 'pred')} from j) select tp, fp, fn, tn, {Q.scores()} from k")
def token_metrics(spark, folder):
    return M.token_metrics(versions(spark, folder)).select("tp", "fp", "fn", "tn", "tokens", *rounded(*SCORES))


@query(f"with {_J}, k as (select dataset_name, {Q.confusion('gold', 'pred')} from j group by grouping sets ((), (dataset_name))) select dataset_name, {Q.scores()} from k")
def metrics_by_dataset(spark, folder):
    return M.metrics_with_total(versions(spark, folder), "labels", "pred", "dataset_name").select("dataset_name", "tokens", *rounded(*SCORES))


_SPAN = lambda col: f"""select id, min(pos) as a, max(pos) + 1 as b from (select id, pos, pos - row_number() over (partition by id order by pos) as g from j where {col} = 1) group by id, g"""


@query(f"""
    with {_J}, g as ({_SPAN('gold')}), p as ({_SPAN('pred')}), s as (
        select (select count(*) from g) as gs, (select count(*) from p) as ps, (select count(*) from g join p using (id, a, b)) as hit),
    e as (select avg(r) as mean_rate from (select avg(pred) as r from j group by id)),
    k as (select count(distinct id) as examples, {Q.confusion('gold', 'pred')} from j)
    select examples, {Q.scores()}, gs as gold_spans, ps as pred_spans, hit as span_tp, round(hit::double / greatest(ps, 1), 9) as exact_span_precision,
           round(hit::double / greatest(gs, 1), 9) as exact_span_recall, round(2.0 * hit / (gs + ps), 9) as exact_span_f1,
           round(mean_rate, 9) as mean_example_mask_rate, round((tp + tn)::double / (tp + fp + fn + tn), 9) as accuracy_secondary
    from k, s, e""")
def exact_span_scores(spark, folder):
    return M.redactor_scores(versions(spark, folder)).select(
        "examples", "tokens", *rounded(*SCORES), "gold_spans", "pred_spans", "span_tp",
        *rounded("exact_span_precision", "exact_span_recall", "exact_span_f1", "mean_example_mask_rate", "accuracy_secondary"))


@query(f"""
    with {_J} select cast(sum(pred) as bigint) as selected_tokens, count(*) as total_tokens, round(sum(pred) / count(*), 9) as redaction_rate,
        round(sum(pred) / count(distinct id), 9) as average_selected_tokens_per_example,
        (select count(*) from (select id from j group by id having sum(pred) = 0)) as zero_redaction_examples,
        round(least((count(*) - sum(gold)) / greatest(sum(gold), 1), 20.0), 9) as class_weight from j""")
def mask_statistics(spark, folder):
    rows = versions(spark, folder)
    stats = M.mask_statistics(rows, "pred").drop("examples")
    return stats.select("selected_tokens", "total_tokens", "zero_redaction_examples",
                        *rounded("redaction_rate", "average_selected_tokens_per_example"),
                        F.round(M.class_weight(rows).scalar(), 9).alias("class_weight"))


@query(f"""
    with {_J}, o as (select id, dataset_name, source_index, bool_or(gold = 1 and pred = 0) as missed, bool_or(gold = 0 and pred = 1) as extra, count(*) as n, sum(gold) as g from j group by id, dataset_name, source_index),
    t as (select id, dataset_name, case when n > 10 + source_index % 30 then 'truncated' when missed and extra then 'missed+overmask' when missed then 'missed' when extra then 'overmask' else 'agreement' end as outcome from o where g > 0)
    select dataset_name, outcome, id from (select *, row_number() over (partition by dataset_name, outcome order by sha256('42::' || id), id) as r from t) where r <= 5""")
def disagreement_outcomes(spark, folder):
    rows = versions(spark, folder)
    cut = rows.withColumn("pred", F.expr("transform(pred, (x, i) -> case when i < 10 + cast(id as bigint) % 30 then x end)"))
    return RV.disagreement_examples(cut, 5, 42, ["dataset_name"]).select("dataset_name", "outcome", "id")


_SWEEP = f"""
    s as ({Q.SCORED}), th as (select unnest([{', '.join(f'{t!r}e0' for t in Q.THRESHOLDS)}]) as threshold),
    k as (select model, dataset, split, threshold, {Q.confusion('gold', 'cast(score >= threshold as int)')} from s, th group by all)"""


@query(f"with {_SWEEP}, m as (select model, threshold, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from k group by all) select model, threshold, {Q.scores()} from m")
def threshold_sweep(spark, folder):
    return M.threshold_sweep(T.scored_tokens(spark, folder), ["model"]).select("model", "threshold", "tokens", *rounded(*SCORES))


_POINTS = f"""{_SWEEP}, v as (select {{by}}, threshold, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from k where split = 'validation' group by all),
    w as (select *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::double as f1x, coalesce(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0)::double as f2x,
          -abs((tp + fp)::double / (tp + fp + fn + tn) - (tp + fn)::double / (tp + fp + fn + tn)) as bx from v),
    l as (select {{by}}, threshold, 'f1_optimized' as mode, f1x as goal from w union all select {{by}}, threshold, 'f2_optimized', f2x from w union all select {{by}}, threshold, 'budget_matched', bx from w),
    pts as (select {{by}}, mode, threshold from (select *, row_number() over (partition by {{by}}, mode order by goal desc, threshold) as r from l) where r = 1)"""


@query(f"""with {_POINTS.format(by='model')}, t as (select k.model, mode, threshold, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from k join pts using (model, threshold) where split = 'test' group by all)
    select model, mode, threshold, {Q.scores()}, round((tp + tn)::double / (tp + fp + fn + tn), 9) as accuracy from t""")
def operating_points(spark, folder):
    scored = T.scored_tokens(spark, folder)
    points = M.operating_points(M.threshold_sweep(scored.filter("split = 'validation'"), ["model"]), ["model"])
    return M.at_threshold(scored.filter("split = 'test'"), points, ["model"]).select("model", "mode", "threshold", "tokens", *rounded(*SCORES, "accuracy"))


@query(f"""with {_POINTS.format(by='dataset')}, z as (
        select dataset, mode, threshold, 'target' as calibration from pts union all
        select d.dataset, p.mode, p.threshold, 'zero_shot' from (select distinct dataset from pts) d, pts p where p.dataset = 'd3'),
    t as (select k.dataset, mode, threshold, calibration, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from k join z using (dataset, threshold) where split = 'test' group by all)
    select dataset, mode, calibration, threshold, {Q.scores()} from t""")
def zero_shot_vs_calibrated(spark, folder):
    scored = T.scored_tokens(spark, folder)
    return M.zero_shot_and_calibrated(scored.filter("split = 'validation'"), scored.filter("split = 'test'"), "dataset", "d3").select(
        "dataset", "mode", "calibration", "threshold", "tokens", *rounded(*SCORES))


@query(f"with s as ({Q.SCORED}), k as (select model, {Q.confusion('gold', 'cast(score >= 0.437 as int)')} from s group by model) select model, 0.437::double as threshold, {Q.scores()} from k")
def fixed_threshold(spark, folder):
    return M.at_fixed_threshold(T.scored_tokens(spark, folder), 0.437, ["model"]).select("model", "threshold", "tokens", *rounded(*SCORES))


_RANDOM = """
    r as (select id, pos, word, trial, sha256('42::' || trial || '::' || id || '::' || pos) as h from {src}, range(3) z(trial) where regexp_matches(word, '[\\p{{L}}\\p{{N}}]')),
    o as (select *, row_number() over (partition by id, trial order by h) as k from r),
    m as (select o.id, o.trial, o.pos from o join b using (id) where o.k <= b.budget)"""


@query(f"""
    with {_J}, b as (select id, sum(gold) as budget from j group by id), {_RANDOM.format(src='j')}
    select b.id, t.trial, coalesce(string_agg(m.pos, ',' order by m.pos), '') as positions from b cross join range(3) t(trial) left join m on m.id = b.id and m.trial = t.trial group by all""")
def random_masks(spark, folder):
    rows = versions(spark, folder)
    drawn = S.random_masks(rows, total("labels"), 3, 42)
    return drawn.select("id", c("trial").cast("bigint").alias("trial"), F.array_join(F.expr(
        "filter(transform(mask, (x, i) -> case when x = 1 then cast(i as string) end), i -> i is not null)"), ",").alias("positions"))


# A stand-in attacker that SQL can follow: it answers from the parity of the visible text's length.
_ANSWER = "length(text) % 3"


# j (id, pos, word, gold, pred) -> txt (id, condition, trial, text)
_CONDITIONS = f"""b as (select id, sum(gold) as budget from j group by id), {_RANDOM.format(src='j')},
    b2 as (select id, sum(pred) as budget from j group by id), m2 as (select o.id, o.trial, o.pos from o join b2 using (id) where o.k <= b2.budget),
    cond as (
        select id, 'original' as condition, 0 as trial, pos, word as w from j union all
        select id, 'teacher', 0, pos, case when gold = 1 then '[MASK]' else word end from j union all
        select id, 'student', 0, pos, case when pred = 1 then '[MASK]' else word end from j union all
        select j.id, 'random_teacher_budget', t.trial, j.pos, case when m.pos is not null then '[MASK]' else word end from j cross join range(3) t(trial) left join m on m.id = j.id and m.trial = t.trial and m.pos = j.pos union all
        select j.id, 'random_student_budget', t.trial, j.pos, case when m2.pos is not null then '[MASK]' else word end from j cross join range(3) t(trial) left join m2 on m2.id = j.id and m2.trial = t.trial and m2.pos = j.pos),
    txt as (select id, condition, trial, {Q.render("string_agg(w, ' ' order by pos)")} as text from cond group by all)"""
# ans (id, condition, trial, gold, predicted, p_gold) -> the leakage table
_LEAKAGE = f"""org as (select id, predicted as original_predicted from ans where condition = 'original'),
    a as (select * from ans join org using (id)),
    base as (select condition, trial, avg(cast(gold = predicted as int)) as accuracy, avg(p_gold) as mean_gold_label_probability, count_if(gold = original_predicted) as oc,
             sum(cast(gold = predicted and original_predicted = gold as int))::double / count_if(gold = original_predicted) as accuracy_on_originally_correct,
             avg(cast(predicted <> original_predicted as int)) as prediction_change_rate from a group by all),
    cls as (select condition, trial, k, 2.0 * count_if(gold = k and predicted = k) / (count_if(gold = k) + count_if(predicted = k)) as f1
            from a, range(3) z(k) group by all having count_if(gold = k) + count_if(predicted = k) > 0),
    sc as (select * from base join (select condition, trial, avg(f1)::double as macro_f1 from cls group by all) using (condition, trial))
    select condition, count(*) as trials, {', '.join(f'round(avg({f}), 9) as {f}_mean, round(stddev_pop({f}), 9) as {f}_std' for f in LK.LEAKAGE_FIELDS)},
           round((select avg(accuracy) from sc where condition = 'original') - avg(accuracy), 9) as accuracy_drop
    from sc group by condition"""


@query(f"""
    with {_J}, {_CONDITIONS},
    ans as (select txt.id, condition, trial, case task_label when 'F' then 0 when 'O' then 1 else 2 end as gold, {_ANSWER.replace('text', 'txt.text')} as predicted, 1.0 / (1 + length(txt.text) % 7) as p_gold
            from txt join ({Q.NOTES}) q on q.id = txt.id),
    {_LEAKAGE}""")
def leakage_table(spark, folder):
    rows = versions(spark, folder)
    texts = LK.condition_arrays(rows, 3, 42)
    answered = with_once(texts, answers=F.transform("versions", lambda v: F.struct(
        v["condition"].alias("condition"), v["trial"].alias("trial"), (F.length(v["text"]) % 3).alias("predicted"),
        (F.lit(1.0) / (1 + F.length(v["text"]) % 7)).alias("p_gold"))))
    answers = answered.select(
        F.expr("case task_label when 'F' then 0 when 'O' then 1 else 2 end").alias("gold"),
        c("answers")[0]["predicted"].alias("original_predicted"), F.inline("answers"))
    table = LK.leakage_table(LK.leakage_scores(answers))
    return table.select("condition", "trials", *rounded(*[f"{f}_{s}" for f in LK.LEAKAGE_FIELDS for s in ("mean", "std")], "accuracy_drop"))


@query(f"""
    with {_J}, d as (select id, string_agg(gold, '' order by pos) as g, string_agg(pred, '' order by pos) as p from j group by id)
    select id, cast(2 as bigint) as candidates, g <> p as candidate_disagreement, cast(length(replace(g, '0', '')) as bigint) as initial_masked from d""")
def review_candidates(spark, folder):
    rows = versions(spark, folder)
    long = rows.select("id", F.inline(F.array(F.struct(F.lit("latest").alias("method"), c("labels")),
                                              F.struct(F.lit("older").alias("method"), c("pred").alias("labels")))))
    table = RV.review_table(rows.select("id", "text", "words", "task_label"), long, ["latest", "older"], True, "latest")
    return table.select("id", F.size("candidates").cast("bigint").alias("candidates"), "candidate_disagreement",
                        F.expr("aggregate(human_labels, 0L, (a, x) -> a + x)").alias("initial_masked"))


@query(f"""
    with {_J}, d as (select id, dataset_name as dataset, source_index, count(*) as n, bool_or(gold <> pred) as changed from j group by all)
    select dataset, count(*) as total, count_if(source_index % 9 <> 0) as valid, count_if(source_index % 4 = 0) as reviewed,
           count_if(source_index % 9 = 0 or changed) as changed_from_rule from d group by 1""")
def review_progress(spark, folder):
    rows = versions(spark, folder)
    edited = rows.select(
        c("dataset_name").alias("dataset"), "words", c("labels").alias("rule_labels"), (c("source_index") % 4 == 0).alias("human_reviewed"),
        F.expr("case when source_index % 9 = 0 then concat(pred, array(0)) else pred end").alias("human_labels"))
    return RV.review_progress(edited)


@query(f"""
    with {_J}, m as (select 'latest' as method, id, pos, gold as human, gold as pred from j where source_index % 4 = 0 union all select 'older', id, pos, gold, pred from j where source_index % 4 = 0),
    k as (select method, count(distinct id) as examples, {Q.confusion('human', 'pred')} from m group by 1) select method, examples, {Q.scores()} from k""")
def score_review_methods(spark, folder):
    rows = versions(spark, folder)
    pack = lambda l: F.struct(c(l).alias("labels"), F.expr("transform(words, w -> 'O')").alias("types"), X.selected_words(c("words"), c(l)).alias("selected_words"))
    partial = F.map_concat(F.create_map(F.lit("latest"), pack("labels"), F.lit("older"), pack("pred")),
                           F.when(c("source_index") % 8 == 0, F.create_map(F.lit("draft"), pack("pred"))).otherwise(
                               F.expr("cast(map() as map<string,struct<labels:array<int>,types:array<string>,selected_words:array<string>>>)")))
    reviews = rows.select("id", partial.alias("candidates"), c("labels").alias("human_labels"), (c("source_index") % 4 == 0).alias("human_reviewed"))
    return M.score_methods(reviews).select("method", "examples", "tokens", *rounded(*SCORES))


@query(f"""
    with {_J}, x as (select a.id, r.rule, r.s, r.e, bool_and(a.pred = 1) as found from ({Q.spans(Q.NOTES)}) r join (select j.*, tok.s as ws, tok.e as we from j join tok using (id, pos)) a
        on a.id = r.id and a.gold = 1 and a.ws < r.e and r.s < a.we group by all)
    select rule, count(*) as targets, count_if(found) as detected from x group by 1""")
def target_detection(spark, folder):
    rows = with_once(versions(spark, folder), w=X.word_offsets("text"))
    targets = rows.select("labels", "pred", "w", F.explode(R.rule_spans("text")).alias("s"))
    hit = with_once(targets, at=L.target_words("w", "labels", "s.start", "s.end"))
    return hit.filter(F.size("at") > 0).groupBy(c("s.type").alias("rule")).agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(L.detected("at", "pred")).alias("detected"))
