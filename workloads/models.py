"""Queries that train a model and apply it, with SQL that runs the same steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import leakage as LK
from maskwright.operators import metrics as M
from maskwright.operators import rules as R
from maskwright.operators import student as ST
from maskwright.session import cut_lineage, with_once
from maskwright.sources import tables as T
from workloads import metrics as WM
from workloads import sqlparts as Q
from workloads.registry import query

c = F.col
_EPOCHS, _BATCHES = 3, 2


def _bucket(feature: str, buckets: int = 65536) -> str:
    return f"(('0x' || left(md5({feature}), 7))::int % {buckets})"


def _training(rate: float) -> str:
    """CTEs that train on ex (tid, batch, y, own) and ft (tid, bucket, val) and judge each epoch on vx (tid, y) and vf.

    w<k> holds (bucket, w, m, v) after step k; hist one row per epoch; best the weights of the best epoch. The
    intercept is a feature -1 of every example.
    """
    out, step = ["w0 as (select -1 as bucket, 0.0::double as w, 0.0::double as m, 0.0::double as v)"], 0
    for epoch in range(1, _EPOCHS + 1):
        for k in range(_BATCHES):
            part, last, step = (epoch - 1 + k) % _BATCHES, step, step + 1
            out.append(f"""z{step} as materialized (
                select e.tid, any_value(e.y) as y, any_value(e.own) as own, coalesce(sum(w.w * f.val), 0.0) as z
                from ex e join ft f using (tid) left join w{last} w on w.bucket = f.bucket where e.batch = {part} group by e.tid)""")
            out.append(f"""g{step} as materialized (
                select f.bucket, sum(z.own * (1 / (1 + exp(-z.z)) - z.y) * f.val) / (select sum(own) from z{step}) as g from z{step} z join ft f using (tid) group by f.bucket)""")
            out.append(f"s{step} as materialized (select least(1.0, 1.0 / (sqrt(sum(g * g)) + 1e-6)) as clip from g{step})")
            out.append(f"""w{step} as materialized (
                select bucket, w * (1 - {rate} * 0.01) - {rate} * (m / (1 - pow(0.9, {step}))) / (sqrt(v / (1 - pow(0.999, {step}))) + 1e-8) as w, m, v from (
                    select coalesce(a.bucket, b.bucket) as bucket, coalesce(a.w, 0.0) as w, 0.9 * coalesce(a.m, 0.0) + 0.1 * coalesce(b.g, 0.0) * clip as m,
                           0.999 * coalesce(a.v, 0.0) + 0.001 * pow(coalesce(b.g, 0.0) * clip, 2) as v
                    from w{last} a full join g{step} b on a.bucket = b.bucket cross join s{step}))""")
        losses = ", ".join(f"(select sum(own * (greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z))))) / sum(own) from z{k})" for k in range(step - _BATCHES + 1, step + 1))
        out.append(f"""h{epoch} as materialized (
            select {epoch} as epoch, list_avg([{losses}]) as loss, {Q.confusion('y', 'p')} from (
                select x.tid, any_value(x.y) as y, (1 / (1 + exp(-sum(coalesce(w.w, 0.0) * f.val))) >= 0.5)::int as p
                from vx x join vf f using (tid) left join w{step} w on w.bucket = f.bucket group by x.tid))""")
    rows = " union all ".join(f"select * from h{e}" for e in range(1, _EPOCHS + 1))
    tables = " union all ".join(f"select {e} as epoch, bucket, w from w{e * _BATCHES}" for e in range(1, _EPOCHS + 1))
    out.append(f"hist as materialized (select *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1x from ({rows}))")
    out.append(f"best as materialized (select bucket, w from ({tables}) where epoch = (select epoch from hist order by f1x desc, epoch limit 1))")
    return ",\n".join(out)


_SPLIT = "case when source_index % 10 < 8 then 'train' when source_index % 10 = 8 then 'validation' else 'test' end"
_FEATURES = {
    "w=": "lower(word)", "s=": r"regexp_replace(regexp_replace(regexp_replace(word, '\p{Lu}+', 'X', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+', 'x', 'g'), '\p{Nd}+', '9', 'g')",
    "p=": "left(lower(word), 3)", "e=": "right(lower(word), 3)", "-1=": "coalesce(lower(lag(word) over k), '<pad>')", "-2=": "coalesce(lower(lag(word, 2) over k), '<pad>')",
    "+1=": "coalesce(lower(lead(word) over k), '<pad>')", "+2=": "coalesce(lower(lead(word, 2) over k), '<pad>')"}
_PLACES = "[" + ", ".join(_bucket(f"('{n}' || {v})") for n, v in _FEATURES.items()) + "]"
_STUDENT = f"""tok as materialized ({Q.tokens(Q.NOTES)}), lab as materialized ({Q.labelled(Q.NOTES, tok='tok')}),
    tk as materialized (select row_number() over () as tid, l.id, l.pos, l.word, l.y, n.split, {_bucket("('42::' || l.id)", _BATCHES)} as batch, places
        from (select id, pos, word, label as y, {_PLACES} as places from lab window k as (partition by id order by pos)) l
        join (select id, {_SPLIT} as split from ({Q.NOTES})) n using (id)),
    fts as materialized (select distinct tid, split, unnest(list_append(places, -1)) as bucket, 1.0::double as val from tk),
    cw as (select least((count(*) - sum(y)) / greatest(sum(y), 1), 20.0)::double as cw from tk where split = 'train'),
    ex as materialized (select tid, batch, y, case when y = 1 then cw else 1.0 end as own from tk, cw where split = 'train'), ft as (select * from fts where split = 'train'),
    vx as (select tid, y from tk where split = 'validation'), vf as (select * from fts where split = 'validation'),
    {_training(0.05)},
    sc as materialized (select t.tid, t.id, t.pos, t.word, t.split, t.y as gold, 1 / (1 + exp(-sum(coalesce(b.w, 0.0) * f.val))) as score, 'linear' as model
        from tk t join fts f using (tid) left join best b on b.bucket = f.bucket where t.split <> 'train' group by all)"""


def _labelled(spark, folder):
    notes = T.order_notes(spark, folder)
    return cut_lineage(with_once(notes, words=X.words(c("text")), labels=R.rule_labels("text")).withColumn("split", F.expr(_SPLIT)))


def _student(rows):
    part = lambda name: rows.filter(c("split") == name)
    return ST.fit_student(part("train"), part("validation"), iterations=_EPOCHS, batches=_BATCHES)


@query(f"""with {_STUDENT} select epoch, round(loss, 6) as loss, tp, fp, fn, tn, {Q.scores()}, round((tp + tn)::double / (tp + fp + fn + tn), 9) as accuracy,
    epoch = (select epoch from hist order by f1x desc, epoch limit 1) as best from hist""")
def student_epochs(spark, folder):
    model = _student(_labelled(spark, folder))
    return model.history.select("epoch", F.round("loss", 6).alias("loss"), "tp", "fp", "fn", "tn", "tokens", *WM.rounded(*WM.SCORES, "accuracy"),
                                (c("epoch") == model.best_epoch).alias("best"))


@query(f"with {_STUDENT} select bucket, round(w, 6) as weight from best where abs(w) > 1e-3")
def student_weights(spark, folder):
    """The weight table itself, without weights that hardly differ from 0."""
    return _student(_labelled(spark, folder)).table().filter("abs(weight) > 1e-3").select("bucket", F.round("weight", 6).alias("weight"))


_AT = WM._POINTS.format(by="model").replace(f"s as ({Q.SCORED}),", "")


@query(f"""with {_STUDENT}, s as (select * from sc), {_AT.lstrip()}, t as (select k.model, mode, threshold, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn
        from (select model, split, threshold, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from k group by all) k join pts using (model, threshold) where split = 'test' group by all)
    select model, mode, threshold, {Q.scores()}, round((tp + tn)::double / (tp + fp + fn + tn), 9) as accuracy from t""".replace("select model, dataset, split, threshold", "select model, split, threshold"))
def student_scores(spark, folder):
    rows = _labelled(spark, folder)
    scored = cut_lineage(ST.score_words(_student(rows), rows.filter("split <> 'train'"), labels="labels", carry=("split",)))
    points = M.operating_points(M.threshold_sweep(scored.filter("split = 'validation'"), ["model"]), ["model"])
    return M.at_threshold(scored.filter("split = 'test'"), points, ["model"]).select("model", "mode", "threshold", "tokens", *WM.rounded(*WM.SCORES, "accuracy"))


@query(f"""with {_STUDENT}, m as (select id, count_if(score >= 0.5) as masked, string_agg(case when score >= 0.5 then '[REDACTED]' else word end, ' ' order by pos) as j from sc where split = 'test' group by id)
    select id, {Q.render('j')} as redacted, masked from m""")
def student_redaction(spark, folder):
    rows = _labelled(spark, folder)
    return ST.predict_text(_student(rows), rows.filter("split = 'test'").select("id", "text"), 0.5).select("id", "redacted", F.expr(
        "aggregate(pred, 0L, (a, x) -> a + coalesce(x, 0))").alias("masked"))


_LABELLED = "select d.doc_id as id, d.text, l.quality from documents d join labels l on l.doc_id = d.doc_id"
_HELD = f"select * from ({_LABELLED}) where id % 10 = 3"
_ATTACKER = f"""atok as materialized ({Q.tokens(f'select * from ({_LABELLED}) where id % 10 <> 3')}),
    many as materialized (select id, {_bucket('lower(word)')} as bucket, count(*) as n, sum(count(*)) over (partition by id) as len from atok group by 1, 2),
    docs as materialized (select id, (quality <> 0)::int as y, id % 10 = 4 as held, {_bucket("('42::' || id)", _BATCHES)} as batch from ({_LABELLED}) where id % 10 <> 3),
    idf as materialized (select bucket, ln(((select count(*) from docs where not held) + 1.0) / (count(*) + 1))::double as value from many join docs using (id) where not held group by bucket),
    af as materialized (select id as tid, bucket, n * value / len as val from many join idf using (bucket) union all select id, -1, 1.0 from docs),
    ex as (select id as tid, batch, y, 1.0::double as own from docs where not held), ft as (select af.* from af join ex using (tid)),
    vx as (select id as tid, y from docs where held), vf as (select af.* from af join vx using (tid)),
    {_training(1.0)},
    tok as materialized ({Q.tokens(_HELD)}),
    j as materialized (select a.id, a.pos, a.word, a.label as gold, b.label as pred
        from ({Q.labelled(_HELD, '1.4', tok='tok')}) a join ({Q.labelled(_HELD, '1.3', tok='tok')}) b using (id, pos)),
    {WM._CONDITIONS},
    named as materialized (select id, condition, trial, text, id || '|' || condition || '|' || trial as cid from txt),
    cm as (select cid, {_bucket('lower(word)')} as bucket, count(*) as n, sum(count(*)) over (partition by cid) as len from ({Q.tokens('select cid, text from named', 'cid')}) group by 1, 2),
    p as (select cid, sum(n * value * coalesce(w, 0.0) / len) as z from cm join idf using (bucket) left join best using (bucket) group by cid),
    judged as (select id, condition, trial, (quality <> 0)::int as gold, 1 / (1 + exp(-coalesce(z, 0.0) - (select w from best where bucket = -1))) as q
        from named join ({_HELD}) h using (id) left join p using (cid)),
    ans as (select id, condition, trial, gold, (q >= 0.5)::int as predicted, case when gold = 1 then q else 1 - q end as p_gold from judged),
    {WM._LEAKAGE}"""


@query(f"with {_ATTACKER}")
def attacker_scores(spark, folder):
    docs = T.labelled_documents(spark, folder).withColumn("source_index", c("id"))
    teacher = docs.filter("id % 10 = 3").select(F.concat(F.lit("corpus-train-"), c("id")).alias("id"))
    train = cut_lineage(ST.attacker_rows(docs, ST.teacher_indices(teacher, r"^corpus-train-(\d+)$")))
    model = ST.fit_attacker(train.filter("id % 10 <> 4"), train.filter("id % 10 = 4"), iterations=_EPOCHS, batches=_BATCHES)
    held = with_once(docs.filter("id % 10 = 3"), words=X.words(c("text")), labels=R.rule_labels("text"), pred=R.rule_labels("text", R.rules_as_of("1.3")))
    answers = ST.attack(model, LK.conditions(held, 3, 42))
    table = LK.leakage_table(LK.leakage_scores(answers))
    return table.select("condition", "trials", *WM.rounded(*[f"{f}_{s}" for f in LK.LEAKAGE_FIELDS for s in ("mean", "std")], "accuracy_drop"))
