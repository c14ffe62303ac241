"""Corpus preparation: filters, duplicates, sampling, splits, merging and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import predicates as P
from maskwright.functions import text as X
from maskwright.operators import audit as A
from maskwright.operators import corpus as C
from maskwright.operators import lodo, metrics as M
from maskwright.operators import rules as R
from maskwright.operators import sampling as S
from maskwright.operators import teacher as TE
from maskwright.session import with_once
from maskwright.sources import resume
from maskwright.sources import tables as T
from workloads import sqlparts as Q
from workloads.registry import query

c = F.col
SEED = 42
_SQUEEZE = f"trim(trim(regexp_replace(text, '[{Q.SPACE}]+', ' ', 'g'), ' '), '\"')"
_CLEAN = f"select doc_id as id, doc_id as source_index, {_SQUEEZE} as text, lang as task_label, source from documents"
_SIG = "replace(lower(text), 'ß', 'ss')"
_USABLE = f"(length(text) between 10 and 1000 and trim({_SIG}, ' ') not in ('[deleted]', '[removed]', '[ deleted ]', '[ removed ]'))"
_SPLIT = "case when source_index % 10 < 6 then 'train' when source_index % 10 < 8 then 'validation' else 'test' end"


def cleaned(spark, folder):
    docs = T.documents(spark, folder)
    return docs.select("id", c("id").alias("source_index"), X.squeeze(c("text")).alias("text"), c("lang").alias("task_label"), "source")


def split_documents(spark, folder):
    return cleaned(spark, folder).withColumn("desired_split", F.expr(_SPLIT))


@query(f"select task_label, count(*) as n, cast(sum(length(text)) as bigint) as chars from ({_CLEAN}) where {_USABLE} group by 1")
def usable_texts(spark, folder):
    return C.keep_usable(cleaned(spark, folder)).groupBy("task_label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""
    select id, text from (select *, row_number() over (partition by {_SIG} order by source_index) as r from ({_CLEAN}) where {_USABLE}) where r = 1""")
def usable_dedup(spark, folder):
    return C.first_by_text(C.keep_usable(cleaned(spark, folder)), "source_index").select("id", "text")


@query(f"""
    with x as (select *, {_SPLIT} as desired_split from ({_CLEAN}))
    select desired_split, id from (select *, row_number() over (partition by {_SIG} order by
        case desired_split when 'train' then 1 when 'validation' then 2 else 3 end, source_index) as r from x) where r = 1""")
def cross_split_dedup(spark, folder):
    return C.dedupe_across_splits(split_documents(spark, folder)).select("desired_split", "id")


_STAGE = """
    {name}_d as (select * from (select *, row_number() over (partition by {sig} order by source_index) as r from x where desired_split = '{split}') where r = 1),
    {name} as (select id, text, desired_split from (select *, row_number() over (partition by task_label order by sha256('{seed}::' || id), id) as k
        from {name}_d where {sig} not in (select {sig} from ({before}))) order by k, task_label limit {n})"""


@query("with x as (select *, " + _SPLIT + " as desired_split from (" + _CLEAN + "))," + ",".join([
    _STAGE.format(name="a", sig=_SIG, split="train", seed=42, n=80, before="select '' as text where false"),
    _STAGE.format(name="b", sig=_SIG, split="validation", seed=43, n=30, before="select text from a"),
    _STAGE.format(name="d", sig=_SIG, split="test", seed=44, n=30, before="select text from a union all select text from b"),
]) + " select id, desired_split from a union all select id, desired_split from b union all select id, desired_split from d")
def official_split_sample(spark, folder):
    return C.select_official_splits(split_documents(spark, folder), {"train": 80, "validation": 30, "test": 30}, SEED).select("id", "desired_split")


@query(f"""
    with b as (select distinct {_SIG.replace('text', 't')} as s from (select {_SQUEEZE} as t from benchmark))
    select id from ({_CLEAN}) where {_SIG} not in (select s from b)""")
def exclude_benchmark(spark, folder):
    return C.exclude_texts(cleaned(spark, folder), T.table(spark, folder, "benchmark")).select("id")


@query(f"""
    with top as (select source from documents group by 1 order by count(*) desc, source limit 10)
    select source, count(*) as n from documents where source in (select source from top) group by 1""")
def top10_sources(spark, folder):
    return C.keep_top_categories(T.table(spark, folder, "documents").select("source"), "source", 10).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"))


@query("""
    select label, count(*) as n from (
        select case lang when 'en' then 0 when 'de' then 1 when 'fr' then 2 end as label from documents where source in ('src1', 'src2', 'src3', 'src4'))
    where label is not null group by 1""")
def mapped_labels(spark, folder):
    docs = T.table(spark, folder, "documents").select(c("lang").alias("label"), "source")
    kept = C.map_labels(C.keep_values(docs, "source", ("src1", "src2", "src3", "src4")), "label", {"en": 0, "de": 1, "fr": 2})
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_LABELLED = "select d.doc_id as id, cast(l.quality as varchar) as task_label, l.toxic, d.text, d.lang from documents d join labels l using (doc_id)"


@query(f"""
    select id, task_label from (select *, row_number() over (partition by task_label order by sha256('{SEED}::' || id), id) as k from ({_LABELLED}))
    order by k, task_label limit 100""")
def balanced_sample(spark, folder):
    return S.balanced_sample(T.labelled_documents(spark, folder), "task_label", 100, SEED).select("id", "task_label")


@query(f"""
    with r as (select *, row_number() over (partition by task_label order by sha256('{SEED}::' || id), id) as k, count(*) over (partition by task_label) as n from ({_LABELLED})),
    s as (select *, greatest(1, cast(round_even(n * 0.1, 0) as bigint)) as v from r)
    select id, case when k <= v then 'validation' when k <= 2 * v then 'test' else 'train' end as split from s""")
def stratified_split(spark, folder):
    return S.stratified_split(T.labelled_documents(spark, folder), ["task_label"], SEED).select("id", "split")


@query(f"""
    with r as (select *, row_number() over (partition by task_label, toxic order by sha256('{SEED}::' || id), id) as k, count(*) over (partition by task_label, toxic) as n from ({_LABELLED})),
    s as (select *, cast(round_even(n * 0.1, 0) as bigint) as v from r)
    select id, case when k <= v then 'validation' when k <= 2 * v then 'test' else 'train' end as split from s""")
def stratified_split_two_keys(spark, folder):
    return S.stratified_split(T.labelled_documents(spark, folder), ["task_label", "toxic"], SEED, at_least=0).select("id", "split")


@query(f"""
    with r as (select *, row_number() over (partition by lang order by sha256('{SEED}::' || id), id) as k, count(*) over (partition by lang) as n from ({Q.DOCS})),
    s as (select *, cast(round_even(n * 0.2, 0) as bigint) as h from r), u as (select *, cast(round_even(h * 0.5, 0) as bigint) as t from s)
    select id, case when k <= t then 'test' when k <= h then 'validation' else 'train' end as split from u""")
def nested_holdout(spark, folder):
    return S.holdout_split(T.documents(spark, folder).select("id", "lang"), ["lang"], SEED).select("id", "split")


@query(f"select id, task_label from (select *, row_number() over (partition by task_label order by sha256('{SEED}::' || id), id) as k from ({_LABELLED})) where k <= 40")
def exact_class_sample(spark, folder):
    return S.exact_per_class(T.labelled_documents(spark, folder), "task_label", 80, SEED).select("id", "task_label")


@query(f"""
    with tok as ({Q.tokens(Q.NOTES)}), lab as ({Q.labelled(Q.NOTES, tok='tok')}),
    m as (select id, sum(label) as k from lab group by id having sum(label) > 0),
    p as (select n.dataset_name, m.*, sha256('{SEED}::' || m.id) as h, cast(k <= 3 as int) as light from m join ({Q.NOTES}) n using (id)),
    r as (select *, row_number() over (partition by dataset_name, light order by h, id) as i from p),
    q as (select *, i <= 10 as chosen from r),
    e as (select *, row_number() over (partition by dataset_name, chosen order by h, id) as x, count_if(chosen) over (partition by dataset_name) as taken from q where i <= 40)
    select dataset_name, id, cast(k as bigint) as masked from e where chosen or x <= 20 - taken""")
def light_heavy_sample(spark, folder):
    notes = with_once(T.order_notes(spark, folder), labels=R.rule_labels("text"))
    masked = with_once(notes.select("id", "dataset_name", "labels"), masked=F.expr("aggregate(labels, 0L, (a, x) -> a + x)"))
    return S.light_heavy_sample(masked, "masked", 20, SEED, ["dataset_name"]).select("dataset_name", "id", "masked")


@query(f"""
    with n as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents)
    select doc_id from n where i in (select cast(floor(k * (n.n - 1) / 49.0) as bigint) from range(50) z(k))""")
def evenly_spaced_documents(spark, folder):
    return S.evenly_spaced(T.table(spark, folder, "documents").select("doc_id"), "doc_id", 50)


@query("select lang, doc_id from (select *, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 25")
def first_rows_per_group(spark, folder):
    return S.cap_rows(T.table(spark, folder, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 25)


@query(f"select doc_id as id from documents order by sha256('{SEED}::' || doc_id), doc_id limit 64")
def attacker_training_sample(spark, folder):
    return S.sample_n(T.table(spark, folder, "documents").select(c("doc_id").alias("id")), 64, SEED)


@query(f"""
    with t as (select distinct lang from documents), d as (select *, {_SPLIT.replace('source_index', 'doc_id')} as split from documents)
    select t.lang as heldout, d.split, count(*) as n from t join d on d.lang <> t.lang group by all""")
def lodo_counts(spark, folder):
    docs = T.table(spark, folder, "documents").select("lang", F.expr(_SPLIT.replace("source_index", "doc_id")).alias("split"))
    return lodo.lodo_counts(docs, ("de", "en", "es", "fr"), "lang")


@query("select t.lang as heldout, d.lang, count(*) as n, cast(sum(d.doc_id) as bigint) as id_sum from (select distinct lang from documents) t join documents d on d.lang <> t.lang group by all")
def lodo_rows(spark, folder):
    docs = T.table(spark, folder, "documents").select("lang", "doc_id")
    return lodo.lodo_splits(docs, ("de", "en", "es", "fr"), "lang").groupBy("heldout", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@query(f"""
    with tok as ({Q.tokens(Q.DOCS)}), n as (select id, count(*) as n from tok group by id),
    x as (select d.source, d.lang, d.id, coalesce(n.n, 0) as n, coalesce(m.m, 0) as m from ({Q.DOCS}) d left join n using (id)
          left join (select id, sum(label) as m from ({Q.labelled(Q.DOCS, tok='tok')}) group by id) m using (id))
    select source, lang, count(*) as examples, cast(sum(n) as bigint) as tokens, cast(sum(m) as bigint) as selected_tokens,
           round(sum(m) / greatest(sum(n), 1), 9) as mask_rate, count_if(m = 0) as zero_mask_examples,
           count(distinct lang) as label_values
    from x group by rollup (source, lang)""")
def split_stats(spark, folder):
    rows = T.documents(spark, folder).select("source", "lang", R.rule_labels("text").alias("labels"), c("lang").alias("task_label"))
    stats = M.split_stats(rows, ["source", "lang"])
    return stats.select("source", "lang", "examples", "tokens", "selected_tokens", F.round("mask_rate", 9).alias("mask_rate"),
                        "zero_mask_examples", F.size("task_labels").cast("bigint").alias("label_values"))


# Two views of the documents stand for two files: shard a lacks some ids, shard b others.
@query("""
    with a as (select doc_id from documents where doc_id % 97 <> 5), b as (select doc_id from documents where doc_id % 89 <> 7)
    select doc_id as id, 'missing' as side from a where doc_id not in (select doc_id from b)
    union all select doc_id, 'extra' from b where doc_id not in (select doc_id from a)""")
def id_audit(spark, folder):
    ids = T.table(spark, folder, "documents").select(c("doc_id").alias("id"))
    return A.id_difference(ids.filter("id % 97 <> 5"), ids.filter("id % 89 <> 7"))


@query("select conv_id as id, count(*) as count from conversations group by 1 having count(*) > 1")
def duplicate_id_audit(spark, folder):
    rows = T.table(spark, folder, "conversations").select(c("conv_id").alias("id"))
    return A.union_checked([rows])[1]


_OLD_NEW = f"""
    with tok as ({Q.tokens(Q.NOTES)}),
    j as (select a.id, a.pos, a.word, a.label as gold, b.label as pred from ({Q.labelled(Q.NOTES, '1.4', tok='tok')}) a join ({Q.labelled(Q.NOTES, '1.3', tok='tok')}) b using (id, pos))"""


def rule_versions(spark, folder):
    notes = T.order_notes(spark, folder)
    return (R.annotate(notes.select("id", "text", "task_label"), "1.4"), R.annotate(notes.select("id", "text"), "1.3"))


@query(f"""{_OLD_NEW}
    select count(distinct id) as examples, round(avg(cast(gold = pred as int)), 9) as accuracy, {Q.scores()} from (
        select *, count_if(gold = 1 and pred = 1) over () as tp, count_if(gold = 0 and pred = 1) over () as fp,
               count_if(gold = 1 and pred = 0) over () as fn, count_if(gold = 0 and pred = 0) over () as tn from j) group by tp, fp, fn, tn""")
def compare_labels(spark, folder):
    new, old = rule_versions(spark, folder)
    got = A.compare_labels(new, old)
    n = T.order_notes(spark, folder).select(F.count(F.lit(1))).scalar()
    return got.select(n.alias("examples"), F.round("accuracy", 9).alias("accuracy"), "tokens", *[F.round(m, 9).alias(m) for m in (
        "precision", "recall", "f1", "f2", "gold_mask_rate", "predicted_mask_rate", "residual_sensitive_rate", "overmask_rate")])


@query(f"""{_OLD_NEW}
    select id, {Q.render("string_agg(case when gold = 1 then '[REDACTED]' else word end, ' ' order by pos)")} as reference_text,
           {Q.render("string_agg(case when pred = 1 then '[REDACTED]' else word end, ' ' order by pos)")} as candidate_text
    from j group by id having count_if(gold <> pred) > 0 order by id limit 20""")
def disagreements(spark, folder):
    new, old = rule_versions(spark, folder)
    return A.disagreements(new, old, 20).drop("text")


@query(f"""
    with tok as ({Q.tokens(Q.NOTES)}), lab as ({Q.labelled(Q.NOTES, tok='tok')})
    select n.id, n.task_label, count(*) as words, coalesce(string_agg(case when label = 1 then word end, '|' order by pos), '') as selected,
           case when n.source_index % 11 = 0 then 'expected ' || count(*) || ' labels, got ' || (count(*) - 1) end as error
    from lab join ({Q.NOTES}) n using (id) group by n.id, n.task_label, n.source_index""")
def merge_labels(spark, folder):
    notes = T.order_notes(spark, folder)
    inputs = notes.select("id", "task_label", X.words(c("text")).alias("words"))
    broken = c("source_index") % 11 == 0
    labels = R.rule_labels("text")
    annotations = notes.select("id", "source_index", labels.alias("labels")).select(
        "id", F.when(broken, F.slice("labels", 1, F.size("labels") - 1)).otherwise(c("labels")).alias("labels"))
    merged = A.merge_labels(inputs, annotations)
    return merged.select("id", "task_label", F.size("words").cast("bigint").alias("words"),
                         F.array_join("selected_words", "|").alias("selected"), "error")


# Replies are derived from the notes: fenced JSON, bare arrays, wrong lengths, non-integers,
# broken JSON, unknown ids, repeats and ids that never got a reply.
_REPLY = """case source_index % 13
    when 0 then '```json' || chr(10) || '{"labels": [' || zeros || ']}' || chr(10) || '```' when 1 then '[' || zeros || ']'
    when 2 then '[' || zeros || ', 1]' when 3 then '{"labels": [true]}' when 4 then 'not json' when 5 then '{"answer": 1}'
    when 6 then null when 7 then '[' || replace(zeros, '0', '"0"') || ']' else '{"labels": [' || zeros || ']}' end"""


@query(f"""
    with tok as ({Q.tokens(Q.NOTES)}), n as (select id, count(*) as n from tok group by id),
    q as (select t.*, n.n, source_index % 13 as kind from ({Q.NOTES}) t join n using (id)),
    r as (select *, case when source_index % 29 = 1 then 'x' || id else id end as rid, 2 * source_index as line from q where source_index % 31 <> 2
          union all select *, id, 2 * source_index + 1 from q where source_index % 17 = 3 and source_index % 31 <> 2),
    f as (select *, case when rid <> id then 'unknown or missing id' when kind = 6 then 'missing labels or string response/output/content'
            when kind = 4 then 'invalid JSON' when kind = 5 then 'response JSON must contain a labels list'
            when kind = 2 then 'expected ' || n || ' labels, got ' || (n + 1)
            when kind = 3 and n <> 1 then 'expected ' || n || ' labels, got 1' when kind in (3, 7) then 'every label must be integer 0 or 1' end as fault from r),
    g as (select *, min(case when fault is null then line end) over (partition by rid) as first from f)
    select rid as id, line, case when rid = id and line > first then 'duplicate id' else coalesce(fault, 'accepted') end as verdict from g
    union all select id, null, 'missing response' from q where id not in (select rid from r)""")
def validate_responses(spark, folder):
    notes = T.order_notes(spark, folder).select("id", "text", "task_label", "source_index", X.words(c("text")).alias("words"))
    asked = TE.requests(notes, "Return one 0/1 label per word.")
    shaped = notes.filter("source_index % 31 <> 2").select(
        "id", "source_index", F.array_join(F.transform("words", lambda _: F.lit("0")), ", ").alias("zeros"))
    first = shaped.withColumn("line", 2 * c("source_index")).withColumn(
        "id", F.when(c("source_index") % 29 == 1, F.concat(F.lit("x"), "id")).otherwise(c("id")))
    again = shaped.filter("source_index % 17 = 3").withColumn("line", 2 * c("source_index") + 1)
    none = F.lit(None).cast("string")
    replies = first.unionByName(again).select(
        "id", "line", F.lit("m").alias("model"), none.alias("labels"), F.expr(_REPLY).alias("response"), none.alias("output"), none.alias("content"))
    accepted, rejected = TE.validate_responses(asked, replies)
    kept = accepted.select("id").join(replies.select("id", "line"), "id").groupBy("id").agg(F.min("line").alias("line"))
    return kept.select("id", "line", F.lit("accepted").alias("verdict")).unionByName(
        rejected.select("id", c("line").cast("bigint").alias("line"), c("error").alias("verdict")))


@query(f"""
    with tok as ({Q.tokens(Q.NOTES)})
    select id, 'Words: [' || string_agg('"' || replace(word, '"', '\\"') || '"', ', ' order by pos) || ']' as user_prompt from tok group by id""")
def teacher_requests(spark, folder):
    notes = T.order_notes(spark, folder).select("id", "text", "task_label", X.words(c("text")).alias("words"))
    return TE.requests(notes, "Return one 0/1 label per word.").select("id", "user_prompt")


@query("select chunk, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from (select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 150) + 1 as bigint) as chunk from documents) group by 1")
def export_chunks(spark, folder):
    numbered = S.number_rows(T.table(spark, folder, "documents").select("doc_id"), "doc_id")
    return numbered.groupBy((F.floor(c("row_index") / 150) + 1).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("""
    with i as (select doc_id as id from documents), d as (select doc_id as id from documents where doc_id % 5 <> 0 union all
        select -doc_id - 1 from documents where doc_id % 11 = 2 union all select doc_id from documents where doc_id % 35 = 8),
    k as (select id, count(*) as n from d group by id)
    select (select count(*) from i) as inputs, (select count(*) from d) as outputs, (select count(*) from i where id not in (select id from d)) as missing,
           (select count(*) from k where id not in (select id from i)) as unknown, (select count(*) from k where n > 1) as repeated""")
def reconcile_outputs(spark, folder):
    ids = T.table(spark, folder, "documents").select(c("doc_id").alias("id"))
    done = ids.filter("id % 5 <> 0").unionByName(ids.filter("id % 11 = 2").select((-c("id") - 1).alias("id"))).unionByName(ids.filter("id % 35 = 8"))
    return resume.reconcile(ids, done)


@query("select doc_id as id from documents where doc_id % 5 = 0")
def resume_pending(spark, folder):
    ids = T.table(spark, folder, "documents").select(c("doc_id").alias("id"))
    return resume.pending(ids, ids.filter("id % 5 <> 0"))


@query(f"select id, string_agg(word, '|' order by pos) as kept from ({Q.tokens(Q.NOTES)}) where regexp_matches(lower(word), '[\\p{{L}}\\p{{N}}]') and not regexp_matches(lower(word), '^\\p{{L}}$') and lower(word) not in ('{chr(39) + ', ' + chr(39)}') and lower(word) not in ('{(chr(39) + ', ' + chr(39)).join(P.lx.STOP_WORDS)}') and lower(word) not in ('{(chr(39) + ', ' + chr(39)).join(P.lx.CLINICAL_STOP)}') group by id")
def keepable_words(spark, folder):
    words = T.order_notes(spark, folder).select("id", X.words(c("text")).alias("words"))
    kept = words.select("id", F.filter("words", lambda w: P.keep_medical_word(w)).alias("w")).filter(F.size("w") > 0)
    return kept.select("id", F.array_join("w", "|").alias("kept"))

