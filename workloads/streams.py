"""Queries over files that Spark writes from the given tables: streams run to their end, numbered lines, published output."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import phrases as PH
from maskwright.operators import rules as R
from maskwright.plans import jobs as J
from maskwright.session import checkpoint_folder
from maskwright.sources import lines as LI
from maskwright.sources import publish as PU
from maskwright.sources import resume as RE
from maskwright.sources import tables as T
from maskwright.streaming import redaction as SR
from workloads import metrics as WM
from workloads import sqlparts as Q
from workloads.registry import query

c = F.col


def _folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""with tok as ({Q.tokens(Q.NOTES)}), lab as ({Q.labelled(Q.NOTES, tok='tok')})
    select id, {Q.render("string_agg(case when label = 1 then '[REDACTED]' else word end, ' ' order by pos)")} as redacted, count(*) as words from lab group by id""")
def stream_redaction(spark, folder):
    """Notes redacted by a stream of several micro-batches, read back from its sink."""
    source, sink, state = (_folder(spark, n) for n in ("in", "out", "state"))
    T.order_notes(spark, folder).select("id", "text").write.parquet(source)
    stream = SR.redact_stream(SR.read_stream(spark, source, "id string, text string", "parquet", per_trigger=3))
    SR.write_batches(stream.select("id", "redacted", F.size("words").cast("bigint").alias("words")), sink, state)
    return SR.read_batches(spark, sink)


@query("""
    with e as (select event_id, event_type, ts, user_id % 50 || ':' || event_type as key from events),
    late as (select count(*) as late_rows from e where event_id % 97 = 0)
    select event_type, count(distinct key) as keys, any_value(late_rows) as late_rows from e, late group by event_type""")
def stream_dedupe(spark, folder):
    """First event of each key, by a stream with a watermark; a second wave, days older than the first, is counted as late."""
    source, sink, state = (_folder(spark, n) for n in ("in", "out", "state"))
    events = T.table(spark, folder, "events").selectExpr("event_id", "event_type", "ts", "concat(user_id % 50, ':', event_type) as key")
    span = events.agg(F.max("ts").alias("top"), F.min("ts").alias("low")).first()
    delay = f"{int((span['top'] - span['low']).total_seconds()) + 3600} seconds"
    old = events.filter("event_id % 97 = 0").withColumns({"ts": F.lit(span["low"]) - F.expr("interval 40 days"), "key": F.concat(F.lit("late "), "key")})
    schema = "event_id bigint, event_type string, ts timestamp, key string"
    run = lambda: SR.write_batches(SR.dedupe_stream(SR.read_stream(spark, source, schema, "parquet"), "ts", delay, "key").select("event_type", "key"), sink, state)
    wave = lambda rows: rows.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "key").write.mode("append").parquet(source)
    wave(events)
    late = SR.late_rows(run())
    wave(old)
    late += SR.late_rows(run())
    return SR.read_batches(spark, sink).groupBy("event_type").agg(F.countDistinct("key").alias("keys")).withColumn("late_rows", F.lit(late).cast("bigint"))


@query("""
    with o as (select o_orderkey as k, o_orderkey % 4 as part from orders), l as (
        select part, k, 0 as sub, 'record' as kind from o union all select part, k, 1, 'blank' from o where k % 5 = 0 union all select part, k, 2, 'broken' from o where k % 31 = 0)
    select part, line, kind, case when kind = 'record' then k end as id
    from (select *, row_number() over (partition by part order by k, sub) as line from l) where kind <> 'blank'""")
def numbered_records(spark, folder):
    """Orders as JSON lines with blank and broken lines among them, read back with the number of each line."""
    path = _folder(spark, "lines")
    line = F.array(F.struct(F.lit(0).alias("sub"), F.to_json(F.struct(c("o_orderkey").alias("id"))).alias("value")), F.when(c("o_orderkey") % 5 == 0, F.struct(F.lit(1).alias("sub"), F.lit("").alias("value"))),
                   F.when(c("o_orderkey") % 31 == 0, F.struct(F.lit(2).alias("sub"), F.lit('{"id": ').alias("value"))))
    rows = T.table(spark, folder, "orders").select("o_orderkey", (c("o_orderkey") % 4).alias("part"), F.inline(F.array_compact(line)))
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey", "sub").select("part", "value").write.partitionBy("part").text(path)
    got = LI.numbered_records(spark, f"{path}/part=*", "id bigint")
    return got.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part"), "line", F.when(c("_corrupt").isNull(), "record").otherwise("broken").alias("kind"), "id")


@query("""select o_orderpriority as priority, count(*) as orders, count(*) as expected, true as skipped, true as old_kept from orders group by 1""")
def published_output(spark, folder):
    """Orders published per priority; a second run is skipped and a failing one leaves the output whole."""
    path = _folder(spark, "published")
    counts = T.table(spark, folder, "orders").groupBy(c("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("orders"))
    expected = counts.count()
    PU.publish(counts, path, expected)
    skipped = not PU.publish(counts, path, expected)
    try:
        PU.publish(counts.filter(F.raise_error(F.lit("stopped on purpose")).cast("boolean")), path, expected, force=True)
        kept = False
    except Exception as error:
        kept = "stopped on purpose" in str(error) and PU.manifest(spark, path)["rows"] == expected
    return spark.read.parquet(path).select("priority", "orders", c("orders").alias("expected"), F.lit(skipped).alias("skipped"), F.lit(kept).alias("old_kept"))


_TERMS = """select distinct array_to_string(list_transform(ws[pos + 1:pos + n], lambda w: lower(w)), ' ') as phrase, n from (
    select item_id, ws, unnest(range(0, len(ws), 3)) as pos, 1 + (item_id + unnest(range(0, len(ws), 3))) % 5 as n from (
        select item_id, list(word order by pos) as ws from (""" + Q.tokens("select item_id as id, text from benchmark") + """) t(item_id, pos, word, s, e) group by item_id))
    where pos + n <= len(ws) and (n > 1 or length(ws[pos + 1]) > 9)"""


@query(f"""
    with tok as materialized ({Q.tokens(Q.DOCS)}), low as materialized (select id, count(*) as total from tok group by id),
    terms as materialized ({_TERMS}),
    next as materialized (select id, pos, lower(word) as w1, lead(lower(word)) over k as w2, lead(lower(word), 2) over k as w3, lead(lower(word), 3) over k as w4,
        lead(lower(word), 4) over k as w5 from tok window k as (partition by id order by pos)),
    grams as (select id, pos, 1 as n, w1 as phrase from next union all select id, pos, 2, w1 || ' ' || w2 from next union all select id, pos, 3, w1 || ' ' || w2 || ' ' || w3 from next
        union all select id, pos, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from next union all select id, pos, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 from next),
    m as materialized (select id, pos, max(n) as n from grams semi join terms using (phrase) group by id, pos),
    g as (select id, list_reduce(list_prepend({{'e': 0::bigint, 'masked': 0::bigint, 'pc': 0::bigint, 'spans': 0::bigint}},
            list({{'e': pos::bigint, 'masked': n::bigint, 'pc': 0::bigint, 'spans': 0::bigint}} order by pos)), lambda a, h: case when h.e >= a.e
            then {{'e': h.e + h.masked, 'masked': a.masked + h.masked, 'pc': a.pc + (h.e + 1) * h.masked, 'spans': a.spans + 1}} else a end) as x from m group by id)
    select l.id, l.total as words, coalesce(x.spans, 0) as spans, coalesce(x.masked, 0) as masked, coalesce(x.pc, 0) as position_check from low l left join g using (id)""")
def phrase_labels(spark, folder):
    """Documents labelled by terms of one to five words taken from the benchmark."""
    bench = T.table(spark, folder, "benchmark").select("item_id", F.transform(X.words(c("text")), F.lower).alias("ws"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0)), F.lit(3))).alias("pos")
    cut = bench.select("item_id", "ws", at).withColumn("n", (1 + (c("item_id") + c("pos")) % 5).cast("int")).filter("pos + n <= size(ws) and (n > 1 or length(get(ws, pos)) > 9)")
    terms = cut.select(F.array_join(F.slice("ws", c("pos") + 1, c("n")), " ").alias("term")).distinct()
    rows = PH.label_by_phrases(T.documents(spark, folder).select("id", X.words(c("text")).alias("words")), terms)
    sums = lambda value: F.expr(f"aggregate(spans, 0L, (a, s) -> a + {value})")
    return rows.filter(F.size("words") > 0).select(
        "id", F.size("words").cast("bigint").alias("words"), F.size("spans").cast("bigint").alias("spans"), F.expr("aggregate(labels, 0L, (a, x) -> a + x)").alias("masked"),
        sums("cast(s.start + 1 as bigint) * (s.stop - s.start)").alias("position_check"))


@query(f"""with tok as ({Q.tokens(Q.NOTES)}), lab as ({Q.labelled(Q.NOTES, tok='tok')}), r as (select id, row_number() over (order by id) - 1 as i from ({Q.NOTES}))
    select r.id, i // greatest(1, (select count(*) from r) // 7) as unit, sum(label)::bigint as masked from lab join r using (id) group by all""")
def resumed_annotation(spark, folder):
    """Notes annotated in units of key order, by a run that is stopped in its second job and one that takes up the rest."""
    path = _folder(spark, "annotated")
    notes = T.order_notes(spark, folder).select("id", "text")
    per_unit = max(1, notes.count() // 7)
    last = notes.agg(F.max("id")).first()[0]
    label = lambda df: df.select("id", F.expr("cast(aggregate(labels, 0, (a, x) -> a + x) as bigint)").alias("masked")) if "labels" in df.columns else label(df.withColumn("labels", R.rule_labels("text")))
    stopped = lambda df: label(df.filter(F.when(c("id") == last, F.raise_error(F.lit("stopped on purpose")).cast("boolean")).otherwise(True)))
    try:
        RE.annotate_in_order(notes, path, stopped, "id", per_unit, 3)
    except Exception as error:
        if "stopped on purpose" not in str(error):
            raise
    kept = spark.read.parquet(path).select("unit").distinct().count()
    written = RE.annotate_in_order(notes, path, label, "id", per_unit, 3)
    total = spark.read.parquet(path).select("unit").distinct().count()
    if not 0 < kept == total - written:
        raise ValueError(f"{kept} units kept, {written} written, {total} in all")
    return spark.read.parquet(path).select("id", c("unit").cast("bigint").alias("unit"), "masked")


_TASKS = ("d0", "d1", "d2", "d3")


@query(f"""with s as ({Q.SCORED}), th as (select unnest([{', '.join(f'{t!r}e0' for t in Q.THRESHOLDS)}]) as threshold),
    d as (select dataset, split, threshold, {Q.confusion('gold', 'cast(score >= threshold as int)')} from s, th where dataset in {_TASKS} group by all),
    v as (select h.t as heldout, threshold, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from d join (select unnest({list(_TASKS)}) as t) h on h.t <> d.dataset where split = 'validation' group by all),
    w as (select *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::double as f1x, coalesce(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0)::double as f2x,
          -abs((tp + fp)::double / (tp + fp + fn + tn) - (tp + fn)::double / (tp + fp + fn + tn)) as bx from v),
    l as (select heldout, threshold, 'f1_optimized' as mode, f1x as goal from w union all select heldout, threshold, 'f2_optimized', f2x from w union all select heldout, threshold, 'budget_matched', bx from w),
    p as (select heldout, mode, threshold from (select *, row_number() over (partition by heldout, mode order by goal desc, threshold) as r from l) where r = 1),
    t as (select p.heldout, p.mode, p.threshold, tp, fp, fn, tn from p join d on d.dataset = p.heldout and d.threshold = p.threshold where d.split = 'test')
    select heldout, mode, threshold, {Q.scores()}, round((tp + tn)::double / (tp + fp + fn + tn), 9) as accuracy from t""")
def lodo_evaluation(spark, folder):
    """The whole leave-one-domain-out job, with a scorer that hands on the events' scores."""
    rows = T.scored_tokens(spark, folder).withColumn("id", F.lit("e"))
    got = J.evaluate_lodo(rows, _TASKS, lambda train: lambda part: part.select("id", "gold", "score"), "dataset")
    return got.select("heldout", "mode", "threshold", "tokens", *WM.rounded(*WM.SCORES, "accuracy"))
