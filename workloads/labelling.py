"""Label sources other than the plain pattern rules, and the refinements on top of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import dictionaries as D
from maskwright.operators import policies as PO
from maskwright.operators import rules as R
from maskwright.session import with_once
from maskwright.sources import tables as T
from workloads import sqlparts as Q
from workloads.registry import query

c = F.col
_QUOTE = lambda values: "', '".join(v.replace("'", "''") for v in values)
_SPANS = f"select *, cast(instr(text, surface) - 1 as bigint) as s, cast(instr(text, surface) - 1 + length(surface) as bigint) as e from ({Q.ENTITIES})"


def _policy_sql(policy: PO.Policy) -> str:
    lx = PO.lx
    admitted = f"type in ('{_QUOTE(policy.types)}', 'MEDICAL')"
    if policy.dates:
        admitted += rf" or (type = 'DATE' and regexp_matches(surface, '{lx.YEAR_PATTERN}') and not regexp_matches(surface, '{lx.DURATION_PATTERN}'))"
    kind = f"case when type in ('{_QUOTE(lx.PLACE_TYPES)}') then 'LOCATION' else type end" if policy.merge_places else "type"
    low = "lower(word)"
    keep = [f"{low} not in ('{_QUOTE(lx.STOP_WORDS)}')", rf"regexp_matches({low}, '[\p{{L}}\p{{N}}]')", rf"not regexp_matches({low}, '^\p{{L}}$')"]
    if policy.medical_words:
        keep.append(f"{low} not in ('{_QUOTE(lx.CLINICAL_STOP)}')")
    if policy.strict:
        keep.append(rf"regexp_matches({low}, '\p{{L}}')")
    return f"""
        with tok as ({Q.tokens(Q.NOTES)}), sp as (select id, span_order, s, e, {kind} as type from ({_SPANS}) where {admitted}),
        hit as (select t.id, t.pos, arg_min(sp.type, span_order) as type from tok t join sp on sp.id = t.id and t.s < sp.e and sp.s < t.e
                where {' and '.join(keep)} group by t.id, t.pos)
        select t.id, string_agg(coalesce(h.type, 'O'), ' ' order by t.pos) as types,
               coalesce(string_agg(case when h.type is not null then t.word end, '|' order by t.pos), '') as selected
        from tok t left join hit h on h.id = t.id and h.pos = t.pos group by t.id"""


def _policy_query(name: str):
    policy = PO.POLICIES[name]

    @query(_policy_sql(policy), name=f"policy_labels_{name.replace('-', '_')}")
    def run(spark, folder):
        rows = PO.label_entities(T.order_notes(spark, folder).select("id", "text"), T.note_entities(spark, folder), policy)
        return rows.select("id", F.array_join("types", " ").alias("types"), F.array_join("selected_words", "|").alias("selected"))


for _name in PO.POLICIES:
    _policy_query(_name)


# Concepts are the benchmark's words; a word of even length stands for a sensitive type.
@query(f"""
    with con as (select distinct lower(word) as term from ({Q.tokens('select item_id as id, text from benchmark')}) where length(word) % 2 = 0)
    select lang, count(*) as linked, count(distinct id) as documents from ({Q.tokens(Q.DOCS)}) t join ({Q.DOCS}) d using (id)
    where lower(word) in (select term from con) group by lang""")
def linked_concepts(spark, folder):
    terms = T.table(spark, folder, "benchmark").select(F.explode(X.words(c("text"))).alias("w"))
    concepts = terms.select(F.lower("w").alias("term"), F.array(F.when(F.length("w") % 2 == 0, "T047").otherwise("T999")).alias("types"))
    spans = T.documents(spark, folder).select("id", "lang", F.explode(X.words(c("text"))).alias("w")).select("id", "lang", F.lower("w").alias("term"))
    per_doc = PO.link_concepts(spans, concepts).groupBy("lang", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("lang").agg(F.sum("n").alias("linked"), F.count(F.lit(1)).alias("documents"))


_BENCH_TERMS = f"select distinct lower(word) as word from ({Q.tokens('select item_id as id, text from benchmark')})"
_RARE = f"""
    tok as ({Q.tokens(Q.DOCS)}), f as (select lower(word) as word, count(*) as n from tok group by 1),
    rare as (select t.word from ({_BENCH_TERMS}) t left join (select word, log10(n * 1e9 / sum(n) over ()) as zipf from f) z using (word) where coalesce(z.zipf, 0) < 5.2),
    lab as (select id, pos, word, cast(lower(word) in (select word from rare) as bigint) as label from tok)"""


def rare_labelled(spark, folder):
    docs = T.documents(spark, folder)
    words = T.table(spark, folder, "benchmark").select(F.explode(X.words(c("text"))).alias("w"))
    rare = D.rare_terms(words.select(F.lower("w").alias("word")), D.word_frequencies(docs), 5.2)
    return D.label_by_dictionary(docs, rare)


@query(f"with {_RARE} select id, count(*) as words, cast(sum(label) as bigint) as masked, cast(sum(label * (pos + 1)) as bigint) as position_check from lab group by id")
def rare_term_labels(spark, folder):
    rows = rare_labelled(spark, folder)
    return rows.filter(F.size("words") > 0).select(
        "id", F.size("words").cast("bigint").alias("words"), F.expr("aggregate(labels, 0L, (a, x) -> a + x)").alias("masked"),
        F.expr("aggregate(transform(labels, (x, i) -> cast(x * (i + 1) as bigint)), 0L, (a, x) -> a + x)").alias("position_check"))


@query(f"select lower(word) as word, count(*) as n, round(log10(count(*) * 1e9 / sum(count(*)) over ()), 9) as zipf from ({Q.tokens(Q.DOCS)}) group by 1")
def word_frequencies(spark, folder):
    return D.word_frequencies(T.documents(spark, folder)).withColumn("zipf", F.round("zipf", 9))


_LAB13 = f"tok as ({Q.tokens(Q.NOTES)}), lab as ({Q.labelled(Q.NOTES, tok='tok')})"


@query(f"""
    with {_LAB13} select id, string_agg(cast(sym as varchar), '' order by pos) as labels from (
        select id, pos, cast(max(label) over (partition by id, lower(word)) as int) as sym from lab) group by id""")
def symmetrised_labels(spark, folder):
    rows = R.annotate(T.order_notes(spark, folder).select("id", "text"))
    return rows.select("id", F.array_join(R.symmetrise("words", "labels").cast("array<string>"), "").alias("labels"))


@query(f"""
    with {_LAB13}, q as (select *, regexp_matches(word, '^\\p{{Nd}}+$') or rtrim(lower(word), '.') in ('{_QUOTE(PO.lx.DOSAGE_UNITS)}') as num from lab)
    select id, string_agg(cast(x as varchar), '' order by pos) as labels from (
        select id, pos, cast(label = 1 or (num and (
            coalesce(lag(label) over w, 0) = 1 or coalesce(lead(label) over w, 0) = 1
            or (coalesce(lag(label, 2) over w, 0) = 1 and coalesce(lag(num) over w, false))
            or (coalesce(lead(label, 2) over w, 0) = 1 and coalesce(lead(num) over w, false)))) as int) as x
        from q window w as (partition by id order by pos)) group by id""")
def quantity_expansion(spark, folder):
    rows = R.annotate(T.order_notes(spark, folder).select("id", "text"))
    return rows.select("id", F.array_join(R.expand_quantities("words", "labels").cast("array<string>"), "").alias("labels"))


@query(f"""
    with {_LAB13} select id, string_agg(cast(case when length(word) = 1 or regexp_matches(word, '^\\p{{Ll}}+\\p{{Nd}}+$')
        or regexp_matches(word, '(?i)^\\p{{L}}+(?:n[''’]t|[''’](?:m|re|ve|ll|d))$') then 0 else label end as varchar), '' order by pos) as labels
    from lab group by id""")
def excluded_words(spark, folder):
    rows = R.annotate(T.order_notes(spark, folder).select("id", "text"))
    return rows.select("id", F.array_join(R.drop_excluded(c("words"), c("labels")).cast("array<string>"), "").alias("labels"))


_DEMOJI = "select id, replace(text, '’', chr(146)) as text from ({}) ".format(Q.NOTES)


@query(f"""
    with raw as ({_DEMOJI}), norm as (select id, replace(text, chr(146), '''') as text from raw),
    a as (select count(*) as n, count_if(rule = 'c1_control') as c1 from ({Q.spans('select * from raw')})),
    b as (select count(*) as n, count_if(rule = 'possessive') as p from ({Q.spans('select * from norm')}))
    select a.n as raw_hits, a.c1 as control_hits, b.n as clean_hits, b.p as possessive_hits from a, b""")
def c1_normalisation(spark, folder):
    notes = T.order_notes(spark, folder).select("id", F.replace(c("text"), F.lit("’"), F.lit("\x92")).alias("raw"))
    both = notes.withColumn("clean", R.normalise_c1(c("raw")))
    raw, clean = R.rule_counts("raw"), R.rule_counts("clean")
    sums = both.select(sum(raw.values(), F.lit(0)).alias("r"), raw["c1_control"].alias("k"), sum(clean.values(), F.lit(0)).alias("n"), clean["possessive"].alias("p"))
    return sums.agg(F.sum("r").alias("raw_hits"), F.sum("k").alias("control_hits"), F.sum("n").alias("clean_hits"), F.sum("p").alias("possessive_hits"))


def _union_sql(changed: str) -> str:
    return f"""
    with tok as ({Q.tokens(Q.NOTES)}), other as (select id, {changed} as text from ({Q.NOTES})),
    sp as (select id, s, e from ({Q.spans(Q.NOTES)}) union all select id, s, e from ({Q.spans('select * from other')}))
    select t.id, string_agg(cast(cast(x.pos is not null as int) as varchar), '' order by t.pos) as labels
    from tok t left join (select distinct t.id, t.pos from tok t join sp on sp.id = t.id and t.s < sp.e and sp.s < t.e) x
    on x.id = t.id and x.pos = t.pos group by t.id"""


@query(_union_sql(rf"regexp_replace(text, '[''’]s\b', '  ', 'g')"))
def possessive_second_pass(spark, folder):
    notes = T.order_notes(spark, folder)
    return notes.select("id", F.array_join(R.possessive_pass("text").cast("array<string>"), "").alias("labels"))


# between word characters: done by hand, this engine has no look-around
@query(_union_sql(r"regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-([\p{L}\p{N}_])', '\1 \2', 'g'), '([\p{L}\p{N}_])-([\p{L}\p{N}_])', '\1 \2', 'g')"))
def hyphen_union(spark, folder):
    notes = T.order_notes(spark, folder)
    return notes.select("id", F.array_join(R.hyphen_union("text").cast("array<string>"), "").alias("labels"))


@query(f"""
    select id, regexp_replace(text, '( ) +', '\\1', 'g') as squeezed, regexp_replace(text, '([:;,.])([,\\d]+\\.)', '\\1 \\2', 'g') as split
    from (select id, replace(text, ': ', ':  ') as text from ({Q.NOTES}))""")
def space_and_run_on_cleanup(spark, folder):
    notes = T.order_notes(spark, folder).select("id", F.replace(c("text"), F.lit(": "), F.lit(":  ")).alias("text"))
    return notes.select("id", R.squeeze_spaces(c("text")).alias("squeezed"), R.split_run_on(c("text")).alias("split"))


@query(f"""
    with {_LAB13}, n as ({Q.NOTES}),
    p as (select id, pos, case when label = 1 then left(spaced, length(spaced) - length(word)) || '█' else spaced end as part from (
        select lab.*, substr(n.text, cast(coalesce(lag(lab.e) over (partition by lab.id order by lab.pos), 0) + 1 as int),
               cast(lab.e - coalesce(lag(lab.e) over (partition by lab.id order by lab.pos), 0) as int)) as spaced from lab join n using (id))),
    v as (select id, string_agg(part, '' order by pos) as text from p group by id)
    select v.id, v.text as visible, cast(coalesce(k.n, 0) as bigint) as leaks from v left join (select id, count(*) as n from ({Q.spans('select * from v')}) group by id) k using (id)""")
def leak_regression(spark, folder):
    rows = R.annotate(T.order_notes(spark, folder).select("id", "text"))
    return R.leak_hits(rows).select("id", "visible", c("leaks").cast("bigint").alias("leaks"))


# two layers: rule spans and entity spans
@query(f"""
    with n as ({Q.NOTES}), a as (select id, s, e from ({Q.spans(Q.NOTES)})), b as (select id, s, e from ({_SPANS})),
    ch as (select n.id, i from n, lateral (select unnest(range(length(n.text))) as i)),
    m as (select ch.id, ch.i, exists(select 1 from a where a.id = ch.id and a.s <= ch.i and ch.i < a.e) as x,
                 exists(select 1 from b where b.id = ch.id and b.s <= ch.i and ch.i < b.e) as y from ch)
    select count_if(x and y) as tp, count_if(y and not x) as fp, count_if(x and not y) as fn, count_if(x or y) as union_chars from m""")
def mask_layer_union(spark, folder):
    spans = PO.collect_spans(T.note_entities(spark, folder)).select("id", c("spans").alias("entities"))
    rows = T.order_notes(spark, folder).select("id", "text").join(spans, "id")
    merged = with_once(rows, l1=R.merge_spans(R.rule_spans_sql("text")), l2=R.merge_spans("entities"))
    counted = with_once(merged, z=R.char_confusion("l1", "l2"), u=F.expr(
        f"aggregate({R.merge_spans_sql('concat(l1, l2)')}, 0L, (a, s) -> a + s.end - s.start)"))
    return counted.agg(*[F.sum(f"z.{k}").alias(k) for k in ("tp", "fp", "fn")], F.sum("u").alias("union_chars"))


@query(f"""
    with tok as ({Q.tokens(Q.NOTES)}), piece as (select id, s + k as a, least(s + k + 3, e) as b, (s + k) % 5 = 0 as hit from tok, lateral (select unnest(range(0, e - s, 3)) as k))
    select t.id, string_agg(cast(cast(x.pos is not null as int) as varchar), '' order by t.pos) as labels
    from tok t left join (select distinct t.id, t.pos from tok t join piece p on p.id = t.id and p.hit and t.s < p.b and p.a < t.e) x
    on x.id = t.id and x.pos = t.pos group by t.id""")
def subtoken_labels(spark, folder):
    notes = with_once(T.order_notes(spark, folder).select("id", "text"), w=X.word_offsets("text"))
    pieces = F.expr("""flatten(transform(w, x -> transform(sequence(0, x.end - x.start - 1, 3), k -> named_struct(
        'start', x.start + k, 'end', least(x.start + k + 3, x.end), 'label', cast((x.start + k) % 5 = 0 as int)))))""")
    return notes.withColumn("pieces", pieces).select(
        "id", F.array_join(PO.subtoken_labels("text", "pieces").cast("array<string>"), "").alias("labels"))


@query(f"""
    with tok as ({Q.tokens(Q.NOTES)}), sp as ({Q.spans(Q.NOTES)}),
    hit as (select t.id, t.pos, arg_min(r.rule, r.k) as rule from tok t join (
        select *, case rule {' '.join(f"when '{n}' then {i}" for i, n in enumerate(Q.PATTERNS))} end as k from sp) r
        on r.id = t.id and t.s < r.e and r.s < t.e group by t.id, t.pos)
    select coalesce(rule, 'O') as type, count(*) as words from tok left join hit using (id, pos) group by 1""")
def rule_word_types(spark, folder):
    rows = R.annotate(T.order_notes(spark, folder).select("id", "text"), types=True)
    return rows.select(F.explode("types").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("words"))

