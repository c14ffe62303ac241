"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from maskwright.llm import editprint, exact, fim, html, merkle, mixing, packing, secrets, sharding, simhash, substrings, toxicity, warc
from maskwright.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return add


@query()
def op1_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read(spark, folder, "documents"))


@query("""
with records as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
named as (select *, min(page_id) over (partition by payload_digest) as original from records)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> original then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> original then original end as refers_to
from named
""")
def op2_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(read(spark, folder, "pages"))


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    return toxicity.score_documents(documents, toxicity.train(documents, read(spark, folder, "labels")))


@query()
def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(read(spark, folder, "pages"))


@query()
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("""
with sized as (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
           (cast(('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '-') || ':'
             || cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as varchar)), 1, 12)) as bigint) + 0.5::double)
             / 281474976710656.0::double as u
    from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
    select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w,
           3.0::double * source_size as most from sources),
levels as (
    select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
              / sum(w) over (order by most / w, source nulls last rows between current row and unbounded following) as level
    from weighted),
targets as (select source, source_size, least(most, w * max(level) over ()) as target from levels),
ratios as (select *, case when source_size > 0 then target / source_size else 0.0 end as ratio from targets),
plans as (
    select *, floor(ratio) as whole, case when ratio > floor(ratio) then target - floor(ratio) * source_size else 0.0 end as due from ratios),
classes as (
    select s.source, length(bin(s.size)) - 1 as k, sum(s.size) as words, sqrt((1::bigint << (length(bin(s.size)) - 1))::double) as weight
    from sized s where s.size > 0 group by all),
class_levels as (
    select c.*, p.due, (p.due - coalesce(sum(c.words) over (partition by c.source order by c.k desc rows between unbounded preceding and 1 preceding), 0))
              / sum(c.weight * c.words) over (partition by c.source order by c.k desc rows between current row and unbounded following) as level
    from classes c join plans p on c.source is not distinct from p.source),
chances as (select *, least(1.0, max(level) over (partition by source) * weight) as p from class_levels),
opened as (
    select source, k, case when p >= 1 then 0.0 else p end as p, case when p >= 1 then 1 else 0 end as certain,
           due - sum(case when p >= 1 then words else 0 end) over (partition by source) as due from chances),
drawn as (
    select d.doc_id, d.source, d.size, p.source_size, p.target, floor(p.ratio) + coalesce(o.certain, 0) as whole, coalesce(o.p, 0.0) as p, d.u,
           d.size > 0.005 * p.target as large, coalesce(o.p, 0.0) > 0 as open, coalesce(o.due, 0.0) as due
    from sized d join plans p on d.source is not distinct from p.source
    left join opened o on d.source is not distinct from o.source and d.size > 0 and length(bin(d.size)) - 1 = o.k),
ranked as (
    select *, case when open then u / (1 - u) / (p / (1 - p)) else 'inf'::double end as odds from drawn),
summed as (
    select *, coalesce(sum(size) over (partition by source, large, open order by odds, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before,
           sum(case when large then size * p else 0 end) over (partition by source) as large_due from ranked),
first_step as (
    select *, case when open and large and floor((large_due - before) / size + 0.5) >= 1 then 1 else 0 end as extra_large from summed),
second_step as (
    select *, due - sum(extra_large * size) over (partition by source) as small_due from first_step)
select doc_id, size, source_size, target,
       cast((whole + case when not open then 0 when large then extra_large when floor((small_due - before) / size + 0.5) >= 1 then 1 else 0 end) * size as bigint) as taken
from second_step
""")
def op6_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_table(read(spark, folder, "documents"))


@query()
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(read(spark, folder, "documents"))


@query()
def op8_edit_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return editprint.edited_fingerprints(read(spark, folder, "documents"))


@query()
def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query("""
with normal as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from normal
""")
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, folder, "documents"))


#: CRC-32 of the decimal doc_id, bit by bit over its digits.
CRC = """
(select xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ascii(d)::bigint for d in string_split(cast(doc_id as varchar), '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))
"""


def _field(value: str) -> str:
    return f"coalesce(cast(strlen({value}) as varchar) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    fields = ("cast(doc_id as varchar)", "source", "lang", f"cast({n_chars} as varchar)", "text")
    return "sha256(" + " || ".join(_field(f) for f in fields) + ")"


@query(f"""
with recursive base as (
    select doc_id, coalesce('=' || lang, '-') as grp, {_leaf('n_chars')} as leaf,
           {_leaf(f"(n_chars + case when {CRC.strip()}) % 7 = 0 then 1 else 0 end)")} as bent from documents),
leaves as (
    select *, row_number() over (partition by grp order by doc_id) - 1 as place, count(*) over (partition by grp) as size from base),
nodes as (
    select grp, 0 as lvl, place, size, leaf as node from leaves
    union all
    select grp, lvl + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' order by place)) from nodes where size > 1 group by grp, lvl, place // 2, size),
subroots as (
    select grp, node, row_number() over (order by grp) - 1 as place, count(*) over () as size from nodes where size = 1),
tops as (
    select 0 as lvl, place, size, node from subroots
    union all
    select lvl + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' order by place)) from tops where size > 1 group by lvl, place // 2, size),
walk as (
    select doc_id, grp, place, 0 as lvl, size, bent as node, '' as proof from leaves
    union all
    select w.doc_id, w.grp, w.place // 2, w.lvl + 1, (w.size + 1) // 2,
           case when n.node is null then sha256(w.node) when w.place % 2 = 1 then sha256(n.node || w.node) else sha256(w.node || n.node) end,
           w.proof || coalesce(n.node, '')
    from walk w left join nodes n on n.grp = w.grp and n.lvl = w.lvl and n.place = xor(w.place, 1) where w.size > 1),
climb as (
    select w.doc_id, s.place, 0 as lvl, s.size, w.node, w.proof, s.node as subroot from walk w join subroots s on s.grp = w.grp where w.size = 1
    union all
    select w.doc_id, w.place // 2, w.lvl + 1, (w.size + 1) // 2,
           case when n.node is null then sha256(w.node) when w.place % 2 = 1 then sha256(n.node || w.node) else sha256(w.node || n.node) end,
           w.proof || coalesce(n.node, ''), w.subroot
    from climb w left join tops n on n.lvl = w.lvl and n.place = xor(w.place, 1) where w.size > 1)
select c.doc_id, l.leaf, c.subroot, r.node as root, sha256(c.proof) as proof_sha256, c.node as folded_root, c.node = r.node as verified
from climb c join leaves l on l.doc_id = c.doc_id cross join (select node from tops where size = 1) r where c.size = 1
""")
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified_documents(read(spark, folder, "documents"))


@query("""
with cut as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units,
           sha256('7:' || coalesce(cast(doc_id as varchar), '-')) as h from documents),
drawn as (
    select *, len(units)::bigint as n, [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in range(4)] as d from cut),
placed as (
    select *, least(d[1] % (n + 1), d[2] % (n + 1)) as a, greatest(d[1] % (n + 1), d[2] % (n + 1)) as b,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 100 then 'plain'
                when d[4] % 100 < 50 then 'spm' else 'psm' end as form from drawn),
parts as (
    select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from placed)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
       sha256(text) as restored_sha256
from parts
""")
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.cut_documents(read(spark, folder, "documents"))


@query("""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
places as (
    select doc_id, unnest(range(1, len(words) - 18)) as start, unnest(list_transform(range(1, len(words) - 18), lambda i: array_to_string(words[i:i + 19], ' '))) as run
    from texts where len(words) >= 20),
windows as (select doc_id, start, row_number() over (partition by run order by doc_id, start) > 1 as later from places),
each_word as (
    select t.doc_id, t.pos, t.word,
           max(case when w.later then t.pos end) over (partition by t.doc_id order by t.pos rows between 19 preceding and current row) is not null as gone
    from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from texts) t
    left join windows w on w.doc_id = t.doc_id and w.start = t.pos),
kept as (
    select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by pos) filter (where not gone) as kept from each_word group by doc_id)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from texts t left join kept k on k.doc_id = t.doc_id
""")
def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated_documents(read(spark, folder, "documents"))
