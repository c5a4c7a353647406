"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .bpe import op8_bpe
from .chat import op6_chat
from .decontamination import op11_decontamination
from .divergence import op13_divergence
from .filter_audit import op12_filter_audit
from .imatch import op4_imatch
from .line_dedup import op2_line_dedup
from .packing import op5_packing
from .quality_classifier import op3_quality_classifier
from .quality_rules import op7_quality_rules
from .simhash import op10_simhash
from .toxicity import op1_toxicity
from .warc import op9_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_imatch": op4_imatch,
    "op5_packing": op5_packing,
    "op6_chat": op6_chat,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_decontamination": op11_decontamination,
    "op12_filter_audit": op12_filter_audit,
    "op13_divergence": op13_divergence,
}

_OP6 = """
with rows as (select conv_id, turn, role, coalesce(text, '') as x from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (select *, length(role) + 10 + length(replace(replace(x, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) as n from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || x || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(x) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then x else '' end, '' order by turn)) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from sized group by conv_id
"""

_OP7 = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, unnest(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as x, generate_subscripts(list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) as i from d),
g as (select doc_id, i, x, case when lead(x, 2) over (partition by doc_id order by i) is not null then x || ' ' || lead(x) over (partition by doc_id order by i) || ' ' || lead(x, 2) over (partition by doc_id order by i) end as s from w),
c as (select doc_id, i, x, case when s is not null and count(*) over (partition by doc_id, s) > 1 then 1 else 0 end as f from g),
m as (select doc_id, i, x, max(f) over (partition by doc_id order by i rows between 2 preceding and current row) as f from c),
words as (select doc_id, count(*) as n_words, sum(length(x)) as word_chars, sum(f) as n_repeat_words from m group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) as x from d),
lines as (select doc_id, count(*) - count(distinct x) as n_dup_lines from l where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
b as (select d.doc_id, d.source, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from d left join words using (doc_id) left join lines using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
h as (select source, count(*) as n, sum(case when base_failed then 1 else 0 end) as k from f group by source),
tot as (select least(greatest(sum(k) / sum(n), 1e-4), 1 - 1e-4) as p, var_pop(k / n) as spread, avg(1.0 / n) as inverse from h),
pri as (select p, greatest(p * (1 - p) / greatest(spread - p * (1 - p) * inverse, p * (1 - p) * 1e-4) - 1, 1.0) as weight from tot),
v as (select source, (k + p * weight) / (n + weight) <= 0.6 as good from h, pri)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and good as kept
from f join v on f.source is not distinct from v.source
"""

_DIGIT = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((b{k // 8} >> {35 - 5 * (k % 8)}) & 31) as int), 1)" for k in range(32))
_OP9 = f"""
with p as (select page_id, coalesce(html, '') as x, sha1(coalesce(html, '')) as h from pages),
b as (select *, {', '.join(f"cast('0x' || substr(h, {1 + 10 * i}, 10) as bigint) as b{i}" for i in range(4))}, max(page_id) over (partition by x) as latest from p)
select page_id, cast(strlen(x) as bigint) as payload_bytes, {_DIGIT} as payload_digest,
  case when page_id = latest then 'response' else 'revisit' end as record_type, case when page_id <> latest then latest end as refers_to from b
"""

_OP11 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select item, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i, w from b where len(w) > 0),
win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as x from iw),
sizes as (select distinct n from win),
dw as (select r, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n),
dg as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as x from dw),
h as (select r, n, i, item from dg join win using (n, x)),
hw as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, n, i from h)) group by r),
hi as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (r) left join hi using (r)
"""

_OP12 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as least from d),
m as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask from w),
l as (select doc_id as id, max(quality) as q, max(toxic) as x from labels group by doc_id),
c as (select part, mask, coalesce(q = 1, false)::int as good, coalesce(x = 1, false)::int as toxic, count(*) as n from m left join l on doc_id = id group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, unnest([1, 2, 3, 4, 5]) as step, bits from o),
p as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as applied from s),
r as (select part, filter_order, step, bit,
  sum(case when mask & (applied | bit) = 0 then n else 0 end)::bigint as kept, sum(case when mask & bit > 0 and mask & applied = 0 then n else 0 end)::bigint as removed,
  sum(case when mask & bit > 0 and mask & applied > 0 then n else 0 end)::bigint as redundant, sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
  sum(case when mask & bit > 0 and mask & applied = 0 then n * good else 0 end)::bigint as good_lost, sum(case when mask & bit > 0 and mask & applied = 0 then n * toxic else 0 end)::bigint as toxic_lost
  from c, p group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r
"""

_OP13 = r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select lang, source, r, unnest(w) as term from d),
k as (select lang, term from t group by lang, term having count(distinct r) >= 30),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from k group by lang),
tot as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by all),
whole as (select lang, term, sum(n) as n from c group by all),
wt as (select lang, sum(n) as total from whole group by lang),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (tot.total + 5 * v.v) as p
  from g join k using (lang) join v using (lang) join tot using (lang, source) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as q from whole join wt using (lang) join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(x.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select l.lang, l.source, m.source as other, sum(abs(l.p - m.p)) as value from p l join p m on l.lang = m.lang and l.term = m.term and l.source <> m.source group by all) x
  on x.lang = a.lang and x.source = a.source and x.other = b.source),
terms as (select p.lang, p.source, p.term as item, (p.p - q.q)::bigint as value from p join q using (lang, term) where n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms) where rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op6_chat": _OP6, "op7_quality_rules": _OP7, "op9_warc": _OP9, "op11_decontamination": _OP11, "op12_filter_audit": _OP12, "op13_divergence": _OP13}
