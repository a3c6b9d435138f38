"""DuckDB SQL that recomputes the queries SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from keyloom.llm.quality_rules import BOILERPLATE, NAV_LINE

OP7 = r"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as w, source_size * 3 as cap from s),
r as (select *, sum(source_size) over () - coalesce(sum(cap) over b, 0) as rest, sum(w) over () - coalesce(sum(w) over b, 0) as w_left
      from w window b as (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select rest, w_left from r where cap * w_left > rest * w order by cap::double / w, source nulls last limit 1),
t as (select w.source, w.source_size,
             case when coalesce(w.cap * l.w_left > l.rest * w.w, false) then l.rest::double * w.w::double / l.w_left::double else w.cap::double end as target
      from w left join l on true),
x as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
             ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, 'null:' || md5(coalesce(d.text, '')))), 1, 13))::bigint::double / 4503599627370496.0::double as draw
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end)::bigint * size)::bigint as taken from x
"""

OP8 = r"""
with iw as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as w from benchmark),
ig as (select distinct item_id, array_to_string(w[i:i+4], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 3)) as i from iw)),
ic as (select item_id, count(*) as size from ig group by 1),
dw as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as w from documents),
dg as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from dw)),
m as (select doc_id, item_id, count(*) as n from dg join ig using (g) group by 1, 2),
k as (select doc_id, item_id from m join ic using (item_id) where n >= ceil(round(0.8 * size, 6)))
select doc_id, count(*) as n_items, min(item_id) as first_item from k group by doc_id
"""

OP4 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
p as (select r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, i, array_to_string(w[i:i+4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from p)),
f as (select r, i from g qualify count(*) over (partition by r, g) > 1),
c as (select r, sum(least(5, coalesce(nx - i, 5)))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as nx from f) group by r),
ln as (select r, length(x) as n,
              (marks > 0.10 * vis and vis >= 20) or (nw < 3 and not ended) or regexp_matches(lo, '{NAV_LINE}') or regexp_matches(lo, '{BOILERPLATE}') as bad
       from (select r, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) as vis, length(regexp_replace(x, '[\p{{L}}\p{{N}}\p{{M}}\x20\x09-\x0D]', '', 'g')) as marks,
                    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as nw, regexp_matches(x, '[.!?:;"''”’»)…。！？][\x20\x09-\x0D]*$') as ended,
                    regexp_replace(lower(x), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as lo
             from (select r, unnest(l) as x from p))),
lc as (select r, count(*) filter (where bad) as n_bad, sum(n)::bigint as chars, (coalesce(sum(n) filter (where bad), 0))::bigint as lost from ln group by r),
o as (select p.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
             len(l)::bigint as n_lines, coalesce(lc.n_bad, 0)::bigint as n_lines_removed, coalesce(chars, 0)::bigint as line_chars, coalesce(lost, 0)::bigint as lost_chars
      from p left join c using (r) left join lc using (r))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost_chars <= 0.5 * line_chars as kept from o
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4, "op7_mixing": OP7, "op8_decontamination": OP8}
