"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from varloom.llm.licenses import TEMPLATES, TOKEN

OP2 = r"""
with sized as (
  select doc_id, source, mark, n as size, 1.0::double / (1.0::double + sym::double / greatest(n, 1)::double) as weight
  from (select doc_id, source, md5(coalesce(text, '')) as mark,
          coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n,
          coalesce(len(regexp_extract_all(text, '[#*$%&|<>!]')), 0) as sym
        from documents)),
keyed as (
  select doc_id, source, size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || mark), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double) / weight as key
  from sized),
totals as (select source, sum(size)::bigint as source_size from keyed group by source),
w as (
  select *, list_extract([5.0, 2.0, 1.0], ((row_number() over (order by source nulls last) - 1) % 3 + 1)::int)::double as weight,
    source_size * 3.0::double as cap from totals),
r as (
  select *, sum(source_size) over ()::double as budget,
    row_number() over o as rank,
    sum(cap) over (o rows between unbounded preceding and current row) - cap as capped_before,
    sum(weight) over (o rows between current row and unbounded following) as weight_from
  from w window o as (order by cap / weight, source nulls last)),
lv as (select *, (budget - capped_before) / weight_from as level from r),
l as (select level from lv where level * weight <= cap order by rank limit 1),
t as (
  select source, source_size, round(least(cap, coalesce((select level from l) * weight, cap)), 6) as target from lv),
e as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3)::int else 0 end as epochs from t),
o as (
  select k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and current row)::double
      - k.size / 2.0::double as middle
  from keyed k join e on k.source is not distinct from e.source)
select doc_id, source, size, source_size, target,
  (size * (epochs + case when epochs < 3 and middle <= rest then 1 else 0 end))::bigint as taken
from o
"""

_ROWS = ", ".join("({}, '{}', '{}')".format(i, a, t.replace("'", "''")) for i, (a, t) in enumerate(TEMPLATES))
OP5 = f"""
with t(template, license, text) as (values {_ROWS}),
tw as (select template, license, regexp_extract_all(lower(text), '{TOKEN}') as w from t),
tb as (select template, license, len(w) - 1 as size, w[i] || ' ' || w[i + 1] as g, count(*) as times from (select *, unnest(range(1, len(w))) as i from tw) group by all),
d as (select row_number() over () as rid, doc_id, text from documents),
dw as (select rid, regexp_extract_all(lower(text), '{TOKEN}') as w from d where text is not null),
db as (select rid, i - 1 as at_, w[i] || ' ' || w[i + 1] as g from (select *, unnest(range(1, len(w))) as i from dw)),
hit as (select rid, template, license, size, g, times, at_, count(*) over (partition by rid, template) as hits from db join tb using (g)),
h as (
  select *, lead(at_, -times, -1) over (partition by rid, template, g order by at_) as back from hit where hits >= ceil(size * (0.8 / 1.2) - 1e-9)),
p as (
  select a.rid, a.template, a.license, a.size, a.at_ as first, b.at_ as last, (b.back < a.at_)::int as fresh
  from h a join h b on a.rid = b.rid and a.template = b.template and b.at_ between a.at_ and a.at_ + floor(a.size * (1.2 / 0.8) + 1e-9)::bigint - 1),
s as (
  select *, sum(fresh) over (partition by rid, template, first order by last rows between unbounded preceding and current row) * 2
    / (size + last - first + 1)::double as dice from p),
f as (
  select rid, template, license, size, arg_max({{'first': first, 'last': last, 'dice': dice}}, (dice, -first, -last)) as b
  from s where dice >= 0.8 and last - first + 1 >= ceil(size * (0.8 / 1.2) - 1e-9) group by all),
u as (select rid, template, license, size, b.first as first, b.last as last, b.dice as dice from f),
m as (
  select * from u where not exists (select 1 from u v where v.rid = u.rid and v.first <= u.last and u.first <= v.last
    and (v.dice, v.size, -v.template) > (u.dice, u.size, -u.template))),
r as (
  select rid, arg_max({{'l': license, 'a': first, 'z': last}}, (dice, size, -template)) as b, max(dice) as dice, count(*) as n_matches,
    array_to_string(list_sort(list(distinct license)), ',') as licenses from m group by rid)
select doc_id, r.b.l as license, round(coalesce(dice, 0.0), 6) as dice, r.b.a::bigint as first_word, (r.b.z - r.b.a + 2)::bigint as n_words,
  coalesce(n_matches, 0) as n_matches, coalesce(licenses, '') as licenses
from d left join r using (rid)
"""

OP10 = r"""
with base as (
  select doc_id, lang, source, coalesce(text, '') as text from documents),
tok as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, string_split(text, chr(10)) as l, row_number() over () as rid from base),
pos as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from tok where len(w) >= 3)),
rep as (select rid, i from (select *, count(*) over (partition by rid, g) as c from pos) where c > 1),
cov as (select rid, count(distinct i + d) as n from rep, range(0, 3) x(d) group by rid),
lines as (select rid, unnest(l) as line from tok),
dup as (select rid, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
m as (
  select t.doc_id, t.lang, t.source, len(w)::bigint as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from tok t left join cov using (rid) left join dup using (rid)),
r as (
  select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed,
    n_symbols * 10000 // greatest(n_words, 1) as symbol_rate, n_dup_lines * 10000 // greatest(n_words, 1) as dup_rate,
    n_repeat_words * 10000 // greatest(n_words, 1) as repeat_rate, word_chars * 100 // greatest(n_words, 1) as word_length from m),
x as (
  select lang, source, 'symbol_rate' as metric, symbol_rate as v from r where not base_failed
  union all select lang, source, 'dup_rate', dup_rate from r where not base_failed
  union all select lang, source, 'repeat_rate', repeat_rate from r where not base_failed
  union all select lang, source, 'word_length', word_length from r where not base_failed
  union all select lang, source, 'n_dup_lines', n_dup_lines from r where not base_failed
  union all select lang, source, 'n_repeat_words', n_repeat_words from r where not base_failed),
c as (
  select lang, source, metric, v - v % (1::bigint << greatest(length(bin(v)) - 7, 0)::bigint) as cell, count(*) as n from x group by all),
g as (select distinct lang, source, metric from c),
lc as (select lang, metric, cell, sum(n) as n from c group by all),
ac as (select metric, cell, sum(n) as n from c group by all),
u as (
  select lang, source, metric, cell, n as o, 0 as l, 0 as a from c
  union all select g.lang, g.source, g.metric, lc.cell, 0, lc.n, 0 from g join lc on g.lang is not distinct from lc.lang and g.metric = lc.metric
  union all select g.lang, g.source, g.metric, ac.cell, 0, 0, ac.n from g join ac using (metric)),
m1 as (select lang, source, metric, cell, sum(o)::bigint as o, sum(l)::bigint as l, sum(a)::bigint as a from u group by all),
up as (
  select lang, source, metric, cell, (sum(o) over p)::double as ou, (sum(l) over p)::double as lu, (sum(a) over p)::double as au,
    (sum(o) over w)::double as ot, (sum(l) over w)::double as lt, (sum(a) over w)::double as at_
  from m1 window w as (partition by lang, source, metric), p as (partition by lang, source, metric order by cell rows between unbounded preceding and current row)),
bl as (select *, ou + lu / lt * 50.0::double + au / at_ * 10.0::double as below, ot + 60.0::double as total from up),
q as (
  select lang, source, metric, min(cell) filter (below * 100.0::double >= total * 25.0::double - 1e-6::double) as q1,
    min(cell) filter (below * 100.0::double >= total * 75.0::double - 1e-6::double) as q3,
    min(cell) filter (below * 100.0::double >= total * 95.0::double - 1e-6::double) as q95,
    min(cell) filter (below * 100.0::double >= total * 99.0::double - 1e-6::double) as q99 from bl group by all),
lim as (
  select lang, source, max(greatest(q3 * 3, floor(sqrt(((q3 + 1) * (q99 + 1))::double))::bigint)) filter (metric = 'symbol_rate') as symbol_max,
    max(q99) filter (metric = 'n_dup_lines') as dups_max, max(q99) filter (metric = 'n_repeat_words') as repeats_max,
    max(q95 * 3) filter (metric = 'dup_rate') as dup_max, max(q95 * 3) filter (metric = 'repeat_rate') as repeat_max,
    max(q3 + 3 * (q3 - q1) + 100) filter (metric = 'word_length') as length_max,
    max(q1 - 3 * (q3 - q1) - 100) filter (metric = 'word_length') as length_min from q group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(symbol_rate <= symbol_max and (dup_rate <= dup_max or n_dup_lines <= dups_max)
    and (repeat_rate <= repeat_max or n_repeat_words <= repeats_max) and word_length <= length_max and word_length >= length_min, false) as kept
from r left join lim on lim.lang is not distinct from r.lang and lim.source is not distinct from r.source
"""

#: Digests of runs by the usual table of 256 entries (polynomial 0xEDB88320), byte by byte.
OP11 = r"""
with tab as (
  select list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(0::bigint, 256)) as i)),
runs as (
  select coalesce(doc_id::varchar, '') as doc, run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents)
  group by all),
coded as (
  select run, times, xor(list_reduce(
      list_concat([4294967295::bigint], flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195::bigint, (ord(c) - 64)::bigint] end))),
      lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) as h
  from runs, tab),
w as (
  select word, sum(times)::bigint as n
  from (select times, case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from coded)
  where length(word) >= 5 group by word having sum(times) >= 3),
gap as (select word, n, substr(word, 1, i::int) as a, substr(word, i::int + 2) as b from (select *, unnest(range(0, length(word))) as i from w)),
near as (
  select x.word, y.word as other, y.n as other_n from gap x join gap y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select g.word, w.word, w.n from gap g join w on w.word = g.a || g.b
  union select w.word, g.word, g.n from gap g join w on w.word = g.a || g.b),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
f as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
  from w left join best using (word)),
walk as (
  with recursive p(word, at_, far) as (
    select word, word, 0 from f union all select p.word, f.form, far + 1 from p join f on p.at_ = f.word where f.form is not null)
  select word, arg_max(at_, far) as root from p group by word)
select word, form, root, n, n_near, form_n from f join walk using (word)
"""


def _round(k: int) -> str:
    """Assignment to the centroids c<k> and the centroids c<k + 1> made of it."""
    return f"""
a{k} as (
  select r, arg_min(k, (d, k)) as k, min(d) as d
  from (select r, c.k, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c{k} c using (i) group by r, c.k) group by r),
c{k + 1} as (
  select c.k, c.i, coalesce(m.x, c.x) as x from c{k} c left join (
    select a.k, v.i, floor_div(sum(v.x)::bigint, count(*)) as x from v join a{k} a using (r) group by a.k, v.i) m on c.k = m.k and c.i = m.i),"""


#: floor_div is written out, as the engine's division of integers cuts towards zero.
OP12 = f"""
with e as (
  select vec_id, row_number() over () as r, embedding as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
w as (select r, vec_id, list_transform(x, lambda x: floor(64.0::double * x::double)::bigint) as x from e),
v as (select r, unnest(range(1, 65)) as i, unnest(x) as x from w),
s as (
  select row_number() over (order by g nulls last, x) - 1 as k, x
  from (select sha256('1:' || vec_id::varchar) as g, x from w order by g nulls last, x limit 16)),
c0 as (select k, unnest(range(1, 65)) as i, unnest(x) as x from s),
{_round(0)}{_round(1)}{_round(2)}
a3 as (
  select r, arg_min(k, (d, k)) as k, min(d) as d
  from (select r, c.k, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c3 c using (i) group by r, c.k) group by r),
m as (select k, sha256(string_agg(x::varchar, ',' order by i)) as mark from c3 group by k)
select vec_id, k::int as cluster, d as distance, sum(d) over (partition by k)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, mark as centroid_sha256
from a3 join w using (r) join m using (k)
""".replace("floor_div(sum(v.x)::bigint, count(*))", "((sum(v.x)::bigint - (((sum(v.x)::bigint % count(*)) + count(*)) % count(*))) // count(*))")

OP13 = """
with e as (
  select vec_id, label, row_number() over () as r, list_transform(embedding, lambda x: x::double) as x,
    coalesce(label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
      and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as usable
  from embeddings),
link as (
  select a.r as a, b.r as b from e a join e b on a.label = b.label and a.r <> b.r and len(a.x) = len(b.x)
  where a.usable and b.usable and list_cosine_similarity(a.x, b.x) >= 0.98),
reach as (
  with recursive p(r, at_) as (select r, r from e union select p.r, link.b from p join link on p.at_ = link.a)
  select p.r, min(e.vec_id) as component_id from p join e on p.at_ = e.r group by p.r),
n as (select a as r, count(*) as n from link group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from e join reach using (r) left join n using (r)
"""

ORACLES = {
    "op2_mix_sources": OP2,
    "op5_license_scan": OP5,
    "op10_adaptive_rules": OP10,
    "op11_permuterm_spelling": OP11,
    "op12_integer_centroids": OP12,
    "op13_spherical_dedup": OP13,
}
