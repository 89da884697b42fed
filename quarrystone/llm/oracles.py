"""DuckDB SQL for the operators that look for copies; each is the definition itself, with no sketch, anchor or filter."""

from __future__ import annotations

WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"

OP6 = rf"""
with d as (select doc_id, {WORDS.format(x="coalesce(text, '')")} as words from documents),
w as (select doc_id, i, array_to_string(words[i : i + 12], ' ') as win from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from d)),
m as (select win, min(doc_id) as least from w group by win),
r as (select doc_id, i from w join m using (win) where doc_id > least),
g as (select distinct doc_id, i + k as i from r cross join (select unnest(range(0, 13)) as k)),
p as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from d),
k as (select p.doc_id, count(g.i) as n_removed, string_agg(word, ' ' order by p.i) filter (g.i is null) as kept from p left join g on p.doc_id = g.doc_id and p.i = g.i group by p.doc_id)
select d.doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""

OP2 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as win from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from d)),
m as (select win, min(doc_id) as least from w group by win having min(doc_id) < max(doc_id)),
r as (select doc_id, i from w join m using (win) where doc_id > least),
o as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from r),
s as (select doc_id, i, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as span from o),
x as (select doc_id, span, min(i) as a, max(i) + 50 as b from s group by all),
y as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from x),
z as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, cast(2 * before + 1 as bigint), cast(2 * (a - before) as bigint)), '' order by a) as head, max(b) as last from y join d using (doc_id) group by doc_id)
select d.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(case when last is null then h else head || substr(h, cast(2 * last + 1 as bigint)) end)) as kept_sha256 from d left join z using (doc_id)
"""

OP5 = rf"""
with recursive d as (select doc_id, {WORDS.format(x="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as words from documents),
s as (select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) = 1 then words else list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) end) as shingles from d),
n as (select doc_id, len(shingles) as n_shingles from s),
e as (select doc_id, unnest(shingles) as shingle from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
sym as (select a, b from l union all select b, a from l),
reach as (select doc_id, doc_id as root from n union select reach.doc_id, sym.b from reach join sym on sym.a = reach.root),
g as (select doc_id, min(root) as component_id from reach group by doc_id)
select n.doc_id, n_shingles, component_id, n.doc_id = component_id as kept from n join g using (doc_id)
"""
