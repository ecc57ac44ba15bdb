"""SQL (DuckDB) for the registered queries that SQL can express, on whole tables."""

from __future__ import annotations

import functools

from . import url_filter

EMBEDDING_DEDUP = """with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as n from v),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(id, other) as (select distinct a, a from links union select r.id, l.b from reach r join links l on r.other = l.a),
comp as (select id, min(other) as c from reach group by 1), deg as (select a as id, count(*) as n from links group by 1)
select vec_id, coalesce(deg.n, 0)::bigint as n_links, coalesce(c, vec_id)::bigint as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join deg on deg.id = vec_id left join comp on comp.id = vec_id"""

SUBSTRING_DEDUP = """with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, unnest(range(0, greatest(n - 49, 0))) as i, b from d),
m as (select doc_id, i, md5(b[i + 1 : i + 50]) as m from w),
f as (select m, min(doc_id) as f from m group by 1),
hit as (select m.doc_id, m.i, lag(m.i) over (partition by m.doc_id order by m.i) as p from m join f using (m) where f.f < m.doc_id),
run as (select *, sum(case when p is null or i > p + 50 then 1 else 0 end) over (partition by doc_id order by i) as r from hit),
span as (select doc_id, r, min(i) as s, max(i) + 50 as e from run group by 1, 2),
gap as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as a from span),
kept as (select g.doc_id, count(*) as n_spans, sum(e - s) as n_removed,
  string_agg(hex(d.b[a + 1 : s]), '' order by s) || hex(any_value(d.b)[max(e) + 1 : max(d.n)]) as h from gap g join d using (doc_id) group by 1)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
sha256(case when h is null then b else unhex(h) end) as kept_sha256 from d left join kept using (doc_id)"""

#: All pairs that share a shingle, cut by an upper bound of the similarity; the full sum only where counts differ from 1.
MINHASH_DEDUP = r"""with recursive t as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where doc_id is not null),
s as (select doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) as s from t where len(w) > 0),
x as (select doc_id, s, count(*)::double as c from s group by 1, 2),
n as (select doc_id, sum(c) as total, count(*) as n, max(c) as most from x group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common, sum(least(a.c / na.total, b.c / nb.total)) as bound, any_value(na.n) as n1, any_value(nb.n) as n2, max(na.most) as m1, max(nb.most) as m2
  from x a join x b on a.s = b.s and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id group by 1, 2 having bound >= 0.799999),
hard as (select a, b from p where m1 > 1 or m2 > 1),
u as (select a, b, s, sum(ca) as ca, sum(cb) as cb from (select a, b, s, c as ca, 0.0 as cb from hard join x on x.doc_id = a union all select a, b, s, 0.0, c from hard join x on x.doc_id = b) group by 1, 2, 3),
full_sum as (select d.a, d.b, d.s, sum(greatest(e.ca / d.ca, e.cb / d.cb)) as z from u d join u e on d.a = e.a and d.b = e.b where d.ca > 0 and d.cb > 0 group by 1, 2, 3),
links as (select a, b from p where m1 = 1 and m2 = 1 and common / (n1 + n2 - common) >= 0.8 union all select a, b from full_sum group by 1, 2 having sum(1 / z) >= 0.8),
both_ways as (select a, b from links union all select b, a from links),
reach(id, other) as (select distinct a, a from both_ways union select r.id, l.b from reach r join both_ways l on r.other = l.a),
comp as (select id, min(other) as c from reach group by 1)
select doc_id, coalesce(c, doc_id)::bigint as class_id, coalesce(c, doc_id) is not distinct from doc_id as kept from documents left join comp on comp.id = doc_id"""


@functools.lru_cache(maxsize=1)
def url_filter_sql() -> str:
    """Rules and model of the URL query; the fitted weights are a constant list."""
    m = url_filter.fitted()
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    name = "case " + " ".join(f"when {c} then '{n}'" for c, n, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in fits) + " end"
    letters = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
    return f"""with w as (select [{', '.join(repr(x) for x in m.weights)}]::double[] as w),
a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {letters}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, '^' || host || path || '$' as t from b), g as (select *, length(t) - {m.n - 1} as n from c),
s as (select g.*, case when n > 0 then list_reduce(list_prepend(0.0::double, list_transform(range(1, n + 1), lambda i: w.w[(('0x' || substr(md5(substr(t, i::int, {m.n})), 1, 8))::bigint % {len(m.weights)} + 1)::int])), lambda x, y: x + y) / sqrt(n::double) else 0.0 end + {m.bias!r}::double as z from g cross join w),
p as (select *, round(1.0 / (1.0 + exp(-z)), 6) as p_block, {name} as rule, {verdict} as ruled from s)
select page_id, host, path, rule, coalesce(ruled, case when p_block >= 0.5 then 'block' else 'allow' end) as verdict, p_block from p"""
