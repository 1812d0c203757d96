"""DuckDB SQL of the contracts that SQL can express, over whole tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
with recursive d as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) as g
  from d where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), b as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2
), link as (
  select b.a, b.b from b join n x on x.doc_id = b.a join n y on y.doc_id = b.b where 100 * b.k >= 80 * (x.n + y.n - b.k)
), e as (
  select a, b from link union all select b, a from link
), reach(a, b) as (
  select doc_id, doc_id from d
  union
  select r.a, e.b from reach r join e on e.a = r.b
), c as (
  select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, c.component_id = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP7_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) as w from documents
), q as (
  select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) as w from benchmark
), bw as (
  select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + 9], ' '))) as g
  from q where len(w) > 0
), z as (
  select distinct n from bw
), dw as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) as g
  from d join z on len(w) >= n
), h as (
  select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on bw.n = dw.n and bw.g = dw.g
), c as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from h) group by doc_id
), t as (
  select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on c.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""

OP9_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, unnest(range(1, len(w) - 48)) as i, unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i : i + 49], ' ')))) as g
  from d where len(w) >= 50
), m as (
  select g, min(doc_id) as first from s group by g
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as k from s join m on m.g = s.g where m.first < s.doc_id
), words as (
  select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as x from d
), kept as (
  select a.doc_id, string_agg(a.x, ' ' order by a.k) as text, count(*) as n
  from words a left join gone b on b.doc_id = a.doc_id and b.k = a.k where b.k is null group by a.doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""


def _kind(name: str, pattern: str, good: str) -> str:
    return f"""
{name}_m as (
  select doc_id, string_split_regex(t, '{pattern}') as p, regexp_extract_all(t, '{pattern}') as v from d
), {name}_u as (
  select doc_id, unnest(range(1, len(v) + 1)) as i, unnest(v) as v,
    unnest(list_transform(range(1, len(v) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))) as s
  from {name}_m where len(v) > 0
), {name} as (
  select doc_id, '{name}' as kind, cast(s as bigint) as s, cast(s + length(v) as bigint) as e from {name}_u where {good}
)"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when (length({_DIGITS}) - i) % 2 = 0 then cast(substr({_DIGITS}, i, 1) as integer)
 else 2 * cast(substr({_DIGITS}, i, 1) as integer) - (case when cast(substr({_DIGITS}, i, 1) as integer) > 4 then 9 else 0 end) end)) % 10 = 0"""
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x as bigint), 999))) <= 255"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 16 and 19 and {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 8 and 15"),
]
#: The fixed patterns only: over tables in which no context repeats often enough to be trusted, they are all spans.
OP3_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),{",".join(_kind(*k) for k in _KINDS)}, a as (
  {" union all ".join(f"select {k} as o, * from {n}" for k, (n, _, _) in enumerate(_KINDS))}
), j as (
  select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by o, s) as spans,
    {", ".join(f"count(*) filter (kind = '{n}') as {n}" for n, _, _ in _KINDS)} from a group by doc_id
)
select d.doc_id, {", ".join(f"cast(coalesce({n}, 0) as bigint) as n_{n}" for n, _, _ in _KINDS)}, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join j on j.doc_id = d.doc_id
"""
