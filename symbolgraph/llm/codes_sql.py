"""The rows of op13_codes in DuckDB's SQL: plain Lloyd rounds over all entries."""

from __future__ import annotations

from .codes import ENTRIES, PARTS, ROUNDS, SCALE


def _assigned(k: int) -> str:
    """Each part's nearest entry of the codebooks book{k}, ties to the lower index."""
    return f"""
away{k} as (
  select x.r, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) as d
  from x join book{k} b on x.part = b.part and x.pos = b.pos group by all),
code{k} as (select r, part, arg_min(entry, d * 256 + entry) as entry, min(d) as d from away{k} group by all)"""


def _moved(k: int) -> str:
    return f"""
mean{k} as (
  select c.part, c.entry, x.pos, sum(x.v)::bigint as total, count(*)::bigint as n
  from code{k} c join x on x.r = c.r and x.part = c.part group by all),
book{k + 1} as materialized (
  select b.part, b.entry, b.pos,
    case when m.n is null then b.v else (m.total - ((m.total % m.n) + m.n) % m.n) // m.n end as v
  from book{k} b left join mean{k} m on b.part = m.part and b.entry = m.entry and b.pos = m.pos)"""


def oracle() -> str:
    rounds = ",".join(f"{_assigned(k)},{_moved(k)}" for k in range(ROUNDS))
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id, embedding) as r, * from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
x as materialized (
  select r, (i - 1) // width as part, (i - 1) % width as pos, floor({SCALE} * embedding[i]::double)::bigint as v
  from (select r, embedding, len(embedding) // {PARTS} as width, unnest(range(1, len(embedding) + 1)) as i from kept)),
book0 as materialized (select part, r - 1 as entry, pos, v from x where r <= {ENTRIES}),{rounds},{_assigned(ROUNDS)},
coded as (
  select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error
  from code{ROUNDS} group by r)
select k.vec_id, c.code, c.error, (sum(c.error) over (partition by k.label))::bigint as label_error,
  (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) from book{ROUNDS}) as codebooks_sha256
from coded c join kept k using (r)
"""
