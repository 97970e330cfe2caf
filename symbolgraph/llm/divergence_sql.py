"""The rows of op12_divergence in DuckDB's SQL: every kept term of every group, with zeros."""

from __future__ import annotations

from .divergence import LEAST_DOCUMENTS, SCALE, TOP_TERMS


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with docs as (
  select row_number() over () as doc, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source
  from documents),
words as materialized (
  select doc, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from docs),
kept as (select lang, term from words group by all having count(distinct doc) >= {LEAST_DOCUMENTS}),
groups as (select distinct lang, source from docs),
found as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
full_counts as (
  select g.lang, g.source, k.term, coalesce(f.n, 0) as n
  from groups g join kept k using (lang) left join found f using (lang, source, term)),
shares as materialized (
  select *, 1 + ({SCALE} * (n + 1)::hugeint) // (sum(n) over (partition by lang, source) + count(*) over (partition by lang, source)) as p
  from full_counts),
lang_shares as (
  select lang, term, 1 + ({SCALE} * (n + 1)::hugeint) // (sum(n) over (partition by lang) + count(*) over (partition by lang)) as q
  from (select lang, term, sum(n) as n from found group by all)),
pairs as (
  select g.lang, g.source, 'pair' as part, h.source as item,
    coalesce((select sum(((a.p - b.p) * (a.p - b.p)) // b.p) from shares a join shares b using (lang, term)
      where a.lang = g.lang and a.source = g.source and b.source = h.source), 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source),
terms as (
  select s.lang, s.source, 'term' as part, s.term as item, (((s.p - l.q) * (s.p - l.q)) // l.q)::bigint as value
  from shares s join lang_shares l using (lang, term) where s.n > 0 and s.p > l.q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
  from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
