"""DuckDB SQL that states the results of the training-data queries independently of Spark."""

SUBSTRING = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from w, unnest(range(1, len(ws) - 18)) as t(i)),
ranked as (select doc_id, i, rank() over (partition by k order by doc_id, i) as r from win),
gone as (select distinct doc_id, j from ranked, unnest(range(i, i + 20)) as u(j) where r > 1),
kept as (
  select p.doc_id, string_agg(p.ws[p.j], ' ' order by p.j) as body, count(*) as n
  from (select doc_id, ws, j from w, unnest(range(1, len(ws) + 1)) as u(j)) p anti join gone g on g.doc_id = p.doc_id and g.j = p.j
  group by p.doc_id
)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""

NGRAM = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
),
grams as (
  select distinct doc_id, g from (
    select doc_id, array_to_string(ws[i:i + 3], ' ') as g from w, unnest(range(1, len(ws) - 2)) as t(i)
    union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 3
  )
),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_have from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * both_have >= 85 * (x.n + y.n - both_have)
),
ways as (select a, b from links union all select b, a from links),
reached(doc_id, root) as (select doc_id, doc_id from documents union select ways.b, root from reached join ways on ways.a = reached.doc_id)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from w left join sizes on sizes.doc_id = w.doc_id
join (select doc_id, min(root) as component_id from reached group by doc_id) c on c.doc_id = w.doc_id
"""

MIXING = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select source, source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight, 3.0::double * source_size as cap from sizes
),
levels as (
  select *, cap / weight as ratio, row_number() over w as place,
    (sum(source_size::double) over () - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (w rows between current row and unbounded following) as level
  from ranked window w as (order by cap / weight, source nulls last)
),
plan as (
  select source, source_size, least(cap, coalesce((select min_by(level, place) from levels where level <= ratio), (select max(ratio) from levels)) * weight) as target,
    ('0x' || substr(md5('17:' || coalesce('s' || source, 'n')), 1, 8))::bigint::double / 4294967296.0::double as start
  from levels
),
drawn as (
  select doc_id, size, source_size, target, start, case when source_size > 0 then target / source_size else 0 end as each_one,
    row_number() over (partition by sized.source order by size, doc_id nulls first) - 1 as place
  from sized join plan on sized.source is not distinct from plan.source
)
select doc_id, size, source_size, target, ((floor(start + (place + 1) * each_one) - floor(start + place * each_one)) * size)::bigint as taken from drawn
"""
