"""DuckDB forms of the corpus queries that SQL can express on small tables."""

from __future__ import annotations

from shuttleplan.llm.hardneg import OP11_SQL
from shuttleplan.llm.merkle import OP13_SQL
from shuttleplan.llm.urlfilter import OP9_SQL

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {PLAIN}) as ws from documents),
word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j, len(ws) as n from d),
four as (select *, concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o) as f from word window o as (partition by doc_id order by j)),
twenty as (
  select doc_id, j as i, concat_ws(' ', f, lead(f, 4) over o, lead(f, 8) over o, lead(f, 12) over o, lead(f, 16) over o) as g
  from four window o as (partition by doc_id order by j) qualify j <= n - 19
),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from twenty) where k > 1), gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from again),
kept as (select doc_id, string_agg(word, ' ' order by j) as text from word anti join gone using (doc_id, j) group by doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""

OP2_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({FOLD}, {PLAIN}) as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) > 2)
  union all select doc_id, array_to_string(ws, ' ') from d where len(ws) between 1 and 2
), n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
near as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
links as (select a, b from near union all select b, a from near),
reach(a, b) as (select a, a from links union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a as doc_id, min(b) as c from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least.c, d.doc_id) as component_id from d left join n using (doc_id) left join least using (doc_id)
"""

OP10_SQL = f"""
with d as (select doc_id, regexp_extract_all({FOLD}, {ALNUM}) as ws from documents),
b as (select item_id, regexp_extract_all({FOLD}, {ALNUM}) as ws from benchmark),
item as (
  select distinct item_id, least(len(ws), 13) as m, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') as g
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)
), word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i, len(ws) as n from d),
w as (
  select doc_id, i, m, string_agg(word, ' ') over (partition by m, doc_id order by i rows between current row and m - 1 following) as g
  from word, (select distinct m from item) qualify i <= n - m + 1
), hit as (select doc_id, i, m, item_id from w join item using (m, g)),
n as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + m)) as j from hit) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as l from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(items.l, '')) as items_sha256,
       coalesce(n.n, 0) > 0 and 20 * coalesce(n.n, 0) >= len(ws) as contaminated
from d left join n using (doc_id) left join items using (doc_id)
"""

ORACLES = {"op1_substring_dedup": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op9_url_filter": OP9_SQL, "op10_decontaminate": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
