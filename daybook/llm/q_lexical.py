"""op13: ranked lexical search."""

from __future__ import annotations

from daybook.llm.ranked_lexical import search
from daybook.llm.registry import query
from daybook.sources.tables import read_table

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
with d as (select row_number() over () row, doc_id, {TERMS} t from documents),
dn as (select row, doc_id, len(t)::bigint n, t from d where len(t) > 0),
s as (select count(*)::bigint docs, sum(n)::bigint terms from dn),
w as (select row, unnest(t) term from dn),
tf as (select row, term, count(*)::bigint tf from w group by all),
it as (select distinct item_id, unnest({TERMS}) term from benchmark where item_id is not null),
df as (select term, count(*)::bigint df from tf group by 1),
wt as (select item_id, term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint w from it join df using (term), s),
sc as (
  select item_id, dn.row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint score
  from wt join tf using (term) join dn on dn.row = tf.row, s group by all
), r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) r from sc where score > 0)
select item_id, r::int rank, doc_id, score from r where r <= 50
"""


@query("op13_ranked_lexical_search", SQL)
def op13(spark, sf_dir):
    return search(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
