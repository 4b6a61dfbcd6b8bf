"""op1: license scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.llm.license_scan import STRIDE, TEMPLATES, THRESHOLD, document_labels, need
from daybook.llm.registry import query
from daybook.sources.tables import read_table

WIDTH = STRIDE + max(len(t.split()) for _, t, _ in TEMPLATES) - 1
VALUES = ", ".join(
    f"({i}, '{label}', '{kind}', '{t}', {need(t.split(), THRESHOLD)}, {len(set(t.split()))})" for i, (label, t, kind) in enumerate(TEMPLATES)
)

SQL = rf"""
with t(t, label, kind, phrase, need, n) as (values {VALUES}),
tw as (select distinct t, label, kind, need, n, unnest(string_split(phrase, ' ')) w from t),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from documents
), p as (
  select doc_id, len(words) n_words, unnest(words) w, unnest(range(len(words))) p from d
), b as (
  select doc_id, unnest(range(greatest(0, (p - {WIDTH} + {STRIDE}) // {STRIDE}), p // {STRIDE} + 1)) b, w from p where w in (select w from tw)
), m as (
  select doc_id, t, label, kind, count(distinct w) / n score from b join tw using (w) group by doc_id, b, t, label, kind, n, need having count(distinct w) >= need
), f as (
  select doc_id, label, p, list_aggregate(words[p + 1 : p + len(string_split(phrase, ' '))], 'string_agg', ' ') = phrase ok
  from p join d using (doc_id) join t on kind = 'phrase' and w = string_split(phrase, ' ')[1]
), r as (
  select doc_id, label, 'phrase' kind, p, 1.0::double score from f where ok
  union all select doc_id, label, kind, null, score from m where kind = 'notice'
), g as (
  select doc_id, count(p) n_base, min(p) first_word, max(p) last_word, string_agg(distinct label, ',' order by label) filter (kind = 'phrase') base_labels,
    string_agg(distinct label, ',' order by label) labels, max(score) score from r group by doc_id
)
select doc_id, len(words)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score
from d left join g using (doc_id)
"""


@query("op1_license_scan", SQL)
def op1(spark, sf_dir):
    got = document_labels(read_table(spark, sf_dir, "documents"))
    return got.select(F.col("_id").alias("doc_id"), *got.columns[1:])
