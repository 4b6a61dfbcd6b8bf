"""op11: substring dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.llm.registry import query
from daybook.llm.substring_dedup import drop_repeats
from daybook.sources.tables import read_table

SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 18)) p from d where len(w) >= 20),
k as (select doc_id, p, sha256(array_to_string(list_slice(w, p, p + 19), ' ')) key from s),
f as (select key, min({'null': doc_id is null, 'id': coalesce(doc_id, 0), 'p': p}) first from k group by key having count(*) > 1),
r as (select distinct k.doc_id, k.p from k join f using (key) where {'null': k.doc_id is null, 'id': coalesce(k.doc_id, 0), 'p': k.p} > f.first),
g as (select distinct doc_id, p + x p from r, (select unnest(range(20)) x)),
gone as (select doc_id, list(p) gone from g group by doc_id),
kept as (
  select d.doc_id, len(w) n_words, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(coalesce(gone, []), x[2])), lambda x: x[1]) kept
  from d left join gone on gone.doc_id is not distinct from d.doc_id
)
select doc_id, n_words::bigint n_words, (n_words - len(kept))::bigint n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from kept
"""


@query("op11_substring_dedup", SQL)
def op11(spark, sf_dir):
    found = drop_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
