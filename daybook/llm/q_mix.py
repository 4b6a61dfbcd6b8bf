"""op2: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.llm.mix_sources import mix
from daybook.llm.registry import query
from daybook.sources.tables import read_table

SQL = r"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, md5(coalesce(doc_id::varchar, '')) h from documents
), s as (
  select k, sum(size)::bigint source_size from d group by k
), w as (
  select *, [5, 2, 1][((row_number() over (order by k)) - 1) % 3 + 1] w, source_size * 3 cap from s
), r as (
  select *, cap / w ratio, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0))::double rest,
    (sum(w) over () - coalesce(sum(w) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0))::double rest_w from w
), f as (
  select rest f_rest, rest_w f_w from r where cap >= w * rest / rest_w order by ratio, k limit 1
), t as (
  select k, source_size, case when cap >= w * rest / rest_w then w * f_rest / f_w else cap::double end target from r, f
), q as (
  select *, least(floor(target + 0.5)::bigint, source_size * 3) quota from t
), p as (
  select d.*, coalesce(sum(size) over (partition by k order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint start from d
)
select doc_id, size, source_size, target,
  case when size = 0 then 0 else size * (quota // source_size) + greatest(0, least(start + size, quota % source_size) - start) end::bigint taken
from p join q using (k)
"""


@query("op2_mix_sources", SQL)
def op2(spark, sf_dir):
    _, rows = mix(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken")
