"""op9: exact top-k search over binary codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.llm.hamming_topk import nearest, sign_code
from daybook.llm.registry import query
from daybook.sources.tables import read_table

SQL = """
with c as (
  select vec_id, list_sum(list_transform(range(len(embedding)), lambda i: case when embedding[i + 1] > 0 then (1::hugeint << i::int) else 0::hugeint end)) code
  from embeddings where vec_id is not null and len(embedding) between 1 and 64 and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), r as (
  select q.vec_id query_id, c.vec_id, bit_count(xor(q.code::hugeint, c.code::hugeint))::int distance,
    row_number() over (partition by q.vec_id order by bit_count(xor(q.code::hugeint, c.code::hugeint)), c.vec_id) r
  from c q join c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
)
select query_id, r::int rank, vec_id, distance from r where r <= 10
"""


@query("op9_exact_hamming_topk", SQL)
def op9(spark, sf_dir):
    codes = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    queries = codes.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    return nearest(codes, queries).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")
