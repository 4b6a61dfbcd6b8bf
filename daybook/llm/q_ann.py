"""op10: approximate nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.llm.permutation_ann import nearest
from daybook.llm.registry import query
from daybook.sources.tables import read_table


@query("op10_permutation_ann")
def op10(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = vectors.filter("id % 100 = 0").withColumnRenamed("id", "query_id")
    return nearest(vectors, queries).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
