"""op4: SimHash near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.llm.registry import query
from daybook.llm.simhash import near_duplicates
from daybook.sources.tables import read_table


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    got = near_duplicates(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
