"""op5: toxicity."""

from __future__ import annotations

from daybook.llm.registry import query
from daybook.llm.toxicity import toxicity
from daybook.sources.tables import read_table


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
