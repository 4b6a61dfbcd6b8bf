"""op6: best-fit packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from daybook.llm.packing import pack_documents
from daybook.llm.registry import query
from daybook.sources.tables import read_table


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), instead_of_ids={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
