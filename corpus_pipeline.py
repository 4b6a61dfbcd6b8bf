"""Corpus pipeline: toxic documents go, one of each group of near-duplicates stays, sources are mixed to target weights,
and what is left is packed into sequences of tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as a table in the shared folder and gives
the next stage what it reads back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.mix_sources import mixed_documents
from daybook.llm.packing import pack_documents
from daybook.llm.shingle_dedup import one_of_each
from daybook.llm.toxicity import toxicity
from daybook.session import materialize

# Near-duplicates: sets of five-word shingles of a Jaccard similarity of 0.8 or more
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls toxic go, all others stay as they are.

    A NULL or empty text stays unless the labels are mostly toxic; rows that repeat are judged one by one; all columns are kept,
    whatever their names; an empty table gives an empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return toxicity(rows, labels).filter("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays; the defined cases are those of ``shingle_dedup``."""
    return one_of_each(docs, shingle=SHINGLE, similarity=SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source takes its target: rows are repeated, left out, or cut at the end; the defined cases are those of
    ``mix_sources``."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents by sequence; the defined cases are those of ``packing``."""
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), instead_of_ids={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("mix", mix), ("pack", pack)]

# a trained classifier decides what the first stage keeps
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
