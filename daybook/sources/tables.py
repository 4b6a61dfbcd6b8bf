"""Readers. Parquet keeps pushdown and column pruning; dates are cut at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    dates = {"lineitem": ["l_shipdate"], "orders": ["o_orderdate"]}.get(name, [])
    for c in dates:
        df = df.withColumn(c, F.to_date(c))
    return df
