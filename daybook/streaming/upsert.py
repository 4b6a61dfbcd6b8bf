"""Upsert of a stream with restatement and orphan logs, stored as base and delta versions per bucket.

Rows are laid out by a hash bucket of the scope, a part of the key. Every micro-batch adds a delta to the buckets it touches; a
bucket that has gathered ``fold`` deltas is folded into a new base. A manifest per batch says which base and deltas
make up each bucket, so a batch reads of the table only its own buckets, each a base and a few deltas, however many batches
came before. Readers resolve the last write per key from the newest manifest.

A replayed batch starts from the manifest before it and replaces what it wrote, so it may be run again at any point; a
manifest is written last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

from daybook.operators.ingest import find_orphans, find_restatements

FOLD = 8
_MANIFEST = "bucket int, base long, deltas array<long>"


def _with_layout(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add("version", LongType()).add("bucket", IntegerType())


def manifest(spark: SparkSession, target: str, before: int | None = None) -> dict[int, tuple[int | None, list[int]]]:
    """bucket -> (base version, delta versions) as of the newest batch, or the newest before one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    done = [int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest/{n}/_SUCCESS"))]
    done = [b for b in done if before is None or b < before]
    if not done:
        return {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{target}/manifest/batch={max(done)}").collect()  # a row per bucket
    return {r.bucket: (r.base, list(r.deltas)) for r in rows}


def paths(target: str, held: dict[int, tuple[int | None, list[int]]], buckets: Sequence[int]) -> list[str]:
    """Folders that hold the given buckets."""
    out = []
    for b in buckets:
        base, deltas = held.get(b, (None, []))
        out += [f"{target}/base/version={base}/bucket={b}"] if base is not None else []
        out += [f"{target}/delta/version={v}/bucket={b}" for v in deltas]
    return out


def _rows(spark: SparkSession, target: str, schema: StructType, held: dict, buckets: Sequence[int]) -> DataFrame:
    parts = []
    for kind in ("base", "delta"):
        some = [p for p in paths(target, held, buckets) if p.startswith(f"{target}/{kind}/")]
        if some:
            parts.append(spark.read.schema(_with_layout(schema)).option("basePath", f"{target}/{kind}").parquet(*some))
    if not parts:
        return spark.createDataFrame([], _with_layout(schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _last(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key and c != "version"]
    top = rows.groupBy(*key).agg(F.max(F.struct("version", *rest)).alias("_m"))
    return top.select(*key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def current(spark: SparkSession, target: str, schema: StructType, key: Sequence[str]) -> DataFrame:
    """The table as of the newest batch."""
    held = manifest(spark, target)
    return _last(_rows(spark, target, schema, held, sorted(held)), key).select(*schema.names)


def write_batch(batch: DataFrame, batch_id: int, target: str, log: str, key: Sequence[str], value: str, scope: str, order: Sequence[str], buckets: int, fold: int = FOLD) -> None:
    """Store one micro-batch and log what it restated and what it left untouched in its scopes."""
    spark, schema = batch.sparkSession, batch.schema
    held = manifest(spark, target, batch_id)  # a replay must not see itself
    rest = [c for c in batch.columns if c not in key]
    # the batch itself may repeat a key: its newest row by ``order`` wins
    one = batch.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_m"))
    one = one.select(*key, *[F.col(f"_m.{c}").alias(c) for c in rest]).select(*schema.names)
    rows = one.withColumn("bucket", F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int")).persist()
    try:
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most the number of buckets
        old = _last(_rows(spark, target, schema, held, touched), key)
        if held:
            find_restatements(rows, old, key, value).write.mode("overwrite").parquet(f"{log}/restatements/batch_id={batch_id}")
            scoped = old.join(rows.select(scope).distinct(), scope, "left_semi")
            find_orphans(rows, scoped, key).write.mode("overwrite").parquet(f"{log}/orphans/batch_id={batch_id}")
        if touched:
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/delta/version={batch_id}")
    finally:
        rows.unpersist()
    now = dict(held)
    for b in touched:
        base, deltas = held.get(b, (None, []))
        now[b] = (base, [*deltas, batch_id])
    full = [b for b in touched if len(now[b][1]) >= fold]
    if full:
        whole = _last(_rows(spark, target, schema, now, full), key)
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/base/version={batch_id}")
        now.update({b: (batch_id, []) for b in full})
    spark.createDataFrame([(b, *v) for b, v in sorted(now.items())], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/batch={batch_id}")


def stream_upsert(stream: DataFrame, target: str, log: str, checkpoint: str, key: Sequence[str], value: str, scope: str, order: Sequence[str], buckets: int = 64, fold: int = FOLD) -> StreamingQuery:
    """Run the upsert over everything available, one version of the touched buckets per micro-batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, target, log, key, value, scope, order, buckets, fold)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
