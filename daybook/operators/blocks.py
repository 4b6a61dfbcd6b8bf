"""Rows as numeric blocks for fits that pass over them many times.

The rows are written once as binary blocks in the shared folder and read back as an RDD of arrays that stays in memory; each pass
is one job that returns the tasks' sums, added up in a tree. A lost executor re-reads its blocks from the written table.
Tables that fit a task are sent to all workers instead, and each fit is made whole by one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.session import materialize

BLOCK_ROWS = 20_000
SMALL = 64 << 20  # bytes of features, up to which there is one task a core, and fits that a task makes whole
TASK_ROWS = 2_000  # rows worth a task of their own
DEALT_ROWS = 1_000_000  # rows up to which a table is dealt out anew; files of larger ones are many enough
FEW_TASKS = 16  # whose sums are added on the driver at once


def _merge(a: dict, b: dict) -> dict:
    for k, v in b.items():
        if k in a:
            a[k] = a[k] + v
        else:
            a[k] = v
    return a


def added(rdd, each: Callable[..., dict[object, np.ndarray]]) -> dict:
    """Key-wise sums of what ``each(*block)`` gives, in one pass."""

    def task(rows: Iterator) -> Iterator[dict]:
        total: dict = {}
        for row in rows:
            _merge(total, each(*row))
        yield total

    sums = rdd.mapPartitions(task)
    if rdd.getNumPartitions() > FEW_TASKS:
        return sums.treeReduce(_merge)
    total: dict = {}
    for part in sums.collect():  # as many sums as there are tasks
        _merge(total, part)
    return total


def even_tasks(rows: DataFrame, n: int) -> int:
    """In how many even partitions the ``n`` rows of a fit should be, as their files may be few and uneven; 0: as they are."""
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS)
    return tasks if tasks > 1 and n <= DEALT_ROWS else 0


def fits_a_task(rows: DataFrame, x: str, y: str | None, width: int) -> bool:
    """Whether a task can hold the features of all rows with a label at ``width`` bytes a number."""
    got = (rows if y is None else rows.filter(F.col(y).isNotNull())).agg(F.count("*").alias("n"), F.max(F.size(x)).alias("k")).first()
    return got.n * (got.k or 0) * width <= SMALL


def packed(rows: DataFrame, by: str, x: str, y: str, h: Column, prepare: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """Written table of blocks of the rows with a label: a group's features as ``prepare(group, x)`` makes them, label and ``h``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for group, part in b.groupby("_g"):
                for at in range(0, len(part), BLOCK_ROWS):
                    p = part.iloc[at : at + BLOCK_ROWS]
                    made = prepare(int(group), np.stack(p["_x"].to_numpy()))
                    yield pd.DataFrame({
                        "g": [int(group)], "kind": [made.dtype.str], "n": [len(p)], "x": [np.ascontiguousarray(made).tobytes()],
                        "y": [p["_y"].to_numpy(float).tobytes()], "h": [p["_h"].to_numpy(np.int64).tobytes()],
                    })

    src = rows.filter(F.col(y).isNotNull()).select(F.col(by).alias("_g"), F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"), h.alias("_h"))
    tasks = even_tasks(src, src.count())
    if tasks:  # by ranges, so that a task has the sums of few groups
        src = src.repartitionByRange(tasks, "_g", "_h")
    return materialize(src.mapInPandas(pack, "g int, kind string, n int, x binary, y binary, h binary"), "numeric-blocks")


def _arrays(r) -> tuple:
    return r.g, np.frombuffer(r.x, r.kind).reshape(r.n, -1), np.frombuffer(r.y), np.frombuffer(r.h, np.uint64)


def hashed(keys: Sequence[str], x: str) -> Column:
    return F.xxhash64(*(keys or [x]))


def gathered(rows: DataFrame, by: str, x: str, y: str, h: Column, prepare: Callable[[int, np.ndarray], np.ndarray] = lambda g, x: x) -> dict[int, tuple]:
    """Features, labels and ``h`` of each group's rows in the order of ``h``, for rows that fit a task."""
    parts: dict[int, list] = {}
    for r in packed(rows, by, x, y, h, prepare).collect():  # up to SMALL bytes of features
        group, *own = _arrays(r)
        parts.setdefault(group, []).append(own)
    out = {}
    for group, own in sorted(parts.items()):
        a, label, number = (np.concatenate(v) for v in zip(*own, strict=True))
        order = np.lexsort((label, number))
        out[group] = (a[order], label[order], number[order])
    return out


def dealt(rows: DataFrame, by: str, x: str, y: str, keys: list[str]) -> list[list[tuple]]:
    """The blocks of each task of ``blocks``, for rows that fit one."""
    with blocks(rows, by, x, y, keys) as data:
        return data.glom().collect()  # up to SMALL bytes of features


def summed(parts: Sequence[Sequence[tuple]], each: Callable[..., np.ndarray]) -> np.ndarray:
    """``added`` of blocks that are at hand, in its order: a step that depends on the last digits is the same."""
    return sum(sum(each(*b) for b in part) for part in parts if part)


def apart(spark: SparkSession, todo: Sequence, held: object, run: Callable[[object, object], object]) -> list:
    """``run(one, held)`` for each of ``todo``, a task each; every worker gets ``held`` once. The costly ones come first."""
    if not todo:
        return []
    sc = spark.sparkContext
    given = sc.broadcast(held)
    try:
        return sc.parallelize(list(todo), len(todo)).map(lambda one: run(one, given.value)).collect()
    finally:
        given.unpersist()


@contextmanager
def blocks(rows: DataFrame, by: str, x: str, y: str, keys: list[str], prepare: Callable[[int, np.ndarray], np.ndarray] = lambda g, x: x):
    """RDD of blocks (group, x, y, h) of the rows with a label, by the int column ``by``: features as ``prepare(group, x)`` makes them,
    label, and a hash of the row's keys. Small tables are in few partitions, as a pass is then mostly its tasks' start."""
    table = packed(rows, by, x, y, F.xxhash64(*keys), prepare)
    size = table.agg(F.coalesce(F.sum(F.length("x")), F.lit(0))).first()[0]
    rdd = table.rdd.map(_arrays)
    if size < SMALL:
        rdd = rdd.coalesce(min(max(rdd.getNumPartitions(), 1), table.sparkSession.sparkContext.defaultParallelism))
    rdd.persist()
    try:
        yield rdd
    finally:
        rdd.unpersist()
