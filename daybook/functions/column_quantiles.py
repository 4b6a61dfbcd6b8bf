"""Exact order statistics of many columns by few groups, without a row for each value.

Two passes over wide rows. Tasks sort the numbers of some rows and send every so many-th, which gives a range around each wanted place that
must hold it; then they send how many numbers lie below a range and the distinct ones in it with their counts. Numbers are compared as
integers of the same order, in which NaN is last.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UNIT_ROWS = 1 << 16  # rows that a task sorts together
KEPT = 1000  # numbers of a column that it sends of them


def ordered(v: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    v = np.where(np.isnan(v), np.nan, v + 0.0)  # one NaN, one zero
    u = v.view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def numbers(u: np.ndarray) -> np.ndarray:
    return np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(np.float64)


def units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Some rows of a group: its key and the columns' numbers that there are. The first ``keys`` columns name the group."""
    held: list[pa.RecordBatch] = []

    def cut() -> Iterator[tuple[tuple, list[np.ndarray]]]:
        whole = pa.Table.from_batches(held)
        held.clear()
        names = pd.MultiIndex.from_arrays([c.to_pandas() for c in whole.columns[:keys]]) if keys else None
        code, groups = names.factorize() if keys else (np.zeros(len(whole), int), [()])
        cols = [(c.fill_null(0.0).to_numpy(), c.is_valid().to_numpy()) for c in whole.columns[keys:]]
        for g, key in enumerate(groups):
            at = np.flatnonzero(code == g)
            yield tuple(key), [v[at][here[at]] for v, here in cols]

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= UNIT_ROWS:
            yield from cut()
    if held:
        yield from cut()


def _wide(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])


def _shape(df: DataFrame, by: Sequence[str], rest: str) -> tuple[str, pa.Schema]:
    """The key's columns and others, for Spark and for Arrow."""
    ddl = ", ".join([*[f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by], rest])
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def column_order_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> dict[tuple, list[tuple[int, float, float]]]:
    """(key, number of the column) -> per wanted place the count of numbers and the two order statistics around it. Rows without a
    number take no part; columns without any are left out."""
    by, wide, m = list(by), _wide(df, by, cols), len(by)
    sent, near = (_shape(df, by, c) for c in ("i long, n long, at binary, v binary", "i long, j long, below long, v binary, n binary"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, columns in units(batches, m):
            rows = []
            for i, v in enumerate(columns):
                if len(v):
                    line = np.sort(ordered(v))
                    at = np.unique(np.append(np.arange(0, len(v), max(1, len(v) // KEPT)), len(v) - 1))
                    rows.append((*key, i, len(v), at.astype(np.int64).tobytes(), line[at].tobytes()))
            if rows:
                yield _batch(rows, sent[1])

    def ranged(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].sum())
        v, up, low = [], [], []
        for size, at, own in zip(part["n"], part["at"], part["v"]):
            at = np.frombuffer(at, np.int64)
            v.append(np.frombuffer(own, np.uint64))
            up.append(np.diff(at, append=size))  # numbers that may lie below the next one sent
            low.append(np.diff(at, prepend=-1))  # and those that do not lie above this one
        v, up, low = (np.concatenate(x) for x in (v, up, low))
        order = np.argsort(v, kind="stable")
        v, first = np.unique(v[order], return_index=True)
        at_most = np.add.reduceat(up[order], first).cumsum() - np.add.reduceat(up[order], first)
        at_least = np.add.reduceat(low[order], first).cumsum()
        out = []
        for j, p in enumerate(probs):
            place = p * (n - 1)
            lo = np.searchsorted(at_most, np.floor(place), "right") - 1
            hi = np.searchsorted(at_least, np.ceil(place) + 1, "left")
            out.append((j, n, v[lo : lo + 1].tobytes(), v[hi : hi + 1].tobytes()))
        one = part.iloc[:1][[*by, "i"]].merge(pd.DataFrame(out, columns=["j", "n", "lo", "hi"]), how="cross")
        return one

    ranges = wide.mapInArrow(sampled, sent[0]).groupBy(*by, "i").applyInPandas(ranged, _shape(df, by, "i long, j long, n long, lo binary, hi binary")[0]).collect()  # groups times columns
    within: dict[tuple, dict] = {}
    for r in ranges:
        within.setdefault((tuple(r[b] for b in by), r.i), {})[r.j] = (r.n, *(np.frombuffer(x, np.uint64)[0] for x in (r.lo, r.hi)))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, columns in units(batches, m):
            rows = []
            for i, v in enumerate(columns):
                u = ordered(v)
                for j, (_, lo, hi) in within.get((key, i), {}).items() if len(v) else ():
                    own, counts = np.unique(u[(u >= lo) & (u <= hi)], return_counts=True)
                    rows.append((*key, i, j, int((u < lo).sum()), own.tobytes(), counts.astype(np.int64).tobytes()))
            if rows:
                yield _batch(rows, near[1])

    def found(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[:1][[*by, "i", "j"]].copy()
        key, i, j = tuple(one[b].iloc[0] for b in by), int(one["i"].iloc[0]), int(one["j"].iloc[0])
        v, counts = (np.concatenate([np.frombuffer(x, t) for x in part[c]]) for c, t in (("v", np.uint64), ("n", np.int64)))
        order = np.argsort(v, kind="stable")
        upto = part["below"].sum() + counts[order].cumsum()
        place = probs[j] * (within[key, i][j][0] - 1)
        one["lo"], one["hi"] = (numbers(v[order][[np.searchsorted(upto, x, "right")]])[0] for x in (np.floor(place), np.ceil(place)))
        return one

    got = wide.mapInArrow(inside, near[0]).groupBy(*by, "i", "j").applyInPandas(found, _shape(df, by, "i long, j long, lo double, hi double")[0]).collect()
    out: dict[tuple, list] = {}
    for r in sorted(got, key=lambda r: r.j):
        key = (tuple(r[b] for b in by), r.i)
        out.setdefault(key, []).append((within[key][r.j][0], *(float("nan") if x is None else x for x in (r.lo, r.hi))))  # pandas has NaN as NULL
    return out


def clipped_sums(df: DataFrame, by: Sequence[str], cols: Sequence[str], lo: Mapping[tuple, Sequence[float]], hi: Mapping[tuple, Sequence[float]], center: Mapping[tuple, Sequence[float]]) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """Key -> count of rows, and per column the sum and the sum of squares of its numbers, clipped and less ``center``. Bounds are per key, one
    a column; keys without bounds take no part."""
    by, m = list(by), len(by)
    wide, (ddl, shape) = _wide(df, by, cols), _shape(df, by, "i long, s double, ss double")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for key, columns in units(batches, m):
            if key in lo:
                # as in Spark, NaN is above every bound
                d = [np.fmin(np.maximum(v, a), b) - c for v, a, b, c in zip(columns, lo[key], hi[key], center[key])]
                total[key] = total.get(key, 0.0) + np.array([[x.sum() for x in d], [x @ x for x in d]])
        rows = [(*key, i, s, ss) for key, (a, b) in total.items() for i, (s, ss) in enumerate(zip(a, b))]
        if rows:
            yield _batch(rows, shape)

    parts = wide.mapInArrow(summed, ddl).groupBy(*by, "i").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()
    sizes = {tuple(r[b] for b in by): r["_n"] for r in df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).collect()}
    out = {key: (sizes[key], np.zeros(len(cols)), np.zeros(len(cols))) for key in lo}
    for r in parts:
        key = tuple(r[b] for b in by)
        out[key][1][r.i], out[key][2][r.i] = r.s, r.ss
    return out
