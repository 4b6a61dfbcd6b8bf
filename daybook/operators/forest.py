"""Random forests by histograms, for tables whose binned features fit a task.

Features are cut at quantiles once per group of rows (a fold). A task holds the binned rows of the groups and grows some trees of one
group, some side by side: every level adds up counts and labels per (node, feature, bin) of the features drawn for the node. Trees that
differ only in their depth limit are one tree, read off at several depths, so a grid is grown once per group and remaining point.
Each tree sees a bootstrap sample. Splits are those of the variance; for labels 0/1 these are the Gini splits and a leaf's mean is its
chance. Rows are put in the order of a hash of their keys, so results don't depend on partitions or cores.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.blocks import apart, gathered, hashed
from daybook.operators.boosting import binned, quantile_edges
from daybook.session import materialize

BINS = 32
SUBSETS = 8192  # random feature subsets that nodes draw from
CHUNK = 50  # trees of a task
SIDE = 60_000  # sampled rows of the trees that grow side by side
CELLS = 120_000  # sums that are looked at together
SCORED = 200_000  # paths of rows through trees that are followed together


@dataclass
class Trees:
    """Nodes of some trees: the split's feature (-1: none) and last bin that goes left, the left child (the right one follows it) and the
    mean label. ``gain`` adds up to 1 per tree that splits."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    gain: np.ndarray

    def sums(self, codes: np.ndarray, depths: Sequence[int]) -> np.ndarray:
        """Per row and depth the sum of the values that the trees cut there give; a column per depth."""
        out = np.zeros((len(codes), len(depths)))
        flat, k = np.ascontiguousarray(codes).ravel(), codes.shape[1]
        some = max(1, SCORED // max(len(self.roots), 1))
        for first in range(0, len(codes), some):
            part = out[first : first + some]
            at = np.repeat(self.roots[None, :], len(part), 0)
            row = (np.arange(first, first + len(part)) * k)[:, None]
            level, ended = 0, False
            for j, depth in sorted(enumerate(depths), key=lambda x: x[1]):
                while level < depth and not ended:
                    f = self.feature[at]
                    inner = f >= 0
                    right = flat.take(row + np.maximum(f, 0).astype(np.int64)) > self.cut[at]
                    at = np.where(inner, self.left[at] + right, at)
                    level, ended = level + 1, not inner.any()
                part[:, j] = self.value[at].sum(1)
        return out


def joined(parts: Sequence[Trees]) -> Trees:
    first = np.cumsum([0, *[len(p.feature) for p in parts]])
    left, roots = ([(getattr(p, n) + at).astype(np.int32) for p, at in zip(parts, first)] for n in ("left", "roots"))
    whole = [np.concatenate([getattr(p, n) for p in parts]) for n in ("feature", "cut", "value")]
    return Trees(whole[0], whole[1], np.concatenate(left), whole[2], np.concatenate(roots), sum(p.gain for p in parts))


def subsets(k: int, drawn: int, seed: int) -> np.ndarray:
    return np.sort(np.random.default_rng([seed, k, drawn]).random((SUBSETS, k)).argsort(1)[:, :drawn], 1)


def best_splits(flat: np.ndarray, k: int, row: np.ndarray, w: np.ndarray, wy: np.ndarray, size: np.ndarray, total: np.ndarray, feats: np.ndarray, least: float):
    """Per node its best (feature, cut, gain); ``size`` rows of each follow one another, ``wy`` are labels less the node's mean."""
    m, drawn = feats.shape
    place = np.repeat(feats, size, 0)
    place += (row * k)[:, None]
    key = flat.take(place).astype(np.int64)
    key *= m * drawn  # sums of a bin lie together, so that running sums are over whole rows
    key += np.repeat(np.arange(m * drawn).reshape(m, drawn), size, 0)
    key = key.ravel()
    n, s = (np.bincount(key, np.repeat(v, drawn), m * drawn * BINS).reshape(BINS, m * drawn) for v in (w, wy))
    for x in (n, s):
        for i in range(1, BINS):
            x[i] += x[i - 1]
    n, s = n[:-1], s[:-1]
    right = np.repeat(total, drawn) - n
    ok = (n >= least) & (right >= least)
    s *= s
    right *= n
    with np.errstate(divide="ignore", invalid="ignore"):
        s /= right
    gain = np.where(ok, s, 0.0)
    each = gain.max(0).reshape(m, drawn)
    top = each.max(1)
    # sums of different order differ in their last digits, which must not choose between equal splits
    enough, node = top * (1 - 1e-9), np.arange(m)
    best = (each >= enough[:, None]).argmax(1)
    return feats[node, best], (gain[:, node * drawn + best] >= enough).argmax(0), top * total


def grow(codes: np.ndarray, y: np.ndarray, numbers: Sequence[int], drawn: int, least: float, depth: int, seed: int) -> Trees:
    """The trees of these numbers. What a tree draws depends on its number and level only."""
    (n, k), own = codes.shape, []
    flat, pool = np.ascontiguousarray(codes).ravel(), subsets(k, drawn, seed)
    side = max(1, SIDE // max(n, 1))
    for first in range(0, len(numbers), side):
        own.append(_grow(flat, k, y, numbers[first : first + side], pool, max(float(least), 1.0), depth, seed))
    return joined(own)


def _grow(flat: np.ndarray, k: int, y: np.ndarray, numbers: Sequence[int], pool: np.ndarray, least: float, depth: int, seed: int) -> Trees:
    drawn, label, many = pool.shape[1], y - y.mean(), len(numbers)
    bags = [np.random.default_rng([seed, t]).poisson(1.0, len(y)) for t in numbers]
    bags = [b if b.any() else np.ones(len(y), np.int64) for b in bags]
    picked = [np.flatnonzero(b) for b in bags]
    row, w = np.concatenate(picked), np.concatenate([b[p] for b, p in zip(bags, picked)]).astype(float)
    size, tree = np.array([len(p) for p in picked]), np.arange(many)
    gains, levels, level, done = np.zeros((many, k)), [], 0, 0
    while len(size):
        start = np.cumsum(size) - size
        wl = w * label[row]
        total, mean = np.add.reduceat(w, start), np.add.reduceat(wl, start)
        mean /= total
        m = len(size)
        feature, cut, left = np.full(m, -1, np.int16), np.zeros(m, np.uint8), np.full(m, -1, np.int32)
        levels.append((feature, cut, left, mean))
        done += m
        if level == depth:
            break
        draw = np.concatenate([np.random.default_rng([seed, t, level]).integers(len(pool), size=c) for t, c in zip(numbers, np.bincount(tree, minlength=many)) if c])
        node = np.flatnonzero(total >= 2 * least)
        stays = np.repeat(total >= 2 * least, size)
        row, w, wl, size, tree, total = row[stays], w[stays], wl[stays], size[node], tree[node], total[node]
        wl -= w * np.repeat(mean[node], size)
        ends = np.cumsum(size)
        gain = np.zeros(len(node))
        a = 0
        while a < len(node):  # some nodes together, so that their sums stay near
            before = ends[a] - size[a]
            cost = (ends[a:] - before) * drawn + np.arange(1, len(node) - a + 1) * drawn * BINS
            b = a + max(1, int(np.searchsorted(cost, CELLS, "right")))
            at = slice(before, ends[b - 1])
            feature[node[a:b]], cut[node[a:b]], gain[a:b] = best_splits(flat, k, row[at], w[at], wl[at], size[a:b], total[a:b], pool[draw[node[a:b]]], least)
            a = b
        # nor make one
        spread = np.add.reduceat(wl * wl / w, ends - size) if len(node) else gain
        splits = gain > 1e-12 * np.maximum(spread, 1e-300)
        feature[node[~splits]] = -1
        np.add.at(gains, (tree[splits], feature[node[splits]]), gain[splits])
        left[node[splits]] = done + 2 * np.arange(splits.sum())
        goes = np.repeat(splits, size)
        row, w, size, tree, node = row[goes], w[goes], size[splits], tree[splits], node[splits]
        # rows of a node: those of its left child, then those of its right one
        right = flat.take(row * k + np.repeat(feature[node].astype(np.int64), size)) > np.repeat(cut[node], size)
        start = np.cumsum(size) - size
        lefts = np.cumsum(~right)
        upto = np.concatenate(([0], lefts))[start]
        n_left = np.concatenate(([0], lefts))[start + size] - upto
        mine = lefts - np.repeat(upto, size)  # left rows of the node up to here
        spot = np.arange(len(row)) - np.repeat(start, size)
        to = np.repeat(start, size) + np.where(right, np.repeat(n_left, size) + spot - mine, mine - 1)
        moved, weight = np.empty_like(row), np.empty_like(w)
        moved[to], weight[to] = row, w
        row, w = moved, weight
        size, tree = np.stack([n_left, size - n_left], 1).ravel(), np.repeat(tree, 2)
        level += 1
    feature, cut, left, value = (np.concatenate([x[i] for x in levels]) for i in range(4))
    whole = gains.sum(1)
    gains[whole > 0] /= whole[whole > 0, None]
    return Trees(feature, cut, left, value + y.mean(), np.arange(many), gains.sum(0))


@dataclass
class Forest:
    """A grown forest, cut at ``depth``; it is written, read and applied to vectors as MLlib's are."""

    edges: np.ndarray
    grown: Trees
    depth: int
    source: str = "x"

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - as MLlib names it
        return len(self.grown.roots)

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.depth

    @property
    def trees(self) -> list[Trees]:
        t = self.grown
        return [Trees(t.feature, t.cut, t.left, t.value, t.roots[i : i + 1], t.gain) for i in range(len(t.roots))]

    def array(self, x: np.ndarray) -> np.ndarray:
        return self.grown.sums(binned(x, self.edges), [self.depth])[:, 0] / len(self.grown.roots)

    def transform(self, rows: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(self.array(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        return rows.withColumn("prediction", run(vector_to_array("_f")))

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> Forest:
        got = SparkSession.getActiveSession().read.schema(_STORED).parquet(path).collect()  # one row per array
        a = {r.part: np.frombuffer(r.data, r.kind).reshape(r["shape"]) for r in got}
        return cls(a["edges"], Trees(*[a[n] for n in _PARTS]), int(a["depth"]), str(a["source"]))


_PARTS = ("feature", "cut", "left", "value", "roots", "gain")
_STORED = "part string, kind string, shape array<long>, data binary"


@dataclass
class _Writer:
    model: Forest
    mode: str = "error"

    def overwrite(self) -> _Writer:
        return _Writer(self.model, "overwrite")

    def save(self, path: str) -> None:
        m = self.model
        arrays = {n: getattr(m.grown, n) for n in _PARTS} | {"edges": m.edges, "depth": np.array(m.depth), "source": np.array(m.source)}
        rows = [(n, v.dtype.str, list(v.shape), np.ascontiguousarray(v).tobytes()) for n, v in arrays.items()]
        SparkSession.getActiveSession().createDataFrame(rows, _STORED).write.mode(self.mode).parquet(path)


def _drawn(features: object, k: int) -> int:
    """As MLlib counts them."""
    return min(k, max(1, int(np.ceil(np.sqrt(k) if features == "sqrt" else float(features) * k))))


def _chunks(groups: Mapping[int, tuple], points: Sequence[Mapping], trees: int, shared: bool) -> list[tuple]:
    """(group, features drawn, least, {point: depth}, numbers of trees), the costly ones first. ``shared``: points that differ only in
    their depth are together."""
    same: dict[tuple, dict[int, int]] = {}
    for i, p in enumerate(points):
        same.setdefault((p.get("features", "sqrt"), p.get("min_leaf", 20), 0 if shared else i), {})[i] = p.get("max_depth", 5)
    todo = []
    for g, (codes, *_) in groups.items():
        for (features, least, _), depths in same.items():
            drawn = _drawn(features, codes.shape[1])
            cost = len(codes) * (drawn + 4) * min(max(depths.values()), np.log2(len(codes) / least + 2))
            todo += [(cost, (g, drawn, least, depths, range(a, min(a + CHUNK, trees)))) for a in range(0, trees, CHUNK)]
    return [t for _, t in sorted(todo, key=lambda c: -c[0])]


def _binned_rows(rows: DataFrame, by: str, x: str, y: str, keys: Sequence[str]) -> tuple[dict[int, np.ndarray], dict[int, tuple]]:
    """Edges, and binned features, label and hash of each group's rows."""
    rows = rows.filter(F.col(y).isNotNull())
    if rows.first() is None:
        return {}, {}
    edges = quantile_edges(rows, by, x, BINS)
    return edges, gathered(rows, by, x, y, hashed(keys, x), lambda g, v: binned(v, edges[g]))


def forests(rows: DataFrame, points: Sequence[Mapping], *, keys: Sequence[str], by: str, y: str, x: str = "x", trees: int = 400, seed: int = 42) -> dict[tuple[int, int], Forest]:
    """A forest for every (group of ``by``, number of the point). Points: max_depth, min_leaf, features (sqrt or a share)."""
    edges, groups = _binned_rows(rows, by, x, y, keys)
    todo = _chunks(groups, points, trees, shared=False)

    def run(one: tuple, held: dict) -> Trees:
        g, drawn, least, depths, numbers = one
        codes, label, _ = held[g]
        return grow(codes, label, numbers, drawn, least, max(depths.values()), seed)

    parts: dict = {}
    for (g, _, _, depths, numbers), made in zip(todo, apart(rows.sparkSession, todo, groups, run), strict=True):
        (i, depth), = depths.items()
        parts.setdefault((g, i, depth), []).append((numbers[0], made))
    return {(g, i): Forest(edges[g], joined([t for _, t in sorted(v, key=lambda c: c[0])]), depth, x) for (g, i, depth), v in parts.items()}


def scored(
    rows: DataFrame, points: Sequence[Mapping], test: DataFrame, keep: Sequence[str], *, keys: Sequence[str], by: str, y: str, x: str = "x", trees: int = 400, seed: int = 42
) -> DataFrame:
    """What the forests of ``forests`` predict for ``test`` rows of their groups: ``keep``, ``by``, _point, pred.

    The trees stay in the task that grew them: it scores the rows and gives sums, which are added up in the order of the trees.
    """
    spark = rows.sparkSession
    edges, groups = _binned_rows(rows, by, x, y, keys)
    named = materialize(test.filter(F.col(by).isin(list(groups))).select(*keep, by, x).withColumn("_id", F.monotonically_increasing_id()), "scored_rows")
    seen = gathered(named.withColumn("_one", F.lit(1.0)), by, x, "_one", F.col("_id"), lambda g, v: binned(v, edges[g]))
    todo = _chunks({g: v for g, v in groups.items() if g in seen}, points, trees, shared=True)
    held = spark.sparkContext.broadcast((todo, groups, {g: (codes, ids) for g, (codes, _, ids) in seen.items()}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        todo, groups, seen = held.value
        for at in (int(i) for b in batches for i in b["id"]):
            g, drawn, least, depths, numbers = todo[at]
            codes, label, _ = groups[g]
            got = grow(codes, label, numbers, drawn, least, max(depths.values()), seed).sums(seen[g][0], list(depths.values()))
            for j, i in enumerate(depths):
                yield pd.DataFrame({"g": [g], "point": [i], "first": [numbers[0]], "part": [got[:, j].tobytes()]})

    def total(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        added = sum(np.frombuffer(p) for p in parts.sort_values("first")["part"])
        return pd.DataFrame({"g": key[0], "_point": key[1], "_id": held.value[2][key[0]][1].astype(np.int64), "pred": added / trees})

    parts = materialize(spark.range(0, len(todo), 1, max(1, len(todo))).mapInPandas(run, "g int, point int, first int, part binary"), "forest_parts")
    whole = materialize(parts.groupBy("g", "point").applyInPandas(total, "g int, _point int, _id long, pred double"), "forest_scores")
    held.unpersist()
    return whole.join(named.drop(x), "_id").select(*keep, by, "_point", "pred")
