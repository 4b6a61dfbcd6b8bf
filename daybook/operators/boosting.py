"""Gradient-boosted trees by histograms, for many fits at once.

Features are cut at quantiles once per group of rows (a fold). Every level of a tree is one pass: tasks add up gradients and
weights per (fit, node, feature, bin), and the best splits are read off these sums, so the work of a pass does not grow with the
rows of a node and no row moves. Below the root only the lighter child of a node is added up; the other is what it leaves of the node. All fits (folds times grid points) grow their trees in the same passes. Each tree sees a
sample of the rows, drawn by a hash of the row's keys, and of the features; leaves are shrunk by an L2 penalty. ``boost_apart`` makes
the same fits a task each, for rows that fit one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators.blocks import added, apart, blocks, gathered, hashed

BINS = 64
ALONG = 5  # trees after which the blocks take the predictions so far along
REFRESH = 25  # trees after which these are computed anew from the written blocks
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Boosted:
    """Trees of one depth as heaps: per inner node a feature and the last bin that goes left, per leaf a value."""

    edges: np.ndarray
    base: float
    binary: bool = False
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    gain: np.ndarray | None = None
    source: str = "x"

    def trees(self, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature[first:]), np.array(self.cut[first:]), np.array(self.leaf[first:])

    def array(self, x: np.ndarray) -> np.ndarray:
        m = self.base + tree_sum(binned(x, self.edges), self.trees())
        return 1 / (1 + np.exp(-m)) if self.binary else m


def tree_sum(codes: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    out, row = np.zeros(len(codes)), np.arange(len(codes))[:, None]
    for first in range(0, len(trees[0]), 32):  # some trees side by side
        feature, cut, leaf = (x[first : first + 32] for x in trees)
        tree = np.arange(len(leaf))
        at = np.zeros((len(codes), len(leaf)), np.int64)
        for level in range(int(np.log2(leaf.shape[1]))):
            heap = at + (1 << level) - 1
            f = feature[tree, heap]
            at = 2 * at + ((f >= 0) & (codes[row, np.maximum(f, 0)] > cut[tree, heap]))
        out += leaf[tree, at].sum(1)
    return out


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each value: how many of the feature's edges are below it."""
    return np.column_stack([np.searchsorted(e, v) for e, v in zip(edges, x.T, strict=True)]).astype(np.uint8)


def node_of(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Number of each row's node among the 2^depth of that level; nodes that don't split send all rows left."""
    at, row = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for level in range(depth):
        heap = at + (1 << level) - 1
        f = feature[heap]
        at = 2 * at + ((f >= 0) & (codes[row, np.maximum(f, 0)] > cut[heap]))
    return at


def sampled(h: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    z = (h ^ np.uint64((seed * 1_000_003 + tree) & (2**63 - 1))) * _GOLD
    z = (z ^ (z >> np.uint64(32))) * _MIX
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def splits(hist: np.ndarray, allowed: np.ndarray, lam: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (feature, cut, gain) per node of ``hist`` (node, feature, bin, (gradient, weight)); feature -1: none gains."""
    g, h = np.cumsum(hist[..., 0], 2), np.cumsum(hist[..., 1], 2)
    tg, th = g[:, :, -1:], h[:, :, -1:]
    left, right = h[:, :, :-1], th - h[:, :, :-1]
    gain = g[:, :, :-1] ** 2 / np.maximum(left + lam, 1e-300) + (tg - g[:, :, :-1]) ** 2 / np.maximum(right + lam, 1e-300) - tg**2 / np.maximum(th + lam, 1e-300)
    ok = (left >= least) & (right >= least) & allowed[None, :, None]
    gain = np.where(ok, gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    top = flat.max(1)
    # sums of different order differ in their last digits, which must neither choose between equal splits nor make one
    best = (flat >= (top - 1e-9 * np.abs(top))[:, None]).argmax(1)
    some = top > 1e-9 * np.maximum(np.abs(tg[:, 0, 0]), 1.0)
    return np.where(some, best // gain.shape[2], -1), best % gain.shape[2], np.where(some, top, 0.0)


def quantile_edges(rows: DataFrame, by: str, x: str, bins: int) -> dict[int, np.ndarray]:
    """Per group, the ``bins`` - 1 cuts of every feature; k x bins numbers a group."""
    k = rows.select(F.size(x)).first()[0]
    probs = [i / bins for i in range(1, bins)]
    got = rows.groupBy(by).agg(F.array(*[F.percentile_approx(F.get(x, F.lit(i)), probs, 10_000) for i in range(k)]).alias("e")).collect()
    return {r[by]: np.array(r.e, float) for r in got}


def _start(mean: float, binary: bool) -> float:
    p = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p))) if binary else float(mean)


def _begun(rows: DataFrame, points: Sequence[Mapping], by: str, x: str, y: str, binary: bool, bins: int) -> dict[tuple[int, int], Boosted]:
    """Fits without trees: a group's edges and its mean."""
    mean = {r[by]: r.m for r in rows.groupBy(by).agg(F.avg(F.col(y).cast("double")).alias("m")).collect()}
    edges = quantile_edges(rows, by, x, bins) if mean else {}
    return {(g, i): Boosted(edges[g], _start(m, binary), binary, gain=np.zeros(len(edges[g]))) for g, m in mean.items() for i in range(len(points))}


def _params(p: Mapping) -> tuple[int, float, float]:
    return int(p.get("max_depth", 2)), float(p.get("learning_rate", 0.05)), float(p.get("reg_lambda", 1.0))


def _gradient(margin: np.ndarray, label: np.ndarray, binary: bool) -> tuple[np.ndarray, np.ndarray | None]:
    if not binary:
        return margin - label, None
    p = 1 / (1 + np.exp(-margin))
    return p - label, p * (1 - p)


def _leaves(sums: np.ndarray, rate: float, lam: float) -> np.ndarray:
    return np.where(sums[:, 1] > 0, -rate * sums[:, 0] / np.maximum(sums[:, 1] + lam, 1e-300), 0.0)


def _sides(hist: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """What goes left and right of each node; a node that doesn't split keeps all on the left."""
    node = np.arange(len(hist))
    run = np.cumsum(hist[node, np.maximum(feature, 0)], 1)
    whole = run[:, -1]
    left = np.where(feature[:, None] >= 0, run[node, cut], whole)
    return np.stack([left, whole - left], 1).reshape(-1, 2)


def boost(
    rows: DataFrame, points: Sequence[Mapping], *, keys: Sequence[str], by: str = "fold", x: str = "x", y: str = "y_fit", rounds: int = 300, row_share: float = 0.8,
    feature_share: float = 0.8, binary: bool = False, bins: int = BINS, seed: int = 42, least: float = 1.0,
) -> dict[tuple[int, int], Boosted]:
    """A model for every (group of ``by``, number of the point). Points: max_depth, learning_rate, reg_lambda.

    Squared error, or with ``binary`` the logistic loss of a 0/1 label. ``keys`` name a row; rows of equal keys are sampled alike.
    """
    rows = rows.filter(F.col(y).isNotNull())
    fits = _begun(rows, points, by, x, y, binary, bins)
    if not fits:
        return {}
    depth, rate, lam = ({i: _params(p)[j] for i, p in enumerate(points)} for j in range(3))
    edges = {g: m.edges for (g, _), m in fits.items()}
    k = len(next(iter(edges.values())))

    def one(group: int, values: np.ndarray) -> np.ndarray:
        return binned(values, edges[group])

    with blocks(rows, by, x, y, list(keys), one) as data:
        rng, held = np.random.default_rng(seed), data
        done = {f: m.base for f, m in fits.items()}
        state, cached = held.map(lambda b: (*b, {i: np.full(len(b[2]), done[b[0], i]) for i in depth})).persist(), []
        taken = 0
        for tree in range(rounds):
            picked = np.sort(rng.permutation(k)[: max(1, round(feature_share * k))])
            wide = len(picked) * bins
            most = max(depth.values())
            grown = {f: (np.full((1 << depth[f[1]]) - 1, -1), np.zeros((1 << depth[f[1]]) - 1, np.int64)) for f in fits}
            sums: dict = {}
            hist_of: dict = {}  # of the level above
            recent = {f: m.trees(taken) for f, m in fits.items()}  # since the blocks took the predictions along
            light: dict = {}  # per fit, the place of each node of the level among those that are added up; -1: not added up
            for level in range(most):
                open_points = [i for i in depth if depth[i] > level]

                def hists(group, codes, label, h, margin, level=level, points=open_points, tree=tree, grown=grown, light=light, recent=recent, picked=picked, wide=wide):
                    use, out = np.flatnonzero(sampled(h, tree, seed, row_share)), {}
                    if not len(use):
                        return out
                    c, own = codes[use], label[use]
                    place = c[:, picked] + np.arange(len(picked)) * bins  # a cell per feature and bin
                    for i in points:
                        cell = place
                        grad, weight = _gradient(margin[i][use] + tree_sum(c, recent[group, i]), own, binary)
                        nodes = 1
                        if level:
                            nodes = 1 << (level - 1)
                            at = light[group, i][node_of(c, *grown[group, i], level)]
                            mine = at >= 0
                            cell, grad, weight = place[mine] + (at[mine] * wide)[:, None], grad[mine], weight if weight is None else weight[mine]
                        cell = cell.ravel()
                        both = [np.bincount(cell, None if w is None else np.repeat(w, len(picked)), minlength=nodes * wide) for w in (grad, weight)]
                        out[group, i] = np.stack(both, 1).reshape(nodes, len(picked), bins, 2)
                    return out

                got = added(state, hists)
                for (g, i), hist in got.items():
                    if level:
                        above, which = hist_of[g, i], light[g, i]
                        hist = np.stack([hist, above - hist], 1).reshape(-1, *hist.shape[1:])
                        swap = np.arange(0, 1 << level, 2)[which[1::2] >= 0]  # the right child was added up
                        hist[np.concatenate((swap, swap + 1))] = hist[np.concatenate((swap + 1, swap))]
                    feature, cut, gain = splits(hist, np.ones(len(picked), bool), lam[i], least)
                    sums[g, i] = _sides(hist, feature, cut)
                    named = np.where(feature >= 0, picked[np.maximum(feature, 0)], -1)
                    heap = np.arange(1 << level) + (1 << level) - 1
                    grown[g, i][0][heap], grown[g, i][1][heap] = named, cut
                    np.add.at(fits[g, i].gain, named[named >= 0], gain[named >= 0])
                    hist_of[g, i] = hist
                    right = sums[g, i][1::2, 1] < sums[g, i][::2, 1]
                    light[g, i] = np.stack([np.where(right, -1, np.arange(1 << level)), np.where(right, np.arange(1 << level), -1)], 1).ravel()
            for (g, i), m in fits.items():
                s = sums.get((g, i), np.zeros((1 << depth[i], 2)))
                m.feature.append(grown[g, i][0])
                m.cut.append(grown[g, i][1])
                m.leaf.append(_leaves(s, rate[i], lam[i]))
            if (tree + 1) % ALONG and (tree + 1) % REFRESH:
                continue
            for old in cached:
                old.unpersist()
            cached = [state]
            if (tree + 1) % REFRESH:
                state = state.map(lambda b, recent={f: m.trees(taken) for f, m in fits.items()}: (*b[:4], {i: b[4][i] + tree_sum(b[1], recent[b[0], i]) for i in depth})).persist()
            else:  # from the written blocks and all trees so far, so that a lost one needs few other states
                upto = {f: (m.base, m.trees()) for f, m in fits.items()}
                state = held.map(lambda b, upto=upto: (*b, {i: upto[b[0], i][0] + tree_sum(b[1], upto[b[0], i][1]) for i in depth})).persist()
            taken = tree + 1
        for old in (*cached, state):
            old.unpersist()
    return fits


def boost_apart(
    rows: DataFrame, points: Sequence[Mapping], *, keys: Sequence[str], by: str = "fold", x: str = "x", y: str = "y_fit", rounds: int = 300, row_share: float = 0.8,
    feature_share: float = 0.8, binary: bool = False, bins: int = BINS, seed: int = 42, least: float = 1.0,
) -> dict[tuple[int, int], Boosted]:
    """The models of ``boost``, each grown whole by a task that holds the binned rows."""
    rows = rows.filter(F.col(y).isNotNull())
    fits = _begun(rows, points, by, x, y, binary, bins)
    if not fits:
        return {}
    edges = {g: m.edges for (g, _), m in fits.items()}
    groups = gathered(rows, by, x, y, hashed(keys, x), lambda g, v: binned(v, edges[g]))

    def run(one: tuple[int, int], held: dict) -> Boosted:
        m = fits[one]
        _grow_whole(m, *held[one[0]], *_params(points[one[1]]), rounds, row_share, feature_share, bins, seed, least)
        return m

    todo = sorted(fits, key=lambda f: -len(groups[f[0]][0]) * _params(points[f[1]])[0])
    return dict(zip(todo, apart(rows.sparkSession, todo, groups, run), strict=True))


def _grow_whole(
    m: Boosted, codes: np.ndarray, label: np.ndarray, h: np.ndarray, depth: int, rate: float, lam: float, rounds: int, row_share: float, feature_share: float, bins: int,
    seed: int, least: float,
) -> None:
    (n, k), rng = codes.shape, np.random.default_rng(seed)
    margin, wide = np.full(n, m.base), k * bins
    for tree in range(rounds):
        picked = np.sort(rng.permutation(k)[: max(1, round(feature_share * k))])
        use = np.flatnonzero(sampled(h, tree, seed, row_share))
        feature, cut = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)
        c, at = codes[use], np.zeros(len(use), np.int64)
        grad, weight = _gradient(margin[use], label[use], binary=m.binary)
        cells = c + np.arange(k) * bins  # a cell per feature and bin
        hist, light = None, np.zeros(1, np.int64)
        for level in range(depth):
            nodes, cell, g, w = max(1, (1 << level) // 2), cells, grad, weight
            if level:
                place = light[at]
                mine = np.flatnonzero(place >= 0)
                cell, g, w = cells[mine] + (place[mine] * wide)[:, None], grad[mine], weight if weight is None else weight[mine]
            flat = cell.ravel()
            both = [np.bincount(flat, None if v is None else np.repeat(v, k), minlength=nodes * wide) for v in (g, w)]
            above, hist = hist, np.stack([np.asarray(v, float).reshape(nodes, k, bins)[:, picked] for v in both], -1)
            if level:
                hist = np.stack([hist, above - hist], 1).reshape(-1, *hist.shape[1:])
                swap = np.arange(0, 1 << level, 2)[light[1::2] >= 0]  # the right child was added up
                hist[np.concatenate((swap, swap + 1))] = hist[np.concatenate((swap + 1, swap))]
            f, b, gain = splits(hist, np.ones(len(picked), bool), lam, least)
            sums = _sides(hist, f, b)
            named = np.where(f >= 0, picked[np.maximum(f, 0)], -1)
            heap = np.arange(1 << level) + (1 << level) - 1
            feature[heap], cut[heap] = named, b
            np.add.at(m.gain, named[named >= 0], gain[named >= 0])
            right = sums[1::2, 1] < sums[::2, 1]
            light = np.stack([np.where(right, -1, np.arange(1 << level)), np.where(right, np.arange(1 << level), -1)], 1).ravel()
            own = named[at]
            at = 2 * at + ((own >= 0) & (c[np.arange(len(c)), np.maximum(own, 0)] > b[at]))
        m.feature.append(feature)
        m.cut.append(cut)
        m.leaf.append(_leaves(sums, rate, lam))
        margin += m.leaf[-1][node_of(codes, feature, cut, depth)]
