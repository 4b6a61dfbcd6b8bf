"""Linear models read off one Gram matrix per group of rows.

Ridge, lasso and elastic net need of their training rows only the centred pair sums of features and label, so one pass over all
groups (folds, prefixes of a time line) serves every penalty and every subset of the features. The sums of a group are k x k
numbers, combined per task; the solvers then work on those alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    """Row count, means of features and label (last), and their centred pair sums."""

    n: int
    mean: np.ndarray
    pairs: np.ndarray

    def subset(self, at: Sequence[int]) -> Gram:
        keep = [*at, len(self.mean) - 1]
        return Gram(self.n, self.mean[keep], self.pairs[np.ix_(keep, keep)])

    @property
    def sd_y(self) -> float:
        return float(np.sqrt(self.pairs[-1, -1] / self.n))


def grams(rows: DataFrame, by: Sequence[str] = (), x: str = "z", y: str = "y_fit") -> dict[tuple, Gram]:
    """One ``Gram`` per value of ``by``; rows without a label or with a NULL or non-finite number take no part."""
    by = list(by)
    ok = F.col(y).isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = rows.filter(ok).select(*by, F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))
    head = rows.select(F.size("_x").alias("k")).first()
    if head is None:
        return {}
    columns = [*[F.avg(F.get("_x", F.lit(i))) for i in range(head.k)], F.avg("_y")]
    each = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.array(*columns).alias("_mean")).collect()  # one row per group
    count = {tuple(r[b] for b in by): (r["_n"], np.array(r["_mean"])) for r in each}

    def pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(by) if by else [((), b)]:
                a = np.column_stack([np.stack(part["_x"].to_numpy()), part["_y"]]) - count[key][1]
                total[key] = total.get(key, 0.0) + a.T @ a
        if total:
            yield pd.DataFrame([(*k, v.tobytes()) for k, v in total.items()], columns=[*by, "pairs"])

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        one = b.iloc[:1][[*by]].copy()
        one["pairs"] = [sum(np.frombuffer(p) for p in b["pairs"]).tobytes()]
        return one

    kinds = [f for f in rows.schema.fields if f.name in by]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "pairs binary"])
    parts = rows.mapInPandas(pair_sums, schema)
    got = parts.groupBy(*by).applyInPandas(merge, schema).collect()  # one k x k block per group
    k = head.k + 1
    return {key: Gram(count[key][0], count[key][1], np.frombuffer(r.pairs).reshape(k, k)) for r in got for key in [tuple(r[b] for b in by)]}


def ridge(g: Gram, alpha: float) -> np.ndarray:
    """argmin of |y - Xw|^2 + alpha |w|^2, the mean not penalised."""
    s = g.pairs[:-1, :-1]
    return np.linalg.solve(s + alpha * np.eye(len(s)), g.pairs[:-1, -1])


def coordinate_descent(g: Gram, l1: float, l2: float = 0.0, tol: float = 1e-12, rounds: int = 20_000) -> np.ndarray:
    """argmin of |y - Xw|^2 / 2n + l1 |w|_1 + l2 |w|^2 / 2."""
    s, left = g.pairs[:-1, :-1] / g.n, g.pairs[:-1, -1] / g.n  # left: what the weights so far leave of X'y
    left, w, size = left.copy(), np.zeros(len(left)), np.diag(s)
    scale = max(g.sd_y, 1e-300)
    for _ in range(rounds):
        moved = 0.0
        for j in np.nonzero(size > 1e-15)[0]:
            rho = left[j] + size[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (size[j] + l2)
            if new != w[j]:
                left -= s[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * np.sqrt(size[j]))
                w[j] = new
        if moved <= tol * scale:
            break
    return w


@dataclass
class Linear:
    """A fitted linear model; ``at`` are the features it has been given."""

    weight: np.ndarray
    intercept: float
    source: str = "z"

    def column(self, x: str | Column) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        out = F.lit(float(self.intercept))
        for i, w in enumerate(self.weight):
            if w:
                out = out + F.get(x, F.lit(i)) * float(w)
        return out

    def array(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.intercept


def solved(g: Gram, weight: np.ndarray, at: Sequence[int] | None = None, k: int | None = None, source: str = "z") -> Linear:
    """The model of a solution; with ``at`` its weights are put at those of ``k`` features, the others weigh 0."""
    intercept = float(g.mean[-1] - g.mean[:-1] @ weight)
    if at is not None:
        full = np.zeros(k)
        full[list(at)] = weight
        weight = full
    return Linear(weight, intercept, source)


def scores(rows: DataFrame, models: Mapping[tuple, object], keep: Sequence[str], by: Sequence[str] = ("fold",)) -> DataFrame:
    """``keep``, ``by``, which and pred for every (group, which) of ``models``: a group's rows are read once for all its models.

    A model has ``array(features)`` and says in ``source`` which array it reads. Groups without models give no rows.
    """
    by, keep = list(by), [c for c in keep if c not in by]
    sources = sorted({m.source for m in models.values()})
    of: dict[tuple, list] = {}
    for (group, label), m in models.items():
        of.setdefault(group, []).append((label, m))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(by) if by else [((), b)]:
                xs = {s: np.stack(part[s].to_numpy()) for s in sources}
                for label, m in of.get(key, ()):
                    yield part[[*keep, *by]].assign(which=label, pred=m.array(xs[m.source]))

    src = rows.select(*keep, *by, *sources)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name not in sources)
    return src.mapInPandas(run, f"{kinds}, which string, pred double")
