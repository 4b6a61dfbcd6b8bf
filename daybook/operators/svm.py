"""Support vector machines and logistic regression on a fixed feature map, for many fits at once.

Epsilon-insensitive regression, and hinge or logistic classification, with an L2 penalty on the weights (not the intercept):
|w|^2 / 2 + C * sum of losses. The kink of a hinge is rounded over a width that shrinks in steps, so that L-BFGS can
follow it, and each evaluation is one pass for all fits (folds times grid points). Weights are found on the driver, as many
numbers as there are features.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from daybook.operators.blocks import added, apart, blocks, dealt, summed

EPSILON = 0.1
WIDTHS = (0.5, 0.05, 0.005)  # of the rounded kink, in units of the loss
MEMORY = 10
HALVED = (1, 3, 7, 14)  # step lengths 1, 1/2, 1/4, ... that are tried in one pass


def fourier(k: int, size: int, gamma: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions and phases of random cosines whose inner products approximate exp(-gamma |a - b|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2 * gamma), (k, size)), rng.uniform(0.0, 2 * np.pi, size), float(np.sqrt(2.0 / size))


@dataclass
class Machine:
    """Weights on the mapped features; ``map`` None: on the features themselves. With ``chance`` it gives a probability."""

    weight: np.ndarray
    intercept: float
    map: tuple | None = None
    chance: bool = False
    source: str = "z"

    def array(self, x: np.ndarray) -> np.ndarray:
        f = mapped(x, self.map) @ self.weight + self.intercept
        return 1 / (1 + np.exp(-np.clip(f, -500, 500))) if self.chance else f


def mapped(x: np.ndarray, by: tuple | None) -> np.ndarray:
    return x if by is None else by[2] * np.cos(x @ by[0] + by[1])


def rounded(t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, t) with its kink rounded over [0, width], and the derivative."""
    inside, beyond = (t > 0) & (t < width), t >= width
    return np.where(beyond, t - width / 2, np.where(inside, t * t / (2 * width), 0.0)), np.where(beyond, 1.0, np.where(inside, t / width, 0.0))


def machines(
    rows: DataFrame, points: Sequence[Mapping], *, keys: Sequence[str], by: str = "fold", x: str = "z", y: str = "y_fit", size: int = 200, gamma: float | None = None,
    loss: str = "epsilon", epsilon: float = EPSILON, rounds: int = 60, seed: int = 42, together: bool = True,
) -> dict[tuple[int, int], Machine]:
    """A machine for every (group of ``by``, number of the point). Points: C. ``size`` 0: no feature map; ``loss`` is epsilon, or
    hinge or logistic for labels 0/1. ``gamma`` defaults to one over the number of features, which is the usual scale of standardised ones. ``together``: all fits
    share passes over the rows; otherwise each is solved by a task that holds all rows."""
    rows = rows.filter(f"{y} is not null")
    head = rows.select(x).first()
    if head is None:
        return {}
    k = len(head[0])
    by_map = fourier(k, size, 1.0 / k if gamma is None else gamma, seed) if size else None
    groups = [r[0] for r in rows.select(by).distinct().collect()]
    c = {i: float(p["C"]) for i, p in enumerate(points)}
    n = (size or k) + 1

    def solved(sums: Callable[[dict, float], dict], fits: Sequence[tuple[int, int]]) -> dict[tuple[int, int], Machine]:
        def value(weights: dict, width: float) -> dict:
            """Objective and gradient of every fit."""
            got, out = sums(weights, width), {}
            for f, w in weights.items():
                s = c[f[1]] * got.get(f, np.zeros(n + 1))
                plain = np.concatenate((w[:-1], [0.0]))
                out[f] = (s[0] + plain @ plain / 2, s[1:] + plain)
            return out

        at = {f: np.zeros(n) for f in fits}
        for width in WIDTHS if loss != "logistic" else (0.0,):
            at = minimise(lambda w, width=width: value(w, width), at, rounds)
        return {f: Machine(w[:-1], float(w[-1]), by_map, loss == "logistic") for f, w in at.items()}

    if together:
        with blocks(rows, by, x, y, list(keys), lambda group, values: mapped(values, by_map)) as data:

            def one_pass(weights: dict, width: float) -> dict:
                def each(group, a, label, h):
                    return {f: lost(w, a, label, width, loss, epsilon) for f, w in weights.items() if f[0] == group}

                return added(data, each)

            return solved(one_pass, [(g, i) for g in groups for i in c])

    parts = dealt(rows, by, x, y, list(keys) or [x])
    held = {g: [[b for b in part if b[0] == g] for part in parts] for g in groups}

    def run(fit: tuple[int, int], held: dict) -> Machine:
        own = [[(mapped(a, by_map), label) for _, a, label, _ in part] for part in held[fit[0]]]

        def sums(weights: dict, width: float) -> dict:
            return {f: summed(own, lambda a, label, w=w: lost(w, a, label, width, loss, epsilon)) for f, w in weights.items()}

        return solved(sums, [fit])[fit]

    size = {g: sum(len(b[2]) for part in parts for b in part if b[0] == g) for g in groups}
    todo = sorted(((g, i) for g in groups for i in c), key=lambda f: (-size[f[0]], -c[f[1]]))
    return dict(zip(todo, apart(rows.sparkSession, todo, held, run), strict=True))


def lost(w: np.ndarray, a: np.ndarray, label: np.ndarray, width: float, loss: str, epsilon: float) -> np.ndarray:
    """Sum of the losses and its gradient."""
    f = a @ w[:-1] + w[-1]
    if loss == "logistic":
        sign = 2 * label - 1
        v, d = np.logaddexp(0, -sign * f), -sign / (1 + np.exp(np.clip(sign * f, -500, 500)))
    elif loss == "hinge":
        sign = 2 * label - 1
        v, d = rounded(1 - sign * f, width)
        d = -sign * d
    else:
        r = f - label
        up, du = rounded(r - epsilon, width)
        down, dd = rounded(-r - epsilon, width)
        v, d = up + down, du - dd
    return np.concatenate(([v.sum()], a.T @ d, [d.sum()]))


def minimise(value, at: dict, rounds: int, tol: float = 1e-6) -> dict:
    """L-BFGS on several smooth functions side by side, named by tuples; ``value(points)`` gives (value, gradient) for each point, whose
    name starts with its function's."""
    now = value(at)
    past: dict = {f: [] for f in at}
    live = set(at)
    for _ in range(rounds):
        live = {f for f in live if np.abs(now[f][1]).max() > tol * max(1.0, abs(now[f][0]))}
        if not live:
            break
        step = {}
        for f in live:
            q, alphas = now[f][1].copy(), []
            for s, y, rho in reversed(past[f]):
                a = rho * (s @ q)
                alphas.append(a)
                q -= a * y
            q *= past[f][-1][0] @ past[f][-1][1] / (past[f][-1][1] @ past[f][-1][1]) if past[f] else 1 / max(1.0, np.linalg.norm(q))
            for (s, y, rho), a in zip(past[f], reversed(alphas), strict=True):
                q += (a - rho * (y @ q)) * s
            step[f] = -q
        left, first = set(live), 0
        for several in HALVED:  # the longest step that goes down enough
            lengths = [0.5**j for j in range(first, first + several)]
            new = value({(*f, j): at[f] + t * step[f] for f in left for j, t in enumerate(lengths)})
            for f in list(left):
                down = now[f][1] @ step[f]
                enough = [j for j, t in enumerate(lengths) if new[*f, j][0] <= now[f][0] + 1e-4 * t * down]
                if enough:
                    to, found = at[f] + lengths[enough[0]] * step[f], new[*f, enough[0]]
                    s, y = to - at[f], found[1] - now[f][1]
                    if s @ y > 1e-12 * (y @ y):
                        past[f] = [*past[f], (s, y, 1 / (s @ y))][-MEMORY:]
                    at[f], now[f] = to, found
                    left.discard(f)
            first += several
            if not left:
                break
        live -= left  # no further way down
    return at
