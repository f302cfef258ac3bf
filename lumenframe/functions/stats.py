"""Numpy kernels of statistics on samples and on assignments; no Spark here."""

from __future__ import annotations

import math

import numpy as np


def gaussian_mixture_1d(x: np.ndarray, n: int = 2, rounds: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, deviations), by ascending mean, of a mixture fitted by expectation maximisation from quantiles."""
    x = np.asarray(x, np.float64)
    n = min(n, len(np.unique(x)))
    mean = np.quantile(x, (np.arange(n) + 0.5) / n)
    floor = 1e-6 * max(np.var(x), 1e-12)
    var, weight, before = np.full(n, max(np.var(x), floor)), np.full(n, 1 / n), -np.inf
    for _ in range(rounds):
        log = np.log(weight) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        share = np.exp(log - total[:, None])
        mass = share.sum(0) + 1e-12
        weight, mean = mass / mass.sum(), (share * x[:, None]).sum(0) / mass
        var = np.maximum((share * (x[:, None] - mean) ** 2).sum(0) / mass, floor)
        if abs(total.mean() - before) < tol:
            break
        before = total.mean()
    order = np.argsort(mean)
    return weight[order], mean[order], np.sqrt(var[order])


def mixture_mask(x: np.ndarray, n: int = 2, valid: int = 1, above_lowest: bool = True) -> np.ndarray:
    """Values that belong to the components of the `valid` largest means, and lie above the lowest mean."""
    w, m, s = gaussian_mixture_1d(x, n)
    log = np.log(w) - np.log(s) - (np.asarray(x)[:, None] - m) ** 2 / (2 * s**2)
    keep = log.argmax(1) >= len(m) - valid
    return keep & (x > m[0]) if above_lowest else keep


def normal_ks(x: np.ndarray) -> tuple[float, float]:
    """(D, p) of a sample's z-scores against the standard normal; p by the asymptotic series with Stephens' correction."""
    x = np.asarray(x, np.float64)
    n, sd = len(x), x.std()
    if n == 0 or sd == 0:
        return 1.0, 0.0
    z = np.sort((x - x.mean()) / sd)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    d = float(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()))
    t = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    k = np.arange(1, 101)
    p = 2 * float(((-1.0) ** (k - 1) * np.exp(-2 * k**2 * t**2)).sum())
    return d, min(1.0, max(0.0, p)) if t > 0.2 else 1.0


def spatial_partition(positions: np.ndarray, target: int) -> np.ndarray:
    """Dense part labels, depth first: halves at the stable median along the longer axis until parts hold target points at most."""
    positions = np.asarray(positions, np.float64)
    if positions.ndim != 2 or positions.shape[1] != 2:
        raise ValueError("positions must be (n, 2)")
    if target < 1:
        raise ValueError("target must be positive")
    if not np.isfinite(positions).all():
        raise ValueError("positions must be finite")
    labels, todo, n = np.zeros(len(positions), np.int64), [np.arange(len(positions))], 0
    while todo:
        own = todo.pop()
        if len(own) <= target:
            labels[own] = n
            n += len(own) > 0
            continue
        span = np.ptp(positions[own], 0)
        order = own[np.argsort(positions[own, int(span[1] > span[0])], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return labels


def nearest_walk(points: np.ndarray) -> np.ndarray:
    """Rank of each point on a greedy walk: from the smallest coordinate sum, always to the nearest point left."""
    points = np.asarray(points, np.float64)
    rank, left = np.zeros(len(points), np.int64), np.ones(len(points), bool)
    at = int(np.argmin(points.sum(1))) if len(points) else 0
    for n in range(len(points)):
        rank[at], left[at] = n, False
        d = np.where(left, ((points - points[at]) ** 2).sum(1), np.inf)
        at = int(np.argmin(d))
    return rank


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns (shortest augmenting paths)."""
    cost = np.asarray(cost, np.float64)
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            reduced = c[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)
