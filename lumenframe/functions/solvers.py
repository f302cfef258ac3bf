"""Numpy solvers of the spatial and temporal updates; no Spark here."""

from __future__ import annotations

import numpy as np

from .signals import ar_response


def nonnegative_lasso(x: np.ndarray, y: np.ndarray, alpha: float, intercept: bool = True, sweeps: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """w >= 0 that minimises |y - x w|^2 / (2 T) + alpha |w|_1, by cyclic coordinate descent; x is (T, k)."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    if intercept:
        x, y = x - x.mean(0), y - y.mean()
    gram, cross, t = x.T @ x, x.T @ y, len(y)
    w = np.zeros(x.shape[1])
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            new = max(0.0, (cross[j] - gram[j] @ w + gram[j, j] * w[j] - t * alpha) / gram[j, j])
            moved = max(moved, abs(new - w[j]) * np.sqrt(gram[j, j]))
            w[j] = new
        if moved < tol * max(1.0, np.sqrt(y @ y)):
            break
    return w


def cgls(a: np.ndarray, b: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Least squares by conjugate gradients on the normal equations, a bounded number of rounds."""
    x = np.zeros(a.shape[1])
    r = b.astype(np.float64)
    s = a.T @ r
    p, gamma = s.copy(), s @ s
    for _ in range(rounds):
        q = a @ p
        if gamma <= 1e-28 or not q.any():
            break
        step = gamma / (q @ q)
        x, r = x + step * p, r - step * q
        s = a.T @ r
        new = s @ s
        p, gamma = s + (new / gamma) * p, new
    return x


def deconvolve(y: np.ndarray, g: np.ndarray, noise: float, penalty: float = 1.0, max_iters: int = 200, start: tuple[np.ndarray, float, float] | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(calcium, spikes, baseline, initial calcium): minimises |y - c - b - c0 d|_2 + noise * penalty * |s|_1.

    s = G c >= 0, b >= min(y), c0 >= 0, with d the decay from the first sample. The norm is not squared: as in a
    square-root lasso, its scale and the non-negative problem at that scale take turns; the inner problem is
    solved by accelerated projected gradient steps, from start (spikes, baseline, initial calcium) if that is given.
    """
    y = np.asarray(y, np.float64)
    t = len(y)
    decay = ar_response(np.eye(1, t)[0], g)
    kernel = decay

    def forward(s):
        return np.convolve(s, kernel)[:t]

    def backward(r):
        return np.convolve(r[::-1], kernel)[:t][::-1]

    floor = float(y.min())
    v = np.ones(t)
    for _ in range(30):  # the largest curvature
        w = backward(forward(v))
        v = w / max(np.linalg.norm(w), 1e-12)
    step = 1.0 / max(float(v @ backward(forward(v))) + t + float(decay @ decay), 1e-12)
    s, b, c0 = np.zeros(t), floor, 0.0
    if start is not None:
        s, b, c0 = np.maximum(start[0], 0), max(floor, start[1]), max(0.0, start[2])
    sigma = max(float(np.linalg.norm(y - forward(s) - b - c0 * decay)), 1e-12)
    for _ in range(8):
        ps, pb, pc, momentum = s, b, c0, 1.0
        lam = noise * penalty * sigma
        for _ in range(max_iters):
            r = forward(ps) + pb + pc * decay - y
            ns = np.maximum(ps - step * (backward(r) + lam), 0)
            nb, nc = max(floor, pb - step * r.sum()), max(0.0, pc - step * float(decay @ r))
            new = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            k = (momentum - 1) / new
            ps, pb, pc, momentum = ns + k * (ns - s), nb + k * (nb - b), nc + k * (nc - c0), new
            s, b, c0 = ns, nb, nc
        now = max(float(np.linalg.norm(y - forward(s) - b - c0 * decay)), 1e-9 * sigma)
        if abs(now - sigma) < 1e-4 * sigma:
            break
        sigma = now
    return forward(s), s, b, c0


def deconvolve_many(y: np.ndarray, g: np.ndarray, noise: np.ndarray, penalty: float = 1.0, max_iters: int = 200, starts: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """deconvolve of the rows of y (n, T), each with its own g (n, p), noise and start (or None); rows take their steps together and stop on their own."""
    y, g = np.asarray(y, np.float64), np.asarray(g, np.float64)
    n, t = y.shape

    def recursion(x, h):
        """c[t] = x[t] + sum h[k] c[t - k], over the first axis."""
        c = x.copy()
        for i in range(1, t):
            for k in range(min(i, h.shape[0])):
                c[i] += h[k] * c[i - k - 1]
        return c

    forward = recursion
    backward = lambda r, h: recursion(r[::-1], h)[::-1]
    y, g = np.ascontiguousarray(y.T), np.ascontiguousarray(g.T)  # samples first: a step is over all rows
    one = np.zeros((t, n))
    one[0] = 1
    decay = forward(one, g)
    floor = y.min(0)
    v = np.ones((t, n))
    for _ in range(30):  # the largest curvature
        w = backward(forward(v, g), g)
        v = w / np.maximum(np.sqrt((w * w).sum(0)), 1e-12)
    step = 1.0 / np.maximum((v * backward(forward(v, g), g)).sum(0) + t + (decay * decay).sum(0), 1e-12)
    s, b, c0 = np.zeros((t, n)), floor.copy(), np.zeros(n)
    for i, start in enumerate(starts or []):
        if start is not None:
            s[:, i], b[i], c0[i] = np.maximum(start[0], 0), max(floor[i], start[1]), max(0.0, start[2])
    norm = lambda r: np.sqrt((r * r).sum(0))
    sigma = np.maximum(norm(y - forward(s, g) - b - c0 * decay), 1e-12)
    on = np.arange(n)
    for _ in range(8):
        yy, h, d, lo, st = y[:, on], g[:, on], decay[:, on], floor[on], step[on]
        ls, lb, lc = s[:, on], b[on], c0[on]
        ps, pb, pc, momentum = ls, lb, lc, 1.0
        lam = noise[on] * penalty * sigma[on]
        for _ in range(max_iters):
            r = forward(ps, h) + pb + pc * d - yy
            ns = np.maximum(ps - st * (backward(r, h) + lam), 0)
            nb, nc = np.maximum(lo, pb - st * r.sum(0)), np.maximum(0.0, pc - st * (d * r).sum(0))
            new = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            k = (momentum - 1) / new
            ps, pb, pc, momentum = ns + k * (ns - ls), nb + k * (nb - lb), nc + k * (nc - lc), new
            ls, lb, lc = ns, nb, nc
        s[:, on], b[on], c0[on] = ls, lb, lc
        now = np.maximum(norm(yy - forward(ls, h) - lb - lc * d), 1e-9 * sigma[on])
        go = ~(np.abs(now - sigma[on]) < 1e-4 * sigma[on])
        sigma[on[go]] = now[go]
        on = on[go]
        if not len(on):
            break
    return forward(s, g).T, s.T, b, c0


def objective(y, c, s, b, c0, g, noise, penalty=1.0) -> float:
    decay = ar_response(np.eye(1, len(y))[0], g)
    return float(np.linalg.norm(y - c - b - c0 * decay) + noise * penalty * np.abs(s).sum())
