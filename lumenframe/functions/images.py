"""Numpy kernels over stacks of frames (n, height, width); no Spark here."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def disk(radius: int) -> np.ndarray:
    """Offsets (dy, dx) with dy^2 + dx^2 <= radius^2."""
    r = np.arange(-radius, radius + 1)
    dy, dx = np.meshgrid(r, r, indexing="ij")
    inside = dy**2 + dx**2 <= radius**2
    return np.stack([dy[inside], dx[inside]], 1)


def _padded(x: np.ndarray, before: int, after: int, border: str, fill: float = 0.0) -> np.ndarray:
    """border: reflect repeats the edge sample, mirror does not, edge replicates it, fill is a constant."""
    width = ((0, 0), (before, after), (before, after))
    if border == "fill":
        return np.pad(x, width, constant_values=fill)
    return np.pad(x, width, mode={"reflect": "symmetric", "mirror": "reflect", "edge": "edge"}[border])


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over a size x size window around each pixel, reflecting at the border."""
    p = _padded(x.astype(np.float64), size // 2, size - 1 - size // 2, "reflect")
    return sliding_window_view(p, (size, size), (1, 2)).mean((-1, -2))


def extreme(x: np.ndarray, offsets: np.ndarray, kind: str) -> np.ndarray:
    """Dilation (max) or erosion (min) by offsets; what lies outside the image is ignored."""
    r = int(np.abs(offsets).max(initial=0))
    p = _padded(x.astype(np.float64), r, r, "fill", -np.inf if kind == "max" else np.inf)
    h, w = x.shape[1:]
    pick = np.maximum if kind == "max" else np.minimum
    out = None
    for dy, dx in offsets:
        part = p[:, r + dy : r + dy + h, r + dx : r + dx + w]
        out = part.copy() if out is None else pick(out, part)
    return out


def background(x: np.ndarray, method: str, wnd: int) -> np.ndarray:
    if method == "uniform":
        return x - box_mean(x, wnd)
    if method == "tophat":
        around = disk(wnd)
        return x - extreme(extreme(x, around, "min"), around, "max")
    raise ValueError(f"unknown background method {method!r}")


def median_filter(x: np.ndarray, size: int) -> np.ndarray:
    p = _padded(x, size // 2, size // 2, "edge")
    return np.median(sliding_window_view(p, (size, size), (1, 2)), (-1, -2))


def gaussian_weights(size: int, sigma: float) -> np.ndarray:
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return w / w.sum()


def gaussian_filter(x: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    w, r = gaussian_weights(size, sigma), size // 2
    p = _padded(x.astype(np.float64), r, r, "mirror")
    return np.einsum("nhwij,i,j->nhw", sliding_window_view(p, (size, size), (1, 2)), w, w)


def bilateral_filter(x: np.ndarray, d: int, sigma_value: float, sigma_space: float) -> np.ndarray:
    r = d // 2
    p, (h, w) = _padded(x.astype(np.float64), r, r, "mirror"), x.shape[1:]
    total, weight = np.zeros(x.shape), np.zeros(x.shape)
    for dy, dx in disk(r):
        part = p[:, r + dy : r + dy + h, r + dx : r + dx + w]
        g = np.exp(-(dy**2 + dx**2) / (2 * sigma_space**2) - (part - x) ** 2 / (2 * sigma_value**2))
        total += g * part
        weight += g
    return total / weight


def anisotropic_diffusion(x: np.ndarray, niter: int = 1, kappa: float = 50.0, gamma: float = 0.1) -> np.ndarray:
    """Explicit Perona-Malik steps with exponential conduction; no flow across the border."""
    x = x.astype(np.float64)
    for _ in range(niter):
        flow = np.zeros(x.shape)
        for axis in (1, 2):
            d = np.diff(x, axis=axis)
            d *= np.exp(-((d / kappa) ** 2))
            pad = [(0, 0)] * 3
            pad[axis] = (0, 1)
            flow += np.pad(d, pad)
            pad[axis] = (1, 0)
            flow -= np.pad(d, pad)
        x = x + gamma * flow
    return x


def denoise(x: np.ndarray, method: str, **how) -> np.ndarray:
    kinds = {"gaussian": gaussian_filter, "anisotropic": anisotropic_diffusion, "median": median_filter, "bilateral": bilateral_filter}
    if method not in kinds:
        raise ValueError(f"unknown denoise method {method!r}")
    return kinds[method](x, **how)


def local_extreme(x: np.ndarray, radius: int, kind: str = "max", diff: float = 0.0) -> np.ndarray:
    """1 where a pixel is its neighbourhood's extreme and the neighbourhood's range is above diff."""
    around = disk(radius)
    high, low = extreme(x, around, "max"), extreme(x, around, "min")
    if kind not in ("max", "min"):
        raise ValueError(f"unknown extreme {kind!r}")
    return ((x == (high if kind == "max" else low)) & (high - low > diff)).astype(np.uint8)


def adaptive_mask(x: np.ndarray, above: float, size: int) -> np.ndarray:
    """Pixels that exceed their neighbourhood's mean (replicated border) by more than above."""
    p = _padded(x.astype(np.float64), size // 2, size // 2, "edge")
    return x > sliding_window_view(p, (size, size), (1, 2)).mean((-1, -2)) + above


def label(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Connected features of one image, numbered from 1 in scan order; 0 elsewhere. Union-find over runs of neighbours."""
    mask = np.asarray(mask, bool)
    h, w = mask.shape
    parent = np.arange(h * w)

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * diagonal
    for dy, dx in steps:
        ys, xs = np.nonzero(mask[: h - dy, max(0, -dx) : w - max(0, dx)] & mask[dy:, max(0, dx) : w - max(0, -dx)])
        for y, x in zip(ys, xs + max(0, -dx), strict=True):
            a, b = find(y * w + x), find((y + dy) * w + x + dx)
            parent[max(a, b)] = min(a, b)
    out = np.zeros(h * w, np.int64)
    roots: dict[int, int] = {}
    for i in np.flatnonzero(mask.ravel()):
        out[i] = roots.setdefault(find(i), len(roots) + 1)
    return out.reshape(h, w)


def local_max_roll(fm: np.ndarray, k0: int, k1: int, diff: float) -> np.ndarray:
    """Local maxima for any disk radius in [k0, k1), each touching group reduced to its middle pixel."""
    found = np.zeros(fm.shape, bool)
    for k in range(k0, k1):
        found |= local_extreme(fm[None], k, "max", diff)[0] > 0
    names, out = label(found, diagonal=True), np.zeros(fm.shape, np.uint8)
    for k in range(1, names.max(initial=0) + 1):
        ys, xs = np.nonzero(names == k)
        out[int(np.median(ys)), int(np.median(xs))] = 1
    return out


def shift_rounded(fm: np.ndarray, dy: float, dx: float, fill: float = np.nan) -> np.ndarray:
    """Content moved by whole pixels (halves to even); uncovered pixels get fill; an all-NaN frame stays."""
    if np.isnan(fm).all():
        return fm
    h, w = fm.shape
    sy, sx = int(np.around(dy)), int(np.around(dx))
    out = np.full(fm.shape, fill, np.float64)
    if abs(sy) < h and abs(sx) < w:
        out[max(0, sy) : h + min(0, sy), max(0, sx) : w + min(0, sx)] = fm[max(0, -sy) : h + min(0, -sy), max(0, -sx) : w + min(0, -sx)]
    return out


def translate(fm: np.ndarray, dy: float, dx: float, fill: float = 0.0) -> np.ndarray:
    """Bilinear translation; a positive shift moves content to larger indices; fill takes part at the border."""
    h, w = fm.shape
    y, x = np.arange(h)[:, None] - dy, np.arange(w)[None] - dx
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0

    def tap(yy, xx):
        ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        return np.where(ok, fm[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], fill)

    parts = [(y0, x0, (1 - fy) * (1 - fx)), (y0, x0 + 1, (1 - fy) * fx), (y0 + 1, x0, fy * (1 - fx)), (y0 + 1, x0 + 1, fy * fx)]
    return sum(np.where(g > 0, tap(a, b) * g, 0.0) for a, b, g in parts)
