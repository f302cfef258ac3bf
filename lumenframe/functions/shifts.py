"""Numpy kernels of motion estimation; no Spark here."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from .images import adaptive_mask, label, translate


def xcorr_shifts(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Shifts (n, 2) that move each dst of a stack onto its src: the circular cross-correlations' peaks, refined by a parabola on each axis."""
    n, *shape = src.shape
    corr = np.fft.irfft2(np.fft.rfft2(src) * np.conj(np.fft.rfft2(dst)), s=shape)
    peak, each = np.unravel_index(corr.reshape(n, -1).argmax(1), shape), np.arange(n)
    out = np.empty((n, 2))
    for axis, size in enumerate(shape):
        line = corr[each, :, peak[1]] if axis == 0 else corr[each, peak[0], :]
        low, mid, high = (line[each, (peak[axis] + d) % size] for d in (-1, 0, 1))
        bend = low - 2 * mid + high
        at = peak[axis] + np.where(bend != 0, 0.5 * (low - high) / np.where(bend != 0, bend, 1), 0.0)
        out[:, axis] = np.where(at > size // 2, at - size, at)
    return out


def xcorr_shift(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    return xcorr_shifts(src[None], dst[None])[0]


def match_scores(src: np.ndarray, dst: np.ndarray, most: int) -> np.ndarray:
    """(n, rows, columns): normalised correlations of the overlaps of a stack's pairs, by whole-pixel shift of dst; -inf where one does not vary."""
    n, h, w = src.shape
    ys, xs = min(most, h - 2), min(most, w - 2)
    out = np.full((n, 2 * ys + 1, 2 * xs + 1), -np.inf)
    for dy in range(-ys, ys + 1):
        for dx in range(-xs, xs + 1):
            a = src[:, max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)].reshape(n, -1)
            b = dst[:, max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)].reshape(n, -1)
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
            out[:, dy + ys, dx + xs] = np.where(norm > 0, (a * b).sum(1) / np.where(norm > 0, norm, 1), -np.inf)
    return out


def match_templates(src: np.ndarray, dst: np.ndarray, most: int, local: bool = False, subpixel: bool = False) -> np.ndarray:
    """Shifts (n, 2) of dst onto src by normalised correlation, up to `most` pixels.

    The best shift, or with local the local maximum nearest to none; subpixel puts a parabola through up to eleven scores on each axis.
    """
    scores = match_scores(src, dst, most)
    n, rows, cols = scores.shape
    if local:
        top = sliding_window_view(np.pad(scores, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf), (3, 3), (1, 2)).max((-1, -2))
        y, x = np.arange(rows)[:, None] - rows // 2, np.arange(cols)[None] - cols // 2
        far = np.where((scores == top) & np.isfinite(scores), (y * y + x * x)[None], np.inf)
        best = far.reshape(n, -1).argmin(1)
    else:
        best = scores.reshape(n, -1).argmax(1)
    out = np.zeros((n, 2))
    for k in range(n):
        peak = np.unravel_index(best[k], (rows, cols))
        if not np.isfinite(scores[k][peak]):
            continue
        for axis, size in enumerate((rows, cols)):
            place = float(peak[axis])
            if subpixel:
                at = np.arange(max(peak[axis] - 5, 0), min(peak[axis] + 6, size))
                line = scores[k][at, peak[1]] if axis == 0 else scores[k][peak[0], at]
                ok = np.isfinite(line)
                if ok.sum() > 2:
                    bend, slope, _ = np.polyfit(at[ok], line[ok], 2)
                    place = -slope / (2 * bend) if bend < 0 else place
            out[k, axis] = place - size // 2
    return out


def match_template(src: np.ndarray, dst: np.ndarray, most: int, **how) -> np.ndarray:
    return match_templates(src[None], dst[None], most, **how)[0]


def roundness(region: np.ndarray) -> float:
    """4 pi area / perimeter^2 of the outline through the outer pixels of a mask's only piece (8 neighbours); 0 for none or several.

    Holes count as inside. Each square of four pixels adds its part of the area; sides between two set pixels with
    none beyond, and the slants of squares with three, make up the perimeter.
    """
    if label(region, diagonal=True).max(initial=0) != 1:
        return 0.0
    outside = label(~np.pad(region, 1))
    inside = outside != outside[0, 0]
    a, b, c, d = inside[:-1, :-1], inside[:-1, 1:], inside[1:, :-1], inside[1:, 1:]
    held = a.astype(int) + b + c + d
    slant = (held == 2) & (a == d)
    area = (held == 4).sum() + 0.5 * (held == 3).sum()
    length = ((held == 2) & ~slant).sum() + np.sqrt(2) * ((held == 3).sum() + 2 * slant.sum())
    return float(4 * np.pi * area / length**2) if length else 0.0


def template_quality(fm: np.ndarray, most: int = 100) -> float:
    """How well a frame can serve as a template: the roundness of the shifts, up to `most` pixels, at which it resembles itself.

    It does where the sum of squared differences to the zero-padded frame is below the root of both energies' product.
    """
    h, w = fm.shape
    my, mx = min(most, h), min(most, w)
    padded = np.pad(fm.astype(np.float64), ((my, my), (mx, mx)))
    slide = lambda x, k: np.fft.irfft2(np.fft.rfft2(x) * np.conj(np.fft.rfft2(k, x.shape)), s=x.shape)[: 2 * my + 1, : 2 * mx + 1]
    own, there = float((fm.astype(np.float64) ** 2).sum()), np.maximum(slide(padded**2, np.ones(fm.shape)), 0)
    both = np.sqrt(own * there)
    return roundness((own + there - 2 * slide(padded, fm) < both) & (both > 1e-9 * own))


def _chain(good: np.ndarray, register) -> np.ndarray:
    """Shifts of frames in a row: each registers to the nearest good frame toward the good one in the middle, and takes that one's shift on.

    A bad frame is no other's target, so its error stays its own.
    """
    n, at = len(good), np.flatnonzero(good)
    middle = at[np.abs(at - n / 2).argmin()]
    shifts = np.zeros((n, 2))
    for i in [*range(middle - 1, -1, -1), *range(middle + 1, n)]:
        target = at[at > i].min() if i < middle else at[at < i].max()
        shifts[i] = shifts[target] + register(target, i)
    return shifts


def estimate(frames: np.ndarray, npart: int = 3, how: str = "mean", mask: tuple[float, int] | float | None = None, circ_thres: float | None = None, max_sh: int = 100, alt_error: float | None = None, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(template, shifts, ends) of a run of frames, or of templates with the first and last frames (ends) that they stand for.

    Frames register in groups of npart, so steps are small and add up. A group's good frames, aligned, aggregate to a
    template; templates register like frames. mask blanks dim pixels: below a value, or (above, size) their surroundings. Frames
    whose template_quality is not above circ_thres are bad. With alt_error, templates register by their facing ends too, and
    that shift counts where both differ by more pixels and it is the smaller. Shifts have mean 0.
    """
    if mask is not None:
        frames = np.where(adaptive_mask(frames, *mask) if isinstance(mask, tuple) else frames > mask, frames, 0)
    good = np.ones(len(frames), bool)
    if circ_thres is not None:
        good = np.array([template_quality(f, max_sh) > circ_thres for f in frames])
    return _estimate(frames, good, npart, how, alt_error, ends)


def _estimate(frames: np.ndarray, good: np.ndarray, npart: int, how: str, alt_error: float | None, ends):
    n = len(frames)
    if n > npart:
        size = -(-n // npart)
        parts = [slice(i, min(n, i + size)) for i in range(0, n, size)]
        inner = [_estimate(frames[p], good[p], npart, how, alt_error, None if ends is None else (ends[0][p], ends[1][p])) for p in parts]
        templates = np.stack([t for t, _, _ in inner])
        outer_ends = tuple(np.stack([e[k] for _, _, e in inner]) for k in (0, 1))
        _, outer, _ = _estimate(templates, np.ones(len(parts), bool), npart, how, alt_error, outer_ends)
        shifts = np.concatenate([s + move for (_, s, _), move in zip(inner, outer, strict=True)])
    else:

        def register(target: int, i: int) -> np.ndarray:
            step = xcorr_shift(frames[target], frames[i])
            if alt_error is not None and ends is not None:
                mine, theirs = (1, 0) if i < target else (0, 1)
                other = xcorr_shift(ends[theirs][target], ends[mine][i])
                if np.abs(step - other).max() > alt_error and np.abs(other).sum() < np.abs(step).sum():
                    return other
            return step

        shifts = _chain(good if good.any() else ~good, register)
    shifts -= shifts.mean(0)
    used = np.flatnonzero(good if good.any() else ~good)
    first, last = (frames, frames) if ends is None else ends
    facing = translate(first[used[0]], *shifts[used[0]]), translate(last[used[-1]], *shifts[used[-1]])
    return aggregate(frames[used], shifts[used], how), shifts, facing


def aggregate(frames: np.ndarray, shifts: np.ndarray, how: str = "mean") -> np.ndarray:
    moved = np.stack([translate(f, *s) for f, s in zip(frames, shifts, strict=True)])
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {how!r}")
    return moved.mean(0) if how == "mean" else moved.max(0)


def patch_field(src: np.ndarray, dst: np.ndarray, patch: int) -> np.ndarray:
    """Experimental non-rigid motion: a shift for each patch, (rows, columns, 2)."""
    h, w = src.shape
    ys, xs = range(0, max(1, h - patch + 1), patch), range(0, max(1, w - patch + 1), patch)
    return np.array([[xcorr_shift(src[y : y + patch, x : x + patch], dst[y : y + patch, x : x + patch]) for x in xs] for y in ys])


def field_at(field: np.ndarray, patch: int, shape: tuple[int, int]) -> np.ndarray:
    """A field of patch shifts (rows, columns, 2) at every pixel (h, w, 2): bilinear between the patches' middles, constant beyond."""
    middles = [patch * np.arange(n) + (patch - 1) / 2 for n in field.shape[:2]]
    down = np.stack([[np.interp(np.arange(shape[0]), middles[0], field[:, j, k]) for j in range(field.shape[1])] for k in (0, 1)], -1)
    across = np.stack([[np.interp(np.arange(shape[1]), middles[1], down[:, y, k]) for y in range(shape[0])] for k in (0, 1)], -1)
    return across


def apply_field(fm: np.ndarray, field: np.ndarray, patch: int, fill: float = 0.0) -> np.ndarray:
    """A frame moved by a field of patch shifts, by bilinear sampling."""
    moves = field_at(field, patch, fm.shape)
    return translate(fm, moves[..., 0], moves[..., 1], fill)
