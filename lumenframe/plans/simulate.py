"""Seeded test inputs: planted movies and spike traces."""

from __future__ import annotations

import numpy as np


def planted_movie(n_frames: int = 200, side: int = 40, cells: int = 6, noise: float = 0.05, drift: float = 0.0, texture: float = 0.0, seed: int = 0) -> dict[str, np.ndarray]:
    """Gaussian blobs with AR(1) traces: movie (n, side, side), A (cells, side, side), C, S (cells, n), shifts (n, 2)."""
    from ..functions.images import box_mean, translate
    from ..functions.signals import ar_response

    rng = np.random.default_rng(seed)
    per = int(np.ceil(np.sqrt(cells)))
    grid = [((i // per + 0.5) * side / per, (i % per + 0.5) * side / per) for i in range(cells)]
    y, x = np.mgrid[:side, :side]
    a = np.stack([np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 2.0**2)) for cy, cx in grid])
    a[a < 0.1] = 0
    s = (rng.random((cells, n_frames)) < 0.04) * rng.uniform(0.5, 1.5, (cells, n_frames))
    c = ar_response(s, np.array([0.9]))
    movie = np.tensordot(c.T, a, 1)
    if texture:  # still tissue, which moves with the rest
        still = box_mean(box_mean(rng.normal(0, 1, (1, side, side)), 5), 5)[0]
        movie = movie + texture * still / still.std()
    shifts = np.cumsum(rng.normal(0, drift, (n_frames, 2)), 0) if drift else np.zeros((n_frames, 2))
    shifts -= shifts.mean(0)
    movie = np.stack([translate(f, *m) for f, m in zip(movie, shifts, strict=True)]) if drift else movie
    return {"movie": movie + rng.normal(0, noise, movie.shape), "A": a, "C": c, "S": s, "shifts": shifts}


def frames_df(spark, movie: np.ndarray):
    rows = [(i, int(f.shape[0]), int(f.shape[1]), f.ravel().tolist()) for i, f in enumerate(movie)]
    return spark.createDataFrame(rows, "frame long, height int, width int, px array<double>")
