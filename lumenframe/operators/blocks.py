"""Numpy kernels as Arrow-batched functions over columns of frames and traces: narrow, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def _by_size(rows: pd.Series) -> dict[int, np.ndarray]:
    lengths = rows.map(len).to_numpy()
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def map_frames(kernel: Callable[[np.ndarray], np.ndarray], px: str = "px", height: str = "height", width: str = "width", returns: str | DataType = "array<double>") -> Column:
    """kernel over (n, h, w) stacks of the batch's frames; frames of one shape go together."""

    @F.pandas_udf(returns)
    def run(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out: list = [None] * len(p)
        shapes = pd.Series(list(zip(h, w, strict=True)))
        for (hh, ww), at in shapes.groupby(shapes).groups.items():
            got = kernel(np.stack([np.asarray(p.iloc[i], np.float64) for i in at]).reshape(len(at), hh, ww))
            for i, g in zip(at, got, strict=True):
                out[i] = np.asarray(g, np.float64).ravel() if np.ndim(g) else float(g)
        return pd.Series(out)

    return run(F.col(px), F.col(height), F.col(width))


#: Values of the stack of traces that a kernel takes at a time, at most (or one trace), whatever an Arrow batch holds.
VALUES = 1 << 16


def map_traces(kernel: Callable[[np.ndarray], np.ndarray], y: str = "y", returns: str = "array<double>") -> Column:
    """kernel over (n, T) stacks of the batch's traces, VALUES at a time; traces of one length go together."""
    most = VALUES

    @F.pandas_udf(returns)
    def run(v: pd.Series) -> pd.Series:
        out: list = [None] * len(v)
        for length, rows in _by_size(v).items():
            step = max(1, most // max(1, length))
            for at in (rows[s : s + step] for s in range(0, len(rows), step)):
                got = kernel(np.stack([np.asarray(v.iloc[i], np.float64) for i in at]))
                for i, g in zip(at, got, strict=True):
                    out[i] = np.asarray(g, np.float64) if np.ndim(g) else g.item() if isinstance(g, np.generic) else g
        return pd.Series(out)

    return run(F.col(y))


def with_frames(df: DataFrame, kernel, px: str = "px") -> DataFrame:
    return df.withColumn(px, map_frames(kernel, px))


def with_traces(df: DataFrame, kernel, y: str = "y") -> DataFrame:
    return df.withColumn(y, map_traces(kernel, y))
