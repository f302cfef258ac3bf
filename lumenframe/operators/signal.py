"""Operators on traces (rows with y array<double>): narrow kernels."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from ..functions import signals as K
from .blocks import map_traces, with_traces


def noise_fft(traces: DataFrame, band=(0.25, 0.5), how: str = "logmexp", name: str = "sn") -> DataFrame:
    return traces.withColumn(name, map_traces(partial(K.noise_fft, band=band, how=how), returns="double"))


def noise_welch(traces: DataFrame, band=(0.25, 0.5), how: str = "logmexp", name: str = "sn") -> DataFrame:
    if how == "sum":
        raise ValueError("Welch noise has no sum")
    return traces.withColumn(name, map_traces(partial(K.noise_welch, band=band, how=how), returns="double"))


def smooth(traces: DataFrame, freq: float, method: str = "fft", btype: str = "low") -> DataFrame:
    return with_traces(traces, partial(K.smooth, freq=freq, method=method, btype=btype))


def ptp_quantile(traces: DataFrame, q=(0.1, 99.9), name: str = "ptp") -> DataFrame:
    return traces.withColumn(name, map_traces(partial(K.ptp_q, q=q), returns="double"))


def pnr(traces: DataFrame, freq: float = 0.25, q=(0.1, 99.9), name: str = "pnr") -> DataFrame:
    return traces.withColumn(name, map_traces(partial(K.pnr, freq=freq, q=q), returns="double"))


def median_baseline(traces: DataFrame, wnd: int) -> DataFrame:
    return with_traces(traces, partial(K.median_baseline, wnd=wnd))


def ar_coefficients(traces: DataFrame, p: int = 2, add_lag="p", noise: float = 0.0, name: str = "g") -> DataFrame:
    return traces.withColumn(name, map_traces(lambda x: [K.ar_coefficients(r, noise, p, add_lag) for r in x]))


def rising_run(traces: DataFrame, name: str = "p") -> DataFrame:
    return traces.withColumn(name, map_traces(lambda x: [K.rising_run(r) for r in x], returns="long"))


def ar_response(traces: DataFrame, g: list[float]) -> DataFrame:
    return with_traces(traces, lambda x: K.ar_response(x, np.array(g)))
