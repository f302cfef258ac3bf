"""Seed detection, refinement and initial footprints."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import stats as T
from . import near
from .blocks import map_traces
from .graph import connected_components, edge_correlation, radius_pairs, unit_norm
from .image import local_max_roll, max_projection
from .signal import median_baseline, pnr, smooth

HW = ["height", "width"]
#: Values that a mixture is fitted on, at most.
MIXTURE_VALUES = 5000


def windows(n_frames: int, size: int, step: int) -> list[tuple[int, int]]:
    """Hopping windows [from, to) of frames: centres evenly from the first to the last frame, half a size on either side."""
    m, half = math.ceil(n_frames / step) + 1, math.ceil(size / 2)
    centres = [i * (n_frames - 1) / (m - 1) for i in range(m)]
    return [(max(0, math.floor(c - half)), math.ceil(c + half)) for c in centres]


def window_projections(cells: DataFrame, n_frames: int, size: int, step: int, method: str = "rolling", n_random: int = 100, seed: int = 0) -> DataFrame:
    """(sample, height, width, value): the maximum over each window of frames, rolling or drawn at random."""
    if method == "rolling":
        # a frame's windows by arithmetic on its label: no join with a window table
        m, half = math.ceil(n_frames / step) + 1, math.ceil(size / 2)
        gap = (n_frames - 1) / (m - 1)
        low = F.floor((F.col("frame") - half - 1) / gap) if gap > 0 else F.lit(0)
        high = F.ceil((F.col("frame") + half + 1) / gap) if gap > 0 else F.lit(m - 1)
        near = F.sequence(F.greatest(F.lit(0), low).cast("int"), F.least(F.lit(m - 1), high).cast("int"))
        centre = lambda i: i * F.lit(float(n_frames - 1)) / F.lit(m - 1)
        hit = F.filter(near, lambda i: (F.col("frame") >= F.greatest(F.lit(0), F.floor(centre(i) - half))) & (F.col("frame") < F.ceil(centre(i) + half)))
        rows = cells.withColumn("sample", F.explode(hit))
    elif method == "random":
        draws = cells.sparkSession.range(n_random * size).select((F.col("id") % n_random).cast("int").alias("sample"), F.floor(F.rand(seed) * n_frames).cast("long").alias("frame")).distinct()
        rows = cells.join(draws, "frame")
    else:
        raise ValueError(f"unknown window method {method!r}")
    return rows.groupBy("sample", *HW).agg(F.max("value").alias("value"))


def seeds_init(cells: DataFrame, n_frames: int, height: int, width: int, size: int = 500, step: int = 200, max_wnd: int = 10, diff: float = 2.0, method: str = "rolling", **how) -> DataFrame:
    """(height, width, seeds): in how many windows a pixel is a local maximum of the projection."""
    from ..model import LabelledFrame

    frames = LabelledFrame(window_projections(cells, n_frames, size, step, method, **how), ("sample", *HW)).to_frames(height, width).df
    found = LabelledFrame(local_max_roll(frames, 2, max_wnd, diff), ("sample", *HW), layout="frame").to_cells().df
    return found.groupBy(*HW).agg(F.sum("value").cast("int").alias("seeds")).where("seeds > 0")


def at_seeds(traces: DataFrame, seeds: DataFrame) -> DataFrame:
    return traces.join(seeds.select(*HW), HW)


def _mask(seeds: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    return seeds.join(marked.select(*HW, name), HW, "left")


def gmm_refine(traces: DataFrame, seeds: DataFrame, q=(0.1, 99.9), n: int = 2, valid: int = 1, above_lowest: bool = True) -> DataFrame:
    """seeds with ptp and mask_gmm: whether a seed's range of values belongs to the upper components of a mixture over seeds.

    The mixture is fitted on the driver on evenly spaced quantiles: all values of up to MIXTURE_VALUES seeds, else so many.
    """
    from .signal import ptp_quantile

    values = ptp_quantile(at_seeds(traces, seeds), q).select(*HW, "ptp")
    return _mixture(seeds, values, "ptp", "mask_gmm", n, valid, above_lowest)


def _quantiles(values: DataFrame, column: str) -> np.ndarray:
    """All values of a column of up to MIXTURE_VALUES rows, else so many evenly spaced quantiles."""
    m = min(values.where(F.col(column).isNotNull()).count(), MIXTURE_VALUES)
    if not m:
        return np.empty(0)
    places = F.array(*[F.lit((i + 0.5) / m) for i in range(m)])
    return np.array(values.agg(F.percentile_approx(column, places, F.lit(100 * MIXTURE_VALUES)).alias("x")).first()["x"])


def _mixture(seeds: DataFrame, values: DataFrame, column: str, name: str, n: int, valid: int, above_lowest: bool) -> DataFrame:
    x = _quantiles(values, column)
    if not len(x):
        return seeds.withColumn(name, F.lit(None).cast("boolean"))
    w, m, s = T.gaussian_mixture_1d(x, n)
    part = F.array(*[F.lit(float(np.log(a) - np.log(c))) - (F.col(column) - float(b)) * (F.col(column) - float(b)) / float(2 * c**2) for a, b, c in zip(w, m, s, strict=True)])
    best = F.array_position(part, F.array_max(part)) - 1
    keep = best >= len(m) - valid
    if above_lowest:
        keep = keep & (F.col(column) > float(m[0]))
    return seeds.join(values.withColumn(name, keep), HW, "left")


def mixture_histogram(values: DataFrame, column: str, bins: int = 50, n: int = 2) -> DataFrame:
    """(bin, low, high, n, density): the histogram of a column and the fitted mixture's density at the bins' middles."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if ends["lo"] is None:
        return values.sparkSession.createDataFrame([], "bin int, low double, high double, n long, density double")
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) / bins or 1.0
    counts = {r["b"]: r["n"] for r in values.where(F.col(column).isNotNull()).groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}  # a row for each bin
    w, m, s = T.gaussian_mixture_1d(_quantiles(values, column), n)
    middles = lo + width * (np.arange(bins) + 0.5)
    density = (w * np.exp(-((middles[:, None] - m) ** 2) / (2 * s**2)) / (s * np.sqrt(2 * np.pi))).sum(1)
    return values.sparkSession.createDataFrame([(i, lo + i * width, lo + (i + 1) * width, counts.get(i, 0), float(density[i])) for i in range(bins)], "bin int, low double, high double, n long, density double")


def pnr_refine(traces: DataFrame, seeds: DataFrame, noise_freq: float = 0.25, thres: float | str = 1.5, q=(0.1, 99.9), med_wnd: int | None = None, compat: bool = False) -> DataFrame:
    """seeds with pnr and mask_pnr. A running-median baseline is taken off first if med_wnd is given (not under compat)."""
    rows = at_seeds(traces, seeds)
    if med_wnd and not compat:
        rows = median_baseline(rows, med_wnd)
    values = pnr(rows, noise_freq, q).select(*HW, "pnr")
    if thres == "auto":
        return _mixture(seeds, values, "pnr", "mask_pnr", 2, 1, True)
    return seeds.join(values.withColumn("mask_pnr", F.col("pnr") > thres), HW, "left")


def intensity_refine(cells: DataFrame, seeds: DataFrame, height: int, width: int, thres_mul: float = 2.0) -> DataFrame:
    """seeds with mask_int: whether the maximum projection is above a multiple of its commonest bin; seeds as they are if that is out of range."""
    high = max_projection(cells)
    bins = int(np.around(height * width / 10))
    ends = high.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    place = F.least(F.floor((F.col("value") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)) if hi > lo else F.lit(0)
    top = high.groupBy(place.alias("b")).count().orderBy(F.desc("count"), "b").first()
    at = int(np.around(top["b"] * thres_mul))
    if at > bins:
        warnings.warn("the threshold is out of range; seeds are unchanged", stacklevel=2)
        return seeds
    return _mask(seeds, high.withColumn("mask_int", F.col("value") > lo + (hi - lo) * at / bins), "mask_int")


def ks_refine(traces: DataFrame, seeds: DataFrame, sig: float = 0.01) -> DataFrame:
    """seeds with mask_ks: whether a seed's z-scores differ from a normal distribution at level sig."""
    p = map_traces(lambda x: [T.normal_ks(r)[1] for r in x], returns="double")
    return _mask(seeds, at_seeds(traces, seeds).withColumn("mask_ks", p < sig), "mask_ks")


def ks_statistic(traces: DataFrame) -> DataFrame:
    return traces.withColumn("d", map_traces(lambda x: [T.normal_ks(r)[0] for r in x], returns="double"))


def zscore_rank(cells: DataFrame, by: str = "unit_id") -> DataFrame:
    """(by, frame, z, rank): each trace's z-scores and their places in ascending order, ties by frame; null scores where it does not vary."""
    own = W.partitionBy(by)
    spread = F.stddev_pop("value").over(own)
    z = F.when(spread > 0, (F.col("value") - F.avg("value").over(own)) / spread)
    return cells.select(by, "frame", z.alias("z"), F.row_number().over(own.orderBy("value", "frame")).alias("rank"))


def seeds_merge(traces: DataFrame, projection: DataFrame, seeds: DataFrame, thres_dist: float = 5, thres_corr: float = 0.6, noise_freq: float | None = None) -> DataFrame:
    """seeds (id, height, width, ...) with mask_mrg: the brightest of each group of near, correlated seeds, and all others."""
    pairs = radius_pairs(seeds, thres_dist)
    rows = seeds.select("id", *HW).join(traces, HW).select("id", "y")
    linked = edge_correlation(pairs.select("src", "dst"), rows, "id", noise_freq).where(F.col("corr") > thres_corr)
    labels = connected_components(linked.select("src", "dst"), seeds.select("id"))
    bright = seeds.select("id", *HW).join(projection.withColumnRenamed("value", "_v"), HW).join(labels, F.col("id") == F.col("node"))
    best = bright.groupBy("label").agg(F.max_by("id", F.struct("_v", -F.col("id"))).alias("id")).select("id", F.lit(True).alias("_best"))
    return seeds.join(best, "id", "left").withColumn("mask_mrg", F.coalesce("_best", F.lit(False))).drop("_best")


#: Samples of a trace that meet at a time at most, and values of a region's pixels in a task.
SEGMENT, VALUES = 1024, 1 << 22


def _near_correlation(z: DataFrame, places: DataFrame, wnd: float) -> DataFrame:
    """(sh, sw, height, width, value): products of traces (height, width, t, z) at places with those of the pixels within wnd.

    Traces are cut into segments of samples, and the field into square regions that overlap by wnd. What a task holds is a
    segment of a region's pixels; a trace meets others once in each region, not once a pair, and a pair's parts are added up.
    """
    side = max(4 * math.ceil(wnd), 8)
    step = int(min(SEGMENT, max(16, VALUES // (side + 2 * math.ceil(wnd)) ** 2)))
    region = lambda c: F.floor(F.col(c) / side)
    around = lambda c: F.sequence(F.floor((F.col(c) - wnd) / side), F.floor((F.col(c) + wnd) / side))
    places = places.dropna().distinct()
    rows = z.join(places.withColumn("seed", F.lit(True)), HW, "left").select(*HW, "t", F.coalesce("seed", F.lit(False)).alias("seed"), "z")
    kinds = StructType([*rows.schema.fields, StructField("segment", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("z")
            ends = col.offsets.to_numpy()
            pieces = np.maximum(1, -(-np.diff(ends) // step))
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.append(np.repeat(ends[:-1], pieces) + step * nth, ends[-1]).astype(np.int32)
            of = pa.array(np.repeat(np.arange(b.num_rows), pieces))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in (*HW, "t", "seed")], pa.ListArray.from_arrays(pa.array(starts), col.values), pa.array(nth)], kinds.names)

    met = rows.mapInArrow(cut, kinds).withColumn("rh", F.explode(around("height"))).withColumn("rw", F.explode(around("width")))
    met = met.join(places.select(region("height").alias("rh"), region("width").alias("rw")).distinct(), ["rh", "rw"])
    out = StructType([*[StructField(n, z.schema[c].dataType) for n, c in (("sh", "height"), ("sw", "width"))], *[z.schema[c] for c in HW], StructField("part", DoubleType())])

    def kernel(t: pa.Table) -> pa.Table:
        h, w, n, on, rh, rw = (t[c].to_numpy() for c in (*HW, "t", "seed", "rh", "rw"))
        x, _, _ = near.vectors(*[t["z"].combine_chunks()] * 2)
        own = np.flatnonzero(on & (np.floor(h / side) == rh) & (np.floor(w / side) == rw))
        at, parts = [], []
        for s in range(0, len(own), many := max(1, near.AT_ONCE // len(h))):
            some = own[s : s + many]
            d2 = (h[some, None].astype(float) - h) ** 2 + (w[some, None].astype(float) - w) ** 2
            i, j = np.nonzero((d2 <= wnd * wnd) & (d2 > 0))
            parts.append(np.where(n[some[i]] == n[j], (x[some] @ x.T)[i, j], 0.0))
            at.append(np.stack([some[i], j]))
        i, j = np.concatenate(at, 1) if at else np.zeros((2, 0), int)
        cols = [t[c].combine_chunks().take(pa.array(k)) for k in (i, j) for c in HW]
        return pa.table([*cols, pa.array(np.concatenate(parts) if parts else np.zeros(0))], out.names)

    return met.groupBy("rh", "rw", "segment").applyInArrow(kernel, out).groupBy("sh", "sw", *HW).agg(F.sum("part").alias("value"))


def init_a(traces: DataFrame, seeds: DataFrame, thres_corr: float = 0.8, wnd: float = 10, noise_freq: float | None = None) -> DataFrame:
    """(unit_id, height, width, value): correlation of each seed (id, height, width) with the pixels within wnd, where above thres_corr; 1 at the seed."""
    rows = traces if noise_freq is None else smooth(traces, noise_freq)
    z = unit_norm(rows.withColumn("_p", F.struct(*HW, F.coalesce(F.size("y"), F.lit(0)).alias("t"))), "_p").select("_p.*", "z")
    still = F.col("z").isNull()  # 0 with any other, as with traces of another length
    z = z.withColumns({"t": F.when(still, -1).otherwise(F.col("t")), "z": F.coalesce("z", F.array().cast("array<double>"))})
    found = _near_correlation(z, seeds.select(*HW), wnd).where(F.col("value") > thres_corr)
    at = seeds.select(F.col("id").alias("unit_id"), F.col("height").alias("sh"), F.col("width").alias("sw"))
    own = seeds.select(F.col("id").alias("unit_id"), *HW, F.lit(1.0).alias("value"))
    return at.join(found, ["sh", "sw"]).select("unit_id", *HW, "value").union(own)


def seed_counts(seeds: DataFrame, mask: str) -> DataFrame:
    return seeds.groupBy(F.coalesce(F.col(mask), F.lit(False)).alias("kept")).agg(F.count("*").alias("n"))
