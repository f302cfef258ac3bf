"""Operators on movies: frames (frame, height, width, px) through kernels, cells through aggregates."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images as K
from .blocks import map_frames, with_frames


def remove_background(frames: DataFrame, method: str, wnd: int, wrap_uint8: bool = False) -> DataFrame:
    """Frames less their local mean (uniform) or their opening (tophat). wrap_uint8 repeats unsigned wrap-around."""
    out = with_frames(frames, partial(K.background, method=method, wnd=wnd))
    return out.withColumn("px", F.transform("px", lambda v: F.pmod(v, F.lit(256.0)))) if wrap_uint8 else out


def denoise(frames: DataFrame, method: str, **how) -> DataFrame:
    return with_frames(frames, partial(K.denoise, method=method, **how))


def stripe_correction(cells: DataFrame, reduce_dim: str = "height", on: str = "mean") -> DataFrame:
    """Cells less the mean along reduce_dim of the temporal mean or max, or of their own frame."""
    keep = "width" if reduce_dim == "height" else "height"
    if on in ("mean", "max"):
        still = cells.groupBy("height", "width").agg((F.avg if on == "mean" else F.max)("value").alias("v"))
        stripe, by = still.groupBy(keep).agg(F.avg("v").alias("stripe")), [keep]
    elif on == "perframe":
        stripe, by = cells.groupBy("frame", keep).agg(F.avg("value").alias("stripe")), ["frame", keep]
    else:
        raise NotImplementedError(f"stripe correction on {on!r}")
    return cells.join(stripe, by).withColumn("value", F.col("value") - F.col("stripe")).drop("stripe")


def glow_removal(cells: DataFrame) -> DataFrame:
    """Each pixel less its minimum over frames."""
    low = cells.groupBy("height", "width").agg(F.min("value").alias("low"))
    return cells.join(low, ["height", "width"]).withColumn("value", F.col("value") - F.col("low")).drop("low")


def coarsen(cells: DataFrame, **factors: int) -> DataFrame:
    """Block means; a block's label is its smallest; incomplete blocks at the end go."""
    size = 1
    keys = []
    out = cells
    for dim, k in factors.items():
        out = out.withColumn(f"_{dim}", F.floor(F.col(dim) / k))
        size *= k
    for dim in ("frame", "height", "width"):
        keys.append(F.col(f"_{dim}") if dim in factors else F.col(dim))
    out = out.groupBy(*keys).agg(F.avg("value").alias("value"), F.count("*").alias("_n"), *[F.min(d).alias(f"_min_{d}") for d in factors])
    out = out.where(F.col("_n") == size)
    return out.select(*[F.col(f"_min_{d}").alias(d) if d in factors else F.col(d) for d in ("frame", "height", "width")], "value")


def local_extreme(frames: DataFrame, radius: int, kind: str = "max", diff: float = 0.0) -> DataFrame:
    return with_frames(frames, partial(K.local_extreme, radius=radius, kind=kind, diff=diff))


def local_max_roll(frames: DataFrame, k0: int, k1: int, diff: float) -> DataFrame:
    return with_frames(frames, lambda x: [K.local_max_roll(f, k0, k1, diff) for f in x])


def adaptive_mask(frames: DataFrame, above: float, size: int) -> DataFrame:
    return with_frames(frames, partial(K.adaptive_mask, above=above, size=size))


def morph(frames: DataFrame, kind: str, radius: int) -> DataFrame:
    """dilate or erode by a disk."""
    return with_frames(frames, lambda x: K.extreme(x, K.disk(radius), "max" if kind == "dilate" else "min"))


def dilate_cells(cells: DataFrame, radius: int, height: int, width: int, by: list[str]) -> DataFrame:
    """The pixels within a disk of sparse cells: (by, height, width), distinct."""
    offsets = F.array(*[F.struct(F.lit(int(a)).alias("dy"), F.lit(int(b)).alias("dx")) for a, b in K.disk(radius)])
    out = cells.select(*by, "height", "width", F.explode(offsets).alias("o"))
    out = out.select(*by, (F.col("height") + F.col("o.dy")).alias("height"), (F.col("width") + F.col("o.dx")).alias("width"))
    return out.where(F.col("height").between(0, height - 1) & F.col("width").between(0, width - 1)).distinct()


def label_image(frames: DataFrame, threshold: float) -> DataFrame:
    """Connected features (4 neighbours) of pixels above a threshold, numbered in scan order."""
    return with_frames(frames, lambda x: [K.label(f > threshold) for f in x])


def frame_summary(cells: DataFrame) -> DataFrame:
    """mean, max, min of each frame, and the mean's step from the frame before."""
    out = cells.groupBy("frame").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))
    # neighbours meet through a shifted join: no window over all frames in one task
    before = out.select((F.col("frame") + 1).alias("frame"), F.col("mean").alias("_before"))
    return out.join(before, "frame", "left").withColumn("diff", F.col("mean") - F.col("_before")).drop("_before")


def max_projection(cells: DataFrame) -> DataFrame:
    return cells.groupBy("height", "width").agg(F.max("value").alias("value"))


def mosaic(a: DataFrame, b: DataFrame, dim: str, offset: int) -> DataFrame:
    """b beside a: its labels of dim moved by offset."""
    return a.unionByName(b.withColumn(dim, (F.col(dim) + offset).cast(a.schema[dim].dataType)))


def frame_scalar(frames: DataFrame, kernel, name: str) -> DataFrame:
    return frames.withColumn(name, map_frames(kernel, returns="double"))


def sweep(frames: DataFrame, fn, **grids) -> DataFrame:
    """fn(frames, **parameters) for every combination of the grids, with the parameters as columns: a preview of few frames."""
    from functools import reduce
    from itertools import product

    names = list(grids)
    parts = []
    for values in product(*grids.values()):
        chosen = dict(zip(names, values, strict=True))
        parts.append(fn(frames, **chosen).withColumns({f"param_{k}": F.lit(v) for k, v in chosen.items()}))
    return reduce(DataFrame.unionByName, parts)


def footprint_summary(a: DataFrame) -> DataFrame:
    """(height, width, total, units): sum of footprints over each pixel and how many units cover it."""
    return a.groupBy("height", "width").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("units"))
