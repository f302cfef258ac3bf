"""Matrix factorisation on sparse footprints A (unit_id, height, width, value), traces C (unit_id, frame, value) and movies Y (frame, height, width, value).

Products are join-aggregates over non-zero cells; zeros stay implicit. Solvers run per pixel or per unit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import signals as S
from ..functions import solvers as K
from . import near
from .graph import connected_components, unit_norm
from .signal import smooth

HW = ["height", "width"]


def centroid(a: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """Centre of mass of each unit, as cm / H * (largest - smallest label); units without mass go."""
    mass = F.sum("value")
    out = a.groupBy(*by).agg(mass.alias("_m"), *[(F.sum(F.col(d) * F.col("value")) / mass / n * (n - 1)).alias(d) for d, n in (("height", height), ("width", width))])
    return out.where("_m > 0").select(*by, "height", "width")


def product(a: DataFrame, c: DataFrame) -> DataFrame:
    """AtC: sum over units of A * C, (frame, height, width, value)."""
    j = a.select("unit_id", *HW, F.col("value").alias("_a")).join(c, "unit_id")
    return j.groupBy("frame", *HW).agg(F.sum(F.col("_a") * F.col("value")).alias("value"))


def overlap(a: DataFrame) -> DataFrame:
    """(src, dst, shared): units with common non-zero pixels, src < dst."""
    left = a.select(F.col("unit_id").alias("src"), *HW)
    right = a.select(F.col("unit_id").alias("dst"), *HW)
    return left.join(right, HW).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def _support_blocks(a: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks of units (unit_id, px: codes of their pixels, and the columns of more), near ones together, and the pairs (a, b) whose extents meet."""
    ends = [f(d).alias(f"{n}_{d}") for d in HW for n, f in (("lo", F.min), ("hi", F.max))]
    units = a.groupBy("unit_id").agg(F.collect_list(F.col("height").cast("long") * (1 << 31) + F.col("width").cast("long")).alias("px"), *ends)
    units = units.withColumns({"_h": F.floor(F.col("lo_height") / 64), "_w": F.floor(F.col("lo_width") / 64)})
    units = units if more is None else units.join(more, "unit_id")
    blocks = near.pack(units, [], ["_h", "_w", "unit_id"]).drop("_h", "_w")
    ends = {s: blocks.select(F.col("block").alias(s), *[f(f"{n}_{d}").alias(f"{n}_{d}_{s}") for d in HW for n, f in (("lo", F.array_min), ("hi", F.array_max))]) for s in "ab"}
    meets = F.col("a") <= F.col("b")
    for d in HW:
        meets = meets & (F.col(f"lo_{d}_a") <= F.col(f"hi_{d}_b")) & (F.col(f"lo_{d}_b") <= F.col(f"hi_{d}_a"))
    pairs = ends["a"].join(F.broadcast(ends["b"]), meets).select("a", "b")  # a row for each block of units
    return blocks.select("block", *[c for c in blocks.columns if c != "block" and not c.startswith(("lo_", "hi_"))]), pairs


#: Pixels that supports are laid out over at once.
PIXELS = 1024


def _shared(a: pa.Array, b: pa.Array) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Pixels that each unit of a shares with each of b (None: no pixel at all), and each unit's pixels."""
    na, nb = (near.numbers(x.value_lengths()) for x in (a, b))
    pa_, pb = near.numbers(a.flatten()), near.numbers(b.flatten())
    common, out = np.intersect1d(pa_, pb), None
    for s in range(0, len(common), PIXELS):
        some = common[s : s + PIXELS]
        laid = []
        for px, n in ((pa_, na), (pb, nb)):
            at = np.minimum(np.searchsorted(some, px), len(some) - 1)
            on = some[at] == px
            row = np.repeat(np.arange(len(n)), n)
            laid.append(np.bincount(row[on] * len(some) + at[on], minlength=len(n) * len(some)).reshape(len(n), len(some)).astype(np.float32))
        m = laid[0] @ laid[1].T
        out = m if out is None else out + m
    return out, na, nb


def jaccard_edges(a: DataFrame, thres: float) -> DataFrame:
    """(src, dst, jaccard) of footprints whose supports overlap by more than thres: counts of shared pixels are products of blocks of supports."""
    blocks, pairs = _support_blocks(a)
    kind = a.schema["unit_id"].dataType

    def kernel(met):
        for x, y, a, b in met:
            shared, na, nb = _shared(a["px"], b["px"])
            if shared is None:
                continue
            bound = np.float32(thres / (1 + thres) * (1 - 1e-5)) if thres > -1 else None
            step = max(1, near.AT_ONCE // len(nb))
            for s in range(0, len(na), step):
                part = shared[s : s + step]
                hit = part > 0
                if bound is not None and bound > 0:  # in single precision first, loosely
                    hit &= part > bound * (na[s : s + step, None] + nb).astype(np.float32)
                k = np.flatnonzero(hit)
                i, j = np.divmod(k, len(nb))
                n = part.ravel()[k].astype(np.float64)
                i += s
                value = n / (na[i] + nb[j] - n)
                on = value > thres
                if x == y:
                    on &= i < j
                yield [a["unit_id"].take(pa.array(i[on])), b["unit_id"].take(pa.array(j[on])), value[on]]

    out = near.meet(blocks, pairs, kernel, StructType([StructField("x", kind), StructField("y", kind), StructField("jaccard", DoubleType())]))
    return out.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "jaccard")


def compute_trace(y: DataFrame, a: DataFrame, c: DataFrame, b: DataFrame | None = None, f: DataFrame | None = None) -> DataFrame:
    """(unit_id, frame, value): max(0, (Y - b f) A / |A|^2 - C AtA / |A|^2 + C)."""
    if b is not None:
        back = b.select(*HW, F.col("value").alias("_b"))
        y = y.join(back, HW, "left").join(f.select("frame", F.col("value").alias("_f")), "frame", "left")
        y = y.select("frame", *HW, (F.col("value") - F.coalesce(F.col("_b") * F.col("_f"), F.lit(0.0))).alias("value"))
    y = y.join(c.select("frame").distinct(), "frame", "left_semi")  # arrays align on frames; others would go at the end
    norm = a.groupBy("unit_id").agg(F.sum(F.col("value") * F.col("value")).alias("_n"))
    w = a.select("unit_id", *HW, F.col("value").alias("_a"))
    ya = y.join(w, HW).groupBy("unit_id", "frame").agg(F.sum(F.col("value") * F.col("_a")).alias("_ya"))
    # C AtA as (A C) A: over pixels, not over all pairs of overlapping units
    cross = product(a, c).join(w, HW).groupBy("unit_id", "frame").agg(F.sum(F.col("value") * F.col("_a")).alias("_gc"))
    out = ya.join(norm, "unit_id").join(cross, ["unit_id", "frame"]).join(c, ["unit_id", "frame"])
    return out.select("unit_id", "frame", F.greatest(F.lit(0.0), (F.col("_ya") - F.col("_gc")) / F.col("_n") + F.col("value")).alias("value"))


def update_background(y: DataFrame, a: DataFrame, c: DataFrame, b: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(b, f): mean over frames of Yb = max(0, Y - AC), and its least-squares trace sum b Yb / sum b^2."""
    ac = product(a, c).withColumnRenamed("value", "_ac")
    yb = y.join(ac, ["frame", *HW], "left").select("frame", *HW, F.greatest(F.lit(0.0), F.col("value") - F.coalesce("_ac", F.lit(0.0))).alias("value"))
    b = yb.groupBy(*HW).agg(F.avg("value").alias("value")) if b is None else b
    j = yb.join(b.select(*HW, F.col("value").alias("_b")), HW)
    f = j.groupBy("frame").agg((F.sum(F.col("_b") * F.col("value")) / F.sum(F.col("_b") * F.col("_b"))).alias("value"))
    return b, f


def scale(x: DataFrame, y: DataFrame, dims: list[str], by: str = "unit_id") -> DataFrame:
    """(by, scale): least-squares factor of y on x, sum x y / sum x^2."""
    j = x.join(y.select(*dims, F.col("value").alias("_y")), dims)
    return j.groupBy(by).agg((F.sum(F.col("value") * F.col("_y")) / F.sum(F.col("value") * F.col("value"))).alias("scale"))


def _correlated(a: DataFrame, traces: DataFrame, thres: float) -> DataFrame:
    """(src, dst): edges that connect the same units as all pairs of overlapping units whose traces correlate above thres.

    Correlations are products of blocks; each task gives a forest of what it found, an edge for each unit it met at most.
    """
    z = unit_norm(traces).join(traces.select("unit_id", F.size("y").alias("_t")), "unit_id")
    z = z.select("unit_id", F.coalesce("z", F.expr("transform(sequence(1, greatest(_t, 1)), x -> 0D)")).alias("z"))
    blocks, pairs = _support_blocks(a, z)
    kind = a.schema["unit_id"].dataType

    def kernel(met):
        found = near.Forest()
        for x, y, a, b in met:
            shared, na, nb = _shared(a["px"], b["px"])
            if shared is None:
                continue
            za, zb, fits = near.vectors(a["z"], b["z"])
            step = max(1, near.AT_ONCE // len(nb))
            for s in range(0, len(na), step):
                corr = za[s : s + step] @ zb.T
                if fits is not None:
                    corr = np.where(fits[s : s + step], corr, 0.0)
                i, j = np.nonzero((corr > thres) & (shared[s : s + step] > 0))
                i += s
                on = i < j if x == y else slice(None)
                found.join((x, a["unit_id"]), i[on], (y, b["unit_id"]), j[on])
        yield from found.edges()

    return near.meet(blocks, pairs, kernel, StructType([StructField("src", kind), StructField("dst", kind)]))


def unit_merge(a: DataFrame, c: DataFrame, thres_corr: float = 0.9, freq: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(A, C, labels): overlapping units whose traces correlate above thres become their group's mean, under its smallest id."""
    if not a.groupBy("unit_id").agg(F.sum("value").alias("m")).where("m = 0 OR m IS NULL").isEmpty():
        raise ValueError("footprints without mass")
    traces = c.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda r: r["value"]).alias("y"))
    labels = connected_components(_correlated(a, traces if freq is None else smooth(traces, freq), thres_corr), a.select("unit_id").distinct())
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    by = labels.join(n, "label").select(F.col("node").alias("unit_id"), "label", "n")
    a2 = a.join(by, "unit_id").groupBy(F.col("label").alias("unit_id"), *HW).agg((F.sum("value") / F.first("n")).alias("value"))
    c2 = c.join(by, "unit_id").groupBy(F.col("label").alias("unit_id"), "frame").agg(F.avg("value").alias("value"))
    return a2, c2, labels.select(F.col("node").alias("unit_id"), "label")


def sub_mask(a: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(unit_id, height, width): pixels that a unit may spread to, its support dilated by a disk."""
    from .image import dilate_cells

    return dilate_cells(a.where("value > 0"), radius, height, width, ["unit_id"])


def update_spatial(y: DataFrame, a: DataFrame, c: DataFrame, sn: DataFrame, radius: int = 5, penalty: float = 0.5, height: int = 0, width: int = 0, size_thres: tuple = (9, None), normalize: bool = True, f: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """(A, norm), and b if f is given: each pixel's trace by a non-negative lasso on the traces of its candidate units.

    y is in trace layout (height, width, y); c is (unit_id, y); sn is (height, width, sn). A pixel's row carries the
    traces of its own candidates only, so no task holds all units. Footprints of sizes outside the thresholds go; the rest are scaled by their largest value, which norm keeps.
    f is the background's trace, one row (y): it is a candidate of every pixel, and its weights are the new background b (height, width, value).
    """
    near = sub_mask(a, radius, height, width).join(c.select("unit_id", F.col("y").alias("_c")), "unit_id").withColumn("unit_id", F.col("unit_id").cast("long"))
    if f is not None:
        near = near.unionByName(y.select(*HW).crossJoin(F.broadcast(f.limit(1).select(F.lit(None).cast("long").alias("unit_id"), F.col("y").alias("_c")))))  # one row
    rows = near.groupBy(*HW).agg(F.collect_list(F.struct("unit_id", "_c")).alias("_units")).join(y, HW).join(sn, HW)

    @F.pandas_udf("array<double>")
    def solve(traces: pd.Series, units: pd.Series, noise: pd.Series) -> pd.Series:
        out = []
        for t, us, s in zip(traces, units, noise, strict=True):
            x = np.stack([np.asarray(u["_c"], float) for u in us], 1)
            out.append(K.nonnegative_lasso(x, np.asarray(t, float), penalty * s))
        return pd.Series(out)

    done = rows.withColumn("_w", solve("y", "_units", "sn"))
    cells = done.select(*HW, F.explode(F.arrays_zip(F.col("_units.unit_id").alias("unit_id"), F.col("_w").alias("value"))).alias("x"))
    every = cells.select("x.unit_id", *HW, "x.value").where("value > 0")
    cells = every.where("unit_id IS NOT NULL")
    size = cells.groupBy("unit_id").agg(F.count("*").alias("n"), F.max("value").alias("norm"))
    low, high = size_thres
    size = size.where(F.col("n") > (low or 0)) if high is None else size.where((F.col("n") > (low or 0)) & (F.col("n") < high))
    out = cells.join(size, "unit_id")
    value = F.col("value") / F.col("norm") if normalize else F.col("value")
    result = out.select("unit_id", *HW, value.alias("value")), size.select("unit_id", "norm")
    return result if f is None else (*result, every.where("unit_id IS NULL").select(*HW, "value"))


def overlap_groups(a: DataFrame, thres: float = 0.1) -> DataFrame:
    """(unit_id, label): groups of units whose footprints overlap by more than thres (Jaccard), directly or through others."""
    labels = connected_components(jaccard_edges(a, thres).select("src", "dst"), a.select("unit_id").distinct())
    return labels.select(F.col("node").alias("unit_id"), "label")


#: Samples of traces that are deconvolved together.
SOLVE_VALUES = 1 << 15


def update_temporal(yra: DataFrame, noise_freq: float = 0.25, p: int = 2, add_lag="p", penalty: float = 1.0, use_smooth: bool = True, med_wd: int | None = None, zero_thres: float = 1e-8, max_iters: int = 200, groups: DataFrame | None = None, warm: DataFrame | None = None, post_scal: bool = False) -> DataFrame:
    """(unit_id, c, s, b, c0, g) of traces (unit_id, y): each unit's AR model and deconvolution; units without positive values or spikes go.

    Units share no variables once their traces are given, so each is a row: a group of overlapping units of any size stays
    spread. What a group (unit_id, label; see overlap_groups) shares is the scale that its traces are solved at, the mean of
    their sums; without groups a unit is its own. warm (unit_id, s, b, c0) is where the solver starts. post_scal scales results by
    least squares onto the traces. A trace whose solution is not finite gets zeros, so its unit goes.
    """

    @F.pandas_udf("c array<double>, s array<double>, b double, c0 double, g array<double>")
    def solve(traces: pd.Series, totals: pd.Series, starts: pd.Series, firsts: pd.Series, decays: pd.Series) -> pd.DataFrame:
        rows: list = [None] * len(traces)
        lengths = traces.map(len).to_numpy()
        for length in np.unique(lengths):
            places = np.flatnonzero(lengths == length)
            most = max(1, SOLVE_VALUES // max(1, int(length)))
            for at in np.split(places, range(most, len(places), most)):
                fits = []
                for i in at:
                    total, given = totals.iloc[i], np.array(traces.iloc[i], np.float64)
                    norm = len(given) / total if total > 0 else 1.0
                    y = given * norm
                    noise = float(S.noise_fft(y[None], (noise_freq, 0.5))[0])
                    base = S.median_baseline(y[None], med_wd)[0] if med_wd else y
                    g = S.ar_coefficients(S.fft_filter(base, noise_freq, "low") if use_smooth else base, 0.0 if use_smooth else noise, p, add_lag)
                    roots = np.roots(np.concatenate([[1.0], -g]))
                    if (np.abs(roots) >= 1).any():  # an unstable fit decays at the edge of stability
                        g = -np.poly(np.where(np.abs(roots) >= 1, 0.98 * roots / np.maximum(np.abs(roots), 1e-12), roots))[1:].real
                    s0 = starts.iloc[i]
                    start = None if s0 is None else (np.array(s0, np.float64) * norm, float(firsts.iloc[i]) * norm, float(decays.iloc[i]) * norm)
                    g = np.append(g, np.zeros(p - len(g)))  # a root of zero is left out of the polynomial
                    fits.append((given, norm, noise, base, g, start))
                bases, gs, noises = (np.stack([f[k] for f in fits]) for k in (3, 4, 2))
                cs, ss, bs, firsts_ = K.deconvolve_many(bases, gs, noises, penalty, max_iters, [f[5] for f in fits])
                for i, (given, norm, _, _, g, _), c, s, b, c0 in zip(at, fits, cs, ss, bs.tolist(), firsts_.tolist(), strict=True):
                    if not (np.isfinite(c).all() and np.isfinite(s).all()):
                        c, s, b, c0 = np.zeros(len(c)), np.zeros(len(c)), 0.0, 0.0
                    back = 1 / norm
                    if post_scal and (c * c).sum() > 0:
                        back *= float(c @ given) * norm / float(c @ c)
                    rows[i] = (c * back, np.where(s > zero_thres, s, 0) * back, b * back, c0 * back, g)
        return pd.DataFrame(rows, columns=["c", "s", "b", "c0", "g"])

    rows = yra.where(F.exists("y", lambda v: v > 0)).withColumn("_total", F.aggregate("y", F.lit(0.0), lambda x, v: x + v))
    if groups is not None:
        own = rows.join(groups.select("unit_id", F.col("label").alias("_label")), "unit_id")
        rows = own.join(own.groupBy("_label").agg(F.avg("_total").alias("_mean")), "_label").withColumn("_total", F.col("_mean"))
    if warm is not None:
        rows = rows.join(warm.select("unit_id", F.col("s").alias("_s"), F.col("b").alias("_b"), F.col("c0").alias("_c0")), "unit_id", "left")
    else:
        rows = rows.withColumns({"_s": F.lit(None).cast("array<double>"), "_b": F.lit(None).cast("double"), "_c0": F.lit(None).cast("double")})
    out = rows.withColumn("_r", solve("y", "_total", "_s", "_b", "_c0"))
    return out.select("unit_id", "_r.*").where(F.exists("s", lambda v: v > 0))


#: Frames that one task solves for a component of units.
SOLVE_FRAMES = 256


def init_c(y: DataFrame, a: DataFrame, rounds: int = 10) -> DataFrame:
    """(unit_id, frame, value): least squares of every frame on the footprints, by at most `rounds` of conjugate gradients on the Gram matrix.

    The Gram matrix of overlapping units and A'Y are join-aggregates. Each component of overlapping units solves a run
    of SOLVE_FRAMES frames in a task, which gets the component's Gram matrix once. A component of more units than pixels
    takes the same steps over its pixels; see _init_c_pixels.
    """
    first = a.groupBy(*HW).agg(F.min("unit_id").alias("_first"))  # units of a pixel are connected through its first
    labels = connected_components(a.join(first, HW).select(F.col("_first").alias("src"), F.col("unit_id").alias("dst")), a.select("unit_id").distinct())
    named = a.join(labels, F.col("unit_id") == F.col("node")).select("label", "unit_id", *HW, "value")
    units, pixels = named.groupBy("label").agg(F.countDistinct("unit_id").alias("_n")), named.groupBy("label", *HW).agg(F.lit(1)).groupBy("label").agg(F.count("*").alias("_p"))
    crowded = units.join(pixels, "label").where("_p < _n").select("label").checkpoint()
    few = _init_c_units(y, named.join(crowded, "label", "left_anti"), rounds)
    return few if crowded.isEmpty() else few.union(_init_c_pixels(y, named.join(crowded, "label", "left_semi"), rounds))


def _init_c_pixels(y: DataFrame, a: DataFrame, rounds: int) -> DataFrame:
    """init_c of components (label, unit_id, height, width, value) with more units than pixels, without their Gram matrix of units.

    With AA' = V L V' over a component's pixels, its units' steps of conjugate gradients are those on the diagonal L, from
    L^1/2 V'Y, turned into units by A'V L^-1/2. Then blocks of units meet the solutions of runs of frames.
    """
    px = (F.col("height").cast("long") * (1 << 31) + F.col("width").cast("long")).alias("px")
    w = a.select("label", "unit_id", px, F.col("value").alias("_a"))
    other = w.select("unit_id", F.col("px").alias("_j"), F.col("_a").alias("_b"))
    gram = w.join(other, "unit_id").groupBy("label", F.col("px").alias("_i"), "_j").agg(F.sum(F.col("_a") * F.col("_b")).alias("_g"))
    places = a.select("label", *HW).distinct()
    rows = y.dropna(subset=["value"]).join(places, HW).select("label", F.floor(F.col("frame") / SOLVE_FRAMES).alias("run"), F.col("frame").cast("long").alias("frame"), px, "value")
    runs = rows.select(F.col("label").alias("_label"), F.col("run").alias("_run")).distinct()
    grams = gram.join(runs, F.col("label") == F.col("_label")).select("_label", "_run", "_i", "_j", "_g")

    def solve(found: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        ids, i = np.unique(entries["_i"].to_numpy(), return_inverse=True)
        frames, f = np.unique(found["frame"].to_numpy(), return_inverse=True)
        k, v = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(frames)))
        k[i, np.searchsorted(ids, entries["_j"].to_numpy())] = entries["_g"]
        np.add.at(v, (np.searchsorted(ids, found["px"].to_numpy()), f), found["value"].to_numpy())
        power, basis = np.linalg.eigh((k + k.T) / 2)
        on = power > power.max() * len(ids) * np.finfo(float).eps
        power, basis = power[on, None], basis[:, on]
        u = basis @ (_steps(lambda p: power * p, np.sqrt(power) * (basis.T @ v), rounds) / np.sqrt(power))
        return pd.DataFrame({"label": [found["label"].iloc[0]], "px": [ids], "frame": [frames], "u": [u.ravel()]})

    kind, named = a.schema["unit_id"].dataType, a.schema["label"].dataType.simpleString()
    solved = rows.groupBy("label", "run").cogroup(grams.groupBy("_label", "_run")).applyInPandas(solve, f"label {named}, px array<long>, frame array<long>, u array<double>")
    solved = solved.withColumn("block", F.monotonically_increasing_id()).checkpoint()
    units = w.groupBy("label", "unit_id").agg(F.collect_list("px").alias("px"), F.collect_list("_a").alias("w"))
    blocks = near.pack(units, ["label"], ["unit_id"], spread=True)
    pairs = blocks.select("label", F.col("block").alias("a")).join(solved.select("label", F.col("block").alias("b")), "label").select("a", "b")

    def kernel(met):
        for _, _, a, b in met:
            ids, frames = near.numbers(b["px"]), near.numbers(b["frame"])
            u = near.numbers(b["u"]).reshape(len(ids), len(frames))
            n = near.numbers(a["px"].value_lengths())
            at, weight, ends = np.searchsorted(ids, near.numbers(a["px"].flatten())), near.numbers(a["w"].flatten()), np.append(0, np.cumsum(n))
            step = max(1, near.AT_ONCE // max(len(ids), len(frames)))
            for s in range(0, len(n), step):
                e = min(len(n), s + step)
                cells = slice(ends[s], ends[e])
                dense = np.bincount(np.repeat(np.arange(e - s), n[s:e]) * len(ids) + at[cells], weight[cells], (e - s) * len(ids)).reshape(e - s, len(ids))
                yield [a["unit_id"].take(pa.array(np.repeat(np.arange(s, e), len(frames)))), np.tile(frames, e - s), (dense @ u).ravel()]

    return near.meet(blocks, pairs, kernel, StructType([StructField("unit_id", kind), StructField("frame", LongType()), StructField("value", DoubleType())]), solved)


def _steps(times, d: np.ndarray, rounds: int) -> np.ndarray:
    """Solutions of every column of d by conjugate gradients, a bounded number of rounds; times is the matrix's product."""
    c, p, s = np.zeros_like(d), d.copy(), (d * d).sum(0)
    for _ in range(rounds):
        q = times(p)
        slope = (p * q).sum(0)
        on = (s > 1e-28) & (slope > 0)
        if not on.any():
            break
        step = np.where(on, s / np.where(on, slope, 1), 0)
        c, d = c + step * p, d - step * q
        new = (d * d).sum(0)
        p = np.where(on, d + new / np.where(on, s, 1) * p, p)
        s = np.where(on, new, s)
    return c


def _init_c_units(y: DataFrame, named: DataFrame, rounds: int) -> DataFrame:
    """init_c of components (label, unit_id, height, width, value) by their Gram matrices of units."""
    a = named.drop("label")
    labels = named.select("label", F.col("unit_id").alias("node")).distinct()
    w = a.select("unit_id", *HW, F.col("value").alias("_a"))
    gram = w.join(a.select(F.col("unit_id").alias("_u"), *HW, F.col("value").alias("_v")), HW).groupBy("unit_id", "_u").agg(F.sum(F.col("_a") * F.col("_v")).alias("g"))
    ay = y.join(w, HW).groupBy("unit_id", "frame").agg(F.sum(F.col("value") * F.col("_a")).alias("v"))
    own = F.col("unit_id") == F.col("node")
    rows = ay.join(labels, own).select("label", F.floor(F.col("frame") / SOLVE_FRAMES).alias("run"), "unit_id", F.col("frame").cast("long"), "v")
    runs = rows.select(F.col("label").alias("_label"), F.col("run").alias("_run")).distinct()
    grams = gram.join(labels, own).join(runs, F.col("label") == F.col("_label")).select("_label", "_run", F.col("unit_id").alias("_i"), F.col("_u").alias("_j"), F.col("g").alias("_g"))

    def solve(found: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        ids, u = np.unique(entries["_i"].to_numpy(), return_inverse=True)
        frames, f = np.unique(found["frame"].to_numpy(), return_inverse=True)
        m, d = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(frames)))
        m[u, np.searchsorted(ids, entries["_j"].to_numpy())] = entries["_g"]
        d[np.searchsorted(ids, found["unit_id"].to_numpy()), f] = found["v"]
        c = _steps(lambda p: m @ p, d, rounds)
        return pd.DataFrame({"unit_id": np.repeat(ids, len(frames)), "frame": np.tile(frames, len(ids)), "value": c.ravel()})

    kind = named.schema["unit_id"].dataType.simpleString()
    return rows.groupBy("label", "run").cogroup(grams.groupBy("_label", "_run")).applyInPandas(solve, f"unit_id {kind}, frame long, value double")
