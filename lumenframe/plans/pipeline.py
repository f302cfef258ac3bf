"""The movie pipeline: load or take a movie, correct motion, find cells, factorise, and keep each stage in the store."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import assign
from ..model import LabelledFrame
from ..operators import algebra as A
from ..operators import cnmf as C
from ..operators import image as I
from ..operators import motion as M
from ..operators import seeds as D
from ..operators import signal as S
from ..operators.graph import edge_correlation
from ..sources import store

HW = ["height", "width"]
#: Pixels of an image that is broadcast.
BROADCAST_PIXELS = 4_000_000


@dataclass
class Config:
    denoise: dict | None = None
    background: dict | None = None
    motion: bool = True
    window: int = 500
    step: int = 200
    max_wnd: int = 10
    diff: float = 2.0
    pnr_freq: float = 0.1
    pnr_thres: float | str = 1.5
    ks_sig: float = 0.05
    merge_dist: float = 5.0
    merge_corr: float = 0.6
    init_corr: float = 0.6
    init_wnd: float = 10.0
    unit_corr: float = 0.8
    dilate: int = 3
    sparse_spatial: float = 0.01
    size_thres: tuple = (9, None)
    p: int = 1
    sparse_temporal: float = 1.0
    rounds: int = 1
    noise_freq: float = 0.06


def run(spark: SparkSession, frames: DataFrame, folder: str, cfg: Config | None = None) -> dict[str, DataFrame]:
    """Run all stages over (frame, height, width, px); returns the stored variables A, C, S, b, f, motion, max_proj, seeds."""
    cfg = cfg or Config()
    row = frames.agg(F.max("height").alias("h"), F.max("width").alias("w"), F.count("*").alias("n")).first()
    h, w, n = row["h"], row["w"], row["n"]
    cells = lambda f: LabelledFrame(f, ("frame", *HW), layout="frame").to_cells().df.select("frame", *HW, "value")
    keep = lambda df, name, order=None: store.save(df, folder, name, overwrite=True, order=order)

    if h * w <= BROADCAST_PIXELS:
        low = cells(frames).groupBy(*HW).agg(F.min("value").alias("low"))
        packed = low.agg(F.transform(F.array_sort(F.collect_list(F.struct(*HW, "low"))), lambda r: r["low"]).alias("low"))  # one image
        ref = frames.crossJoin(F.broadcast(packed)).withColumn("px", F.zip_with("px", "low", lambda a, b: a - b)).drop("low")
    else:
        ref = LabelledFrame(I.glow_removal(cells(frames)), ("frame", *HW)).to_frames(h, w).df
    if cfg.denoise:
        ref = I.denoise(ref, **cfg.denoise)
    if cfg.background:
        ref = I.remove_background(ref, **cfg.background)
    ref = keep(ref, "varr_ref", ["frame"])
    if cfg.motion:
        motion = keep(M.estimate_motion(ref), "motion")
        ref = M.apply_transform(ref, motion)
    else:
        motion = keep(ref.select("frame", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx")), "motion")
    y_fm = keep(ref, "Y_fm", ["frame"])
    y = cells(y_fm)
    y_hw = keep(LabelledFrame(y_fm, ("frame", *HW), layout="frame").to_traces().df, "Y_hw", HW)
    high = keep(I.max_projection(y), "max_proj")

    seeds = D.seeds_init(y, n, h, w, cfg.window, cfg.step, cfg.max_wnd, cfg.diff)
    seeds = D.pnr_refine(y_hw, seeds, cfg.pnr_freq, cfg.pnr_thres)
    seeds = D.ks_refine(y_hw, seeds, cfg.ks_sig).where("mask_pnr AND mask_ks")
    seeds = keep(seeds.withColumn("id", F.col("height").cast("long") * w + F.col("width")), "seeds_refined")
    seeds = keep(D.seeds_merge(y_hw, high, seeds, cfg.merge_dist, cfg.merge_corr, cfg.noise_freq).where("mask_mrg"), "seeds")

    a = keep(D.init_a(y_hw, seeds, cfg.init_corr, cfg.init_wnd, cfg.noise_freq), "A0", ["unit_id"])
    c = keep(C.init_c(y, a), "C0", ["unit_id"])
    a, c, _ = C.unit_merge(a, c, cfg.unit_corr)
    a, c = keep(a, "A", ["unit_id"]), keep(c, "C", ["unit_id"])
    sn = keep(S.noise_fft(y_hw).select(*HW, "sn"), "sn_spatial")
    b, f = C.update_background(y, a, c)
    b, f = keep(b, "b"), keep(f, "f")
    spikes = None
    for _ in range(cfg.rounds):
        traces = LabelledFrame(c, ("unit_id", "frame")).to_traces().df
        a2, norm = C.update_spatial(y_hw, a, traces, sn, cfg.dilate, cfg.sparse_spatial, h, w, cfg.size_thres)
        a2, norm = keep(a2, "A_new", ["unit_id"]), keep(norm, "norm")
        c = keep(c.join(norm, "unit_id").select("unit_id", "frame", (F.col("value") * F.col("norm")).alias("value")), "C_scaled")
        a = keep(a2, "A", ["unit_id"])
        b2, f2 = C.update_background(y, a, c)
        b, f = keep(b2, "b"), keep(f2, "f")
        yra = C.compute_trace(y, a, c, b, f)
        yra = keep(LabelledFrame(yra, ("unit_id", "frame")).to_traces().df, "YrA")
        t = keep(C.update_temporal(yra, cfg.noise_freq, cfg.p, penalty=cfg.sparse_temporal), "temporal")
        long = lambda col: t.select("unit_id", F.posexplode(col).alias("frame", "value")).select("unit_id", F.col("frame").cast("long").alias("frame"), "value")  # noqa: B023, E731
        c, spikes = keep(long("c"), "C", ["unit_id"]), keep(long("s"), "S", ["unit_id"])
        a = keep(A.mask_semi(a, t.select("unit_id"), ["unit_id"]), "A_kept", ["unit_id"])
    return {"A": a, "C": c, "S": spikes, "b": b, "f": f, "motion": motion, "max_proj": high, "seeds": seeds}


def evaluate(found: DataFrame, truth: DataFrame, least: float = 0.3, found_c: DataFrame | None = None, truth_c: DataFrame | None = None) -> dict:
    """Recall, precision and F1 of footprints against true ones, matched one to one by overlap (intersection over union).

    Overlaps are a join of cells; the assignment is solved on the driver, over each group of units that overlap. With traces
    (unit_id, y) of both, also the mean correlation of the matched ones.
    """
    x, y = found.select(F.col("unit_id").alias("u"), *HW), truth.select(F.col("unit_id").alias("v"), *HW)
    nx, ny = x.groupBy("u").agg(F.count("*").alias("nx")), y.groupBy("v").agg(F.count("*").alias("ny"))
    both = x.join(y, HW).groupBy("u", "v").agg(F.count("*").alias("k")).join(nx, "u").join(ny, "v")
    rows = both.select("u", "v", (F.col("k") / (F.col("nx") + F.col("ny") - F.col("k"))).alias("iou")).collect()
    import numpy as np

    parent: dict = {}

    def find(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for r in rows:
        parent[find(("u", r["u"]))] = find(("v", r["v"]))
    parts: dict = {}
    for r in rows:
        parts.setdefault(find(("u", r["u"])), []).append(r)
    pairs = []
    for part in parts.values():
        us, vs = ({k: i for i, k in enumerate(sorted({r[c] for r in part}))} for c in ("u", "v"))
        cost = np.zeros((len(us), len(vs)))
        for r in part:
            cost[us[r["u"]], vs[r["v"]]] = -r["iou"]
        names = list(us), list(vs)
        pairs += [(names[0][i], names[1][j], -cost[i, j]) for i, j in assign(cost) if -cost[i, j] >= least]
    n_found, n_true = nx.count(), ny.count()
    recall, precision = len(pairs) / max(1, n_true), len(pairs) / max(1, n_found)
    out = {"pairs": sorted(pairs), "recall": recall, "precision": precision, "f1": 2 * recall * precision / max(1e-12, recall + precision)}
    if found_c is not None and truth_c is not None and pairs:
        matched = found.sparkSession.createDataFrame([(("found", int(u)), ("true", int(v))) for u, v, _ in pairs], "src struct<side:string,id:long>, dst struct<side:string,id:long>")
        traces = reduce(DataFrame.unionByName, [df.select(F.struct(F.lit(side).alias("side"), F.col("unit_id").cast("long").alias("id")).alias("unit_id"), "y") for side, df in (("found", found_c), ("true", truth_c))])
        out["correlation"] = edge_correlation(matched, traces).agg(F.avg("corr").alias("r")).first()["r"]
    return out
