"""Queries of the engine's operators on the standard tables; their SQL is in oracle.py."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..model import each
from ..operators import algebra as A
from ..operators import cnmf as C
from ..operators import graph as G
from ..operators import image as I
from ..operators import motion as M
from ..operators import register as X
from ..operators import seeds as D
from ..operators import signal as S
from ..sources import store, video
from . import views as V

CELL, HW = ["frame", "height", "width"], ["height", "width"]


def _r(df, *cols: str, digits: int = 6):
    """Doubles rounded, without negative zeros; NaN as null."""
    for c in cols or ("value",):
        x = F.col(c)
        df = df.withColumn(c, F.nanvl(x, F.lit(None).cast("double")))
        at = F.abs(x) * 10.0**digits
        # round goes by way of decimal text; away from halves the nearest whole number is the same
        plain = (at < 1e9) & (F.abs(at - F.floor(at) - 0.5) > 1e-6)
        df = df.withColumn(c, F.when(plain, F.signum(x) * (F.floor(at + 0.5) / F.lit(10.0**digits))).otherwise(F.round(x, digits)) + F.lit(0.0))
    return df


def _cells(frames):
    from ..model import LabelledFrame

    return LabelledFrame(frames, ("frame", "height", "width"), layout="frame").to_cells().df.select(*CELL, "value")


def _trace_cells(traces):
    from ..model import LabelledFrame

    return LabelledFrame(traces.select("unit_id", "y"), ("unit_id", "frame"), layout="trace").to_cells().df


QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- algebra ---------------------------------------------------------------


@query
def sel_range(s, d):
    return _r(A.sel_range(V.movie(s, d), "frame", 10, 40))


@query
def sel_points(s, d):
    return _r(A.sel_points(V.movie(s, d), V.seeds(s, d).select(*HW), HW).select(*CELL, "value"))


@query
def mask_semi(s, d):
    keep = V.trace_cells(s, d).groupBy("unit_id").agg(F.max("value").alias("m")).where("m > 0.3")
    return _r(A.mask_semi(V.trace_cells(s, d), keep, ["unit_id"]))


@query
def stride_subset(s, d):
    return _r(A.stride(V.movie(s, d), "frame", 7))


@query
def take_index(s, d):
    return _r(A.take(V.movie(s, d), "frame", [5, 3, 5, 11]).select("pos", *CELL, "value"))


@query
def where_fill(s, d):
    return _r(A.where(V.movie(s, d), F.col("value") > 0.05, F.lit(-1.0)))


@query
def crop_to_mask(s, d):
    return _r(A.crop(V.movie(s, d), F.col("value") > 0.15, HW))


@query
def fill_drop(s, d):
    holes = V.movie(s, d).withColumn("value", F.when(F.col("value") > 0.1, F.col("value")))
    whole = A.dropna(holes.withColumn("row", F.col("frame") * 8 + F.col("height")), "row", "all")
    return _r(A.fill(whole.select(*CELL, "value")))


@query
def clip(s, d):
    return _r(A.clip(V.movie(s, d), -0.1, 0.1))


@query
def stack_unstack(s, d):
    wide = A.unstack(V.movie(s, d), ["frame", "height"], "width", list(range(8)))
    long = A.stack(wide, ["frame", "height"], "width")
    return _r(long.select("frame", "height", F.col("width").cast("int").alias("width"), "value"))


@query
def frames_to_traces(s, d):
    return V.pixel_traces(s, d).select(*HW, F.size("y").alias("n"), F.round(F.element_at("y", 1), 6).alias("first"), F.round(F.element_at("y", -1), 6).alias("last"))


@query
def align_arith(s, d):
    mean = V.movie(s, d).groupBy(*HW).agg(F.avg("value").alias("value"))
    return _r(A.combine(V.movie(s, d), mean, HW, lambda x, y: x - y).select(*CELL, "value"))


@query
def reindex_like(s, d):
    return _r(A.reindex(V.movie(s, d).where("value > 0"), V.movie(s, d).select(*CELL), CELL).select(*CELL, "value"))


@query
def isin_between(s, d):
    return _r(V.movie(s, d).where(F.col("height").isin(1, 3, 5) & F.col("width").between(2, 4) & F.col("value").isNotNull()))


@query
def sample_rows(s, d):
    return A.sample(V.movie(s, d).select(*CELL), 100, 3)


# --- sources and sinks -----------------------------------------------------


@query
def open_merge(s, d):
    a, b = V.movie(s, d).where("value > -0.1"), V.movie(s, d).where("value < 0.1")
    return _r(A.merge(a, b, CELL, ("a", "b")), "a", "b")


def _folder(s) -> str:
    root = s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not s.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/lumen-store-{uuid.uuid4().hex}"


@query
def open_multi(s, d):
    root = _folder(s)
    for label in sorted(r[0] for r in V.table(s, d, "embeddings").select("label").distinct().collect()):  # a store for each session
        part = V.footprints(s, d).where(F.col("session") == label).drop("session")
        store.save(part, f"{root}/animal0/session{label}/store", "A")
    out = store.open_many(s, root, {"animal": -2, "session": -1}, "A")
    return out.groupBy("animal", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def concat_dims(s, d):
    m = V.movie(s, d)
    return _r(A.concat([({"animal": "a", "session": 1}, m), ({"animal": "a", "session": 2}, m.withColumn("value", -F.col("value")))]))


@query
def save_reload(s, d):
    return _r(store.save(V.movie(s, d), _folder(s), "movie", order=["frame"]))


@query
def meta_coords(s, d):
    root = _folder(s)
    store.save(V.movie(s, d), root, "movie", {"animal": "m0"})
    store.update_meta(s, root, {"session": "s1"})
    return _r(store.open_variable(s, root, "movie"))


@query
def normalize_u8(s, d):
    out = _cells(video.to_uint8(V.frames(s, d)))
    return out.select(*CELL, F.col("value").cast("int").alias("value"))


@query
def mosaic_residual(s, d):
    y, a, c = _whole(s, d)
    parts = video.generate_videos(y, a, c, scale=1.0)
    return _r(I.mosaic(parts["movie"], parts["residual"], "width", 8), digits=4)


@query
def export_long(s, d):
    path = _folder(s)
    store.export_long(V.movie(s, d), path)
    return _r(s.read.schema("frame long, height int, width int, value double").option("header", True).csv(path))


# --- images ----------------------------------------------------------------


@query
def bg_uniform(s, d):
    return _r(_cells(I.remove_background(V.frames(s, d), "uniform", 3)))


@query
def bg_tophat(s, d):
    return _r(_cells(I.remove_background(V.frames(s, d), "tophat", 1)))


@query
def stripe_mean(s, d):
    return _r(I.stripe_correction(V.movie(s, d)).select(*CELL, "value"))


@query
def stripe_max(s, d):
    return _r(I.stripe_correction(V.movie(s, d), on="max").select(*CELL, "value"))


@query
def stripe_perframe(s, d):
    return _r(I.stripe_correction(V.movie(s, d), on="perframe").select(*CELL, "value"))


@query
def denoise_median(s, d):
    return _r(_cells(I.denoise(V.frames(s, d), "median", size=3)))


@query
def denoise_gaussian(s, d):
    return _r(_cells(I.denoise(V.frames(s, d), "gaussian", size=3, sigma=1.0)))


@query
def denoise_bilateral(s, d):
    return _r(_cells(I.denoise(V.frames(s, d), "bilateral", d=3, sigma_value=0.2, sigma_space=1.5)))


@query
def denoise_anisotropic(s, d):
    return _r(_cells(I.denoise(V.frames(s, d), "anisotropic", niter=3, kappa=0.3)))


@query
def glow_removal(s, d):
    return _r(I.glow_removal(V.movie(s, d)).select(*CELL, "value"))


@query
def coarsen_mean(s, d):
    return _r(I.coarsen(V.movie(s, d), frame=3, height=2))


@query
def local_extreme_max(s, d):
    return _cells(I.local_extreme(V.frames(s, d), 1, "max", 0.1)).withColumn("value", F.col("value").cast("int"))


@query
def local_extreme_min(s, d):
    return _cells(I.local_extreme(V.frames(s, d), 1, "min", 0.1)).withColumn("value", F.col("value").cast("int"))


@query
def adaptive_mask(s, d):
    return _cells(I.adaptive_mask(V.frames(s, d), 0.05, 3)).withColumn("value", F.col("value").cast("int"))


@query
def dilate(s, d):
    return _r(_cells(I.morph(V.frames(s, d), "dilate", 1)))


@query
def erode(s, d):
    return _r(_cells(I.morph(V.frames(s, d), "erode", 1)))


@query
def label_image(s, d):
    """Features by their first pixel, which names them alike however they are numbered."""
    cells = _cells(I.label_image(V.frames(s, d), 0.08)).where("value > 0")
    first = F.min(F.col("height") * 8 + F.col("width"))
    return cells.groupBy("frame", "value").agg(first.cast("int").alias("first"), F.count("*").alias("area")).drop("value")


@query
def minmax_norm(s, d):
    return _r(A.normalize(V.movie(s, d), ["frame"]).select(*CELL, "value"))


# --- motion ----------------------------------------------------------------


@query
def xcorr_shift(s, d):
    f = V.frames(s, d)
    nxt = f.select((F.col("frame") - 1).alias("frame"), F.col("px").alias("px_dst"))
    pairs = f.withColumnRenamed("px", "px_src").join(nxt, "frame")
    return _r(M.pair_shifts(pairs).select("frame", "dy", "dx"), "dy", "dx", digits=4)


def _motion(s, d):
    return V.frames(s, d).select("frame", (F.col("frame") % 5 - 2 + 0.25).alias("dy"), (F.col("frame") % 3 - 1 - 0.5).alias("dx"))


@query
def apply_shifts(s, d):
    whole = _motion(s, d).select("frame", F.bround("dy").alias("dy"), F.bround("dx").alias("dx"))
    return _r(_cells(M.apply_shifts(V.frames(s, d), whole)))


@query
def apply_transform(s, d):
    return _r(_cells(M.apply_transform(V.frames(s, d), _motion(s, d))))


@query
def match_template(s, d):
    f = V.frames(s, d)
    nxt = f.select((F.col("frame") - 1).alias("frame"), F.col("px").alias("px_dst"))
    return M.pair_shifts(f.withColumnRenamed("px", "px_src").join(nxt, "frame"), "ncc", 2).select("frame", "dy", "dx")


@query
def template_quality(s, d):
    return _r(M.template_quality(V.frames(s, d)).select("frame", "quality"), "quality")


@query
def estimate_motion(s, d):
    return _r(M.estimate_motion(V.frames(s, d)), "dy", "dx")


@query
def patch_shifts(s, d):
    f = V.frames(s, d)
    nxt = f.select((F.col("frame") - 1).alias("frame"), F.col("px").alias("px_dst"))
    out = M.patch_shifts(f.withColumnRenamed("px", "px_src").join(nxt, "frame"), 4)
    return out.select("frame", "grid0", "grid1", F.round("dy", 4).alias("dy"), F.round("dx", 4).alias("dx"))


# --- seeds -----------------------------------------------------------------


@query
def max_proj(s, d):
    return _r(I.max_projection(V.movie(s, d)))


@query
def seeds_windows(s, d):
    n = V.table(s, d, "embeddings").count()
    return _r(D.window_projections(V.movie(s, d), n, 100, 40).select("sample", *HW, "value"))


@query
def seeds_rolling(s, d):
    n = V.table(s, d, "embeddings").count()
    return D.seeds_init(V.movie(s, d), n, 8, 8, 100, 40, 4, 0.05)


@query
def local_max_roll(s, d):
    return _cells(I.local_max_roll(V.frames(s, d), 1, 3, 0.1)).where("value > 0").select(*CELL)


@query
def ptp_quantile(s, d):
    return _r(S.ptp_quantile(V.traces(s, d), (5, 95)).select("unit_id", "ptp"), "ptp")


@query
def pnr(s, d):
    return _r(S.pnr(V.traces(s, d), 0.25, (5, 95)).select("unit_id", "pnr"), "pnr", digits=5)


@query
def intensity_mask(s, d):
    out = D.intensity_refine(V.movie(s, d), V.seeds(s, d), 8, 8, 1.0)
    return out.select("id", *HW, "mask_int")


@query
def ks_zscore_rank(s, d):
    return _r(D.zscore_rank(V.trace_cells(s, d)), "z")


@query
def ks_distance(s, d):
    return _r(D.ks_statistic(V.traces(s, d)).select("unit_id", "d"), "d")


@query
def ks_mask(s, d):
    return D.ks_refine(V.pixel_traces(s, d), V.seeds(s, d), 0.05).select("id", *HW, "mask_ks")


@query
def gmm_mask(s, d):
    return D.gmm_refine(V.pixel_traces(s, d), V.seeds(s, d)).select("id", *HW, "mask_gmm")


@query
def pnr_mask(s, d):
    return D.pnr_refine(V.pixel_traces(s, d), V.seeds(s, d), 0.25, 1.5, (0.1, 99.9)).select("id", *HW, "mask_pnr")


@query
def radius_graph(s, d):
    p = V.points(s, d).select(F.col("unit_id").alias("id"), *HW)
    return _r(G.radius_pairs(p, 0.1), "distance")


@query
def seeds_merge(s, d):
    out = D.seeds_merge(V.pixel_traces(s, d), I.max_projection(V.movie(s, d)), V.seeds(s, d), 2.0, 0.05)
    return out.select("id", *HW, "mask_mrg")


@query
def init_a(s, d):
    return _r(D.init_a(V.pixel_traces(s, d), V.seeds(s, d), 0.05, 3.0))


@query
def init_c_single(s, d):
    """Units whose footprints do not overlap: runs of three pixels, weighted by the maximum projection."""
    a = I.max_projection(V.movie(s, d)).where("value > 0").withColumn("unit_id", F.expr("cast((height * 8 + width) div 3 as bigint)"))
    return _r(C.init_c(V.movie(s, d), a.select("unit_id", *HW, "value")).select("unit_id", "frame", "value"))


@query
def init_c_many(s, d):
    return _r(C.init_c(V.movie(s, d), V.footprints(s, d).drop("session")), digits=4)


# --- signals ---------------------------------------------------------------


def _noise(how):
    def run(s, d):
        return _r(S.noise_fft(V.traces(s, d), how=how).select("unit_id", "sn"), "sn")

    run.__name__ = f"noise_fft_{how}"
    return query(run)


for _how in ("mean", "median", "logmexp", "sum"):
    _noise(_how)


@query
def noise_welch(s, d):
    return _r(S.noise_welch(V.traces(s, d)).select("unit_id", "sn"), "sn")


@query
def smooth_low(s, d):
    return _r(_trace_cells(S.smooth(V.traces(s, d), 0.25)))


@query
def smooth_high(s, d):
    return _r(_trace_cells(S.smooth(V.traces(s, d), 0.25, btype="high")))


@query
def butter(s, d):
    return _r(_trace_cells(S.smooth(V.traces(s, d), 0.2, "butter")))


@query
def ar1(s, d):
    return _r(S.ar_coefficients(V.traces(s, d), 1, noise=0.05).select("unit_id", F.element_at("g", 1).alias("g")), "g", digits=5)


@query
def ar2(s, d):
    out = S.ar_coefficients(V.traces(s, d), 2, noise=0.05).select("unit_id", F.element_at("g", 1).alias("g1"), F.element_at("g", 2).alias("g2"))
    return _r(out, "g1", "g2", digits=4)


@query
def rising_run(s, d):
    return S.rising_run(V.traces(s, d)).select("unit_id", "p")


@query
def med_baseline(s, d):
    return _r(_trace_cells(S.median_baseline(V.traces(s, d), 5)))


@query
def ar_response(s, d):
    return _r(_trace_cells(S.ar_response(V.traces(s, d), [0.8])))


# --- factorisation ---------------------------------------------------------


def _whole(s, d):
    """The movie, all footprints and their traces."""
    return V.movie(s, d), V.footprints(s, d).drop("session"), V.trace_cells(s, d)


@query
def submask(s, d):
    return C.sub_mask(V.footprints(s, d).drop("session").where("value > 0.2"), 1, 8, 8)


@query
def compute_trace(s, d):
    y, a, c = _whole(s, d)
    return _r(C.compute_trace(y, a, c), digits=5)


@query
def jaccard_groups(s, d):
    return _r(C.jaccard_edges(V.footprints(s, d).drop("session"), 0.45), "jaccard")


@query
def post_scale(s, d):
    x = V.trace_cells(s, d)
    y = x.withColumn("value", F.col("value") * 2 + F.col("frame") * 0.001)
    return _r(C.scale(x, y, ["unit_id", "frame"]), "scale")


@query
def atc(s, d):
    _, a, c = _whole(s, d)
    return _r(C.product(a, c), digits=5)


def _kinds(**parts):
    """Results of several layouts as one table."""
    none = {"unit_id": "long", "height": "int", "width": "int", "frame": "long"}
    rows = [df.select(F.lit(k).alias("kind"), *[F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()], "value") for k, df in parts.items()]
    return A.concat([({}, df) for df in rows])


@query
def unit_merge(s, d):
    _, a, c = _whole(s, d)
    a2, c2, labels = C.unit_merge(a, c, 0.4)
    return _r(_kinds(a=a2, c=c2, label=labels.withColumn("value", F.col("label").cast("double"))))


@query
def background(s, d):
    b, f = C.update_background(*_whole(s, d))
    return _r(_kinds(b=b, f=f), digits=5)


@query
def centroid(s, d):
    return _r(V.points(s, d), *HW)


@query
def update_spatial(s, d):
    """Every vector as the trace of a pixel of a wide field of view; pixels of even rows and columns are units."""
    y = V.wide_traces(s, d)
    units = y.where("height % 2 = 0 AND width % 2 = 0").withColumn("unit_id", F.col("height").cast("long") * V.WIDE + F.col("width"))
    a = units.select("unit_id", *HW, F.lit(1.0).alias("value"))
    height = -(-V.table(s, d, "embeddings").count() // V.WIDE)
    sn = S.noise_fft(y).select(*HW, "sn")
    out, _ = C.update_spatial(y, a, units.select("unit_id", "y"), sn, 1, 0.01, height, V.WIDE, (0, None))
    return _r(out)


@query
def update_temporal(s, d):
    out = C.update_temporal(V.traces(s, d), max_iters=60)
    cells = out.select("unit_id", "b", F.posexplode(F.arrays_zip("c", "s")).alias("frame", "r")).select("unit_id", "frame", "b", "r.c", "r.s")
    return _r(cells, "b", "c", "s", digits=4)


# --- graphs ----------------------------------------------------------------


@query
def edge_corr(s, d):
    p = V.points(s, d).select(F.col("unit_id").alias("id"), *HW)
    return _r(G.radius_correlation(p, V.traces(s, d), 0.2), "corr")


@query
def components(s, d):
    p = V.points(s, d).select(F.col("unit_id").alias("id"), *HW)
    return G.radius_components(p, 0.08)


@query
def canonical_edges(s, d):
    o = V.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return G.canonical(o)


@query
def kd_partition(s, d):
    p = V.points(s, d).select(F.col("unit_id").alias("id"), *HW)
    return G.kd_partition(p, 64)


@query
def partition_diag(s, d):
    p = V.points(s, d).select(F.col("unit_id").alias("id"), *HW)
    return _r(G.radius_diagnostics(p.withColumn("part", F.floor(F.col("height")).cast("long")), 0.15, n_frames=1000), "mib")


# --- sessions --------------------------------------------------------------


def _pairs(s, d):
    return X.pair_distance(V.points(s, d), 0.1)


@query
def fov_window(s, d):
    cells = V.movie(s, d).withColumn("value", F.when(F.col("value") > -0.1, F.col("value")))
    return X.fov_window(cells, [])


@query
def centroids_window(s, d):
    window = V.seeds(s, d).select(*HW)
    return _r(X.centroids_in(V.footprints(s, d), window, ["session", "unit_id"], 8, 8), *HW)


@query
def pair_distance(s, d):
    return _r(_pairs(s, d), "distance")


@query
def tile_pairs(s, d):
    return _r(X.tile_pairs(V.points(s, d), (1.0, 1.0)), "distance")


@query
def cartesian(s, d):
    """Every unit with every session."""
    p = V.points(s, d)
    return X.cartesian(p.select("unit_id"), p.select("session").distinct())


@query
def mutual_nn(s, d):
    return _r(X.mutual_pairs(V.points(s, d), 0.1), "distance")


def _mapping(s, d, mode):
    return X.resolve_mapping(X.mutual_pairs(V.points(s, d), 0.04), mode)


def _named(mapping):
    """Mappings named by their smallest node, as text."""
    node = F.concat_ws(":", F.lpad(F.col("session").cast("string"), 4, "0"), F.lpad(F.col("unit_id").cast("string"), 8, "0"))
    name = mapping.groupBy("mapping_id").agg(F.min(node).alias("mapping"))
    return mapping.join(name, "mapping_id").select("mapping", "session", "unit_id")


@query
def resolve_strict(s, d):
    return _named(_mapping(s, d, "strict"))


@query
def resolve_majority(s, d):
    return _named(_mapping(s, d, "majority"))


@query
def group_sessions(s, d):
    counts = X.mapping_counts(X.fill_mapping(_mapping(s, d, "strict"), V.points(s, d)))
    return counts.select(F.array_join(F.col("group").cast("array<string>"), ",").alias("sessions"), "n")


@query
def fill_mapping(s, d):
    return _named(X.fill_mapping(_mapping(s, d, "strict"), V.points(s, d)))


@query
def nn_order(s, d):
    return X.nn_order(V.points(s, d), ["session"]).select("session", "unit_id", "nn")


# --- views -----------------------------------------------------------------


@query
def frame_summary(s, d):
    return _r(I.frame_summary(V.movie(s, d)), "mean", "max", "min", "diff")


@query
def footprint_summary(s, d):
    return _r(I.footprint_summary(V.footprints(s, d)), "total", digits=4)


@query
def preview_sweep(s, d):
    out = I.sweep(V.frames(s, d), lambda f, wnd: I.remove_background(f, "uniform", wnd), wnd=[3, 5])
    cells = each(out, ["param_wnd", "frame"], "px", "i", "value")
    return _r(cells.select("param_wnd", "frame", F.expr("cast(i div 8 as int)").alias("height"), F.expr("cast(i % 8 as int)").alias("width"), "value"))


@query
def mapping_pivot(s, d):
    named = _named(_mapping(s, d, "strict")).withColumnRenamed("mapping", "mapping_id")
    wide = X.pivot_mapping(named, list(range(10)))
    return wide.select(F.col("mapping_id").alias("mapping"), *[F.col(str(i)).alias(f"session{i}") for i in range(10)])


@query
def unit_groups(s, d):
    order = V.points(s, d).select("unit_id", F.col("unit_id").alias("nn"))
    return X.unit_groups(order).groupBy("unit_group").agg(F.count("*").alias("n"))


@query
def unit_labels(s, d):
    labels = V.traces(s, d).select("unit_id", F.when(F.col("unit_id") % 10 == 0, -1).otherwise(F.expr("cast(unit_id div 3 as int)")).alias("unit_label"))
    return _r(X.apply_unit_labels(V.trace_cells(s, d), labels))


@query
def overlay_counts(s, d):
    mapping = X.fill_mapping(_mapping(s, d, "strict"), V.points(s, d))
    return X.overlay_counts(mapping, V.footprints(s, d))


@query
def seed_counts(s, d):
    return D.seed_counts(D.intensity_refine(V.movie(s, d), V.seeds(s, d), 8, 8, 1.0), "mask_int")
