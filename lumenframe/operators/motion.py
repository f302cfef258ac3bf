"""Motion estimation and correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import shifts as K

_SHIFT = "dy double, dx double"


def pair_shifts(pairs: DataFrame, method: str = "xcorr", most: int = 10, local: bool = False, subpixel: bool = False) -> DataFrame:
    """dy, dx that move px_dst onto px_src for each row (height, width, px_src, px_dst), by xcorr or by template matching (ncc)."""

    @F.pandas_udf(_SHIFT)
    def run(h: pd.Series, w: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(h), 2))
        shapes = pd.Series(list(zip(h, w, strict=True)))
        for shape, at in shapes.groupby(shapes).groups.items():  # pairs of one shape go together
            x, y = (np.stack([np.asarray(s.iloc[i], float) for i in at]).reshape(len(at), *shape) for s in (a, b))
            out[np.asarray(at)] = K.xcorr_shifts(x, y) if method == "xcorr" else K.match_templates(x, y, most, local, subpixel)
        return pd.DataFrame(out, columns=["dy", "dx"])

    out = pairs.withColumn("_s", run("height", "width", "px_src", "px_dst"))
    return out.select("*", "_s.dy", "_s.dx").drop("_s", "px_src", "px_dst")


def _moved(kernel) -> Column:
    @F.pandas_udf("array<double>")
    def run(h: pd.Series, w: pd.Series, px: pd.Series, dy: pd.Series, dx: pd.Series) -> pd.Series:
        return pd.Series([kernel(np.asarray(p, float).reshape(hh, ww), y, x).ravel() for hh, ww, p, y, x in zip(h, w, px, dy, dx, strict=True)])

    return run("height", "width", "px", "dy", "dx")


def apply_shifts(frames: DataFrame, motion: DataFrame, fill: float = float("nan")) -> DataFrame:
    """Frames moved by whole pixels; motion is (frame, dy, dx)."""
    return frames.join(motion, "frame").withColumn("px", _moved(lambda f, y, x: I.shift_rounded(f, y, x, fill))).drop("dy", "dx")


def apply_transform(frames: DataFrame, motion: DataFrame, fill: float = 0.0) -> DataFrame:
    """Frames translated bilinearly."""
    return frames.join(motion, "frame").withColumn("px", _moved(lambda f, y, x: I.translate(f, y, x, fill))).drop("dy", "dx")


def estimate_motion(frames: DataFrame, by: list[str] | None = None, npart: int = 3, chunk: int = 64, how: str = "mean", mask: tuple[float, int] | float | None = None, circ_thres: float | None = None, max_sh: int = 100, alt_error: float | None = None) -> DataFrame:
    """(by, frame, dy, dx): hierarchical registration; see functions.shifts.estimate for mask, circ_thres, max_sh and alt_error.

    Level 0 registers chunks of consecutive frames, each chunk in one task, and leaves one template a chunk; each
    further level registers runs of npart * npart templates, until one is left for each group. A frame's shift is the
    sum over its levels, with mean 0. Levels are checkpointed: their kernels run once.
    """
    spark = frames.sparkSession
    by = by or []
    _checkpoints(spark)
    group = F.struct(*by) if by else F.lit(0)
    rows = frames.withColumn("_g", F.to_json(group) if by else F.lit("")).select("_g", F.col("frame").alias("_id"), "height", "width", F.col("px").cast("array<double>"))
    kind = "_g string, _id long, _chunk long, dy double, dx double, height int, width int, px array<double>, _first array<double>, _last array<double>"
    level, total = rows.withColumn("_chunk", F.floor(F.col("_id") / chunk)), None
    step = max(2, npart * npart)
    while True:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_id")
            h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
            stack = lambda c: np.stack(pdf[c].to_numpy()).reshape(-1, h, w).astype(float)
            if "_first" in pdf:  # templates
                template, s, ends = K.estimate(stack("px"), npart, how, alt_error=alt_error, ends=(stack("_first"), stack("_last")))
            else:
                template, s, ends = K.estimate(stack("px"), npart, how, mask, circ_thres, max_sh, alt_error)
            out = pd.DataFrame({"_g": pdf["_g"], "_id": pdf["_id"], "_chunk": pdf["_chunk"], "dy": s[:, 0], "dx": s[:, 1]})
            out["height"], out["width"] = h, w
            for name, image in (("px", template), ("_first", ends[0]), ("_last", ends[1])):
                out[name] = pd.Series([None] * len(out), dtype=object, index=out.index)
                out.iat[0, out.columns.get_loc(name)] = image.ravel()
            return out

        done = level.groupBy("_g", "_chunk").applyInPandas(kernel, kind).checkpoint()
        here = done.select("_g", "_id", "_chunk", "dy", "dx")
        if total is None:
            total = here.select("_g", F.col("_id").alias("frame"), "_chunk", "dy", "dx")
        else:
            up = here.select("_g", F.col("_id").alias("_c"), F.col("_chunk").alias("_n"), F.col("dy").alias("_y"), F.col("dx").alias("_x"))
            total = total.withColumnRenamed("_chunk", "_c").join(up, ["_g", "_c"]).select("_g", "frame", F.col("_n").alias("_chunk"), (F.col("dy") + F.col("_y")).alias("dy"), (F.col("dx") + F.col("_x")).alias("dx"))
        templates = done.where("px IS NOT NULL").select("_g", F.col("_chunk").alias("_id"), "height", "width", "px", "_first", "_last")
        if templates.groupBy("_g").count().where("count > 1").isEmpty():
            break
        level = templates.withColumn("_chunk", F.floor(F.col("_id") / step))
    mean = total.groupBy("_g").agg(F.avg("dy").alias("_my"), F.avg("dx").alias("_mx"))
    out = total.join(mean, "_g").select("_g", "frame", (F.col("dy") - F.col("_my")).alias("dy"), (F.col("dx") - F.col("_mx")).alias("dx"))
    if by:
        kinds = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in by)
        out = out.withColumn("_k", F.from_json("_g", kinds)).select(*[F.col(f"_k.{c}") for c in by], "frame", "dy", "dx")
    return out.drop("_g")


def mesh_size(height: int, width: int, pixels: int = 100) -> tuple[int, int]:
    """Control points a non-rigid field has on each axis: about one for so many pixels."""
    return max(1, round(height / pixels)), max(1, round(width / pixels))


def patch_shifts(pairs: DataFrame, patch: int) -> DataFrame:
    """Experimental non-rigid motion: (grid0, grid1, dy, dx) of the patches of each row (height, width, px_src, px_dst)."""

    @F.pandas_udf("array<struct<grid0:int,grid1:int,dy:double,dx:double>>")
    def run(h: pd.Series, w: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for hh, ww, x, y in zip(h, w, a, b, strict=True):
            field = K.patch_field(np.asarray(x, float).reshape(hh, ww), np.asarray(y, float).reshape(hh, ww), patch)
            out.append([{"grid0": i, "grid1": j, "dy": float(field[i, j, 0]), "dx": float(field[i, j, 1])} for i in range(field.shape[0]) for j in range(field.shape[1])])
        return pd.Series(out)

    out = pairs.withColumn("_s", F.explode(run("height", "width", "px_src", "px_dst")))
    return out.select("*", "_s.*").drop("_s", "px_src", "px_dst")


def estimate_fields(frames: DataFrame, template: DataFrame, patch: int) -> DataFrame:
    """(frame, grid0, grid1, dy, dx): experimental non-rigid motion of each frame onto a template, one row of (height, width, px)."""
    one = template.limit(1).select(F.col("px").alias("px_src"))
    pairs = frames.withColumnRenamed("px", "px_dst").crossJoin(F.broadcast(one))  # one row
    return patch_shifts(pairs, patch).select("frame", "grid0", "grid1", "dy", "dx")


def apply_fields(frames: DataFrame, fields: DataFrame, patch: int, fill: float = 0.0) -> DataFrame:
    """Frames moved by fields (frame, grid0, grid1, dy, dx) of patch shifts, bilinear between the patches' middles."""
    packed = fields.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("grid0", "grid1", "dy", "dx"))).alias("_f"))  # a frame's patches

    @F.pandas_udf("array<double>")
    def run(h: pd.Series, w: pd.Series, px: pd.Series, f: pd.Series) -> pd.Series:
        out = []
        for hh, ww, p, rows in zip(h, w, px, f, strict=True):
            field = np.zeros((max(r["grid0"] for r in rows) + 1, max(r["grid1"] for r in rows) + 1, 2))
            for r in rows:
                field[r["grid0"], r["grid1"]] = r["dy"], r["dx"]
            out.append(K.apply_field(np.asarray(p, float).reshape(hh, ww), field, patch, fill).ravel())
        return pd.Series(out)

    return frames.join(packed, "frame").withColumn("px", run("height", "width", "px", "_f")).drop("_f")


def template_quality(frames: DataFrame, most: int = 100) -> DataFrame:
    from .image import frame_scalar

    return frame_scalar(frames, lambda x: [K.template_quality(f, most) for f in x], "quality")


def _checkpoints(spark) -> None:
    """A checkpoint folder where the session has none, as in single-process tests."""
    import tempfile

    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumen-ckpt-"))
