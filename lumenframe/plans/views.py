"""The engine's data model on the standard tables: vectors as 8 x 8 frames and as traces of 64 samples, labels as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LabelledFrame
from ..operators.cnmf import centroid

SIDE = 8
#: Columns of the wide field of view, whose pixels are vectors.
WIDE = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark, sf_dir) -> DataFrame:
    """(frame, height, width, px)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.col("embedding").cast("array<double>").alias("px"))


def movie(spark, sf_dir) -> DataFrame:
    """(frame, height, width, value)."""
    return LabelledFrame(frames(spark, sf_dir), ("frame", "height", "width"), layout="frame").to_cells().df


def traces(spark, sf_dir) -> DataFrame:
    """(unit_id, y)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").cast("array<double>").alias("y"))


def wide_traces(spark, sf_dir) -> DataFrame:
    """(height, width, y): each vector as the trace of a pixel of a field of WIDE columns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr(f"cast(vec_id div {WIDE} as int)").alias("height"), F.expr(f"cast(vec_id % {WIDE} as int)").alias("width"), F.col("embedding").cast("array<double>").alias("y"))


def trace_cells(spark, sf_dir) -> DataFrame:
    """(unit_id, frame, value)."""
    return LabelledFrame(traces(spark, sf_dir), ("unit_id", "frame"), layout="trace").to_cells().df


def pixel_traces(spark, sf_dir) -> DataFrame:
    """(height, width, y over frames)."""
    return LabelledFrame(frames(spark, sf_dir), ("frame", "height", "width"), layout="frame").to_traces().df


def footprints(spark, sf_dir) -> DataFrame:
    """(session, unit_id, height, width, value), positive values only."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("unit_id"), F.posexplode("embedding").alias("i", "v"))
    out = e.select("session", "unit_id", F.expr(f"cast(i div {SIDE} as int)").alias("height"), F.expr(f"cast(i % {SIDE} as int)").alias("width"), F.col("v").cast("double").alias("value"))
    return out.where("value > 0")


def points(spark, sf_dir) -> DataFrame:
    """(session, unit_id, height, width): centroids of footprints."""
    return centroid(footprints(spark, sf_dir), ["session", "unit_id"], SIDE, SIDE)


def seeds(spark, sf_dir) -> DataFrame:
    """Every third pixel as a seed (id, height, width)."""
    return spark.range(0, SIDE * SIDE, 3).select("id", F.expr(f"cast(id div {SIDE} as int)").alias("height"), F.expr(f"cast(id % {SIDE} as int)").alias("width"))
