"""LabelledFrame: a DataFrame with named dimensions in one of three layouts.

cell: a row for each scalar (dims..., value). frame: a row for each image (frame, height,
width, px array). trace: a row for each series (other dims..., y array over frame). The
class holds names and layout only; every method returns a lazy plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


def _transposed(frames: DataFrame, tile: int) -> DataFrame:
    """(height, width, y) of frames (frame, height, width, px) of one size.

    A batch of frames is turned where it is read, and cut into tiles of pixels; a tile's pieces meet in one task.
    """
    frames = frames.select("frame", *[F.col(c).cast("int").alias(c) for c in ("height", "width")], F.col("px").cast("array<double>").alias("px"))
    frame = frames.schema["frame"].dataType
    pieces = StructType([StructField("_at", IntegerType()), StructField("_w", IntegerType()), StructField("_frames", ArrayType(frame)), StructField("_cut", ArrayType(DoubleType()))])
    traces = StructType([StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("y", ArrayType(DoubleType()))])

    def lists(ends: np.ndarray, values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            size = np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width")])
            for h, w in np.unique(size, axis=1).T.tolist():
                some = np.flatnonzero((size[0] == h) & (size[1] == w))
                part = t if len(some) == t.num_rows else t.take(pa.array(some))
                px, n, m = part.column("px"), h * w, len(some)
                if px.null_count or (px.value_lengths().to_numpy() < n).any():
                    raise ValueError(f"an image has fewer than {h} x {w} pixels")
                flat = px.flatten().to_numpy(zero_copy_only=False)
                if len(flat) != n * m:
                    flat = np.concatenate([x[:n] for x in np.split(flat, np.cumsum(px.value_lengths().to_numpy())[:-1])])
                at = np.arange(0, n, tile, dtype=np.int32)
                values = pa.array(np.ascontiguousarray(flat.reshape(m, n).T).ravel())
                labels = part.column("frame").take(pa.array(np.tile(np.arange(m), len(at))))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), w, np.int32)), lists(np.arange(len(at) + 1) * m, labels), lists(np.append(at, n) * m, values)], pieces.names)

    def turn(t: pa.Table) -> pa.Table:
        at, w = t["_at"][0].as_py(), t["_w"][0].as_py()
        labels = pa.chunked_array([x.flatten() for x in t["_frames"].chunks]).combine_chunks()
        values = [x.values.to_numpy() for c in t["_cut"].chunks for x in c]
        sizes = [len(x) for c in t["_frames"].chunks for x in c]
        y, done = np.empty((len(values[0]) // sizes[0], len(labels))), 0
        for v, m in zip(values, sizes, strict=True):
            y[:, done : done + m] = v.reshape(len(y), m)
            done += m
        rank = pc.rank(labels, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        # frames of one label stand by their values, so that reruns agree
        y = y[:, np.argsort(rank) if rank.max() == len(rank) else np.lexsort([*y[::-1], rank])]
        pixel = np.arange(at, at + len(y), dtype=np.int32)
        return pa.table([pa.array(pixel // w), pa.array(pixel % w), lists(np.arange(len(y) + 1) * y.shape[1], pa.array(y.ravel()))], traces.names)

    return frames.mapInArrow(cut, pieces).groupBy("_at", "_w").applyInArrow(turn, traces)


def each(rows: DataFrame, keep: list, array: str, place: str, value: str) -> DataFrame:
    """keep, place and value for each element of an array column, as posexplode has them.

    From an inner posexplode Spark infers a filter on the array, and a kernel that makes the array runs twice, in two workers.
    """
    return rows.select(*keep, F.posexplode_outer(array).alias(place, value)).where(F.col(place).isNotNull())


@dataclass(frozen=True)
class LabelledFrame:
    df: DataFrame
    dims: tuple[str, ...]
    value: str = "value"
    layout: str = "cell"
    name: str = "array"

    def to_cells(self) -> LabelledFrame:
        if self.layout == "cell":
            return self
        if self.layout == "frame":
            rest = [c for c in self.df.columns if c not in ("height", "width", "px")]
            out = each(self.df, [*rest, F.col("width").alias("_w")], "px", "_i", self.value)
            out = out.select(*rest, F.expr("cast(_i div _w as int)").alias("height"), F.expr("cast(_i % _w as int)").alias("width"), self.value)
            return replace(self, df=out, dims=(*rest, "height", "width"), layout="cell")
        rest = [c for c in self.df.columns if c != "y"]
        out = each(self.df, rest, "y", "frame", self.value)
        return replace(self, df=out.withColumn("frame", F.col("frame").cast("long")), dims=(*rest, "frame"), layout="cell")

    def _blocks(self, by: list[str], order: list[str], name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*order, self.value)))
        packed = self.to_cells().df.groupBy(*by).agg(rows.alias("_rows"))
        return packed.withColumn(name, F.transform("_rows", lambda r: r[self.value])).drop("_rows")

    def to_traces(self, tile: int = 8) -> LabelledFrame:
        """A shuffle by all dims but frame; positions are ranks of the frames, so the array must be dense.

        Images are cut into tiles of so many pixels: the shuffle moves turned pieces of them, not cells. A task holds
        one tile's tile * frames values at a time.
        """
        if self.layout == "trace":
            return self
        if self.layout == "frame" and self.dims[0] == "frame":
            return replace(self, df=_transposed(self.df, tile), dims=("height", "width", "frame"), layout="trace")
        by = [d for d in self.to_cells().dims if d != "frame"]
        return replace(self, df=self._blocks(by, ["frame"], "y"), dims=(*by, "frame"), layout="trace")

    def to_frames(self, height: int, width: int) -> LabelledFrame:
        """Dense images in row order; fails where an image has gaps."""
        if self.layout == "frame":
            return self
        by = [d for d in self.to_cells().dims if d not in ("height", "width")]
        out = self._blocks(by, ["height", "width"], "px")
        whole = F.when(F.size("px") == height * width, F.col("px")).otherwise(F.raise_error("an image has gaps"))
        out = out.select(*by, F.lit(height).alias("height"), F.lit(width).alias("width"), whole.alias("px"))
        return replace(self, df=out, dims=(*by, "height", "width"), layout="frame")

    def rename(self, name: str) -> LabelledFrame:
        return replace(self, name=name)

    def sel(self, **ranges) -> LabelledFrame:
        """Ranges (low, high) with both ends, single labels, or lists of labels, of dims that are columns."""
        df = self.df
        for dim, r in ranges.items():
            c = F.col(dim)
            df = df.where(c.between(*r) if isinstance(r, tuple) else c.isin(list(r)) if isinstance(r, (list, set)) else c == r)
        return replace(self, df=df)

    def isel(self, dim: str, start: int = 0, step: int = 1) -> LabelledFrame:
        """Every step-th label from start, of a dim whose labels are counted from 0."""
        return replace(self, df=self.df.where((F.col(dim) >= start) & ((F.col(dim) - start) % step == 0)))

    def sizes(self) -> dict[str, int]:
        cells = self.to_cells()
        row = cells.df.agg(*[F.countDistinct(d).alias(d) for d in cells.dims]).first()
        return row.asDict()
