"""Movies from and to files: uncompressed 8-bit AVI, NPY, multi-page TIFF; others through ffmpeg where it is installed.

Readers split a file list into one row each through Spark's binaryFile source; frames leave as rows
(frame, height, width, px). Frame numbers run on over files in natural order: a first narrow pass counts each file's frames.
"""

from __future__ import annotations

import io
import re
import shutil
import struct
import subprocess
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def natural_key(name: str) -> list:
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


def ensure_ffmpeg() -> None:
    if shutil.which("ffmpeg") is None:
        raise RuntimeError("this container needs ffmpeg, which is not installed")


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield kind, at + 8, size
        at += 8 + size + size % 2


def decode_avi(data: bytes) -> np.ndarray:
    """Frames (n, h, w) of an uncompressed 8-bit AVI; anything else goes through ffmpeg."""
    width = height = bits = compression = 0
    frames: list[bytes] = []
    todo = [(12, len(data))]
    while todo:
        at, end = todo.pop()
        for kind, start, size in _chunks(data, at, end):
            if kind == b"LIST":
                todo.append((start + 4, min(end, start + size)))
            elif kind == b"strf" and size >= 40 and not width:
                width, height = struct.unpack("<ii", data[start + 4 : start + 12])
                bits, compression = struct.unpack("<H", data[start + 14 : start + 16])[0], struct.unpack("<I", data[start + 16 : start + 20])[0]
            elif kind in (b"00db", b"00dc"):
                frames.append(data[start : start + size])
    if bits != 8 or compression not in (0, 0x30303859, 0x59455247):
        return _ffmpeg(data, width, abs(height))
    stride = -(-width // 4) * 4
    out = np.stack([np.frombuffer(f[: stride * abs(height)], np.uint8).reshape(abs(height), stride)[:, :width] for f in frames]) if frames else np.empty((0, abs(height), width), np.uint8)
    return out[:, ::-1] if height > 0 and compression == 0 else out  # bottom-up rows


def _ffmpeg(data: bytes, width: int, height: int) -> np.ndarray:
    ensure_ffmpeg()
    with tempfile.NamedTemporaryFile(suffix=".avi") as f:
        f.write(data)
        f.flush()
        raw = subprocess.run(["ffmpeg", "-v", "error", "-i", f.name, "-f", "rawvideo", "-pix_fmt", "gray", "pipe:"], check=True, capture_output=True).stdout
    return np.frombuffer(raw, np.uint8).reshape(-1, height, width)


def count_frames(name: str, data: bytes) -> int:
    """Frames of a file from its headers; only files that ffmpeg decodes are decoded for it."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "npy":
        return _npy_shape(data)[0]
    if kind in ("tif", "tiff"):
        return sum(1 for _ in _tiff_pages(data))
    if kind == "avi":
        todo, n, plain = [(12, len(data))], 0, True
        while todo:
            at, end = todo.pop()
            for chunk, start, size in _chunks(data, at, end):
                if chunk == b"LIST":
                    todo.append((start + 4, min(end, start + size)))
                elif chunk == b"strf" and size >= 40:
                    plain &= struct.unpack("<H", data[start + 14 : start + 16])[0] == 8 and struct.unpack("<I", data[start + 16 : start + 20])[0] in (0, 0x30303859, 0x59455247)
                n += chunk in (b"00db", b"00dc")
        if plain:
            return n
    return len(decode(name, data))


def _npy_shape(data: bytes) -> tuple[int, ...]:
    stream = io.BytesIO(data)
    version = np.lib.format.read_magic(stream)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)[0]


class AviWriter:
    """An uncompressed 8-bit grey AVI (top-down Y800), written frame by frame; its counts are filled in at the end."""

    def __init__(self, out, fps: int = 30):
        self.out, self.fps, self.n, self.shape = out, fps, 0, (0, 0)

    def _head(self) -> bytes:
        chunk = lambda kind, d: kind + struct.pack("<I", len(d)) + d
        h, w = self.shape
        size = -(-w // 4) * 4 * h
        main = struct.pack("<14I", 1_000_000 // self.fps, size * self.fps, 0, 0x10, self.n, 0, 1, size, w, h, 0, 0, 0, 0)
        stream = b"vidsY800" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, self.fps, 0, self.n, size, 0xFFFFFFFF, 0, 0, 0, w, h)
        form = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0x30303859, size, 0, 0, 0, 0)
        head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
        body = 4 + self.n * (8 + size)
        total = 4 + len(head) + 8 + body
        if total >= 1 << 32:
            raise ValueError("an AVI holds 4 GB; write the movie in parts")
        return b"RIFF" + struct.pack("<I", total) + b"AVI " + head + b"LIST" + struct.pack("<I", body) + b"movi"

    def add(self, frame: np.ndarray) -> None:
        if not self.n:
            self.shape = frame.shape
            self.out.write(self._head())
        h, w = self.shape
        rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
        rows[:, :w] = frame
        self.out.write(b"00db" + struct.pack("<I", rows.size) + rows.tobytes())
        self.n += 1

    def close(self) -> None:
        self.out.seek(0)
        self.out.write(self._head())


def encode_avi(frames: np.ndarray, fps: int = 30) -> bytes:
    """A movie (n, h, w) as the bytes of an AVI."""
    out = io.BytesIO()
    writer = AviWriter(out, fps)
    writer.shape = frames.shape[1:]
    for f in frames:
        writer.add(f)
    writer.close()
    return out.getvalue()


def _tiff_pages(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(byte order, place, entries) of each page's directory."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    while at:
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        yield order, at, n
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def _unpack_runs(data: bytes) -> bytes:
    """Run-length packed bytes: a count of literal bytes, or of repeats of the next one."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


#: TIFF's numbers of the kinds of strips.
_UNPACK = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_runs}


def decode_tiff(data: bytes) -> np.ndarray:
    """Pages of a grey TIFF, 8, 16 or 32 bits, plain or in deflated or run-length strips."""
    pages = []
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
    for order, at, n in _tiff_pages(data):
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            place = at + 10 + 12 * i
            if size.get(kind, 1) * count > 4:
                place = struct.unpack(order + "I", data[place : place + 4])[0]
            form = {3: "H", 4: "I"}.get(kind)
            if form:
                tags[tag] = struct.unpack(f"{order}{count}{form}", data[place : place + size[kind] * count])
        packing = tags.get(259, (1,))[0]
        if packing not in _UNPACK or tags.get(317, (1,))[0] != 1:
            raise ValueError(f"TIFF compression {packing} is not supported")
        raw = b"".join(_UNPACK[packing](data[a : a + b]) for a, b in zip(tags[273], tags[279], strict=True))
        bits, form = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
        kind = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4"}[bits, form]
        pages.append(np.frombuffer(raw, order + kind).reshape(tags[257][0], tags[256][0]))
    return np.stack(pages)


def decode(name: str, data: bytes) -> np.ndarray:
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "npy":
        return np.load(io.BytesIO(data))
    if kind in ("tif", "tiff"):
        return decode_tiff(data)
    if kind == "avi":
        return decode_avi(data)
    raise ValueError(f"no decoder for {kind}")


def load_videos(spark: SparkSession, folder: str, pattern: str = r"msCam[0-9]+\.avi$", downsample: dict[str, int] | None = None, strategy: str = "subset", post_process=None) -> DataFrame:
    """A movie (frame, height, width, px) of a folder's files that match, in natural order of their names.

    downsample maps dims to factors; subset takes every k-th label, mean takes block means of whole blocks.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").rlike(pattern))

    @F.pandas_udf("long")
    def count(names: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([count_frames(n, d) for n, d in zip(names, data, strict=True)])

    # one row for each file of the folder: its name and number of frames
    counts = sorted(((r["name"], r["n"]) for r in files.select("name", count("name", "content").alias("n")).collect()), key=lambda r: natural_key(r[0]))
    if not counts:
        raise FileNotFoundError(f"no file of {folder} matches {pattern}")
    firsts, at = {}, 0
    for name, n in counts:
        firsts[name] = at
        at += n
    k = downsample or {}

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["name"], b["content"], strict=True):
                movie, first = decode(name, data), firsts[name]
                for i, f in enumerate(movie):
                    if strategy == "subset" and (first + i) % k.get("frame", 1):
                        continue
                    f = np.asarray(f, np.float64)
                    if strategy == "subset":
                        f = f[:: k.get("height", 1), :: k.get("width", 1)]
                    else:
                        a, c = k.get("height", 1), k.get("width", 1)
                        h, w = f.shape[0] // a * a, f.shape[1] // c * c
                        f = f[:h, :w].reshape(h // a, a, w // c, c).mean((1, 3))
                    yield pd.DataFrame({"frame": [first + i], "height": [f.shape[0]], "width": [f.shape[1]], "px": [f.ravel()]})

    out = files.select("name", "content").mapInPandas(frames, "frame long, height int, width int, px array<double>")
    step = k.get("frame", 1)
    if strategy == "mean" and step > 1:
        block = F.floor(F.col("frame") / step)
        cells = out.select(block.alias("b"), "frame", "height", "width", F.posexplode("px").alias("i", "v")).groupBy("b", "height", "width", "i").agg(F.avg("v").alias("v"), F.min("frame").alias("frame"), F.count("*").alias("n"))
        px = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"])
        out = cells.where(F.col("n") == step).groupBy("frame", "height", "width").agg(px.alias("px"))
    return post_process(out) if post_process else out


def to_uint8(frames: DataFrame) -> DataFrame:
    """Frames scaled so that the movie's least and greatest values are 0 and 255, as whole numbers."""
    ends = frames.agg(F.min(F.array_min("px")).alias("lo"), F.max(F.array_max("px")).alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    out = frames.crossJoin(F.broadcast(ends))  # one row
    return out.withColumn("px", F.transform("px", lambda v: F.floor((v - F.col("lo")) / span * 255.0).cast("int"))).drop("lo", "hi")


def write_video(frames: DataFrame, path: str, norm: bool = True, fps: int = 30) -> str:
    """One AVI of a movie: frames come in order, a partition at a time, and are written as they come; odd sizes are padded to even ones."""
    rows = (to_uint8(frames) if norm else frames).orderBy("frame").select("height", "width", "px").toLocalIterator(prefetchPartitions=True)
    with open(path, "wb") as out:
        writer = AviWriter(out, fps)
        for r in rows:
            f = np.clip(np.asarray(r["px"], float), 0, 255).astype(np.uint8).reshape(r["height"], r["width"])
            writer.add(np.pad(f, ((0, f.shape[0] % 2), (0, f.shape[1] % 2))))
        writer.close()
    return path


def generate_videos(y: DataFrame, a: DataFrame, c: DataFrame, scale: float | None = None, gain: float = 1.5) -> dict[str, DataFrame]:
    """Cells of the movie, of AC and of the residual, by gain 255 / max(Y) * gain; scale None fits Y on AC by least squares."""
    from ..operators.cnmf import product

    top = y.agg(F.max("value").alias("m")).first()["m"]
    k = 255.0 / top * gain
    ac = product(a, c)
    j = y.join(ac.withColumnRenamed("value", "ac"), ["frame", "height", "width"], "left").withColumn("ac", F.coalesce("ac", F.lit(0.0)))
    if scale is None:
        row = j.agg((F.sum(F.col("value") * F.col("ac")) / F.sum(F.col("ac") * F.col("ac"))).alias("s")).first()
        scale = row["s"] if row["s"] is not None else 1.0
    keys = ["frame", "height", "width"]
    return {"movie": j.select(*keys, (F.col("value") * k).alias("value")), "ac": j.select(*keys, (F.col("ac") * scale * k).alias("value")), "residual": j.select(*keys, ((F.col("value") - F.col("ac") * scale) * k).alias("value"))}
