"""Media columns: content-addressed payloads in tar shards.

Each task of the write packs its rows' payloads as 8-bit grey PNG members (named by the
payload's SHA-256) into one tar shard in the shared folder; a payload is stored once per
shard, whatever number of rows carries it. Rows keep (digest, shard, offset, length).
Metadata columns come from range reads of a member's first bytes (the PNG header alone);
features come from a range read of the member. Nothing is shuffled: copies that lie in
different shards are stored once in each, which costs less than moving every payload to its
digest's partition, and a hot payload costs no task more than one copy.

A task that runs again writes a shard under a new name; the index, written as a table,
names the shards of the attempts that succeeded only.

Defined results: null content is empty; empty content has one row of padding; repeated rows
share members; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, take_over

#: Samples in a row of the image, and the sample that fills the last row.
WIDTH, PAD = 576, 255
_SIGNATURE, _HEADER = b"\x89PNG\r\n\x1a\n", 33


def padded(content: bytes) -> bytes:
    """Content with PAD appended up to a positive multiple of WIDTH."""
    rows = max(1, -(-len(content) // WIDTH))
    return content + bytes([PAD]) * (rows * WIDTH - len(content))


def to_png(payload: bytes) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 ahead of each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from a PNG's first bytes."""
    if len(head) < _HEADER or head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG member")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(media: bytes) -> bytes:
    """The samples of a grey 8-bit PNG whose rows are not filtered."""
    width, height, _ = read_header(media)
    at, data = 8, b""
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data += media[at + 8 : at + 8 + n]
        at += n + 12
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, entropy in bits and the three commonest samples of a payload."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    top = sorted(range(256), key=lambda v: (-counts[v], v))[:3]
    mean = int(np.dot(counts, np.arange(256))) / len(payload)
    entropy = abs(float(-(p * np.log2(p)).sum()))
    return f"rows={len(payload) // WIDTH};mean={mean:.4f};entropy={entropy:.4f};top={','.join(map(str, top))}"


def write_shards(df: DataFrame, root: str, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Pack content (string or binary) into tar shards under root; the index is lazy: write it.

    Index: key, n_bytes, digest, shard, offset, length; offset and length are of the member's data.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "digest", "shard", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("media", lambda: None)
        store, top = fs.FileSystem.from_uri(root)
        shard, out, at, seen = f"shard-{uuid.uuid4().hex}.tar", None, 0, {}
        for b in batches:
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{shard}")
            rows: list[tuple] = []
            for content in b.column(1):
                raw = content.as_buffer()
                raw = b"" if raw is None else raw.to_pybytes()
                payload = padded(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    media = to_png(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    out.write(media + bytes(-len(media) % 512))
                    seen[digest] = (at + 512, len(media))
                    at += 512 + len(media) + -len(media) % 512
                rows.append((len(raw), digest, shard, *seen[digest]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], names=names)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    schema = f"`{key}` {kind}, n_bytes long, digest string, shard string, offset long, length long"
    return bounded_batches(df).select(key, content).mapInArrow(run, schema)


class _Reader:
    """Range reads of shards; one shard stays open."""

    def __init__(self, root: str):
        self.store, self.top = fs.FileSystem.from_uri(root)
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.store.open_input_file(f"{self.top}/{shard}")
        self.file.seek(offset)
        return self.file.read(length)


def _per_member(index: DataFrame, root: str, add: list[tuple[str, pa.DataType, str]], work) -> DataFrame:
    """The index with columns that work(read, offset, length, digest) gives; members that rows share are read once a task."""
    kinds = index.schema
    base = [f.name for f in kinds if f.name not in {n for n, _, _ in add}]

    def run(batches):
        take_over("media", lambda: None)
        reader, known = _Reader(root), {}
        for b in batches:
            out = []
            for shard, offset, length, digest in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                if (shard, offset) not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[shard, offset] = work(lambda n, s=shard, o=offset: reader.read(s, o, n), length, digest)
                out.append(known[shard, offset])
            cols = list(zip(*out, strict=True)) if out else [[]] * len(add)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in base), *(pa.array(c, k) for c, (_, k, _) in zip(cols, add, strict=True))], names=[*base, *(n for n, _, _ in add)])

    schema = ", ".join([*(f"`{c}` {kinds[c].dataType.simpleString()}" for c in base), *(f"{n} {t}" for n, _, t in add)])
    return index.select(*base).mapInArrow(run, schema)


def with_metadata(index: DataFrame, root: str) -> DataFrame:
    """Width, height and bits from the members' headers alone."""
    add = [("width", pa.int32(), "int"), ("height", pa.int32(), "int"), ("bits", pa.int32(), "int")]
    return _per_member(index, root, add, lambda read, length, digest: read_header(read(_HEADER)))


def with_features(index: DataFrame, root: str) -> DataFrame:
    """Metadata from the header, then digests and features of the payload as read back and verified."""
    add = [("width", pa.int32(), "int"), ("height", pa.int32(), "int"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]

    def work(read, length, digest):
        width, height, _ = read_header(read(_HEADER))
        media = read(length)
        payload = from_png(media)
        sha = hashlib.sha256(payload).hexdigest()
        if sha != digest or len(payload) != width * height:
            raise ValueError(f"member {digest} does not hold its payload")
        return width, height, len(payload), sha, zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)

    return _per_member(index, root, add, work)


def read_members(index: DataFrame, root: str) -> DataFrame:
    """The index with the payload bytes."""
    return _per_member(index, root, [("payload", pa.binary(), "binary")], lambda read, length, digest: (from_png(read(length)),))


def list_shard(data: bytes) -> list[tuple[str, int]]:
    """Names and sizes of a shard's members, by the standard tar reader."""
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return [(m.name, m.size) for m in t.getmembers()]


def op2_media(spark, sf_dir):
    from .common import save, scratch, table

    root = scratch(spark, "media")
    index = save(write_shards(table(spark, sf_dir, "documents"), f"{root}/shards"), f"{root}/index")
    out = with_features(index, f"{root}/shards")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", F.col("shard"), "offset")
