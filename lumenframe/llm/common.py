"""Shared pieces of the training-data operators: shared storage, hashing and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir, or the one set on the context).

    Only where the session names none (single-process tests) is a temporary folder set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lumen_root", None)
    if not root and (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        root = own.get()
        root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumen-")
        sc._lumen_root = root
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and read back: cuts the lineage with replicated files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths through Spark's own file system layer."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; its files go when no plan refers to them any more."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a batch that goes to a Python worker at once.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with this session's Arrow batches bounded by bytes: long texts would else make batches of any size.

    Spark reads the bound when a plan runs, which may be after the operator has returned, so it stays set; a
    lower bound of the caller's is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (conf.get(name, None) or "").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not taken."""
    while name in columns:
        name = f"_{name}"
    return name


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with, for each name, the sum of a column over all rows that come earlier in an order.

    Rows are sorted by ranges, ties by their place, so rows that agree in all of the order are spread too. Sums are
    taken within a partition and over the partitions before it; these are a row for each partition.
    """
    hidden = {n: unused(f"_own_{n}", df.columns) for n in sums}
    at, part = unused("_at", df.columns), unused("_part", df.columns)
    rows = df.withColumns({hidden[n]: c for n, c in sums.items()}).withColumn(at, F.monotonically_increasing_id())
    rows = kept(rows.orderBy(*order, at).withColumn(part, F.spark_partition_id()))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(part).agg(*[F.sum(h).alias(h) for h in hidden.values()])
    totals = totals.select(part, *[F.coalesce(F.sum(h).over(earlier), F.lit(0)).alias(f"{h}_before") for h in hidden.values()])
    within = W.partitionBy(part).orderBy(*order, at).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(totals), part)
    rows = rows.withColumns({n: F.col(f"{h}_before") + F.coalesce(F.sum(h).over(within), F.lit(0)) for n, h in hidden.items()})
    return rows.select(*df.columns, *sums)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    Returns (node, root) for every node with an edge to another one; root is the
    component's smallest node. All steps are joins and partial aggregates, each round is
    written, and only whether the stars have settled reaches the driver.
    """
    spark = edges.sparkSession

    def stars(e: DataFrame, both: bool) -> DataFrame:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a key of its own on the small side: both sides are then dealt for this join, and Spark may split a hub's rows
        low = low.withColumn("k", F.col("u").bitwiseXOR(F.lit(0).cast("long")))
        out = sym.withColumn("k", F.col("u").bitwiseXOR(F.lit(0).cast("long"))).join(low.drop("u"), "k").drop("k")
        if both:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def settled(e: DataFrame) -> bool:
        """Every node has one neighbour, and no neighbour has one: a star for each component."""
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

    path = scratch(spark, "cc")
    e = save(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u != v").distinct(), path)
    for _ in range(max_rounds):
        if settled(e):
            break
        nxt = scratch(spark, "cc")
        e = save(stars(stars(e, True), False), nxt)
        discard(spark, path)
        path = nxt
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = kept(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
    discard(spark, path)
    return out


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class WordHash:
    """64-bit hashes of whitespace-separated words, remembered up to a bound."""

    def __init__(self, bound: int = 100_000):
        self.memo: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = xxh3_64_intdigest(w)
        out = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(memo) > self.bound:
            memo.clear()
        return out


#: Bits of a filter that is sent to every executor: a fixed 512 KB, whatever the data.
FILTER_BITS = 22


def filter_of(df: DataFrame, hashed: str) -> np.ndarray:
    """A fixed-size filter of a column of 64-bit hashes. It may pass others (more as it fills), never drops one."""
    slots = df.select(F.col(hashed).bitwiseAND((1 << FILTER_BITS) - 1).cast("int").alias("s")).distinct().toArrow()["s"].to_numpy()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[slots] = True
    return np.packbits(bits)


def filter_passes(bits: np.ndarray, hashed: int) -> bool:
    s = hashed & ((1 << FILTER_BITS) - 1)
    return bool(bits[s >> 3] & (128 >> (s & 7)))


def blocks(column: pa.Array, most_bytes: int, most_rows: int):
    """(first row, values) of a string column in blocks of bounded bytes and rows (at least one row each), as bytes or None."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most_bytes or i + 1 - at >= most_rows or i + 1 == len(sizes):
            yield at, column.slice(at, i + 1 - at).cast(pa.binary()).to_pylist()
            at, total = i + 1, 0


_OWNER = [""]
_CACHES: dict[str, object] = {}


@cache
def _lean() -> object:
    """Lets a worker return freed memory: large blocks are mapped on their own, Arrow's come from the same allocator.

    Returns the C library's trimming function, or nothing where there is none.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        lib = ctypes.CDLL(None)
        lib.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        lib.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        return lib.malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def take_over(name: str, clear) -> None:
    """What a Python worker remembers for one operator goes when another begins to use the worker, and its memory is returned."""
    trim = _lean()
    if _OWNER[0] != name:
        for other in list(_CACHES):
            if other != name:
                _CACHES.pop(other)()
        _OWNER[0] = name
        gc.collect()
        trim(0)
    _CACHES[name] = clear
