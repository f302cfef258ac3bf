"""Pairs of rows by blocks: rows are packed into lists, blocks that may hold pairs meet once, and numpy compares them.

A pair's rows never go through a join: what is shuffled is blocks, and a task holds two of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .motion import _checkpoints

#: Rows of a block; an Arrow batch's end cuts blocks too.
BLOCK = 2048
#: Comparisons that a kernel makes at once, and rows that it gives at once.
AT_ONCE, ROWS = 1 << 18, 1 << 18


def tasks(spark) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(rows: DataFrame, keys: list[str], order: list[str], size: int = BLOCK, spread: bool = False) -> DataFrame:
    """(block, keys, a list for each other column): runs of at most size rows of the same keys, in the order given.

    Rows with null keys go. spread sorts over all tasks, so that few keys do not mean few tasks.
    """
    spark = rows.sparkSession
    _checkpoints(spark)
    rows = rows.dropna(subset=keys) if keys else rows
    placed = rows.orderBy(*keys, *order) if spread or not keys else rows.repartition(tasks(spark), *keys).sortWithinPartitions(*keys, *order)
    rest = [c for c in rows.columns if c not in keys]
    kinds = StructType([StructField("block", LongType()), *[rows.schema[c] for c in keys], *[StructField(c, ArrayType(rows.schema[c].dataType)) for c in rest]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for t in batches:
            n = t.num_rows
            if not n:
                continue
            new = np.arange(n) == 0
            for c in keys:
                col = t.column(c)
                new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            pieces = -(-np.diff(np.append(starts, n)) // size)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.repeat(starts, pieces) + size * nth
            ends = pa.array(np.append(starts, n).astype(np.int32))
            cols = [pa.array(at + np.arange(len(starts))), *[t.column(c).take(pa.array(starts)) for c in keys], *[pa.ListArray.from_arrays(ends, t.column(c)) for c in rest]]
            at += len(starts)
            yield pa.RecordBatch.from_arrays(cols, kinds.names)

    return placed.select(*keys, *rest).mapInArrow(cut, kinds).checkpoint()


def grid(rows: DataFrame, radius: float) -> DataFrame:
    """rows with the square cell (ch, cw) of their place; rows without a place go."""
    ok = rows.where(~F.isnan("height") & ~F.isnan("width"))
    return ok.withColumns({"ch": F.floor(F.col("height") / radius), "cw": F.floor(F.col("width") / radius)})


def neighbours(blocks: DataFrame, by: list[str], reach: int = 1, both: bool = False) -> DataFrame:
    """(a, b): blocks of cells at most reach apart, each pair once (a block with itself too), or from both sides."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if both or (i, j) >= (0, 0)]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    a = blocks.select(*by, F.col("block").alias("a"), "ch", "cw", F.explode(around).alias("o"))
    a = a.select(*by, "a", (F.col("ch") + F.col("o.i")).alias("ch"), (F.col("cw") + F.col("o.j")).alias("cw"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("_own"))
    j = a.join(blocks.select(*by, F.col("block").alias("b"), "ch", "cw"), [*by, "ch", "cw"])
    return (j if both else j.where("NOT _own OR a <= b")).select("a", "b")


def meet(blocks: DataFrame, pairs: DataFrame, kernel: Callable, schema: StructType, right: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Rows of kernel(met), met an iterator of (a, b, A, B) over pairs (a, b) of blocks; A and B hold a block's columns.

    kernel yields lists of arrays, one for each column of schema. whole: a block a meets all its blocks b in one task, one after the other.
    """
    spark = blocks.sparkSession
    right = blocks if right is None else right
    left = blocks.select(*[F.col(c).alias("a" if c == "block" else f"a_{c}") for c in blocks.columns])
    right = right.select(*[F.col(c).alias("b" if c == "block" else f"b_{c}") for c in right.columns])
    names = {s: [c for c in d.columns if c != s] for s, d in (("a", left), ("b", right))}
    n = tasks(spark)
    if whole:
        j = pairs.join(right, "b").repartition(n, "a").join(left, "a").sortWithinPartitions("a", "b")
    else:
        slices = max(1, -(-4 * n // max(1, left.count())))  # few blocks: their pairs are dealt to more tasks
        j = pairs.join(left, "a").withColumn("_s", F.pmod(F.xxhash64("a"), F.lit(slices)).cast("long")).repartition(n, "b", "_s")
        j = j.join(right.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))), ["b", "_s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met():
            for t in batches:
                at = {c: t.column(c) for c in t.schema.names}
                get = lambda c, i: at[c][i].values if pa.types.is_list(at[c].type) else at[c][i]
                for i in range(t.num_rows):
                    yield at["a"][i].as_py(), at["b"][i].as_py(), *[{c[2:]: get(c, i) for c in names[s]} for s in "ab"]

        held, rows = [], 0
        for cols in kernel(met()):
            t = pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in cols], schema.names)
            if t.num_rows:
                held, rows = [*held, t], rows + t.num_rows
            if rows >= ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=4 * ROWS)
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=4 * ROWS)

    return j.select("a", "b", *names["a"], *names["b"]).mapInArrow(run, schema)


def numbers(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def close(a: dict, b: dict, radius: float, strict: bool, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of places of a and b at most (strict: less than) radius apart; i < j where a block meets itself."""
    ah, aw, bh, bw = (numbers(x[c]) for x in (a, b) for c in ("height", "width"))
    step, bound = max(1, AT_ONCE // len(bh)), radius * radius * (1 + 1e-12)
    for s in range(0, len(ah), step):
        d, e = ah[s : s + step, None] - bh, aw[s : s + step, None] - bw
        d *= d
        e *= e
        d += e
        k = np.flatnonzero(d <= bound)
        i, j = np.divmod(k, len(bh))
        i += s
        d = np.sqrt(d.ravel()[k])
        on = d < radius if strict else d <= radius
        if own:
            on &= i < j
        yield i[on], j[on], d[on]


def vectors(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Lists of vectors as matrices of one width, and which pairs have one length (None: all)."""
    na, nb = (numbers(x.value_lengths()) for x in (a, b))
    wide, out = max(na.max(), nb.max()), []
    for x, n in ((a, na), (b, nb)):
        m, flat = np.zeros((len(n), wide)), numbers(x.flatten())
        m[np.arange(wide) < n[:, None]] = flat
        out.append(m)
    return *out, None if (na == wide).all() and (nb == wide).all() else na[:, None] == nb


class Forest:
    """Which rows of blocks are connected so far, in memory by the rows met."""

    def __init__(self):
        self.up, self.first, self.ids = np.zeros(0, np.int64), {}, []

    def _place(self, block: int, ids: pa.Array) -> int:
        if block not in self.first:
            self.first[block] = n = len(self.up)
            self.up = np.append(self.up, np.arange(n, n + len(ids)))
            self.ids.append(ids)
        return self.first[block]

    def join(self, a: tuple[int, pa.Array], i: np.ndarray, b: tuple[int, pa.Array], j: np.ndarray) -> None:
        if not len(i):
            return
        i, j = i + self._place(*a), j + self._place(*b)
        u, v = self.up[i], self.up[j]
        new = np.unique(np.stack([u, v], 1)[u != v], axis=0)
        if not len(new):
            return
        up = self.up

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in new.tolist():
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        while True:  # every row points at its root
            flat = up[up]
            if (flat == up).all():
                break
            up = flat
        self.up = up

    def edges(self) -> Iterator[list[pa.Array]]:
        if self.ids:
            ids = pa.concat_arrays(self.ids)
            on = np.flatnonzero(self.up != np.arange(len(self.up)))
            for s in range(0, len(on), ROWS):
                some = on[s : s + ROWS]
                yield [ids.take(pa.array(self.up[some])), ids.take(pa.array(some))]
