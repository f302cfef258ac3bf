"""Approximate nearest neighbours by largest inner product: vantage-point trees per shard.

Inner products become distances by one more component: with M the largest norm, a vector x
gets sqrt(M^2 - |x|^2) and a query 0, so that the squared distance is |q|^2 + M^2 - 2 q.x.
Vectors are hashed into shards of bounded size; a tree is built for each and written as a
row of the index table. A tree splits its vectors at the median distance to a vantage
point; a query skips a half when the triangle inequality, relaxed by a factor, rules it
out: bound * factor > distance of its k-th best. Factor 1 is exact; a greater one skips
more.

Queries travel in blocks: each block meets each shard's tree once (a stated query set
against all rows), and each pair gives the best k of every query there, which a window
limited to k rows puts together. A shard and a block are bounded, whatever the data. Trees
and the blocks they meet are dealt out together and read one after another, so a task holds
one tree and one block.

Scores are sums in order of the components, in double precision, on the original vectors,
so equal vectors have equal scores. Equal vectors of a shard are one entry of its tree. Where
entries beyond those that a search holds may tie with its k-th row, all of the shard at or
above that score are taken.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part; vectors meet those of their own length only; rows with the query's own key are no candidates; ties go to the
smaller key; an empty table gives an empty result; repeated rows are candidates each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, discard, save, scratch, take_over

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 32_768, 512, 512
#: Partitions of a stage, at most.
MOST_TASKS = 20_000
FACTOR = 1.0


class Tree:
    """A vantage-point tree over rows of a matrix."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # leaf: (start, end); inner: (vantage, inner lo, hi, outer lo, hi, inner, outer)
        self._build(points, 0, len(points), leaf, np.random.default_rng(5))

    def _build(self, points: np.ndarray, start: int, end: int, leaf: int, rng) -> int:
        at = len(self.nodes)
        if end - start <= leaf:
            self.nodes.append((start, end))
            return at
        self.nodes.append(())
        own = self.order[start:end]
        some = own[rng.integers(0, len(own), 8)]
        probe = points[own[rng.integers(0, len(own), 128)]]
        spread = [np.var(np.linalg.norm(probe - points[s], axis=1)) for s in some]
        vantage = points[some[int(np.argmax(spread))]].copy()
        d = np.linalg.norm(points[own] - vantage, axis=1)
        by = np.argsort(d, kind="stable")
        self.order[start:end], d = own[by], d[by]
        half = len(own) // 2
        inner = self._build(points, start, start + half, leaf, rng)
        outer = self._build(points, start + half, end, leaf, rng)
        self.nodes[at] = (vantage, d[0], d[half - 1], d[half], d[-1], inner, outer)
        return at


class Shard:
    """Vectors of one length with their keys; equal vectors are one entry."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, norm: float):
        order = np.argsort(keys, kind="stable")
        keys, vectors = keys[order], vectors[order]
        unique, back = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
        self.vectors = unique.view(vectors.dtype).reshape(len(unique), -1)
        by = np.argsort(back, kind="stable")
        self.keys, self.starts = keys[by], np.searchsorted(back[by], np.arange(len(unique) + 1))
        self.norm = norm
        full = self._lifted(self.vectors.astype(np.float64))
        tree = Tree(full)
        self.nodes, self.order = tree.nodes, tree.order

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - (x * x).sum(1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def search(self, keys: np.ndarray, queries: np.ndarray, k: int, factor: float) -> list[tuple]:
        """(query key, key, score) of each query's best k."""
        want = min(k + 9, len(self.order))  # its own entry, and what rounding may swap at the end
        ordered = self.vectors[self.order].astype(np.float64)
        q = queries.astype(np.float64)
        best = np.full((len(q), want), -np.inf)
        place = np.full((len(q), want), -1, np.int64)
        square = (q * q).sum(1) + self.norm**2
        lifted = np.concatenate([q, np.zeros((len(q), 1))], 1)

        def reach(rows: np.ndarray) -> np.ndarray:
            low = best[rows].min(1)
            return np.where(np.isneginf(low), np.inf, np.sqrt(np.maximum(square[rows] - 2 * low, 0)))

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            n = self.nodes[node]
            if len(n) == 2:
                start, end = n
                scores = np.concatenate([best[rows], q[rows] @ ordered[start:end].T], 1)
                places = np.concatenate([place[rows], np.broadcast_to(np.arange(start, end), (len(rows), end - start))], 1)
                top = np.argpartition(-scores, want - 1, axis=1)[:, :want]
                best[rows], place[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(places, top, 1)
                return
            vantage, a, b, c, e, inner, outer = n
            d = np.linalg.norm(lifted[rows] - vantage, axis=1)
            near = d <= (b + c) / 2
            visit(inner, rows[near])
            visit(outer, rows[~near])
            slack = 1e-9 * (1 + d)
            to_inner = np.maximum(np.maximum(d - b, a - d), 0) * factor <= reach(rows) + slack
            to_outer = np.maximum(np.maximum(c - d, d - e), 0) * factor <= reach(rows) + slack
            visit(outer, rows[near & to_outer])
            visit(inner, rows[~near & to_inner])

        visit(0, np.arange(len(q)))
        low = best.min(1)
        slack = 1e-15 * q.shape[1] * (1 + np.sqrt((q * q).sum(1)) * self.norm)
        out = []
        for n in range(len(q)):
            found, score = self._best(keys[n], q[n], self.order[place[n][place[n] >= 0]], k)
            least = score[k - 1] if len(score) == k else -np.inf
            if want < len(self.order) and low[n] >= least - slack[n]:  # entries that tie with the k-th may have been left out
                band = self.order[ordered @ q[n] >= least - slack[n]]
                found, score = self._best(keys[n], q[n], band, k)
            out += [(int(keys[n]), int(v), float(s)) for v, s in zip(found, score, strict=True)]
        return out

    def _best(self, key: int, q: np.ndarray, entries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and exact scores of the best k rows of some entries, by score, then key; the query's own key is left out."""
        score = np.zeros(len(entries))
        for i in range(len(q)):
            score += q[i] * self.vectors[entries, i].astype(np.float64)
        starts = self.starts[entries]
        sizes = np.minimum(self.starts[entries + 1] - starts, k + int((self.keys == key).sum()))
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        rows, score = self.keys[at], np.repeat(score, sizes)
        rows, score = rows[rows != key], score[rows != key]
        by = np.lexsort((rows, -score))[:k]
        return rows[by], score[by]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector array<float>, dim) of vectors that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(key).isNotNull() & v.isNotNull()).where(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(key).cast("long").alias("key"), v.alias("vector"), F.size(v).alias("dim"))


def _stream(batches: Iterator[pa.RecordBatch], group: list[str]):
    """(group values, keys, matrix) of consecutive rows that agree in group; vectors of a group have one length."""
    now, keys, parts = None, [], []
    for b in batches:
        marks = list(zip(*(b.column(c).to_pylist() for c in group), strict=True))
        ids, values = b.column("key").to_numpy(), b.column("vector")
        flat, ends = values.flatten().to_numpy(), values.offsets.to_numpy()
        at = 0
        while at < len(marks):
            end = at
            while end < len(marks) and marks[end] == marks[at]:
                end += 1
            if marks[at] != now:
                if keys:
                    yield now, np.concatenate(keys), np.concatenate(parts)
                now, keys, parts = marks[at], [], []
            keys.append(ids[at:end])
            width = ends[at + 1] - ends[at]
            base = ends[0]
            parts.append(flat[ends[at] - base : ends[end] - base].reshape(-1, width))
            at = end
    if keys:
        yield now, np.concatenate(keys), np.concatenate(parts)


def build_index(vectors: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index table: (dim, shard, tree binary), a row for each shard; written under path."""
    facts = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("norm"))
    shards = save(facts.select("dim", "norm", F.ceil(F.col("n") / shard_rows).alias("shards")), f"{path}/shards")
    placed = vectors.join(F.broadcast(shards), "dim")  # a row for each length of vector
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(3)), F.col("shards")))

    def build(batches):
        take_over("ann", lambda: None)
        for (dim, shard, norm), keys, x in _stream(batches, ["dim", "shard", "norm"]):
            data = pickle.dumps(Shard(keys, np.ascontiguousarray(x), norm), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int64()), pa.array([data], pa.binary())], names=["dim", "shard", "tree"])

    tasks = _spread(shards.agg(F.sum("shards").alias("n")).first()["n"] or 1)
    rows = bounded_batches(placed).select("key", "vector", "dim", "shard", "norm").repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard")
    return save(rows.mapInArrow(build, "dim int, shard long, tree binary"), f"{path}/trees")


def _spread(units: int) -> int:
    """Partitions for units of work that a hash deals out: several times as many, so that few meet."""
    return max(1, min(4 * units, MOST_TASKS))


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest k that the trees give.

    A unit of work is a shard's tree and a group of query blocks. While there are fewer trees than the session
    has tasks, groups are more and trees are copied to each; with more trees there is one group.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // query_rows))
    trees = max(1, index.count())
    groups = max(1, min(blocks, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // trees)))
    placed = queries.withColumn("block", F.pmod(F.xxhash64("key", F.lit(4)), F.lit(blocks)))

    def pack(batches):
        take_over("ann", lambda: None)
        for (dim, block), keys, x in _stream(batches, ["dim", "block"]):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([pickle.dumps((keys, x), protocol=5)], pa.binary())], names=["dim", "block", "data"])

    packed = bounded_batches(placed).repartition(_spread(blocks), "dim", "block").sortWithinPartitions("dim", "block").mapInArrow(pack, "dim int, block long, data binary")
    count = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    asked = packed.join(F.broadcast(count), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))  # a row for each length of vector
    asked = asked.select("dim", "shard", F.pmod("block", F.lit(groups)).alias("group"), F.lit(1).alias("kind"), "data")
    held = index.select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(0).alias("kind"), F.col("tree").alias("data"))
    unit = ["dim", "shard", "group"]
    rows = held.union(asked).repartition(_spread(trees * groups), *unit).sortWithinPartitions(*unit, "kind")

    def run(batches):
        take_over("ann", lambda: None)
        now, tree = None, None
        for b in batches:
            for *at, kind, data in zip(*(b.column(c).to_pylist() for c in (*unit, "kind")), b.column("data"), strict=True):
                if kind == 0:
                    now, tree = at, pickle.loads(data.as_buffer())
                elif at == now:
                    keys, x = pickle.loads(data.as_buffer())
                    got = tree.search(keys, x, k, factor)
                    cols = list(zip(*got, strict=True)) if got else [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_ann(spark, sf_dir):
    from .common import kept, table

    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    path = scratch(spark, "ann")
    index = build_index(vectors, path)
    out = kept(search(index, vectors.where("key % 20 = 0")))
    discard(spark, path)
    return out
