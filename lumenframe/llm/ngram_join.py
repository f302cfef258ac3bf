"""N-gram Jaccard join with signature trees: exact groups of texts whose shingle sets overlap.

Two texts link when their sets of word shingles have a Jaccard similarity of at least
num/den. The join loses no link:

1. Blocks. Sizes fall into levels such that linked sets are in the same or neighbouring
   levels, which bounds their symmetric difference by d. Each set is dealt by hash into
   parts, and a key is the content of a part, or of two parts out of a group of four where
   the threshold would make single parts small. So many parts are dealt that whatever d
   differences touch, linked sets agree on spare + 1 keys at least. Keys of few shingles are
   left out if a set has no more than spare of them; a set that has more is dealt again, until
   it has not, with less asked of a key each time. Linked sets share a key in the first deal
   in which either stops, so no link is lost, and neither an empty part nor a passage that
   many texts share makes a key by itself. Equal keys inside a batch become links to the
   batch's smallest document before anything is shuffled, so a hot key has a row for each
   batch, not for each copy. Components of these candidate links are blocks; linked texts are
   always in one block.
2. Equal sets are one member of their block (its smallest document).
3. Signature trees. A block's members, by size and smallest shingle, are leaves of a tree
   whose nodes hold OR- and AND-combined bitmaps of shingles and the range of sizes. A dual
   traversal skips two nodes when the largest overlap these allow is below what their
   smallest sizes need, or when all their members are already in one component; what is
   left is decided exactly on the sets.
4. Large blocks are dealt into pieces. Each piece is joined by its own tree and nominates
   hubs (its best-linked members); every member is compared with its block's hubs; members
   outside the largest component then are compared with all of the block, in bounded seats. Pairs that are not compared are in one
   component already. Where these are many, as in a chain of texts that have little in common, blocks are first dealt anew by
   other hashes and split where those do not link.
5. Components of the links give the answer.

Defined results: null text, empty text and text without words have an empty set, linked
with nothing; a text of fewer words than a shingle has its whole sequence as one; rows that
repeat a key are one node; a null key takes no part and has a null component; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import FILTER_BITS, WordHash, blocks, bounded_batches, components, discard, filter_of, filter_passes, mix64, save, scratch, take_over, union_all

#: Keys of a batch; members and shingles of a block that one tree takes; hubs of a large block; members of a seat of it; members that are held against a seat at once; pairs of a task.
BATCH_KEYS, BLOCK_MEMBERS, BLOCK_SHINGLES, HUBS, SEATS, PACK, PAIRS_A_TASK = 400_000, 256, 2_000_000, 32, 256, 64, 4_000_000
#: Pairs that are left to compare, above which large blocks are dealt anew; and how often.
ANEW_PAIRS, ANEW = 50_000_000, 3
#: Fewest shingles of a key, deal by deal; in the last one all keys count, the empty ones too.
LEAST = (3, 3, 2, 2, *(1,) * 12, 0)
#: Shingles for each difference from which on single parts are large enough to be keys.
SINGLE = 6
#: Differences that a part has in mean where a chance of missing is allowed: the choices.
TOUCHED = (1.5, 1.75, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0)
#: Copies of a set are gathered in so many heaps first, then the heaps' least ones.
HEAPS = 64
#: Members up to which the fixed filter rules out most other documents.
FILTER_MEMBERS = 1 << (FILTER_BITS - 2)
_WORDS = WordHash()


def _begin() -> None:
    take_over("ngram", _WORDS.memo.clear)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = _WORDS(words)
    width = min(size, len(h))
    out = mix64(h[: len(h) - width + 1] + np.uint64(width))
    for i in range(1, width):
        out = mix64(out * np.uint64(3) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


class Plan(NamedTuple):
    """How sets of a level are dealt: keys of single parts (group 1) or of pairs out of groups of four; deals is 0 where LEAST decides."""

    differences: int
    spare: int
    parts: int
    group: int
    deals: int


class Levels:
    """Size levels of a threshold, and for each how its sets are dealt."""

    def __init__(self, num: int, den: int, miss: float = 0.0):
        self.num, self.den, self.miss = num, den, miss
        self.starts = [1, 2]
        self.plans: dict[int, Plan] = {}

    def _reach(self, n: int) -> None:
        while self.starts[-1] <= n + 1:
            self.starts.append(max(self.starts[-1] + 1, (self.starts[-1] - 1) * self.den // self.num + 1))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._reach(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.starts), sizes, side="right") - 1

    def sure(self, level: int) -> Plan:
        """Linked sets, of which the smaller is of this level, share spare + 1 keys whatever their differences touch.

        Groups of four parts with g + 1 + spare parts untouched, g being their number, hold spare + 1 untouched pairs.
        """
        self._reach(self.starts[min(level + 1, len(self.starts) - 1)])
        d = (self.starts[level + 1] - 1) * (self.den - self.num) // self.num
        if not d:
            return Plan(0, 0, 1, 1, 0)
        if self.num >= SINGLE * (self.den - self.num):
            spare = 2 + d // 24
            return Plan(d, spare, d + 1 + spare, 1, 0)
        spare = 1 + d // 12
        return Plan(d, spare, 4 * -(-(d + 1 + spare) // 3), 4, 0)

    def plan(self, level: int) -> Plan:
        """The sure way, or fewer keys where a chance of missing is allowed.

        Linked sets have d differences at most and c common shingles at least. A part of p is untouched and holds
        LEAST[0] common ones with probability q = (1 - 1/p)^d * P(Bin(c, 1/p) >= LEAST[0]). The numbers of both in
        the parts are negatively associated, so no part does with (1 - q)^p at most, and deals are independent.
        """
        if level not in self.plans:
            self.plans[level] = self._plan(level)
        return self.plans[level]

    def _plan(self, level: int) -> Plan:
        sure = self.sure(level)
        if not self.miss or not sure.differences:
            return sure
        d, c = sure.differences, -(-2 * self.num * self.starts[level] // (self.num + self.den))
        best, cost = sure, sure.parts * (1.5 if sure.group > 1 else 1)
        for touched in TOUCHED:
            p = int(d / touched)
            if p < 2:
                break
            few = sum(math.comb(c, i) * (1 / p) ** i * (1 - 1 / p) ** (c - i) for i in range(min(c + 1, LEAST[0])))
            missed = p * math.log1p(-((1 - 1 / p) ** d) * (1 - few))
            deals = math.ceil(math.log(self.miss) / missed) if missed else len(LEAST) + 1
            if deals <= len(LEAST) and deals * p <= cost:
                best, cost = Plan(d, 0, p, 1, deals), deals * p
        return best


_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def keys_of(sets: list[np.ndarray], levels: Levels, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its set in the list) of all sets; empty sets have none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out_keys, out_owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    if not sizes.sum():
        return out_keys[0], out_owner[0]
    level, starts = levels.of(np.maximum(sizes, 1)), np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.concatenate(sets)
    for step in (0, 1):
        at = level - step
        plans = {x: levels.plan(x) for x in set(at.tolist()) if x >= 0}
        table = np.array([plans.get(x, (0,) * 5) for x in at.tolist()], np.int64)
        todo = np.flatnonzero((sizes > 0) & (at >= 0) & ((step == 0) | (table[:, 0] > 0)))
        for time, least in enumerate(LEAST):
            if not len(todo):
                break
            _, spare, parts, group, deals = table[todo].T
            base = np.concatenate([[0], np.cumsum(parts)])
            own = np.repeat(np.arange(len(todo)), sizes[todo])
            tok = tokens[np.repeat(starts[todo] - np.concatenate([[0], np.cumsum(sizes[todo])[:-1]]), sizes[todo]) + np.arange(len(own))]
            deal = mix64((at[todo] * 64 + time).astype(np.uint64) + np.uint64(salt << 40))
            mixed = mix64(tok + deal[own])
            slot = base[own] + ((mixed >> np.uint64(40)) % parts[own].astype(np.uint64)).astype(np.int64)
            n = np.bincount(slot, minlength=base[-1])
            again = mix64(mixed)
            low = np.bincount(slot, (again & np.uint64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(np.uint64)
            high = np.bincount(slot, (again >> np.uint64(32)).astype(np.float64), base[-1]).astype(np.uint64)
            content = mix64(low) + mix64(high + np.uint64(1)) * np.uint64(3) + n.astype(np.uint64)
            whose = np.repeat(np.arange(len(todo)), parts)
            part = np.arange(base[-1]) - base[:-1][whose]
            content = mix64(content + mix64(deal[whose] + part.astype(np.uint64)))
            one = group[whose] == 1
            keys, owners, held = [content[one]], [whose[one]], [n[one]]
            first = np.flatnonzero(~one & (part % 4 == 0))
            for a, b in _PAIRS:
                keys.append(mix64(content[first + a] * np.uint64(3) + content[first + b]))
                owners.append(whose[first])
                held.append(n[first + a] + n[first + b])
            key, owner, held = np.concatenate(keys), np.concatenate(owners), np.concatenate(held)
            asked = np.where(deals > 0, LEAST[0], np.where(parts == 1, 0, np.where(group > 1, min(least, 2), least)))
            emit = held >= asked[owner]
            out_keys.append(key[emit])
            out_owner.append(todo[owner[emit]])
            over = np.where(deals > 0, time + 1 >= deals, np.bincount(owner, ~emit, len(todo)) <= spare)
            todo = todo[~over]
    return np.concatenate(out_keys), np.concatenate(out_owner)


def collapse(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, document) of the same links: one for each key, and pairs with its smallest document under keys of their own."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    head = docs[first][np.cumsum(first) - 1]
    other = ~first & (docs != head)
    pairs = np.unique(np.stack([docs[other], head[other]]), axis=1)
    own = mix64(mix64(pairs[0].astype(np.uint64)) * np.uint64(3) + pairs[1].astype(np.uint64))
    return np.concatenate([keys[first], own, own]), np.concatenate([docs[first], pairs[0], pairs[1]])


def _key_links(batches: Iterator[pa.RecordBatch], levels: Levels, sets_of, salt: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc) of batches whose last column sets_of turns into sets; a group column between, if any, is part of the key."""
    held_keys, held_docs, held = [], [], 0

    def flush():
        k, d = collapse(np.concatenate(held_keys), np.concatenate(held_docs))
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(d)], names=["key", "doc"])

    for b in batches:
        ids = b.column(0).to_numpy()
        group = b.column(1).to_numpy().view(np.uint64) if b.num_columns > 2 else None
        for i, values in blocks(b.column(b.num_columns - 1), 1_000_000, 500):
            k, owner = keys_of([sets_of(t) for t in values], levels, salt)
            owner = owner + i
            held_keys.append(k if group is None else mix64(k + mix64(group[owner] + np.uint64(1))))
            held_docs.append(ids[owner])
            held += len(k)
            if held > BATCH_KEYS:
                yield flush()
                held_keys, held_docs, held = [], [], 0
    if held:
        yield flush()


def _key_groups(keyed: DataFrame) -> DataFrame:
    """(src, dst) that connect the documents of equal keys."""
    head = F.first("doc").over(W.partitionBy("key").orderBy("doc").rowsBetween(W.unboundedPreceding, 0))
    return keyed.select(F.col("doc").alias("src"), head.alias("dst")).where("src != dst").distinct()


def candidate_links(docs: DataFrame, key: str, text: str, size: int, num: int, den: int, miss: float = 0.0) -> DataFrame:
    """(src, dst): links that contain every link between texts in their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        yield from _key_links(batches, Levels(num, den, miss), lambda t: shingles(t, size))

    rows = bounded_batches(docs).where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    return _key_groups(rows.mapInArrow(run, "key long, doc long"))


def split_blocks(members: DataFrame, path: str, num: int, den: int, miss: float, salt: int) -> DataFrame:
    """members (root, doc, n_shingles, tokens) under new roots: documents of a block that another deal does not connect come apart."""

    def run(batches):
        _begin()
        yield from _key_links(batches, Levels(num, den, miss), lambda t: np.frombuffer(t, np.uint64), salt)

    keyed = members.select("doc", "root", "tokens").mapInArrow(run, "key long, doc long")
    parts = components(save(_key_groups(keyed), f"{path}/again")).withColumnRenamed("root", "part")
    out = members.join(parts, F.col("doc") == F.col("node"))
    return save(out.select(F.col("part").alias("root"), "doc", "n_shingles", "tokens"), f"{path}/parts{salt}")


def facts_of(docs: DataFrame, members: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(doc, n_shingles, h1, h2, tokens) of every row; tokens only where the document may be a member.

    A filter of fixed size tells so while it is sparse; more members than that are joined.
    """
    sparse = members.count() <= FILTER_MEMBERS
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(members, "node") if sparse else None)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        _begin()
        for b in batches:
            for i, texts in blocks(b.column(2), 1_000_000, 1000):
                sets = [shingles(t, size) for t in texts]
                j = i + len(texts)
                ids, marks = (b.column(c).slice(i, j - i).to_pylist() for c in (0, 1))
                if bits.value is not None:
                    marks = [x is not None and filter_passes(bits.value, x) for x in ids]
                tokens = [s.tobytes() if mark and len(s) else None for s, mark in zip(sets, marks, strict=True)]
                sums = [(int(mix64(s).sum(dtype=np.uint64)), int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))) for s in sets]
                h = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
                cols = [b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "n_shingles", "h1", "h2", "tokens"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("_text"))
    if sparse:
        rows = rows.select("doc", F.lit(False).alias("_mark"), "_text")
    else:
        rows = rows.join(members.select("node"), F.col("doc") == F.col("node"), "left").select("doc", F.col("node").isNotNull().alias("_mark"), "_text")
    return bounded_batches(rows).mapInArrow(run, f"doc {kind}, n_shingles long, h1 long, h2 long, tokens binary")


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    n, m = len(a), len(b)
    if min(n, m) * den < num * max(n, m):
        return False
    small, large = (a, b) if n <= m else (b, a)
    at = np.searchsorted(large, small)
    inter = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * inter >= num * (n + m - inter)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class SignatureTree:
    """Sets of a block with the bitmaps and size ranges of a binary tree over them."""

    LEAF = 16

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        words = 1 << max(3, min(8, int(self.sizes.max() // 16).bit_length()))  # 512 to 16384 bits
        bits = np.zeros((len(sets), words * 8), np.uint8)
        flat = np.zeros((len(sets), words * 64), bool)
        for i, s in enumerate(sets):
            flat[i, (s % np.uint64(words * 64)).astype(np.int64)] = True
            bits[i] = np.packbits(flat[i])
        self.bits = bits.view(np.uint64)
        self.order = np.lexsort(([int(s[0]) for s in sets], self.sizes))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(sets))

    def _build(self, start: int, end: int) -> int:
        own = self.order[start:end]
        kids: tuple = ()
        if end - start > self.LEAF:
            half = (start + end) // 2
            kids = (self._build(start, half), self._build(half, end))
        bits = self.bits[own]
        self.nodes.append((start, end, kids, np.bitwise_or.reduce(bits), np.bitwise_and.reduce(bits), int(self.sizes[own].min()), int(self.sizes[own].max())))
        return len(self.nodes) - 1

    def join(self, num: int, den: int) -> list[tuple[int, int]]:
        """Links (places of sets) that connect what all links connect."""
        group = list(range(len(self.sets)))
        links: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        def single(node: int) -> int | None:
            start, end = self.nodes[node][:2]
            first = find(int(self.order[start]))
            return first if all(find(int(x)) == first for x in self.order[start + 1 : end]) else None

        def possible(x: tuple, y: tuple) -> bool:
            if x[6] * den < num * y[5] or y[6] * den < num * x[5]:
                return False
            most = min(x[6] - int(_popcount(x[4] & ~y[3])), y[6] - int(_popcount(y[4] & ~x[3])))
            return (num + den) * most >= num * (x[5] + y[5])

        def leaves(a: int, b: int) -> None:
            rows, cols = self.order[self.nodes[a][0] : self.nodes[a][1]], self.order[self.nodes[b][0] : self.nodes[b][1]]
            x, y = self.bits[rows][:, None], self.bits[cols][None]
            most = np.minimum(self.sizes[rows][:, None] - _popcount(x & ~y), self.sizes[cols][None] - _popcount(y & ~x))
            may = (num + den) * most >= num * (self.sizes[rows][:, None] + self.sizes[cols][None])
            for i, j in zip(*np.nonzero(may), strict=True):
                if a == b and i >= j:
                    continue
                p, q = int(rows[i]), int(cols[j])
                u, v = find(p), find(q)
                if u != v and linked(self.sets[p], self.sets[q], num, den):
                    group[max(u, v)] = min(u, v)
                    links.append((p, q))

        todo = [(self.root, self.root)]
        while todo:
            a, b = todo.pop()
            x, y = self.nodes[a], self.nodes[b]
            if a != b and not possible(x, y):
                continue
            one = single(a)
            if one is not None and (a == b or one == single(b)) and (x[1] - x[0] > 1 or a != b):
                continue
            if not x[2] and not y[2]:
                leaves(a, b)
            elif a == b:
                todo += [(x[2][0], x[2][1]), (x[2][1], x[2][1]), (x[2][0], x[2][0])]
            elif not y[2] or (x[2] and x[1] - x[0] >= y[1] - y[0]):
                todo += [(k, b) for k in x[2]]
            else:
                todo += [(a, k) for k in y[2]]
        return links


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]):
    """(group, documents, sets) of consecutive rows of the same group."""
    now, docs, sets = None, [], []
    for b in batches:
        for *g, doc, tokens in zip(*(b.column(c).to_pylist() for c in (*by, "doc", "tokens")), strict=True):
            if g != now:
                if docs:
                    yield now, docs, sets
                now, docs, sets = g, [], []
            docs.append(doc)
            sets.append(np.frombuffer(tokens, np.uint64))
    if docs:
        yield now, docs, sets


def _link_batch(links: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*links, strict=True)) if links else [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["src", "dst"])


def _tree_links(members: DataFrame, by: list[str], num: int, den: int, hubs: bool) -> DataFrame:
    """(src, dst) of each group's tree join; with hubs, rows (root, hub, score, tokens) of each group's best-linked members too."""

    def run(batches):
        for g, docs, sets in _groups(batches, by):
            links = SignatureTree(sets).join(num, den) if len(sets) > 1 else []
            pairs = [(docs[p], docs[q]) for p, q in links]
            if not hubs:
                if pairs:
                    yield _link_batch(pairs)
                continue
            # nearest to the group's majority: shingles that most of its sets hold
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            usual = token[2 * n > len(sets)]
            near = [2 * int(np.isin(s, usual, assume_unique=True).sum()) - len(s) for s in sets]
            best = sorted(range(len(sets)), key=lambda i: (-near[i], docs[i]))[:2]
            rows = [(g[0], a, b, None, None) for a, b in pairs] + [(g[0], docs[i], None, near[i], sets[i].tobytes()) for i in best]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["root", "src", "dst", "score", "tokens"])

    dealt = members.select(*by, "doc", "tokens").repartition(_tasks(members.sparkSession), *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "root long, src long, dst long, score long, tokens binary" if hubs else "src long, dst long")


def _tasks(spark, work: float = 0) -> int:
    """Tasks of a stage whose rows are small but costly, which would else be joined into few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / PAIRS_A_TASK))


class _Bench:
    """A bounded number of members that others are held against, group by group; links within one component are not looked for."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.docs, self.sets, self.ready = num, den, [], [], False
        self.group: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.group.setdefault(x, x)) != x:
            self.group[x] = self.group[up] if up in self.group else up
            x = up
        return x

    def seat(self, doc: int, comp: int, tokens: np.ndarray) -> None:
        self.docs.append((doc, comp))
        self.sets.append(tokens)

    def _bits(self, sets: list[np.ndarray]) -> np.ndarray:
        flat = np.zeros((len(sets), self.width), bool)
        for i, s in enumerate(sets):
            flat[i, (s % np.uint64(self.width)).astype(np.int64)] = True
        return np.packbits(flat, 1).view(np.uint64)

    def links(self, others: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        if not self.docs:
            return []
        if not self.ready:
            self.sizes = np.array([len(s) for s in self.sets])
            self.width = 1 << max(9, min(16, int(4 * self.sizes.max()).bit_length()))
            self.bits, self.ready = self._bits(self.sets), True
        sizes, bits, out = np.array([len(s) for _, _, s in others]), self._bits([s for _, _, s in others]), []
        for i, (doc, comp, tokens) in enumerate(others):
            most = np.minimum(self.sizes - _popcount(self.bits & ~bits[i]), sizes[i] - _popcount(bits[i] & ~self.bits))
            for j in np.flatnonzero((self.num + self.den) * most >= self.num * (self.sizes + sizes[i])).tolist():
                other, theirs = self.docs[j]
                a, b = self.find(comp), self.find(theirs)
                if a != b and linked(tokens, self.sets[j], self.num, self.den):
                    self.group[max(a, b)] = min(a, b)
                    out.append((doc, other))
        return out


def _compare(members: DataFrame, others: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst): links between a block's members and others of it; both (root, doc, comp, tokens), members with the block's size as members.

    Members are dealt into seats of bounded number; each seat holds its members and meets every other of its block in
    turn, a few at a time. Others are copied once for each seat, members are not.
    """
    seats = F.ceil(F.col("members") / SEATS)
    dealt = members.select("root", F.pmod(F.xxhash64("doc", F.lit(6)), seats).alias("seat"), F.lit(0).alias("kind"), "doc", "comp", "tokens")
    size = members.select("root", seats.alias("seats")).distinct()
    copied = others.join(size, "root").select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seats") - 1)).alias("seat"), F.lit(1).alias("kind"), "doc", "comp", "tokens")
    work = others.join(size, "root").agg(F.sum(F.col("seats") * SEATS).alias("w")).first()["w"] or 0

    def run(batches):
        now, bench, waiting = None, None, []
        for b in batches:
            links = []
            for root, seat, kind, doc, comp, tokens in zip(*(b.column(c).to_pylist() for c in ("root", "seat", "kind", "doc", "comp", "tokens")), strict=True):
                if (root, seat) != now:
                    if waiting:
                        links += bench.links(waiting)
                    now, bench, waiting = (root, seat), _Bench(num, den), []
                own = np.frombuffer(tokens, np.uint64)
                if kind == 0:
                    bench.seat(doc, comp, own)
                else:
                    waiting.append((doc, comp, own))
                    if len(waiting) == PACK:
                        links += bench.links(waiting)
                        waiting = []
            yield _link_batch(links)
        if waiting:
            yield _link_batch(bench.links(waiting))

    order = ["root", "seat", "kind"]
    rows = dealt.union(copied).repartition(_tasks(members.sparkSession, work), "root", "seat").sortWithinPartitions(*order)
    return rows.mapInArrow(run, "src long, dst long")


def _block_links(members: DataFrame, path: str, num: int, den: int, miss: float, time: int = 0) -> DataFrame:
    """Links inside blocks: members is (root, doc, n_shingles, tokens)."""
    sizes = members.groupBy("root").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")).where("members > 1")
    sizes = save(sizes.withColumn("large", (F.col("members") > BLOCK_MEMBERS) | (F.col("total") > BLOCK_SHINGLES)), f"{path}/sizes")
    links = _tree_links(members.join(sizes.where("NOT large"), "root"), ["root"], num, den, False)
    big = sizes.where("large").select("root", "members")
    if big.isEmpty():
        return links
    return links.union(_large_links(save(members.join(big, "root"), f"{path}/large"), path, num, den, miss, time))


def _large_links(members: DataFrame, path: str, num: int, den: int, miss: float, time: int) -> DataFrame:
    """Links inside large blocks: members is (root, members, doc, n_shingles, tokens)."""
    piece = F.pmod(F.xxhash64("doc", F.lit(9)), F.ceil(F.col("members") / (BLOCK_MEMBERS // 2)))
    dealt = members.withColumn("piece", piece)
    local = save(_tree_links(dealt, ["root", "piece"], num, den, True), f"{path}/local")
    inside = local.where("dst IS NOT NULL").select("src", "dst")
    ranked = local.where("dst IS NULL").withColumn("r", F.row_number().over(W.partitionBy("root").orderBy(F.desc("score"), "src"))).where(F.col("r") <= HUBS)
    hubs = ranked.select("root", F.col("src").alias("doc"), F.col("src").alias("comp"), "tokens")
    to_hubs = save(_compare(members.withColumn("comp", F.col("doc")), hubs, num, den), f"{path}/to_hubs")
    links = inside.union(to_hubs)
    comp = components(links)
    placed = members.join(comp.withColumnRenamed("root", "comp"), F.col("doc") == F.col("node"), "left").select("root", "members", "doc", "n_shingles", "tokens", F.coalesce("comp", "doc").alias("comp"))
    placed = save(placed, f"{path}/placed")
    sizes = placed.groupBy("root", "comp").agg(F.count("*").alias("n"), F.first("members").alias("members"))
    main = save(sizes.groupBy("root").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max("n").alias("most"), F.first("members").alias("members")), f"{path}/main")
    left = main.agg(F.sum((F.col("members") - F.col("most")) * F.col("members")).alias("n")).first()["n"] or 0
    if left > ANEW_PAIRS and time < ANEW:
        split = split_blocks(placed.select("root", "doc", "n_shingles", "tokens"), path, num, den, miss, time + 1)
        return links.union(_block_links(split, f"{path}/again{time}", num, den, miss, time + 1))
    rest = save(placed.join(main.select("root", "main"), "root").where("comp != main").select("root", "doc", "comp", "tokens"), f"{path}/rest")
    return links.union(save(_compare(placed, rest, num, den), f"{path}/more"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100, miss: float = 0.0) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key that links reach, the row's own included.

    The defaults are five words and a similarity of 0.8. miss bounds the probability that a linked pair shares no key;
    0 loses none. At low thresholds the sure way needs two keys for each difference; a miss of, say, 1e-15 gives long
    texts fewer ones (see Levels.plan), short texts stay sure.
    """
    spark = docs.sparkSession
    root = scratch(spark, "join")
    path = f"{root}/work"
    candidates = save(candidate_links(docs, key, text, size, num, den, miss), f"{path}/candidates")
    blocks = components(candidates)
    facts = save(facts_of(docs, blocks, key, text, size), f"{path}/facts")
    known = facts.where("tokens IS NOT NULL")
    same = ["n_shingles", "h1", "h2"]
    heap = F.pmod(F.xxhash64("doc", F.lit(8)), F.lit(HEAPS)).alias("heap")
    heaps = save(known.groupBy(*same, heap).agg(F.min("doc").alias("low")), f"{path}/heaps")
    heads = save(heaps.groupBy(*same).agg(F.min("low").alias("head")), f"{path}/heads")
    copies = known.select("doc", *same, heap).join(heaps, [*same, "heap"]).where("doc != low").select(F.col("doc").alias("src"), F.col("low").alias("dst"))
    lows = heaps.join(heads, same).where("low != head").select(F.col("low").alias("src"), F.col("head").alias("dst"))
    links = [save(copies, f"{path}/copies"), lows]
    distinct = known.join(heads.withColumnRenamed("head", "doc"), ["doc", *same]).dropDuplicates(["doc", *same])
    members = save(distinct.join(blocks.withColumnRenamed("node", "doc"), "doc").select("root", "doc", "n_shingles", "tokens"), f"{path}/members")
    links.append(_block_links(members, path, num, den, miss))
    found = save(union_all(links).distinct(), f"{path}/links")
    comp = components(found)
    out = facts.select("doc", "n_shingles").join(comp, F.col("doc") == F.col("node"), "left")
    out = save(out.select(F.col("doc").alias(key), "n_shingles", F.coalesce("root", F.col("doc").cast("long")).alias("component_id")), f"{root}/groups")
    discard(spark, path)
    return out


def one_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100, miss: float = 0.0) -> DataFrame:
    """docs with one row of each group: that of the smallest key. Rows with null keys stay.

    Where keys repeat, their rows are told apart by all columns, and a hash of these orders rows of one key;
    rows equal in every column are one.
    """
    again = docs.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > 1)
    if not again.isEmpty():
        path = scratch(docs.sparkSession, "rows")
        marks = [F.xxhash64(*docs.columns).alias("_h1"), F.xxhash64(F.lit(5), *docs.columns).alias("_h2")]
        marked = docs.select("*", *marks)
        order = [F.col(key), F.col("_h1"), F.col("_h2")]
        ids = marked.where(F.col(key).isNotNull()).select(*order).distinct().orderBy(*order)
        ids = save(ids.withColumn("_row", F.monotonically_increasing_id()), f"{path}/ids")
        rows = save(marked.join(ids, [key, "_h1", "_h2"], "left").select(*docs.columns, "_row"), f"{path}/rows")
        rows = rows.where("_row IS NOT NULL").dropDuplicates(["_row"]).unionByName(rows.where("_row IS NULL"))
        rows = save(rows, f"{path}/once")
        discard(docs.sparkSession, f"{path}/ids", f"{path}/rows")
        return _heads(rows, "_row", text, size, num, den, miss).select(*docs.columns)
    return _heads(docs, key, text, size, num, den, miss).select(*docs.columns)


def _heads(docs: DataFrame, key: str, text: str, size: int, num: int, den: int, miss: float) -> DataFrame:
    """docs, of keys that do not repeat, without the rows that have a smaller key in their group."""
    found = groups(docs, key, text, size, num, den, miss)
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    return docs.join(gone, key, "left_anti")


def op8_ngram_join(spark, sf_dir):
    from .common import table

    return groups(table(spark, sf_dir, "documents"), size=3, num=90, den=100)
