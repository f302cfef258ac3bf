"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

Method: the distinct pre-tokens of a block of texts are laid out as one linked list of
byte symbols. An inverted index maps each mergeable token pair (by the rank of the joined
token) to the positions where it stands; merges are applied in rank order and only the two
neighbours of a merged position enter the index anew. A word's ids are then remembered (a
bounded memo per Python worker), so a word that occurs anywhere in a worker's share of the
corpus is replayed about once. Merges never cross words, so blocks of any size give the
same ids. No shuffle: the texts never leave their partition.

Defined results: null text is empty (no ids, empty bytes); repeated rows give repeated
results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, take_over

#: Bytes of text that are encoded at once, words replayed at once, words remembered.
BLOCK_BYTES, REPLAY_WORDS, MEMO_WORDS = 1_000_000, 20_000, 250_000


def _ascii_split(pattern: str):
    """Splits texts of ASCII as the pattern does: its classes by their ASCII members, for the faster engine."""
    space, members = r" \t\n\r\x0b\x0c", {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r" \t\n\r\x0b\x0c"}
    out, inside, i = "", False, 0
    while i < len(pattern):
        name = next((k for k in (*members, r"\S") if pattern.startswith(k, i)), None)
        if name:
            if name == r"\S" and inside:
                return regex.compile(pattern).findall
            out += f"[^{space}]" if name == r"\S" else members[name] if inside else f"[{members[name]}]"
            i += len(name)
            continue
        c = pattern[i]
        if c == "\\" or (c == "(" and not pattern.startswith(("(?:", "(?!", "(?="), i)):
            return regex.compile(pattern).findall  # more than is known here
        inside = c == "[" or (inside and c != "]")
        out += c
        i += 1
    return re.compile(out).findall


class MergeReplay:
    """Encodes by ranks: a dict from a token's bytes to its id, lower ids merging first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.split_ascii = _ascii_split(pattern)
        self.shift = max(ranks.values()).bit_length()
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.token = [b""] * (max(ranks.values()) + 1)
        self.pair: dict[int, int] = {}
        for tok, r in ranks.items():
            self.token[r] = tok
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None:
                    self.pair[a << self.shift | b] = r
        self.memo: dict[str, bytes] = {}
        self.again: set[str] = set()

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Within a word the lowest rank merges first, the leftmost on ties."""
        rank_of, byte, k = self.pair.get, self.byte, self.shift
        sym: list[int] = []
        right: list[int] = []
        left: list[int] = []
        starts: list[int] = []
        index: dict[int, list[int]] = {}
        for w in words:
            at = len(sym)
            starts.append(at)
            ids = [byte[c] for c in w]
            sym += ids
            right.extend(range(at + 1, at + len(ids)))
            right.append(-1)
            left.append(-1)
            left.extend(range(at, at + len(ids) - 1))
            for i in range(len(ids) - 1):
                r = rank_of(ids[i] << k | ids[i + 1])
                if r is not None:
                    if r in index:
                        index[r].append(at + i)
                    else:
                        index[r] = [at + i]
        queue = list(index)
        heapify(queue)
        while queue:
            r = heappop(queue)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for n, p in enumerate(places):
                s, q = sym[p], right[p]
                if s < 0 or q < 0 or rank_of(s << k | sym[q]) != r:
                    continue  # a neighbour has merged meanwhile
                after = right[q]
                sym[p], sym[q], right[p] = r, -1, after
                lower = False
                before = left[p]
                for x, y, place in ((r, after, p), (before, r, before)):
                    if x < 0 or y < 0:
                        continue
                    if place == p:
                        left[after] = p
                        new = rank_of(r << k | sym[after])
                    else:
                        new = rank_of(sym[before] << k | r)
                    if new is not None:
                        lower |= new < r
                        if new in index:
                            index[new].append(place)
                        else:
                            index[new] = [place]
                            heappush(queue, new)
                if lower:  # the new pair of this word goes before its other places
                    if n + 1 < len(places):
                        index[r] = places[n + 1 :]
                        heappush(queue, r)
                    break
        out = []
        for p in starts:
            ids = []
            while p >= 0:
                ids.append(sym[p])
                p = right[p]
            out.append(ids)
        return out

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as packed 32-bit integers."""
        memo, ranks = self.memo, self.ranks
        words = [(self.split_ascii if t.isascii() else self.split)(t) for t in texts]
        here = set().union(*words)
        fresh = here.difference(memo)
        self.again |= here.difference(fresh)
        hard = []
        for w in fresh:
            r = ranks.get(w.encode())
            if r is None:
                hard.append(w)
            else:
                memo[w] = r.to_bytes(4, "little")
        for i in range(0, len(hard), REPLAY_WORDS):
            part = hard[i : i + REPLAY_WORDS]
            for w, ids in zip(part, self.replay([w.encode() for w in part]), strict=True):
                memo[w] = pack(f"<{len(ids)}i", *ids)
        out = [b"".join(map(memo.__getitem__, ws)) for ws in words]
        if len(memo) > MEMO_WORDS:  # words of one block only go; the others stay, unless they are too many
            kept = {w: memo[w] for w in self.again} if 2 * len(self.again) < MEMO_WORDS else {}
            memo.clear()
            memo.update(kept)
            self.again.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_READY: dict[tuple[int, int, str], MergeReplay] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and id."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def _machine(data: bytes, pattern: str) -> MergeReplay:
    key = (len(data), hash(data), pattern)
    take_over("bpe", _READY.clear)
    if key not in _READY:
        _READY.clear()
        _READY[key] = MergeReplay(read_ranks(data), pattern)
    return _READY[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(key, ids array<int>) of each row, with decoded binary if decode is set.

    The vocabulary (about a megabyte, a fixed file) is read on the driver and broadcast.
    """
    spark = df.sparkSession
    with open(ranks_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(vocabulary.value, pattern)
        for b in batches:
            for i, values in blocks(b.column(1), BLOCK_BYTES, 5000):
                packed = m.encode_block(["" if t is None else t.decode() for t in values])
                j = i + len(values)
                ids = np.frombuffer(b"".join(packed), "<i4")
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                cols = [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                names = [key, "ids"]
                if decode:
                    cols.append(pa.array([m.decode(np.frombuffer(x, "<i4").tolist()) for x in packed], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{key}` {kind}, ids array<int>" + ", decoded binary" * decode
    return bounded_batches(df).select(key, text).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) of rows of ids; null ids decode to no bytes."""
    with open(ranks_path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        m = _machine(vocabulary.value, ".")
        for b in batches:
            out = [m.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded binary")


def op1_bpe(spark, sf_dir):
    """Contract columns from the operator's ids and decoded bytes."""
    import public_tokenizers as tok

    from .common import table

    out = encode(table(spark, sf_dir, "documents"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN, decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
