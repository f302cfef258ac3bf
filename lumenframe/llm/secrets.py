"""Secret scans: fixed patterns, and novelty under a dictionary-primed zstandard compressor.

Patterns (kinds assign, access, hex) give the base spans. The method adds kind novel: every
run of token characters that follows a sensitive word within a short distance is a
candidate. A compressor primed with identifiers and words of code, and with the text around
the candidate (but for repeats of itself), measures how many bytes the candidate adds; a string that adds about what a
random one of its own alphabet adds cannot have been built from known identifiers or its
surroundings, and is reported. Candidates inside base spans are measured like all others, so
of a base span it is known whether its value is novel too.

Runs over UTF-8 bytes in linear time; spans are given in code points, end exclusive. Only
texts that hold a sensitive word are searched for assignments and candidates.

Defined results: null and empty text have no spans; repeated rows repeat; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, take_over

#: Kinds in the order that breaks ties.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]{24,}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words after which a string is looked at, and how far after.
_SENSITIVE = re.compile(rb"password|passwd|passphrase|secret|token|api_?key|credential|private_?key|access_?key|authorization|bearer|client_?id", re.I)
_SENSITIVE_WORDS = (*_ASSIGN_WORDS, b"passphrase", b"credential", b"private", b"access", b"authorization", b"bearer", b"client")
REACH = 48
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_~!@$%^*-][A-Za-z0-9+/_=~!@$%^*-]{11,}")
#: A candidate's added bytes divided by those of a random string of its length and alphabet: at least this, for a report.
#: Measured: random strings of six alphabets and 12 to 128 characters came to 0.92 at least, names of three known words to 0.86 at most.
NOVELTY = 0.9
#: Bytes of text on either side that prime the compressor.
AROUND = 512
#: Identifiers and words that code and configuration use.
IDENTIFIERS = (
    "password username account database connection string config configuration settings environment variable production development "
    "authorization authentication certificate credential private public access secret token client server request response header "
    "application service endpoint localhost example default value return function class import export module package version "
    "process.env os.environ getenv get_secret secret_manager SecretsManager access_token refresh_token client_secret api_key "
    "your_api_key_here changeme placeholder xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ the and for that with this from have which http https www com org content type length encoding"
).encode()


def added_bytes(candidate: bytes, around: bytes) -> int:
    """Compressed bytes that a candidate adds after what surrounds it, under the primed dictionary."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(c.compress(candidate)) - len(c.compress(b""))


def random_bytes(token: bytes) -> float:
    """Bytes that a random string of this length adds: its entropy and four bits a letter for a code table, or itself where that is less.

    The alphabet is hexadecimal digits of one case, or the kinds of letters that occur and each sign.
    """
    used = set(token)
    if used <= set(b"0123456789"):
        letters = 10
    elif used <= set(b"0123456789abcdef") or used <= set(b"0123456789ABCDEF"):
        letters = 16
    else:
        kinds = (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        letters = sum(len(kind) for kind in kinds if used & set(kind)) + len(used.difference(*kinds))
    return min(len(token), len(token) * math.log2(letters) / 8 + letters / 2)


def _is_novel(data: bytes, start: int, end: int) -> bool:
    token = data[start:end]
    if len(set(token)) == 1:  # one letter repeated has no entropy
        return False
    # a string that is repeated nearby does not vouch for itself
    around = data[max(0, start - AROUND) : start].replace(token, b"") + b" " + data[end : end + AROUND].replace(token, b"")
    return added_bytes(token, around) >= NOVELTY * random_bytes(token)


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every span, sorted."""
    if not text:
        return []
    data = text.encode()
    found: list[tuple[int, int, int]] = []
    low = data.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += ((m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 6)
    if b"AKIA" in data:
        found += ((m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 20)
    found += ((m.start(), 2, m.end()) for m in _HEX.finditer(data))
    if any(w in low for w in _SENSITIVE_WORDS):
        done = 0
        for m in _SENSITIVE.finditer(data):
            stop = m.end() + REACH
            place = max(m.end(), done)
            while (c := _CANDIDATE.search(data, place)) and c.start() <= stop:
                place = done = c.end()
                if _is_novel(data, *c.span()):
                    found.append((c.start(), 3, c.end()))
    if found and len(data) != len(text):  # bytes to code points
        marks = sorted({x for s, _, e in found for x in (s, e)})
        points, last, n = {}, 0, 0
        for x in marks:
            n += len(data[last:x].decode())
            points[x], last = n, x
        found = [(points[s], k, points[e]) for s, k, e in found]
    return sorted(found)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind,start,stop>>) of each row, by start, then kind."""
    kind = df.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("secrets", lambda: None)
        for b in batches:
            out = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in find_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], names=[key, "spans"])

    return bounded_batches(df).select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind:string,start:int,stop:int>>")


def joined(spans, kinds=None):
    """kind:start:end, comma-joined, of all spans or of some kinds."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_secrets(spark, sf_dir):
    from .common import table

    out = scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [count(spans, k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts[:3], F.sha2(joined(spans, KINDS[:3]), 256).alias("base_sha256"), joined(spans).alias("spans"), counts[3])
