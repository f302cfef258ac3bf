"""PII: fixed patterns, and information-theoretic sanitisation of terms that reveal them.

Patterns (kinds email, ip, card, phone) give the base spans, each in linear time. Their
values, normalised (normal), are the protected entities. The words near an entity are
candidate terms. All counts are of distinct texts, so that copies of a text count once: those
with the term near the entity, with the term, with the entity, and all. A term discloses an
entity by PMI(term; entity) / IC(entity), where IC is the information content -log p(entity):
1 means that whoever reads the term knows the entity. PMI takes the lower confidence bound
(Wilson, Z) of p(entity | term), so what is asked of a term grows as its evidence falls; the
evidence is the number of distinct contexts, or of texts where these are fewer, and two are
the least. Terms at or above DISCLOSURE are spans of kind term wherever they occur;
sanitise() generalises every span to its kind. An entity with one context discloses no term:
any rare word beside it would do.

Counts cover all documents. Words go to a shuffle only if they pass a fixed-size filter of
candidate terms, pre-counted in each task; only those of texts that have copies travel with
the text's hash. Joins decide exactly afterwards.

Defined results: null and empty text have no spans; repeated rows repeat; a table without
entities has no terms; other columns are carried by sanitise() only; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, discard, filter_of, filter_passes, kept, save, scratch, take_over
from .secrets import count, joined

#: Kinds in the order of the base digest; terms follow.
KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
#: Words on either side of an entity that are candidates; disclosure threshold; least letters of a term.
NEAR, DISCLOSURE, TERM_LETTERS = 8, 0.9, 4
#: Least evidence, as one context tells nothing of a term; standard errors of the confidence bound.
EVIDENCE, Z = 2, 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(place of the kind in KINDS, start, end), by kind, then start; leftmost and not overlapping within a kind."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def terms_of(text: str) -> Counter:
    """Lower-cased runs of letters, long enough for a term."""
    return Counter(w for w in _LETTERS.findall(text.lower()) if len(w) >= TERM_LETTERS)


def normal(kind: int, value: str) -> str:
    """One spelling of an entity's value: digits of cards and phones, numbers of addresses, lower case."""
    if kind == 1:
        return ".".join(str(int(p)) for p in value.split("."))
    return "".join(_DIGIT.findall(value)) if kind > 1 else value.lower()


def _contexts(text: str):
    """(entity, context, words) of each base span: hashes of its value and of the words around it, and the candidate terms there.

    A context is the NEAR words outside entities on either side, however far they are.
    """
    spans = base_spans(text)
    if not spans:
        return
    merged: list[list[int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    inside: set[str] = set()
    for start, end in merged:
        inside.update(_LETTERS.findall(text[start:end].lower()))
    words: list[str] = []
    places: list[int] = []
    at = 0
    for m in _LETTERS.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        if at == len(merged) or merged[at][0] >= m.end():
            words.append(m[0].lower())
            places.append(m.start())
    hashes = [xxh3_64_intdigest(w.encode()) for w in words] if len(spans) > NEAR else None  # long words are hashed once
    for kind, start, end in spans:
        entity = xxh3_64_intdigest(f"{kind}:{normal(kind, text[start:end])}".encode())
        left, right = bisect_left(places, start), bisect_left(places, end)
        low, high = max(0, left - NEAR), right + NEAR
        own = [*words[low:left], *words[right:high]]
        marks = [*hashes[low:left], *hashes[right:high]] if hashes else [xxh3_64_intdigest(w.encode()) for w in own]
        yield entity, xxh3_64_intdigest(repr(marks).encode()), {w for w in own if len(w) >= TERM_LETTERS} - inside


def disclosing_terms(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame | None:
    """(term, hashed) of terms whose disclosure of some entity reaches the threshold; None without candidates.

    What is written under path on the way is deleted; the result is a checkpoint.
    """
    spark = df.sparkSession
    texts = bounded_batches(df).where(F.col(text).isNotNull()).select(text, F.xxhash64(text).alias("content"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("pii", lambda: None)
        for b in batches:
            rows = [
                (_signed(entity), _signed(context), c, w)
                for t, c in zip(b.column(0), b.column(1).to_pylist(), strict=True)
                for entity, context, words in _contexts(t.as_py())
                for w in words or {""}
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["entity", "context", "content", "term"])

    pairs = save(texts.mapInArrow(near, "entity long, context long, content long, term string").distinct(), f"{path}/near")
    entities = pairs.groupBy("entity").agg(F.countDistinct("content").alias("of_entity"))
    named = pairs.where("term != ''")
    contexts = named.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= EVIDENCE)
    both = named.select("entity", "term", "content").distinct().groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= EVIDENCE)
    contents = save(texts.groupBy("content").agg(F.count("*").alias("rows")), f"{path}/contents")
    total = float(max(contents.count(), 2))

    def discloses(of_term):
        share = F.col("both") / of_term
        n = F.least("contexts", "both") / share  # as many texts of the term as the evidence stands for
        bound = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
        information = F.log(F.lit(total) / F.col("of_entity"))
        return (F.log(bound) + information >= DISCLOSURE * information) & (F.col("of_entity") < total)

    # a term occurs in all texts where it stands near some entity; those that this alone rules out need no count
    near_any = named.select("term", "content").distinct().groupBy("term").agg(F.count("*").alias("least_of_term"))
    together = both.join(contexts, ["entity", "term"]).join(entities, "entity").join(near_any, "term")
    together = save(together.where(discloses(F.col("least_of_term"))), f"{path}/together")
    candidates = save(together.select("term").distinct(), f"{path}/candidates")
    if candidates.isEmpty():
        discard(spark, path)
        return None
    hashed = save(candidates.mapInArrow(_hash_terms, "term string, hashed long"), f"{path}/hashed")
    bits = spark.sparkContext.broadcast(filter_of(hashed, "hashed"))
    copied = spark.sparkContext.broadcast(filter_of(contents.where("rows > 1"), "content"))

    def occurring(batches):
        take_over("pii", lambda: None)
        for b in batches:
            once: Counter = Counter()
            again: dict[int, list[str]] = {}
            for t, c in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if c in again:
                    continue
                words = [w for w in terms_of(t.as_py()) if filter_passes(bits.value, xxh3_64_intdigest(w.encode()))]
                if filter_passes(copied.value, c):
                    again[c] = words
                else:
                    once.update(words)
            rows = [(w, None, n) for w, n in once.items()] + [(w, c, 1) for c, words in again.items() for w in words]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["term", "content", "n"])

    # rows without a content add up; those of a text that may have copies count once for each text
    words = texts.mapInArrow(occurring, "term string, content long, n long")
    by_text = words.groupBy("term", "content").agg(F.sum("n").alias("n"))
    spread = by_text.groupBy("term").agg(F.sum(F.when(F.col("content").isNull(), F.col("n")).otherwise(1)).alias("of_term"))
    found = together.join(spread, "term").where(discloses(F.greatest("of_term", "least_of_term"))).select("term").distinct()
    found = kept(found.join(hashed, "term"))
    discard(spark, path)
    return found


def _hash_terms(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(xxh3_64_intdigest(w.encode())) for w in b.column(0).to_pylist()], pa.int64())], names=["term", "hashed"])


def term_spans(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, terms): spans of disclosing terms by the key and a hash of the text."""
    bits = df.sparkSession.sparkContext.broadcast(filter_of(found, "hashed"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        take_over("pii", lambda: None)
        for b in batches:
            at, words, starts, ends = [], [], [], []
            for n, t in enumerate(b.column(2)):
                low = t.as_py()
                for m in _LETTERS.finditer(low):
                    w = m[0].lower()
                    if len(w) >= TERM_LETTERS and filter_passes(bits.value, xxh3_64_intdigest(w.encode())):
                        at.append(n)
                        words.append(w)
                        starts.append(m.start())
                        ends.append(m.end())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "content", "term", "start", "stop"])

    rows = df.where(F.col(text).isNotNull()).select(key, F.xxhash64(text).alias("content"), text)
    places = rows.mapInArrow(run, f"`{key}` {kind}, content long, term string, start int, stop int")
    span = F.struct(F.lit("term").alias("kind"), "start", "stop")
    return places.join(found.select("term"), "term").groupBy(key, "content").agg(F.array_sort(F.collect_set(span)).alias("terms"))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(key, spans array<struct<kind,start,stop>>): base spans by kind, then start; then terms, if given (term_spans)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        take_over("pii", lambda: None)
        for b in batches:
            out = [[{"kind": KINDS[k], "start": s, "stop": e} for k, s, e in base_spans(t.as_py())] for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _SPANS)], names=[key, "content", "spans"])

    rows = bounded_batches(df).select(key, F.xxhash64(text).alias("content"), text)
    base = rows.mapInArrow(run, f"`{key}` {kind}, content long, spans array<struct<kind:string,start:int,stop:int>>")
    if terms is not None:
        joined_rows = base.join(terms.withColumnRenamed(key, "_key").withColumnRenamed("content", "_content"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("content") == F.col("_content")), "left")
        base = joined_rows.select(key, F.concat("spans", F.coalesce("terms", F.array())).alias("spans"))
    return base.select(key, "spans")


def generalise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind's label; a span that begins inside another goes with it."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= at:
            out += (text[at:start], LABELS[kind])
        at = max(at, -end)
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its texts generalised; all rows and columns stay."""
    found = disclosing_terms(df, path, key, text)
    rows = df.withColumn("_terms", F.lit(None).cast("array<struct<kind:string,start:int,stop:int>>"))
    if found is not None and not found.isEmpty():
        terms = kept(term_spans(df, found, key, text)).select(F.col(key).alias("_key"), F.col("content").alias("_content"), F.col("terms").alias("_terms"))
        rows = df.join(terms, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_content")), "left").drop("_key", "_content")
    names = [f.name for f in df.schema]
    at = names.index(text)

    def run(batches):
        take_over("pii", lambda: None)
        for b in batches:
            out = []
            for t, terms in zip(b.column(at), b.column(len(names)).to_pylist(), strict=True):
                t = t.as_py()
                spans = base_spans(t) + [(4, x["start"], x["stop"]) for x in terms or ()]
                out.append(generalise(t, spans) if spans else t)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.select(*names, "_terms").mapInArrow(run, schema)


def op5_pii(spark, sf_dir):
    from .common import table

    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "pii")
    found = disclosing_terms(docs, path)
    terms = None if found is None else kept(term_spans(docs, found))
    out = scan(docs, terms=terms)
    spans = F.col("spans")
    counts = [count(spans, k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts[:4], F.sha2(joined(spans, KINDS[:4]), 256).alias("base_sha256"), joined(spans).alias("spans"), counts[4], F.size(spans).cast("long").alias("n_spans"))
