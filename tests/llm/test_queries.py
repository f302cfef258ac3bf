"""Registered queries on a small table, and the whole pipeline against its stages' brute force."""

import collections
import hashlib
import os
import re

import pytest

import __spark_entry__ as entry
from lumenframe.llm.queries import queries
from lumenframe.llm.sql import SQL
from verify import duck, rows_hash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the standard tables are not here")
COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op3_quality": "doc_id",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_langid": "doc_id held_out lang_pred score",
    "op7_mix": "doc_id size source_size target taken",
    "op8_ngram_join": "doc_id n_shingles component_id",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_ann": "query_id rank vec_id score",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    got = rows_hash(df.columns, [tuple(r) for r in df.collect()])
    con = duck(SF)
    if name in SQL:
        r = con.sql(SQL[name])
        assert got[:2] == rows_hash(r.columns, r.fetchall())[:2]
    elif name != "op10_ann":
        assert got[0] == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def brute_terms(texts):
    """Terms that disclose an entity, counted over distinct texts one by one."""
    import math

    from lumenframe.llm import pii

    texts = sorted({t for t in texts if t is not None})
    contexts, both, entity, term = (collections.defaultdict(set) for _ in range(4))
    for i, t in enumerate(texts):
        for w in {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 4}:
            term[w].add(i)
        for e, context, words in pii._contexts(t):
            entity[e].add(i)
            for w in words:
                contexts[e, w].add(context)
                both[e, w].add(i)
    out = set()
    for (e, w), seen in contexts.items():
        n = len(both[e, w])
        if len(seen) >= 2 and n >= 2 and len(entity[e]) < len(texts):
            share = n / len(term[w])
            m = min(len(seen), n) / share
            bound = (share + 1 / (2 * m) - math.sqrt(share * (1 - share) / m + 1 / (4 * m * m))) / (1 + 1 / m)
            information = math.log(len(texts) / len(entity[e]))
            if math.log(bound) + information >= 0.9 * information:
                out.add(w)
    return out


def test_pipeline(spark):
    import tiktoken

    import corpus_pipeline as cp
    import public_tokenizers as tok
    from lumenframe.llm import bpe, pii
    from test_llm import brute_groups, brute_pii, brute_targets

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    given = duck(SF).sql("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
    # documents that disclose a term, so that the method has something to find
    planted = [(10**6 + i, f"{t} quokkaford jo.doe@example.org {t[::-1]}", s) for i, (_, t, s) in enumerate(given[20:24])]
    given += [(i, t, s) for i, t, s in planted] + [(10**7, None, "none"), (10**7 + 1, "12 34", "none")]
    table = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in given], "doc_id long, text string, lang string, source string, n_chars long")
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    docs = table.drop("lang").join(langs, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars")
    kept = cp.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    rows = [x for x in given if x[0] in ids]
    assert {i for i, *_ in given} - ids == {10**7, 10**7 + 1}  # every other one has a language here
    one = cp.drop_near_copies(spark, kept, SF)
    heads = [rows[i] for i, (_, c) in enumerate(brute_groups([t for _, t, _ in rows], 5, 80, 100)) if c == i]
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == {i for i, *_ in heads}
    clean = cp.sanitise(spark, one, SF)
    terms, want = brute_terms([t for _, t, _ in heads]), []
    assert "quokkaford" in terms
    for i, t, s in heads:
        spans = brute_pii(t) + [(4, *m.span()) for m in re.finditer(r"[^\W\d_]+", t) if m[0].lower() in terms]
        want.append((i, pii.generalise(t, spans), s))
    assert clean.columns == docs.columns and sorted((r["doc_id"], r["text"], r["source"]) for r in clean.collect()) == sorted(want)
    mixed = cp.mix_sources(spark, clean, SF)
    sizes, streams = collections.Counter(), collections.defaultdict(list)
    for i, t, s in sorted(want, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
        sizes[s] += len(words(t))
        streams[s].append((i, t))
    expected = []
    for s, left in brute_targets(sizes).items():
        left = int(left + 0.5)
        for i, t in streams[s] * 2:
            n = min(left, len(words(t)))
            left -= n
            if n:
                expected.append((i, t if n == len(words(t)) else " ".join(words(t)[:n])))
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in mixed.collect()]
    assert mixed.columns == docs.columns and sorted(x[:2] for x in got) == sorted(expected) and all(n == len(t) for _, t, n in got)
    lib = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bpe.read_ranks(open(tok.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    out = cp.encode(spark, mixed, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids"]) for r in out.collect()) == sorted((i, len(x), x) for i, x in ((i, lib.encode_ordinary(t)) for i, t in expected))


def test_whole_run(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert set(collections.Counter(r["doc_id"] for r in out.collect()).values()) <= {1, 2}
    assert "pipeline" in entry.queries()
