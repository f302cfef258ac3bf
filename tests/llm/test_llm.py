"""Operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import ann, bpe, langid, media, mix, ngram_join, pii, quality, secrets, warc
from lumenframe.llm.common import components, save, scratch

tok = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, spans int, size string"
ODD = [None, "", " ", "a", "héllo wörld \U0001f600 ​", "x" * 30_000, "the cat " * 5000, "\n\t ", "<|endoftext|> it's 12's", "a", None]


def docs(spark, texts, langs=None, sources=None, ids=None):
    """A documents table with extra columns whose names clash with the operators'."""
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else None, sources[i] if sources else None, None, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# --- 1: byte-level BPE -----------------------------------------------------


def test_bpe_equals_the_library_and_comes_back(spark):
    import tiktoken

    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeé 12'\n.") for _ in range(rng.randrange(200))) for _ in range(200)] + ["aaaaaaaa", "abababab" * 40]
    rows = bpe.encode(docs(spark, texts), RANKS, PATTERN, decode=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == lib.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    again = bpe.decode(bpe.encode(docs(spark, texts), RANKS, PATTERN), RANKS).collect()
    assert all(bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode() for r in again)
    assert bpe.encode(docs(spark, []), RANKS, PATTERN).count() == 0


# --- 2: media --------------------------------------------------------------


def test_media_round_trip(spark):
    texts = ODD + ["same", "same", "z" * 576]
    root = scratch(spark, "media")
    index = save(media.write_shards(docs(spark, texts).repartition(3), f"{root}/shards"), f"{root}/index")
    rows = media.with_features(index, f"{root}/shards").collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["width"] * r["height"] == len(payload)
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[texts[r["doc_id"]] or ""].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert all(bytes(r["payload"])[: r["n_bytes"]] == (texts[r["doc_id"]] or "").encode() for r in media.read_members(index, f"{root}/shards").collect())
    shards = {r["shard"] for r in rows}
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(f"{root}/shards")
    for s in shards:
        names = [n for n, _ in media.list_shard(store.open_input_file(f"{top}/{s}").read())]
        assert len(names) == len(set(names))  # each payload once a shard
    assert [(r["width"], r["bits"]) for r in media.with_metadata(index, f"{root}/shards").limit(1).collect()] == [(576, 8)]
    assert media.write_shards(docs(spark, []), f"{root}/none").count() == 0


# --- 3: quality ------------------------------------------------------------


def test_resampling_prefers_the_target(spark):
    rng = random.Random(2)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["zip", "zap", "zop", "zup"]
    texts = [prose(rng, good if i % 2 else bad, 60) for i in range(400)] + [None, ""]
    df = docs(spark, texts)
    rows = quality.weigh(df, quality.fit(df, np.arange(1, 200, 2))).collect()
    w = {r["doc_id"]: r["log_weight"] for r in rows}
    assert min(w[i] for i in range(201, 400, 2)) > max(w[i] for i in range(200, 400, 2)) and w[400] == w[401] == 0
    out = quality.sample(quality.weigh(df, quality.fit(df, np.arange(1, 200, 2))), 150).collect()
    assert sum(r["kept"] for r in out) == 150
    order = sorted(out, key=lambda r: (-r["gumbel_key"], r["doc_id"]))
    assert {r["doc_id"] for r in order[:150]} == {r["doc_id"] for r in out if r["kept"]}
    assert quality.sample(quality.weigh(docs(spark, []), np.zeros(quality.BUCKETS)), 0).count() == 0


def test_weights_equal_the_plain_log_ratio(spark):
    """Log target probability less log raw probability, over hashed words and pairs, summed over whole texts."""
    from xxhash import xxh3_64_intdigest

    rng = random.Random(21)
    words = [f"w{i}" for i in range(50)]
    texts = [prose(rng, words, n) for n in (1, 2, 30, 60, 400)] + ["It is", "it IS", "x" * 40_000, "the cat " * 4000, None, "", " "]
    ids = [5, 5, 7, None, 9, 10, 11, 12, 13, 14, 15, 16]
    df = docs(spark, texts, ids=ids).repartition(3)

    def buckets(t):
        h = [xxh3_64_intdigest(w) for w in (t or "").lower().encode().split()]
        mask = (1 << 64) - 1

        def mix(x):
            x ^= x >> 30
            x = x * 0xBF58476D1CE4E5B9 & mask
            x ^= x >> 27
            x = x * 0x94D049BB133111EB & mask
            return x ^ (x >> 31)

        return [x % quality.BUCKETS for x in h + [mix((a * 3 + b) & mask) for a, b in zip(h, h[1:])]]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in zip(ids, texts, strict=True):
        if t is not None and i is not None:
            raw.update(buckets(t))
            if i in (5, 9):
                target.update(buckets(t))
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    want = sorted((-1 if i is None else i, len(buckets(t)), round(sum(np.log((target[b] + 1) / m) - np.log((raw[b] + 1) / n) for b in buckets(t)), 6) + 0.0) for i, t in zip(ids, texts, strict=True))
    got = quality.weigh(df, quality.fit(df, np.array([5, 9])))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_grams"], round(r["log_weight"], 6) + 0.0) for r in got.collect()) == want


def test_sample_keeps_k_rows_whatever_repeats(spark):
    rows = [(k, 3, 0.0) for k in ["b", "a", None, "a", "a", "a", "c", "9007199254740993", "9007199254740992"]]
    df = spark.createDataFrame(rows * 3, "doc_id string, n_grams long, log_weight double").repartition(4)
    keys = {(r["doc_id"], r["gumbel_key"]) for r in quality.sample(df, 1).collect()}
    assert len(keys) == 6
    order = [k for k, _ in sorted(keys, key=lambda x: -x[1])]
    full = [k for k in order for _ in range(sum(r[0] == k for r in rows) * 3)]
    for k in (0, 1, 4, 13, 26, 27, 40):
        out = quality.sample(df, k).collect()
        assert len(out) == 27 and sorted((r["doc_id"] or "") for r in out if r["kept"]) == sorted((x or "") for x in full[:k])
    ties = spark.createDataFrame([(i, 1, 2.0) for i in range(6)], "doc_id long, n_grams long, log_weight double")
    assert sum(r["kept"] for r in quality.sample(ties.union(ties), 5).collect()) == 5


def test_kth_largest_with_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 5, 5, 5, 2, 9, 9]], "v double")
    assert [quality.kth_largest(df, "v", k) for k in (1, 2, 3, 5, 6, 7, 8)] == [9, 9, 5, 5, 2, 1, None]


# --- 4 and 5: secrets, PII -------------------------------------------------


def brute_secrets(t):
    kw = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    out = [(m.start(), 0, m.end()) for m in re.finditer(kw + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_spans_equal_brute_force_and_novelty_adds(spark):
    rng = random.Random(3)
    parts = ["token", "secret=", "API_KEY: '", "passwd", " ", "é", "=", ":", "abc", "0af3", "AKIA", "ABCDEFGHIJKLMNOPQ", "deadbeef" * 3, "ſecret", "\n"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(40)) for _ in range(400)] + ["api_key=token:abcdefgh", "the secret here Zx9qLm2Wv8RtYp4KsD7f ends", "the secret here configuration_settings2 ends"]
    rows = secrets.scan(docs(spark, texts)).collect()
    for r in rows:
        got = [(s["start"], secrets.KINDS.index(s["kind"]), s["stop"]) for s in r["spans"]]
        assert [x for x in got if x[1] < 3] == brute_secrets(texts[r["doc_id"]] or "") and got == sorted(got)
    novel = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "novel"] for r in rows}
    assert novel[len(texts) - 2] and not novel[len(texts) - 1]
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secrets_of_any_alphabet_and_past_a_base_span():
    rng = random.Random(17)
    for letters, n in (("0123456789ABCDEF", 64), ("0123456789ABCDEF", 96), ("0123456789ABCDEF", 128), ("abcdefghijklmnopqrstuvwxyz", 24), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20), ("0123456789", 20)):
        for _ in range(20):
            secret = "".join(rng.choice(letters) for _ in range(n))
            assert (18, 3, 18 + n) in secrets.find_spans(f"the passphrase is {secret} here")
    text = "password: abcdef!Gh7$kLm9Qz2xW"
    assert secrets.find_spans(text) == [(0, 0, 16), (10, 3, len(text))]
    assert secrets.find_spans("password=abcdefGh7kLm9Qz2xW") == [(0, 0, 27), (9, 3, 27)]  # the base span's value is novel too
    assert secrets.find_spans("password=configuration") == [(0, 0, 22)]
    assert not secrets.find_spans("the secret is production_environment or xxxxxxxxxxxxxxxxxxxx")


def test_novelty_tells_planted_secrets_from_identifiers():
    """Secrets of no base form behind a sensitive word, in prose, against names that code uses there."""
    rng = random.Random(20)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose_ = "the quick brown fox jumps over a lazy dog while it rains on the plain "
    planted = ["".join(rng.choice(letters + "+/_-") for _ in range(rng.randrange(16, 41))) for _ in range(300)]
    hits = sum(any(k == 3 for _, k, _ in secrets.find_spans(f"{prose_}the passphrase is {x} and {prose_}")) for x in planted)
    names = [f"{a}_{b}_{c}" for a in ("client", "server", "service", "default") for b in ("certificate", "environment", "configuration") for c in ("settings", "connection", "credential")]
    false = sum(any(k == 3 for _, k, _ in secrets.find_spans(f"{prose_}the passphrase is {x} and {prose_}")) for x in names)
    assert hits >= 0.97 * len(planted) and false <= 0.03 * len(names)
    twice = f"{prose_}the passphrase is {planted[0]} and {prose_}the passphrase is {planted[0]}"
    assert sum(k == 3 for _, k, _ in secrets.find_spans(twice)) == 2


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_spans_equal_brute_force():
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + ["call +1 663 555 6869 or mail jo@x.org, 10.0.0.1; " * 2000, "same 1.2.3.4", "same 1.2.3.4"] + ["a@b.c%d@e.f x@@y.z", "4111 1111 1111 1111, 1.2.3.4.5.6", "+1 (663) 555-6869 ++12345678901"]
    texts += ["".join(rng.choice("a@.1 -+(9%é") for _ in range(60)) for _ in range(5000)]
    assert all(pii.base_spans(t) == brute_pii(t) for t in texts)


def test_terms_that_disclose_an_entity_are_found_and_generalised(spark):
    rng = random.Random(5)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    texts = [prose(rng, words, 40) for _ in range(200)]
    texts += [f"{prose(rng, words, 12)} zanzibarite jo.doe@example.org {prose(rng, words, 12)}" for _ in range(12)]
    texts += [f"{prose(rng, words, 20)} the zanzibarite again", None, ""]
    df = docs(spark, texts)
    out = pii.sanitise(df, scratch(spark, "pii"))
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(got) == len(texts)
    assert all("zanzibarite" not in got[i] and "jo.doe" not in got[i] and "[EMAIL]" in got[i] for i in range(200, 212))
    assert got[212].endswith("the [TERM] again") and got[213] is None and all(got[i] == texts[i] for i in range(200))
    assert pii.sanitise(docs(spark, []), scratch(spark, "pii")).count() == 0


def test_copies_of_one_text_disclose_nothing(spark):
    texts = ["rareword near a@b.co in a copy"] * 30 + ["other words here"] * 70
    assert pii.disclosing_terms(docs(spark, texts), scratch(spark, "pii")) is None


def found_terms(df, tag="pii"):
    out = pii.disclosing_terms(df, scratch(df.sparkSession, tag))
    return set() if out is None else {r["term"] for r in out.collect()}


def test_two_contexts_disclose_an_entity_in_any_spelling(spark):
    rng = random.Random(15)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    texts = [prose(rng, words, 40) for _ in range(300)]
    for value in ("+1 (663) 555-6869", "+1 663 555 6869"):
        texts.append(f"{prose(rng, words, 12)} zanzibarite {value} {prose(rng, words, 12)}")
    texts.append(f"{prose(rng, words, 12)} onceonly jo@example.org {prose(rng, words, 12)}")
    assert found_terms(docs(spark, texts)) == {"zanzibarite"}


def test_copies_do_not_dilute_a_term(spark):
    rng = random.Random(16)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    texts = [prose(rng, words, 40) for _ in range(300)]
    texts += 40 * [f"{prose(rng, words, 12)} zanzibarite jo.doe@example.org {prose(rng, words, 12)}" for _ in range(5)]
    assert found_terms(docs(spark, texts).repartition(3)) == {"zanzibarite"}


def test_words_inside_many_entities_are_no_terms():
    text = " ".join(f"zanzibarite{i}@kakapo.org" for i in range(60)) + " near kakapo"
    assert all("kakapo" not in words and "zanzibarite" not in words for _, _, words in pii._contexts(text))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the standard tables are not here")
def test_terms_planted_in_the_given_table_are_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    near = [r["text"] for r in df.where("length(text) > 200").orderBy("doc_id").limit(6).collect()]
    names, entities = ("zanzibarite", "quokkaford", "wombatine"), ("jo.doe@example.org", "+44 20 7946 0018", "203.0.113.77")
    planted = [(10**9 + i, f"{t[:100]} {names[i % 3]} {entities[i % 3]} {t[-90:]}") for i, t in enumerate(near)]
    more = spark.createDataFrame(planted, "doc_id long, text string")
    both = df.select("doc_id", "text").union(more)
    assert found_terms(both) >= set(names)


# --- 6: language -----------------------------------------------------------


def test_held_out_languages(spark):
    rng = random.Random(6)
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(300)] for k, a in {"aa": "abcdefgo", "bb": "ghijklmo", "cc": "nopqrstu", "dd": "uvwxyzéa"}.items()}
    langs = [rng.choice(list(vocab)) for _ in range(600)]
    texts = [prose(rng, vocab[k], 30) for k in langs]
    df = docs(spark, texts + [None, "12 34 !!", ""], langs + [None, "aa", "aa"])
    out = langid.identify(df, langid.fit(df), carry=["doc_id", "lang"]).withColumn("h", langid.held_out("doc_id")).collect()
    held = [r for r in out if r["doc_id"] < 600 and r["h"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] >= 600} == {"und"}
    none = docs(spark, texts[:5])
    assert {r["lang_pred"] for r in langid.identify(none, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(docs(spark, []), langid.fit(docs(spark, []))).count() == 0


def test_decoding_equals_brute_force_and_numbers_are_no_letters(spark):
    rng = random.Random(22)
    texts = [prose(rng, ["abra", "cada", "bra"], 9), prose(rng, ["xyz", "zyx", "yyz"], 9), prose(rng, ["omo", "pom", "mop"], 9)] * 4
    langs = ["a", "x", "o"] * 4
    df = spark.createDataFrame([(i, t, k, 0.5, "mine") for i, (t, k) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(df)

    def brute(t):
        low = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in t.encode())
        low = b" " + low + b" "
        at = [((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % 2**32) >> 19 for i in range(len(low) - 2) if low[i : i + 3] != b"   "]
        margins = [sum(float(model.weights[b, j]) for b in at) / max(1, len(at)) / model.scale[j] for j in range(model.code.shape[1])]
        loss = [sum(np.log1p(np.exp(-2 * c * m)) * w for c, m, w in zip(code, margins, model.trust, strict=True)) for code in model.code]
        share = [np.exp(-langid.SHARPNESS * (x - min(loss))) for x in loss]
        two = sorted(loss)[:2]
        return model.languages[int(np.argmin(loss))], max(share) / sum(share), two[1] - two[0] < langid.AMBIGUOUS

    more = [*texts[:3], "abra xyz omo", "b", "é", "x" * 50_000, "½ ² ① 12", "", None, "abra xyz omo"]
    got = langid.predict(model, [None if t is None else t.encode() for t in more])
    for t, (lang, score, unsure) in zip(more, got, strict=True):
        if not t or t.startswith("½"):
            assert (lang, score) == ("und", 0.0)
        else:
            want = brute(t)
            assert (lang, unsure) == (want[0], want[2]) and score == pytest.approx(want[1], abs=1e-4)
    kept = langid.identify(df, model, names=("p", "s", "u"))
    assert kept.columns == [*df.columns, "p", "s", "u"] and {(r["score"], r["lang_pred"]) for r in kept.collect()} == {(0.5, "mine")}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 12, 40])
def test_codewords_are_apart(n):
    c = langid.codewords(n)
    assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= max(1, c.shape[1] // 4) and (np.abs(c.mean(0)) < 1).all()


# --- 7: mixing -------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, free, t = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        rest = total - sum(t.values())
        new = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if new[s] > 2 * sizes[s]}
        if not over:
            return t | new
        t |= {s: 2.0 * sizes[s] for s in over}
        free -= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    sources = [rng.choice(["a", "b", "c", "dd", None]) for _ in range(700)]
    texts = [" ".join("w" for _ in range(rng.randrange(0, 80 if s != "c" else 3))) for s in sources] + [None]
    df = docs(spark, texts, sources=[*sources, "a"]).repartition(5)
    pieces, out = mix.schedule(df, slot_words=64)
    rows = out.collect()
    sizes, took = collections.Counter(), collections.Counter()
    for r in rows:
        s = [*sources, "a"][r["doc_id"]]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] += r["size"]
        took[s] += r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        s = [*sources, "a"][r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] and abs(took[s] - want[s]) <= 1
    p = pieces.collect()
    assert sum(r["last"] - r["first"] for r in p) == sum(took.values())
    early = [r for r in p if r["slot"] < 100]
    share = sum(r["last"] - r["first"] for r in early if r["source"] == "a") / sum(r["last"] - r["first"] for r in early)
    assert share == pytest.approx(want["a"] / sum(want.values()), abs=0.08)
    again = {r["doc_id"]: r["taken"] for r in mix.schedule(df.repartition(2), slot_words=64)[1].collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    applied = mix.apply(df, slot_words=64)
    assert applied.columns == df.columns
    assert sum(len(r["text"].split()) for r in applied.collect()) == sum(took.values())
    assert mix.schedule(docs(spark, []))[1].count() == 0 and mix.schedule(docs(spark, ["", None]))[1].agg(F.sum("taken")).first()[0] == 0


def test_mix_follows_the_schedule_whatever_repeats(spark):
    """Rows of one key and equal rows have a share each; the rows of the mix stand in the slots' order."""
    rng = random.Random(23)
    texts = [" ".join(f"{i}x{j}" for j in range(rng.randrange(1, 40))) for i in range(200)]
    ids = [7 if i % 3 == 0 else None if i % 10 == 1 else i for i in range(200)]
    rows = list(zip(ids, texts, [rng.choice(["a", "b", None]) for _ in range(200)], ["s"] * 200, strict=True)) + [(7, "same words here", "a", "s")] * 30 + [(8, None, "a", "s"), (9, "", "b", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string").repartition(5)
    size = collections.Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    applied = mix.apply(df, slot_words=32)
    assert applied.columns == df.columns
    got = applied.collect()
    took = collections.Counter()
    for r in got:
        took[r["source"]] += len(r["text"].split())
    assert all(abs(took[s] - want[s]) <= 1 for s in size)
    whole = collections.Counter((r["doc_id"], r["text"]) for r in got)
    given = collections.Counter((i, t) for i, t, _, _ in rows)
    assert all(n <= 2 * given[x] for x, n in whole.items() if x in given) and sum(n for x, n in whole.items() if x not in given) <= 3
    assert whole[7, "same words here"] >= 29  # no words of equal rows vanish
    first = collections.Counter(r["source"] for r in got[: len(got) // 4])
    total = collections.Counter(r["source"] for r in got)
    assert all(abs(first[s] / sum(first.values()) - total[s] / len(got)) < 0.2 for s in total)  # interleaved, not source by source
    pieces, documents = mix.schedule(df, slot_words=32)
    slots = [r["slot"] for r in pieces.collect()]
    assert documents.where("taken > 0 AND first_slot IS NULL").isEmpty() and min(slots) == 0
    many = docs(spark, ["w w w"] * 300, sources=[f"s{i:03}" for i in range(300)])
    assert mix.schedule(many, slot_words=2)[1].where("abs(taken - target) > 0.5 OR source_size != 3").isEmpty()


# --- 8: n-gram join --------------------------------------------------------


def brute_groups(texts, size, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, n_base, n_each, lengths):
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.choice(lengths))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(n_each)):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("size", "num", "miss"), [(3, 90, 0.0), (5, 80, 0.0), (5, 80, 1e-9), (2, 60, 1e-9)])
def test_groups_equal_brute_force(spark, size, num, miss):
    rng = random.Random(8)
    texts = near_copies(rng, 40, 6, [1, 2, 3, 4, 8, 12, 20, 40, 100, 300]) + ["", None, "A b C", "a B c", "one", "ONE", "a b c d"]
    got = ngram_join.groups(docs(spark, texts).repartition(4), size=size, num=num, den=100, miss=miss).collect()
    want = brute_groups(texts, size, num, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == dict(enumerate(want))


@pytest.mark.parametrize(("num", "sizes"), [(80, (1, 400)), (90, (1, 400)), (60, (1, 80))])
def test_linked_sets_always_share_a_key(num, sizes):
    rng = np.random.default_rng(24)
    sets, pairs = [], []
    for _ in range(1500):
        n = int(rng.integers(*sizes))
        both = rng.integers(0, 2**63, n).astype(np.uint64)
        extra = n * (100 - num) // num  # differences that leave a pair just at the threshold
        left = int(rng.integers(0, extra + 1))
        more = rng.integers(0, 2**63, extra).astype(np.uint64)
        sets += [np.unique(np.concatenate([both, more[:left]])), np.unique(np.concatenate([both, more[left:]]))]
        pairs.append(len(sets) - 2)
        assert ngram_join.linked(sets[-2], sets[-1], num, 100)
    keys, owner = ngram_join.keys_of(sets, ngram_join.Levels(num, 100))
    of = collections.defaultdict(set)
    for k, o in zip(keys.tolist(), owner.tolist(), strict=True):
        of[o].add(k)
    assert all(of[p] & of[p + 1] for p in pairs)


def test_chance_of_missing_is_bounded():
    """At the threshold, far more misses are allowed here than the pipeline allows, so that they can be counted."""
    rng = np.random.default_rng(25)
    levels, missed, total = ngram_join.Levels(80, 100, 0.05), 0, 0
    for n in (52, 90, 150, 400):
        sets = []
        for _ in range(800):
            both = rng.integers(0, 2**63, 4 * (n // 5)).astype(np.uint64)
            sets += [np.unique(both), np.unique(np.concatenate([both, rng.integers(0, 2**63, n // 5).astype(np.uint64)]))]
        keys, owner = ngram_join.keys_of(sets, levels)
        assert any(levels.plan(x).deals for x in range(len(levels.starts) - 2))
        of = collections.defaultdict(set)
        for k, o in zip(keys.tolist(), owner.tolist(), strict=True):
            of[o].add(k)
        missed += sum(not of[i] & of[i + 1] for i in range(0, len(sets), 2))
        total += len(sets) // 2
    assert missed <= 0.05 * total


@pytest.mark.parametrize(("num", "n"), [(80, 5000), (90, 5000)])
def test_unrelated_short_texts_fall_into_no_block(num, n):
    rng = np.random.default_rng(26)
    sets = [np.unique(rng.integers(0, 2**63, int(rng.integers(9, 13))).astype(np.uint64)) for _ in range(n)]
    keys, owner = ngram_join.keys_of(sets, ngram_join.Levels(num, 100))
    of = collections.defaultdict(set)
    for k, o in zip(keys.tolist(), owner.tolist(), strict=True):
        of[k].add(o)
    assert max(map(len, of.values())) == 1


def test_more_members_than_the_filter_takes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_MEMBERS", 3)
    rng = random.Random(27)
    texts = near_copies(rng, 10, 4, [30, 90]) + [None, "", "x y " * 20_000, "x y " * 20_000]
    got = ngram_join.groups(docs(spark, texts).repartition(3), size=3, num=90).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == dict(enumerate(brute_groups(texts, 3, 90, 100)))


@pytest.mark.parametrize("anew", [0, 10**9])
def test_large_blocks_keep_every_link(spark, monkeypatch, anew):
    monkeypatch.setattr(ngram_join, "ANEW_PAIRS", anew)
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    monkeypatch.setattr(ngram_join, "SEATS", 16)
    monkeypatch.setattr(ngram_join, "PACK", 5)
    rng = random.Random(9)
    texts = near_copies(rng, 3, 60, [120]) + near_copies(rng, 10, 3, [30])
    got = ngram_join.groups(docs(spark, texts), size=3, num=90, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == dict(enumerate(brute_groups(texts, 3, 90, 100)))


def test_one_of_each_group_stays(spark):
    rng = random.Random(10)
    texts = near_copies(rng, 12, 5, [60, 100]) + [None, None]
    want = {i for i, (n, c) in enumerate(brute_groups(texts, 5, 80, 100)) if c == i}
    df = docs(spark, texts)
    out = ngram_join.one_each(df)
    assert {r["doc_id"] for r in out.collect()} == want and out.columns == df.columns
    twice = df.union(df.limit(5))
    assert ngram_join.one_each(twice).count() == len(want)
    assert ngram_join.groups(docs(spark, [])).count() == 0
    nulls = docs(spark, ["a b c", "a b c"], ids=[None, 4])
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.groups(nulls).collect()} == {(None, None), (4, 4)}


def test_texts_under_one_key_stay_unless_they_link(spark):
    rng = random.Random(18)
    texts = [prose(rng, [f"w{i}" for i in range(500)], 60) for _ in range(12)]
    rows = [(7, t) for t in texts[:8]] + [(7, texts[0]), (3, texts[1]), (9, texts[2]), (5, texts[8]), (None, texts[3]), (None, texts[3])]
    df = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    want = sorted([(7, t) for t in (texts[0], *texts[2:8])] + [(3, texts[1]), (5, texts[8]), (-1, texts[3]), (-1, texts[3])])
    for n in (1, 3):
        got = ngram_join.one_each(df.repartition(n))
        assert got.columns == df.columns and sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in got.collect()) == want


def test_components_against_union_find(spark):
    rng = np.random.default_rng(11)
    e = rng.integers(0, 200, (150, 2)).tolist() + [[i, i + 1] for i in range(300, 360)]
    parent = list(range(400))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(e, "src long, dst long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for a, b in e if a != b for x in (a, b)}


# --- 9: WARC ---------------------------------------------------------------


def test_warc_archive_and_records(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 40, "<p>a</p>", "x"]
    rows = [(i + 3, f"http://h/{i}\r\nx" if i == 4 else None if i == 6 else f"http://h/{i}", t, "clash") for i, t in enumerate(html)] + [(None, "u", "<p>a</p>", "c"), (3, "http://h/0", "<p>a</p>", "c"), (None, "u", "only null", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, header string")
    headers, payloads = warc.write_archive(df, scratch(spark, "warc"))
    assert payloads.count() == len({t or "" for _, _, t, _ in rows})
    got = warc.reconstruct(headers, payloads, full=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    texts = collections.Counter()
    for r in got:
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        body = body[:-4].decode()
        texts[r["page_id"], body] += 1
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        want = "response" if body not in first or r["page_id"] == first[body] else "revisit"
        assert r["record_type"] == want and r["refers_to"] == (first[body] if want == "revisit" else None)
        assert head.startswith(b"WARC/1.1\r\n") and head.count(b"\r\n") == len(head.split(b"\r\n")) - 1
    assert texts == collections.Counter((i, t or "") for i, _, t, _ in rows)
    few, _ = warc.write_archive(df, scratch(spark, "warc"), min_revisit=100)
    assert warc.parse_headers(few).where("record_type = 'revisit'").count() == 0
    none, _ = warc.write_archive(df.limit(0), scratch(spark, "warc"))
    assert none.count() == 0


# --- 10: nearest neighbours ------------------------------------------------


def test_search_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[50]
    x[5] = 0
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] * 16, 1), (903, [float("inf")] * 16, 1), (904, [1.0, 2.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    v = ann.usable(df, "vec_id", "embedding")
    index = ann.build_index(v, scratch(spark, "ann"), 200)
    assert index.count() >= 5
    for factor, least in ((1.0, 1.0), (1.3, 0.9)):
        got = collections.defaultdict(list)
        for r in ann.search(index, v.where("key % 20 = 0"), 20, factor, 16).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        hit = total = 0
        for q in range(0, 900, 20):
            s = np.zeros(900)
            for i in range(16):
                s += x[q, i].astype(float) * x[:, i].astype(float)
            want = sorted((i for i in range(900) if i not in (q, 5)), key=lambda i: (-s[i], i))[:20]
            hit, total = hit + len(set(want) & {i for i, _ in got[q]}), total + 20
            if factor == 1.0:
                assert [i for i, _ in got[q]] == want and [b for _, b in got[q]] == pytest.approx([s[i] for i in want], abs=1e-12)
        assert hit / total >= least
    none = ann.usable(df.limit(0), "vec_id", "embedding")
    assert ann.search(ann.build_index(none, scratch(spark, "ann")), none).count() == 0


def test_rows_that_repeat_a_key_are_candidates_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (20, [1.0, 0.0]), (2, [0.5, 0.0])]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), "vec_id", "embedding")
    got = ann.search(ann.build_index(v, scratch(spark, "ann"), 2), v.where("key % 20 = 0"), 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (1, 0.5), (1, 0.5), (2, 0.5)]


@pytest.mark.parametrize("kind", ["binary", "one-hot"])
def test_ties_of_different_vectors_go_to_the_smaller_key(kind):
    rng = np.random.default_rng(19)
    x = rng.integers(0, 2, (1500, 12)) if kind == "binary" else np.eye(700)[rng.permutation(700)]
    x = x[(x != 0).any(1)].astype(np.float32)
    keys = rng.permutation(len(x)) + 1
    shard = ann.Shard(keys, x, float(np.sqrt((x.astype(float) ** 2).sum(1).max())))
    got = collections.defaultdict(list)
    for q, v, s in shard.search(keys[:40], x[:40], 20, 1.0):
        got[q].append((v, s))
    for key, q in zip(keys[:40].tolist(), x[:40], strict=True):
        s = x.astype(float) @ q.astype(float)
        want = sorted(((-a, b) for a, b in zip(s.tolist(), keys.tolist(), strict=True) if b != key))[:20]
        assert got[key] == [(b, -a) for a, b in want]


def test_ascii_splitting_equals_the_pattern():
    import regex

    fast, slow = bpe._ascii_split(PATTERN), regex.compile(PATTERN).findall
    rng = random.Random(13)
    pool = "ab Z09'stredmvl \t\n\r\x0b\x0c\x1c\x1d\x1f\x00.,!$-_"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        assert fast(t) == slow(t)
    assert bpe._ascii_split(r"(a)\b")("a a") == ["a", "a"]


def test_bounded_memo_changes_nothing(monkeypatch):
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    rng = random.Random(14)
    texts = ["".join(rng.choice("abcd e") for _ in range(60)) for _ in range(200)]
    want = bpe.MergeReplay(ranks, PATTERN).encode_block(texts)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 40)
    monkeypatch.setattr(bpe, "REPLAY_WORDS", 7)
    small = bpe.MergeReplay(ranks, PATTERN)
    assert [small.encode_block([t])[0] for t in texts] == want
