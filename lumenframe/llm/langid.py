"""Language identification by error-correcting output codes.

Each language has a codeword of bits. A binary classifier for each bit is a pair of n-gram
models: the languages whose codewords have the bit set against the others, as the log ratio
of their mean hashed byte-trigram distributions. A text's mean log ratio, scaled by the
least that any language shows on that bit, is its margin. Decoding takes the codeword of
least logistic loss over all bits, each weighted by how well the bit separates; a text
whose best two codewords are close in loss is flagged ambiguous.

Training reads every labelled text outside the held-out quarter, as counts of languages by
buckets: the model's size depends on the number of languages only. Prediction reads whole
texts. Neither shuffles texts.

Defined results: null text, or one without a letter, is und with score 0; without any
labelled text all are und; one learned language is predicted with score 1; repeated rows repeat; other
columns are carried if asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, take_over

BUCKETS = 1 << 13
#: Added to each bucket's count, in parts of a language's mean count.
SMOOTH = 0.01
#: Difference in loss between the two best codewords, below which a text is ambiguous.
AMBIGUOUS = 0.10
#: How sharply differences in loss become a score.
SHARPNESS = 8.0
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_BLOCK_BYTES, _BLOCK_ROWS = 1_000_000, 64


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts (rows by BUCKETS) of the texts' byte trigrams, letters folded and the rest as spaces, and their sums."""
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        a = np.frombuffer(b" " + t.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
        g = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        g = g[g != 0x202020]
        counts[i] = np.bincount((g * np.uint32(2654435761)) >> np.uint32(19), minlength=BUCKETS)
    return counts, counts.sum(1)


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages: all splits for few, the best of seeded random ones for many."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        rest = [c for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array([(1, *c) for c in rest], float).T
    rng, best, far = np.random.default_rng(7), None, -1
    width = 8 * int(np.ceil(np.log2(n))) + 7
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (n, width))
        c[0], c[1] = 1.0, -1.0  # no bit is the same for all
        c[2:4] = rng.choice([-1.0, 1.0], (2, width))
        d = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        if d > far:
            best, far = c, d
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages by bits
    weights: np.ndarray  # buckets by bits
    scale: np.ndarray  # of each bit's margin
    trust: np.ndarray  # of each bit in the loss, sums to 1

    def losses(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        margins = (counts @ self.weights) / np.maximum(total, 1)[:, None] / self.scale
        return np.stack([(np.logaddexp(0, -2 * self.code[k] * margins) * self.trust).sum(1) for k in range(len(self.languages))], 1)


def fit_counts(counts: dict[str, np.ndarray]) -> Model:
    names = sorted(counts)
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.ones(1))
    p = np.stack([counts[k] + SMOOTH * max(1.0, counts[k].sum()) / BUCKETS for k in names])
    p /= p.sum(1, keepdims=True)
    weights = np.stack([np.log(p[c > 0].mean(0)) - np.log(p[c < 0].mean(0)) for c in code.T], 1)
    expected = p @ weights * code  # positive where a language falls on its side
    scale = np.maximum(expected.min(0), 1e-3)
    return Model(names, code, weights.astype(np.float32), scale, scale / scale.sum())


def held_out(key: str):
    """The quarter of keys that is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from all labelled texts that are not held out."""
    rows = bounded_batches(df).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("langid", lambda: None)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for i, texts in blocks(b.column(0), _BLOCK_BYTES, _BLOCK_ROWS):
                counts, _ = grams(texts)
                here = langs[i : i + len(texts)]
                for k in set(here):
                    of = [n for n, x in enumerate(here) if x == k]
                    sums[k] = sums.get(k, 0) + counts[of].sum(0, dtype=np.float64)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "bucket", "n"])

    found = rows.select(text, lang).mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    for k, bucket, n in zip(found["lang"].to_pylist(), found["bucket"].to_pylist(), found["n"].to_pylist(), strict=True):
        counts.setdefault(k, np.zeros(BUCKETS))[bucket] = n
    return fit_counts(counts)


def predict(model: Model, texts: list[bytes | None]) -> list[tuple[str, float, bool]]:
    """(language, score, ambiguous) of each text."""
    out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
    real = [i for i, t in enumerate(texts) if t and model.languages and _LETTER.search(t.decode())]
    if not real:
        return out
    loss = model.losses(*grams([texts[i] for i in real]))
    order = np.argsort(loss, 1, kind="stable")
    share = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    for n, i in enumerate(real):
        best = order[n, 0]
        gap = loss[n, order[n, 1]] - loss[n, best] if loss.shape[1] > 1 else np.inf
        out[i] = (model.languages[best], float(share[n, best]), bool(gap < AMBIGUOUS))
    return out


def identify(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """The carried columns with the language, its score and whether it is ambiguous, under the given names.

    Carried columns that have one of the names are left out; give other names to keep them.
    """
    carry = df.columns if carry is None else carry
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages by buckets: a fixed size
    own = [c for c in carry if c not in names]

    def run(batches):
        take_over("langid", lambda: None)
        for b in batches:
            got = [x for _, texts in blocks(b.column(len(own)), _BLOCK_BYTES, _BLOCK_ROWS) for x in predict(shared.value, texts)]
            cols = list(zip(*got, strict=True)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], *map(pa.array, cols, (pa.string(), pa.float64(), pa.bool_()))], names=[*own, *names])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own), *(f"`{c}` {t}" for c, t in zip(names, ("string", "double", "boolean"), strict=True))])
    return bounded_batches(df).select(*own, F.col(text).alias("_text")).mapInArrow(run, schema)


def op6_langid(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs), carry=["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
