"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams (one and two words) are estimated: of target
texts and of raw text. A text's log importance weight is its n-grams' log probability under
the target model less that under the raw one. Adding Gumbel noise to the weights and taking
the k largest samples k texts without replacement in proportion to their weights.

The raw model counts every text. The target model may be fitted on a bounded sample of
labelled texts: TARGET_ROWS keys at most in expectation, the smallest by hash, which is the only thing
broadcast besides the models (BUCKETS numbers). The k-th largest key is found by counting
in ever finer ranges, so nothing is sorted in one place.

Defined results: null or empty text has weight 0; the noise depends on the key and seed only, so
reruns agree; ties go to the smaller key (null first), then to fewer n-grams; of rows alike in all this as many
are kept as are left of k, so k rows stay whatever repeats; keys may be of any type that sorts; other columns are
not read; without target texts all weights are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, bounded_batches, kept, mix64, running, take_over

BUCKETS = 10_000
#: Labelled target texts that are fitted on, at most (expected).
TARGET_ROWS = 20_000
#: Share of the texts that is sampled.
KEEP = 0.5
_WORDS = WordHash()


def _begin() -> None:
    take_over("quality", _WORDS.memo.clear)


def buckets(text: bytes) -> np.ndarray:
    """Buckets of a text's words and pairs of neighbouring words."""
    h = _WORDS(text.lower().split())
    pairs = mix64(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, target_keys: np.ndarray, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability of each bucket."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(target_keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        sums = np.zeros((2, BUCKETS))
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            hit = np.isin(keys, wanted.value)
            for t, target in zip(b.column(1), hit, strict=True):
                n = np.bincount(buckets(t.as_buffer().to_pybytes()), minlength=BUCKETS)
                sums[0] += n
                if target:
                    sums[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "raw", "target"])

    rows = bounded_batches(docs).where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)
    found = rows.mapInArrow(count, "bucket int, raw double, target double").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = found["bucket"].to_numpy()
    raw[at] += found["raw"].to_numpy()
    target[at] += found["target"].to_numpy()
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_grams, log_weight) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        _begin()
        for b in batches:
            n, w = [], []
            for t in b.column(1):
                at = buckets(t.as_buffer().to_pybytes()) if t.is_valid else np.empty(0, np.int64)
                n.append(len(at))
                w.append(float(shared.value[at].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=[key, "n_grams", "log_weight"])

    return bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, n_grams long, log_weight double")


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column of finite numbers, by counts in ever finer ranges."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if k <= 0 or row["n"] < k:
        return None
    lo, hi = row["lo"], row["hi"]
    while lo < hi:
        step = (hi - lo) / 1024
        if step <= 0 or lo + step == lo:
            break
        inside = df.where(F.col(column).between(lo, hi))
        place = F.least(F.floor((F.col(column) - lo) / step), F.lit(1023)).alias("b")
        bins = inside.groupBy(place).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        above = df.where(F.col(column) > hi).count()
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi = r["lo"], r["hi"]
    return hi


def sample(weighted: DataFrame, k: int, key: str = "doc_id", seed: int = 1) -> DataFrame:
    """weighted with gumbel_key and kept: the k rows of the largest keys."""
    u = (F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND((1 << 52) - 1) + F.lit(0.5)) / float(1 << 52)
    rows = kept(weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))
    least = kth_largest(rows, "gumbel_key", k)
    if least is None:
        return rows.withColumn("kept", F.lit(k > 0))
    left = k - rows.where(F.col("gumbel_key") > least).count()
    at = running(rows.where(F.col("gumbel_key") == least), [F.col(key).asc_nulls_first(), F.col("n_grams")], {"_rank": F.lit(1)})
    at = at.withColumn("kept", F.col("_rank") < left).drop("_rank")
    return rows.where(F.col("gumbel_key") != least).withColumn("kept", F.col("gumbel_key") > least).unionByName(at)


def target_sample(labels: DataFrame, key: str = "doc_id", rows: int = TARGET_ROWS) -> np.ndarray:
    """Keys of labelled target rows: all, or in expectation so many by hash."""
    good = labels.where((F.col("quality") == 1) & F.col(key).isNotNull()).select(key).distinct()
    n = good.count()
    share = min(1.0, rows / max(1, n))
    mark = F.xxhash64(F.col(key), F.lit(11)).bitwiseAND((1 << 31) - 1)
    return good.where(mark < int(share * (1 << 31))).toArrow()[key].to_numpy()


def op3_quality(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    ratio = fit(docs, target_sample(table(spark, sf_dir, "labels")))
    return sample(weigh(docs, ratio), int(np.ceil(KEEP * docs.count())))
