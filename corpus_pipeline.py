"""A corpus pipeline of five stages over the documents table; part of the llm package.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
run() writes each stage's rows as Parquet and rereads them. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, langid, mix, ngram_join, pii
from lumenframe.llm.common import discard, scratch, unused

#: Bound on the chance that a linked pair shares no key: about that of two 64-bit hashes of a text being equal by accident.
MISS = 1e-15
#: An ambiguous text with a score below this has no language that it could be kept for.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: und, or ambiguous between codewords with a low score. Learned anew from these documents.

    Null, empty and letterless texts are und; without labelled texts all are; repeated rows share their fate; an
    empty table stays empty; columns of any name are kept as they are.
    """
    pred, score, ambiguous = names = tuple(unused(c, docs.columns) for c in ("lang_pred", "score", "ambiguous"))
    out = langid.identify(docs, langid.fit(docs), names=names)
    rejected = (F.col(pred) == "und") | (F.col(ambiguous) & (F.col(score) < LEAST_SCORE))
    return out.where(~rejected).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group linked by five-word shingles at a similarity of 0.8.

    Null and empty texts and null ids link with nothing and stay; rows of one id are told apart by all columns, and
    rows equal in all are one; an empty table stays empty. A pair goes unseen with a probability of MISS at most;
    see ngram_join.Levels.
    """
    return ngram_join.one_each(docs, miss=MISS)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it become labels; every document stays.

    Null texts stay null, empty ones empty; repeated rows stay, each generalised alike; an empty table stays empty.
    """
    return pii.sanitise(docs, scratch(spark, "pii"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents in the schedule's order: a row for each pass over a document, with the words which that pass takes.

    Whole passes keep the text as it is; the one that meets a source's target is cut there. n_chars
    is that of the new text. Null and empty texts have no words to take and are in no pass; a null source is a source;
    rows that repeat an id have a share each; an empty table stays empty.
    """
    return mix.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every text; null and empty texts have none."""
    import public_tokenizers as tok

    out = bpe.encode(docs, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", sanitise),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: Learned and iterative stages have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{n}")
        docs = spark.read.parquet(f"{root}/{n}")
        if n:
            discard(spark, f"{root}/{n - 1}")
    return docs
