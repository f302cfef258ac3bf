"""WARC: a content-addressed archive of records.

Payload bytes are stored once each, under their SHA-256; the exact header block of every
record is stored separately with the digest of the payload it stands for. Original records
come back by joining headers with payloads. Both are Parquet tables in the shared folder, so
lost executors cost a task only. Everything is built-in functions.

Of records with equal payloads of at least min_revisit bytes, the one with the smallest key
is a response and the others revisit it. Copies meet only in partial aggregates, and the
joins on digests have a large side that Spark may split, so one payload may belong to a
third of all rows.

Defined results: null payload is empty. Rows that repeat the key of the response with the
same payload are responses too (the same record again). A null key is never referred to: such rows revisit
the smallest key with their payload, or are responses where there is none. A null or odd URL
leaves the target header out or has its line breaks encoded. An empty table gives an empty
archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four letters."""
    digest = F.sha1(payload)
    parts = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), key.cast("string"), F.lit(">"))


def _headers(c: dict[str, Column]) -> Column:
    """The header block of a record, through its blank line."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    url = F.replace(F.replace(c["url"], F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = c["type"] == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", c["type"]),
        line("WARC-Record-ID", F.coalesce(_record_id(c["key"]), F.lit("<urn:record:none>"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c["sha1"])),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(c["refers"]))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(c["bytes"].cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(df: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write headers and payloads under root; returns them as read back.

    headers: key, sha256, header binary. payloads: sha256, payload binary.
    """
    from .common import discard, save

    spark = df.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    store = save(rows.select(F.sha2("payload", 256).alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload")), f"{root}/payloads")
    facts = save(rows.select("key", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), f"{root}/facts")
    heads = save(facts.groupBy("sha256").agg(F.min("key").alias("head")), f"{root}/heads")
    typed = facts.join(heads, "sha256")
    revisit = (F.col("bytes") >= min_revisit) & F.col("head").isNotNull() & ~F.col("key").eqNullSafe(F.col("head"))
    typed = typed.withColumn("type", F.when(revisit, "revisit").otherwise("response"))
    header = _headers({"key": F.col("key"), "url": F.col("url"), "type": F.col("type"), "sha1": F.col("sha1"), "refers": F.col("head"), "bytes": F.col("bytes")})
    headers = save(typed.select(F.col("key").alias(key), "sha256", header.cast("binary").alias("header")), f"{root}/headers")
    discard(spark, f"{root}/facts", f"{root}/heads")
    return headers, store


def parse_headers(headers: DataFrame, key_type: str = "long") -> DataFrame:
    """Fields read from the exact header bytes: record_type, refers_to, payload_digest, content_length."""
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    refers = field("WARC-Refers-To", "<urn:record:([^>]*)>")
    return headers.withColumns(
        {
            "record_type": field("WARC-Type", r"(\w+)"),
            "refers_to": F.when(refers != "", refers).cast(key_type),
            "payload_digest": field("WARC-Payload-Digest", r"sha1:(\w+)"),
            "content_length": field("Content-Length", r"(\d+)").cast("long"),
        }
    )


def verified(payloads: DataFrame) -> DataFrame:
    """Facts of each stored payload; fails where bytes do not match their digest."""
    return payloads.select(
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(F.raise_error("stored payload does not match its digest").cast("string")).alias("sha256"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("stored_digest"),
    )


def reconstruct(headers: DataFrame, payloads: DataFrame, full: bool = False) -> DataFrame:
    """Original records: headers joined with payloads, as the bytes of a WARC record.

    A revisit has no block of its own unless full is set, which gives every row its payload.
    """
    fields = parse_headers(headers)
    body = F.when((F.col("record_type") == "revisit") & ~F.lit(full), F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header"), body, F.lit(b"\r\n\r\n"))
    return fields.join(payloads, "sha256").withColumn("record", record)


def op9_warc(spark, sf_dir):
    from .common import scratch, table

    pages = table(spark, sf_dir, "pages")
    headers, payloads = write_archive(pages, scratch(spark, "warc"))
    fields = parse_headers(headers, pages.schema["page_id"].dataType.simpleString())
    out = fields.select("page_id", "sha256", "record_type", "refers_to", F.col("payload_digest").alias("said")).join(verified(payloads), "sha256")
    digest = F.when(F.col("said") == F.col("stored_digest"), F.col("stored_digest")).otherwise(F.raise_error("record and payload differ").cast("string"))
    return out.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
