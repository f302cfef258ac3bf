"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal numbers of words. Slot i takes the golden-ratio point
frac((i + 1/2) * phi), which falls into one source's part of the cumulative weights, so
every stretch of the schedule holds each source close to its weight. A source's slots are
ranked; rank k takes block k of the source's stream: its documents in shuffled order (by
the MD5 of their key), twice over if need be, cut into blocks of as many words. What the
points leave a source short of, or give it beyond its target (a few blocks), is appended
or cut, so that each source's words come to its target exactly. apply() puts the rows of the
mix in the schedule's order.

Running sums over documents, sources and slots are taken in two levels (ranges of a sort,
then within a range), so neither a source nor a key need fit a task. Points meet sources
through cells of the cumulative weights, an equi-join. Only sums reach the driver; the table of
sources is broadcast up to BROADCAST_SOURCES rows and joined beyond.

Defined results: null text has size 0 and is taken 0 times; null sources are one source,
last in order; null keys are a key like others; rows that repeat a key are distinct, in the order of their size
and other columns, each with a share of its own; columns of any name are carried by apply();
an empty table gives an empty schedule; sources without words have target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, running, unused

#: Weights of the sources in order, repeating; share of all words that is taken; passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), (3, 2), 2
#: Words in a slot.
SLOT_WORDS = 4096
#: Sources up to which their table is broadcast; cells of the cumulative weights for each source, and at least.
BROADCAST_SOURCES, CELLS, LEAST_CELLS = 50_000, 4, 1024
_PHI = 0.6180339887498949


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _running(df: DataFrame, by: list[str], order: list, amount, bucket_of, name: str) -> DataFrame:
    """df with the sum of amount over earlier rows of the same by: buckets first, then within a bucket.

    bucket_of must not fall along order.
    """
    df = df.withColumn("_bucket", bucket_of).withColumn("_amount", amount)
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*by, "_bucket").agg(F.sum("_amount").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    within = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(sums.drop("_sum"), [*by, "_bucket"])
    return out.withColumn(name, F.col("_base") + F.coalesce(F.sum("_amount").over(within), F.lit(0))).drop("_bucket", "_amount", "_base")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, passes: int = PASSES) -> DataFrame:
    """(no, source, source_size, ahead, target) of sizes (source, source_size); ahead is the size of the sources before it.

    Targets are in proportion to weight, at most passes times a source's size, the excess reshared: in the order of
    size by weight, sources are full as long as what is left would give them more than they have; the others share the rest.
    """
    rows = running(sizes, [F.col("source").asc_nulls_last()], {"no": F.lit(1).cast("long"), "ahead": F.col("source_size")})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    rows = rows.withColumns({"w": weight, "cap": passes * F.col("source_size")})
    rows = running(rows, [F.col("cap").cast("double") / F.col("w"), F.col("no")], {"held": F.col("cap"), "used": F.col("w")})
    every = rows.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    rest = share[0] * (every["n"] or 0) / share[1]
    rows = rows.withColumn("left", F.lit(every["w"] or 0) - F.col("used"))
    full = F.col("cap").cast("double") * F.col("left") <= F.col("w") * (F.lit(rest) - F.col("held"))
    rows = kept(rows.withColumn("full", full))
    first = rows.where("NOT full").agg(F.min("held").alias("held"), F.max("left").alias("left")).first()
    free = F.lit(0.0) if first["left"] is None else F.col("w") * F.lit(rest - first["held"]) / F.lit(first["left"])
    return rows.select("no", "source", "source_size", "ahead", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(free).alias("target"))


class Recipe:
    """The table of sources (no, source, source_size, ahead, target, words, blocks, low: words of the sources before it) and its sums."""

    def __init__(self, sizes: DataFrame, weights, share, passes, slot_words):
        rows = targets(sizes, weights, share, passes)
        words = F.least(F.floor(F.col("target") + 0.5).cast("long"), passes * F.col("source_size"))
        rows = rows.withColumn("words", words).withColumn("blocks", F.ceil(F.col("words") / slot_words).cast("long"))
        self.rows = kept(running(rows, [F.col("no")], {"low": F.col("words")}))
        sums = self.rows.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("blocks").alias("blocks")).first()
        self.sources, self.words, self.blocks = sums["n"], sums["words"] or 0, sums["blocks"] or 0

    def table(self, rows: DataFrame) -> DataFrame:
        """rows (a few for each source) for a join: broadcast while the sources are few."""
        return F.broadcast(rows) if self.sources <= BROADCAST_SOURCES else rows

    def slots(self, spark, parts: int) -> DataFrame:
        """(no, block, slot): the schedule's order of every source's blocks."""
        n = self.blocks
        cell = max(1, -(-self.words // max(CELLS * self.sources, LEAST_CELLS)))
        frac = F.expr(f"(id + 0.5D) * {_PHI}D - floor((id + 0.5D) * {_PHI}D)")
        drawn = spark.range(0, n, 1, max(1, parts)).withColumn("point", F.least(F.floor(frac * F.lit(float(self.words))).cast("long"), F.lit(max(0, self.words - 1))))
        spans = self.rows.where("words > 0").select("no", "blocks", "low", (F.col("low") + F.col("words")).alias("high"))
        spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
        drawn = drawn.withColumn("cell", F.floor(F.col("point") / cell)).join(self.table(spans), "cell").where("point >= low AND point < high").select("id", "no", "blocks")
        ranked = _running(drawn, ["no"], ["id"], F.lit(1).cast("long"), F.floor(F.col("id") / max(1, math.isqrt(n))).cast("long"), "block")
        placed = ranked.where("block < blocks").select("no", "block", F.col("id").alias("slot"))
        counts = drawn.groupBy("no").agg(F.count("*").alias("drawn"))
        short = self.rows.select("no", "blocks").join(counts, "no", "left").where("coalesce(drawn, 0) < blocks")
        late = short.select("no", F.explode(F.sequence(F.coalesce("drawn", F.lit(0).cast("long")), F.col("blocks") - 1)).alias("block"))
        return placed.union(late.select("no", "block", F.lit(n) + F.col("block") * max(1, self.sources) + F.col("no")))


def _placed(df: DataFrame, key: str, text: str, source: str, weights, share, passes: int, slot_words: int, marks: list) -> tuple[DataFrame, Recipe, DataFrame]:
    """Rows (key, source, size, marks, no, source_size, target, words, start), the recipe, its slots."""
    spark = df.sparkSession
    rows = kept(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text).cast("string")).alias("size"), *marks))
    recipe = Recipe(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes, slot_words)
    own = recipe.rows.select("no", F.col("source").alias("_s"), "source_size", "target", "words", "ahead")
    more = [c for c in rows.columns if c not in ("key", "source", "size")]
    rows = rows.join(recipe.table(own), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shuffled = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))
    rows = running(rows, [F.col("no"), shuffled, F.col("key"), F.col("size"), *map(F.col, more)], {"start": F.col("size")})
    rows = kept(rows.withColumn("start", F.col("start") - F.col("ahead")).drop("ahead"))
    return rows, recipe, recipe.slots(spark, -(-recipe.blocks // 20_000))


def _copies(rows: DataFrame, passes: int) -> DataFrame:
    """A row for each pass over a document that takes words of it: copy, from and to in its source's stream."""
    out = rows.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
    out = out.withColumn("from", F.col("start") + F.col("copy") * F.col("source_size"))
    return out.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words"))).where("to > from")


def schedule(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share=SHARE, passes: int = PASSES, slot_words: int = SLOT_WORDS) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents).

    pieces: slot, block, key, source, copy (pass over the source), first and last word (end exclusive) of the
    document that go there. documents: key, size, source_size, target, taken, first_slot (null where none is taken).
    """
    rows, _, slots = _placed(df, key, text, source, weights, share, passes, slot_words, [])
    cut = _copies(rows, passes)
    cut = cut.withColumn("block", F.explode(F.sequence((F.col("from") / slot_words).cast("long"), ((F.col("to") - 1) / slot_words).cast("long"))))
    cut = cut.select("no", "block", "key", "source", "copy", (F.greatest("from", F.col("block") * slot_words) - F.col("from")).alias("first"), (F.least("to", (F.col("block") + 1) * slot_words) - F.col("from")).alias("last"), "start")
    pieces = cut.join(slots, ["no", "block"])
    got = pieces.groupBy("no", "start", "key").agg(F.sum(F.col("last") - F.col("first")).alias("_taken"), F.min("slot").alias("first_slot"))
    docs = rows.join(got.withColumnRenamed("key", "_k").withColumnRenamed("no", "_n").withColumnRenamed("start", "_at"), (F.col("no") == F.col("_n")) & (F.col("start") == F.col("_at")) & F.col("key").eqNullSafe(F.col("_k")) & (F.col("size") > 0), "left")
    docs = docs.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    return pieces.select("slot", "block", F.col("key").alias(key), "source", "copy", "first", "last"), docs


def apply(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars", weights=WEIGHTS, share=SHARE, passes: int = PASSES, slot_words: int = SLOT_WORDS) -> DataFrame:
    """The mix as rows of df's columns, in the schedule's order: one for each pass over a document that takes words of it.

    A row stands in the slot of its first word; partitions hold stretches of the schedule, sorted. A pass that stops at
    its source's target keeps the first words, joined by spaces. length, where df has it, counts the new text's
    characters. Rows equal in every column have as many shares as there are of them.
    """
    names = {n: unused(f"_{n}", df.columns) for n in ("h1", "h2", "take", "size", "slot", "from", "part")}
    marks = [F.xxhash64(*df.columns).alias(names["h1"]), F.xxhash64(F.lit(5), *df.columns).alias(names["h2"])]
    rows, recipe, slots = _placed(df, key, text, source, weights, share, passes, slot_words, marks)
    same = [names["h1"], names["h2"]]
    shares = _copies(rows, passes).withColumn("block", (F.col("from") / slot_words).cast("long")).join(slots, ["no", "block"])
    shares = shares.select(*same, (F.col("to") - F.col("from")).alias(names["take"]), F.col("size").alias(names["size"]), F.col("slot").alias(names["slot"]), F.col("from").alias(names["from"]))
    texts = df.select("*", *marks)
    if not rows.groupBy(*same).count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(same)
    out = texts.join(shares, same)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col(names["take"]).cast("int")), " ")
    out = out.withColumn(text, F.when(F.col(names["take"]) == F.col(names["size"]), F.col(text)).otherwise(cut))
    if length in df.columns:
        out = out.withColumn(length, F.length(text).cast(df.schema[length].dataType))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the points fill the first slots evenly; what is appended goes to the last stretch
    stretch = F.least(F.floor(F.col(names["slot"]) * float(parts) / max(1, recipe.blocks)), F.lit(parts - 1)).cast("int")
    return out.repartitionById(parts, stretch).sortWithinPartitions(names["slot"], names["from"], *same).select(*df.columns)


def op7_mix(spark, sf_dir):
    from .common import table

    return schedule(table(spark, sf_dir, "documents"))[1]
