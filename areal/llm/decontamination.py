"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A benchmark item leaks into a document that holds at least THRESHOLD of the item's
distinct shingles (five words; the words of an item with fewer are one shingle).
Items are partitioned by size: an item of n shingles belongs to the class of the
next power of two, u, and is sketched by its k smallest shingle hashes, k being
one more than the shingles that an item of the class may miss. A document misses
fewer than k shingles of an item that leaks into it, so it holds at least one of
the sketch: the search loses no leak, however long the document is. Its candidates
are verified by exact containment of the shingles' text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.llm.common import SHINGLE_WORDS, SIMILARITY, free_name, join_few, keyed
from areal.plans.sizing import checkpoint

THRESHOLD = SIMILARITY
#: Sketch rows that are broadcast (16 bytes each); longer sketches are joined by a shuffle.
SKETCH_ROWS = 2_000_000
KEY = ["doc_id", "_text_hash"]


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case; a null or empty text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _starts(words: Column) -> Column:
    """Places where a shingle begins."""
    last = F.greatest(F.size(words) - SHINGLE_WORDS, F.lit(0))
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _shingle(words: Column, start: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, SHINGLE_WORDS), " ")


def _hash(words: Column, start: Column) -> Column:
    """Hash of the words of a shingle; places behind a short text count for nothing."""
    return F.xxhash64(*[F.get(words, start + i) for i in range(SHINGLE_WORDS)])


def sketch(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, n, size_class, hash): the smallest shingle hashes of each item, as many as its size class needs."""
    words = items.select("item_id", words_of(F.col("text")).alias("w"))
    hashes = F.array_sort(F.array_distinct(F.transform(_starts(F.col("w")), lambda i: _hash(F.col("w"), i))))
    sized = words.select("item_id", hashes.alias("hashes"), F.size(hashes).alias("n")).filter("n > 0")
    size_class = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")
    needed = F.floor(size_class * (1 - threshold) + 1e-9).cast("int") + 1
    return sized.select(
        "item_id",
        "n",
        size_class.alias("size_class"),
        F.explode(F.slice("hashes", F.lit(1), F.least(needed, F.col("n")))).alias("hash"),
    )


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _text_hash, item_id): documents that hold at least one shingle of an item's sketch."""
    hashes = checkpoint(sketch(items, threshold).select("hash", "item_id").distinct())
    words = docs.select(*KEY, words_of(F.col("text")).alias("w"))
    places = words.select(*KEY, "w", F.explode(_starts(F.col("w"))).alias("i"))
    found = places.select(*KEY, _hash(F.col("w"), F.col("i")).alias("hash"))
    return join_few(found, hashes, ["hash"], "inner", SKETCH_ROWS).select(*KEY, "item_id").distinct()


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _text_hash, item_id, n_shingles, n_shared, containment) of every leak.

    docs has doc_id and text, items has item_id and text; other columns are not
    read. Null and empty texts hold nothing and leak nowhere. Rows that repeat a
    doc_id with other texts count on their own, wholly repeated rows once; rows that
    repeat an item_id count as one item with the shingles of all. An item of fewer
    than five words leaks only into texts of just these words.
    """
    if not 0 < threshold <= 1 or math.isnan(threshold):
        raise ValueError("threshold must be above 0 and at most 1")
    rows = keyed(docs.select("doc_id", "text"))
    found = checkpoint(candidates(rows, items, threshold))
    suspects = checkpoint(found.select(*KEY).distinct())
    held = join_few(rows, suspects, KEY, "left_semi").select(*KEY, words_of(F.col("text")).alias("w"))
    held = held.select(*KEY, F.explode(_starts(F.col("w"))).alias("i"), "w").select(
        *KEY, _shingle(F.col("w"), F.col("i")).alias("shingle")
    )
    words = items.select("item_id", words_of(F.col("text")).alias("w"))
    own = checkpoint(
        words.select("item_id", F.explode(_starts(F.col("w"))).alias("i"), "w")
        .select("item_id", _shingle(F.col("w"), F.col("i")).alias("shingle"))
        .distinct()
    )
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    shared = join_few(held, own, ["shingle"], "inner").distinct()
    counted = shared.groupBy(*KEY, "item_id").agg(F.count("*").alias("n_shared"))
    sized = counted.join(sizes, "item_id")
    verified = sized.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(
        F.col("n_shared") >= F.col("n_shingles") * threshold - 1e-9
    )
    names = [*KEY, "item_id", "n_shingles", "n_shared", "containment"]
    return join_few(verified, found, [*KEY, "item_id"], "left_semi").select(*names)


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, into which no item leaks."""
    named = free_name("_key", docs.columns)
    marked = docs.withColumn(named, F.xxhash64("text"))
    bad = leaks(docs, items, threshold).select("doc_id", F.col("_text_hash").alias(named)).distinct()
    return join_few(marked, checkpoint(bad), ["doc_id", named], "left_anti").drop(named)
