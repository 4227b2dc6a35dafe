"""Helpers shared by the operators: tables, folds, words, free column names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def portions(texts: list[str | None], chars: int = 1 << 20) -> Iterator[slice]:
    """Slices of about so many characters in all, or of one longer text; bounds what a task unfolds at once."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def give_back() -> None:
    """Return the memory that a worker has freed to the system; the worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than Linux have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that gives freed memory back at the end."""

    def rows(batches: Iterator) -> Iterator:
        yield from function(batches)
        give_back()

    return rows


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """A column name that no column has, in any case of its letters."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def labels_of(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with one row for each id; ids without a label or with contrary ones are left out."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_most"))
        .filter(F.col("label") == F.col("_most"))
        .drop("_most")
    )


#: Rows of a few numbers each that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def keyed(docs: DataFrame, name: str = "_text_hash") -> DataFrame:
    """docs with a hash of the text: with doc_id it tells documents apart, also where ids repeat."""
    return docs.withColumn(name, F.xxhash64("text"))


def join_few(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join (null keys match) to a written or checkpointed table of short rows.

    Counted first: up to most rows are broadcast, so left does not move; more are
    joined by a shuffle, where AQE splits partitions of frequent keys. The rows are
    the same either way. how is inner, left, left_semi or left_anti.
    """
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    small = right.limit(most + 1).count() <= most
    matches = [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return left.join(F.broadcast(renamed) if small else renamed, condition, how).drop(*[f"_right_{c}" for c in on])
