"""Line dedup by winnowing: later repeated runs of lines are deleted.

A run is a row of whole lines, blank ones passed over, of at least MIN_WORDS words.
Documents are ordered by doc_id and lines by place; a run that was there before is
deleted, so that each passage stays where it occurs first. A line is deleted
exactly if some run of it was there before.

A window is a shortest run: the lines from one line on, or back from one line,
until MIN_WORDS words are reached. Of each window the line with the least hash is
a fingerprint; two equal windows select the same one, so every repeated run shares
a fingerprint with its earlier place, and most lines select none. Fingerprints met
twice are joined; from these places the match is extended both ways, by the hashes
of all windows around the fingerprint, which together cover a run from end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.llm.common import free_name, join_few
from areal.plans.sizing import checkpoint

#: Words of the shortest run that is deleted.
MIN_WORDS = 40
KEY = ["_place", "_text_hash"]
SELECTED = (
    "_place long, _text_hash long, print long, again boolean, windows array<struct<run:binary,first:int,last:int>>"
)


def windows(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """The shortest runs (first, end) of at least min_words words, from each line on and back from each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + min_words, side="left")
    forward = {(s, int(e)) for s, e in enumerate(ends) if e <= n}
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    back = {(int(s), e + 1) for e, s in enumerate(starts) if s >= 0}
    return sorted(forward | back)


def select(text: str, min_words: int = MIN_WORDS) -> dict[int, list[tuple[bytes, int, int]]]:
    """Fingerprints of a whole text: for each the windows that select it, as (hash of the run, first, last line)."""
    lines = [(i, said) for i, line in enumerate(text.split("\n")) if (said := line.strip())]
    hashes = [hashlib.blake2b(said.encode(), digest_size=16).digest() for _, said in lines]
    numbers = [int.from_bytes(h[:8], "little", signed=True) for h in hashes]
    words = np.fromiter((len(said.split()) for _, said in lines), dtype=np.int64, count=len(lines))
    found: dict[int, list[tuple[bytes, int, int]]] = {}
    for first, end in windows(words, min_words):
        run = hashlib.blake2b(b"".join(hashes[first:end]), digest_size=16).digest()
        least = min(numbers[first:end])
        found.setdefault(least, []).append((run, lines[first][0], lines[end - 1][0]))
    return found


def _selected(min_words: int):  # noqa: ANN202
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct({"run": pa.binary(), "first": pa.int32(), "last": pa.int32()})
        schema = pa.schema(
            {
                "_place": pa.int64(),
                "_text_hash": pa.int64(),
                "print": pa.int64(),
                "again": pa.bool_(),
                "windows": pa.list_(run),
            }
        )
        for batch in batches:
            places, keys, texts = (batch[i].to_pylist() for i in range(3))
            out: list[list] = [[], [], [], [], []]
            for place, key, text in zip(places, keys, texts, strict=True):
                for number, found in select(text, min_words).items():
                    again = len({w[0] for w in found}) < len(found)
                    told = [dict(zip(("run", "first", "last"), w, strict=True)) for w in found]
                    for column, value in zip(out, (place, key, number, again, told), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows


def _placed(docs: DataFrame) -> DataFrame:
    """(_place, _text_hash, text): the order of documents; a null id comes first, a null text counts as empty."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_place"),
        F.xxhash64("text").alias("_text_hash"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_place, _text_hash, lines, copied_from): lines to delete of each document with repeated runs.

    lines are numbers from 0, copied_from the ids of the documents where the runs
    occur first (the document itself, where it repeats its own).
    """
    selected = checkpoint(_placed(docs).mapInArrow(_selected(min_words), SELECTED))
    met = selected.groupBy("print").agg(F.sum(F.lit(1) + F.col("again").cast("int")).alias("n")).filter("n > 1")
    matched = join_few(selected, checkpoint(met.select("print")), ["print"], "left_semi")
    runs = checkpoint(
        matched.select(*KEY, F.inline("windows")).select(*KEY, "run", F.col("first").alias("_first"), "last")
    )
    where = F.struct("_place", "_text_hash", "_first")
    earliest = runs.groupBy("run").agg(F.min(where).alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    later = runs.join(earliest, "run").filter(where > F.col("earliest"))
    return (
        later.select(*KEY, F.col("earliest._place").alias("source"), F.explode(F.sequence("_first", "last")).alias("line"))
        .groupBy(*KEY)
        .agg(F.collect_set("line").alias("lines"), F.collect_set("source").alias("copied_from"))
    )


def _kept(text: Column, lines: Column) -> Column:
    """Text without the lines of these numbers."""
    every = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), lines)
    return F.array_join(F.transform(kept, lambda i: F.get(every, i)), "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, detail: bool = False) -> DataFrame:
    """All rows and columns of docs, texts without their later repeated runs.

    A text that is one repeated run becomes empty; its row stays. Null texts stay
    null. A column n_chars follows the text. Rows that repeat a doc_id are ordered
    by a hash of their text; wholly repeated rows share one place and fare alike.
    detail adds removed_lines (ascending) and copied_from, replacing columns of
    these names. Empty tables give no rows.
    """
    place, key, lines, source = (free_name(n, docs.columns) for n in ("_place", "_text_hash", "_lines", "_source"))
    found = repeats(docs, min_words).toDF(place, key, lines, source)
    marked = docs.withColumn(place, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn(
        key, F.xxhash64("text")
    )
    joined = marked.join(found, [place, key], "left")
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col(lines)))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(changed))
    kept = [F.col(f"`{c}`") for c in docs.columns if not detail or c not in ("removed_lines", "copied_from")]
    if not detail:
        return out.select(*kept)
    none = F.array()
    return out.select(
        *kept,
        F.coalesce(F.array_sort(lines), none.cast("array<int>")).alias("removed_lines"),
        F.coalesce(F.array_sort(source), none.cast("array<bigint>")).alias("copied_from"),
    )
