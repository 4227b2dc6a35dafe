"""N-gram Jaccard join by MinHash banding, and the groups of near copies it links.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of at least THRESHOLD. Texts with equal sets are copies: they form one
class at once and are not compared. Bands and rows of the MinHash signature are
computed from the recall wanted at the threshold. Each class is shuffled on its
band hashes, and every bucket gives one edge from each member to its least one, so
its size grows with the members, not with their pairs. The components of these
edges hold every candidate pair. Within a component all pairs are verified on the
full shingle sets, in blocks of bounded bytes and bounded sets, each block against
each other one in a task of its own; a task works in strips of rows and returns the
number of links of each text and a spanning forest of the links it found, so neither
candidates nor links are ever written out as pairs. The components of the forests are
the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.llm.common import SHINGLE_WORDS, SIMILARITY, free_name, join_few, portions, tidied
from areal.llm.components import components
from areal.plans.sizing import checkpoint

THRESHOLD = SIMILARITY
#: Share of pairs at the threshold itself that may be missed, and the most hashes of a signature.
MISSED, MOST_HASHES = 1e-4, 192
#: Bytes of shingle sets in a block, and sets in it; cells of a matrix of pairs that are held at once.
BLOCK_BYTES, BLOCK_SETS = 4 << 20, 2000
STRIP_CELLS = 2 << 20
SEED = 7
KEY = ["_place", "_text_hash"]
NO_ID = -(2**63)


def bands_for(threshold: float, missed: float = MISSED, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows of a signature of at most so many hashes: the most rows (fewest false candidates) that
    still find all but a share missed of the pairs at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(missed) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text: runs of five words in lower case, parted by white space.

    A text of fewer words has one shingle of all of them, a null or empty text none.
    """
    lists = [t.lower().split() if t else [] for t in texts]
    flat = np.array([w for words in lists for w in words], dtype=object)
    if not len(flat):
        return [np.zeros(0, dtype=np.uint64) for _ in lists]
    codes, distinct = pd.factorize(flat)
    hashes = pd.util.hash_array(distinct, categorize=False)[codes]
    sets, start = [], 0
    for words in lists:
        own = hashes[start : start + len(words)]
        start += len(words)
        width = min(SHINGLE_WORDS, len(own))
        mixed = np.full(max(0, len(own) - width + 1) if width else 0, width, dtype=np.uint64)
        for i in range(width):
            mixed = _mix(mixed + own[i : i + len(mixed)])
        sets.append(np.unique(mixed))
    return sets


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes of each set, one row for each; sets must not be empty."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
    values = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        mixed = np.full(len(sets), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            mixed = _mix(mixed + np.minimum.reduceat(values * factors[k] + shifts[k], starts))
        out[:, band] = mixed
    return out.view(np.int64)


def _signed(bands: int, rows: int):  # noqa: ANN202
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in portions(texts):
                sets = shingle_sets(texts[part])
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                place, key = batch["_place"].to_pylist()[part], batch["_text_hash"].to_pylist()[part]
                full = [i for i, s in enumerate(sets) if len(s)]
                hashes: list = [[]] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], bands, rows), strict=True):
                        hashes[i] = row
                for i, s in enumerate(sets):
                    if not len(s):  # a text without words is like no other
                        keys[i] = hashlib.blake2b(repr((place[i], key[i])).encode(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place, pa.int64()),
                        pa.array(key, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(hashes, pa.list_(pa.int64())),
                    ],
                    names=["_place", "_text_hash", "set_key", "size", "bands"],
                )

    return sign


def _linked(
    rows: list[np.ndarray], others: list[np.ndarray] | None, threshold: float
) -> Iterator[tuple[int, np.ndarray]]:
    """Which rows and others are linked, as strips of a matrix, each with the number of its first row; without others
    the rows with each other, each pair once."""
    every = rows if others is None else [*rows, *others]
    values = np.concatenate(every)
    distinct, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    shared = counts[codes] > 1
    owner, column = owner[shared], place[codes[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    size = np.array([len(s) for s in every], dtype=np.float64)
    behind = 0 if others is None else len(rows)
    n = len(every) - behind
    width = max(256, (4 << 20) // max(1, len(every)))
    strip = max(1, STRIP_CELLS // max(1, n))
    for first in range(0, len(rows), strip):
        last = min(first + strip, len(rows))
        common = np.zeros((last - first, n), dtype=np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            low, high = np.searchsorted(column, [start, start + width])
            own, at = owner[low:high], column[low:high] - start
            left, right = (own >= first) & (own < last), own >= behind
            if not left.any():
                continue
            held, facing = np.zeros((last - first, width), dtype=np.float32), np.zeros((n, width), dtype=np.float32)
            held[own[left] - first, at[left]] = 1
            facing[own[right] - behind, at[right]] = 1
            common += held @ facing.T
        whole = size[first:last, None] + size[None, behind:] - common
        linked = common >= threshold * whole - 1e-6
        yield first, np.triu(linked, first + 1) if others is None else linked


def _verified(threshold: float):  # noqa: ANN202
    schema = pa.schema({"a": pa.binary(), "b": pa.binary(), "links": pa.int64()})

    def block(keys: list[bytes], sides: list[int], sets: list[bytes], same: bool) -> pa.RecordBatch:
        arrays = [np.frombuffer(s, dtype=np.uint64) for s in sets]
        side = np.array(sides)
        left, right = (np.arange(len(keys)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(left) or not len(right):
            return pa.RecordBatch.from_pylist([], schema)
        strips = _linked([arrays[i] for i in left], None if same else [arrays[i] for i in right], threshold)
        links = np.zeros(len(keys), dtype=np.int64)
        tree = np.arange(len(keys))
        forest = []
        for first, linked in strips:
            own = left[first : first + len(linked)]
            links[own] += linked.sum(axis=1)
            links[right] += linked.sum(axis=0)
            for i, row in zip(own, linked, strict=True):
                mates = right[row]
                trees, at = np.unique(tree[mates], return_index=True)
                new = trees != tree[i]
                if new.any():
                    forest += [{"a": keys[i], "b": keys[j], "links": 0} for j in mates[at[new]]]
                    tree[np.isin(tree, trees[new])] = tree[i]
        out = [{"a": keys[i], "b": None, "links": int(links[i])} for i in np.flatnonzero(links)]
        return pa.RecordBatch.from_pylist(out + forest, schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by task; the rows of one are taken together."""
        task, held = None, ([], [], [])
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["group"], row["i"], row["j"])
                if at != task:
                    if held[0]:
                        yield block(*held, same=task[1] == task[2])
                    task, held = at, ([], [], [])
                for column, name in zip(held, ("set_key", "side", "shingles"), strict=True):
                    column.append(row[name])
        if held[0]:
            yield block(*held, same=task[1] == task[2])

    return verify


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        for part in portions(texts):
            sets = pa.array([s.tobytes() for s in shingle_sets(texts[part])], pa.binary())
            own = batch.slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays(
                [own["group"], own["set_key"], own["blocks"], sets], names=["group", "set_key", "blocks", "shingles"]
            )


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_place"),
        F.xxhash64("text").alias("_text_hash"),
        "text",
    )


def near_copies(
    docs: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, block_sets: int = BLOCK_SETS
) -> DataFrame:
    """(_place, _text_hash, class_place, class_text_hash, n_links, n_copies) for every document.

    The class is named by its first document, by doc_id (a null id comes first) and
    then a hash of the text. n_links counts the other shingle sets linked to that of
    the document, n_copies the other documents with the same set. Null and empty
    texts have no shingles, no links and a class of their own. Wholly repeated rows
    count as one document. Other columns are not read.
    """
    bands, rows = bands_for(threshold)
    texts = _placed(docs)
    signed = checkpoint(
        texts.mapInArrow(
            tidied(_signed(bands, rows)), "_place long, _text_hash long, set_key binary, size int, bands array<bigint>"
        )
    )
    place = F.struct(*KEY)
    members = signed.select(*KEY, "set_key").distinct()
    counted = members.groupBy("set_key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = signed.select(*KEY, "set_key", "size", "bands").dropDuplicates(KEY)
    classes = checkpoint(counted.select("set_key", "n", "first.*").join(first.drop("set_key"), KEY))

    node = F.xxhash64("set_key")
    banded = classes.select(node.alias("a"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    met = join_few(banded, checkpoint(buckets.select("band", "b")), ["band"], "inner").filter("a <> b")
    # a class and the least members of its buckets, at most one for each band, all hang on the least of these:
    # as connected as before, with about one edge for each class instead of one for each band
    stars = met.groupBy("a").agg(F.collect_set("b").alias("least")).withColumn("b", F.array_min("least"))
    edges = stars.select(F.explode(F.array_append("least", F.col("a"))).alias("a"), "b").filter("a <> b").distinct()
    groups = components(edges).toDF("node", "group")
    grouped = classes.select(*KEY, "set_key", "size", node.alias("node")).join(groups, "node")
    blocks = F.greatest(F.ceil(F.sum("size") * 8 / block_bytes), F.ceil(F.count("*") / block_sets)).cast("int")
    sizes = grouped.groupBy("group").agg(blocks.alias("blocks"))
    suspects = checkpoint(grouped.join(sizes, "group").select(*KEY, "set_key", "group", "blocks"))

    sets = join_few(texts, suspects, KEY, "inner").dropDuplicates(["set_key"]).select("group", "set_key", "blocks", "text")
    sets = sets.mapInArrow(tidied(_sets_of), "group long, set_key binary, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("set_key", F.lit(SEED)), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "group",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "set_key",
        "shingles",
    )
    tasks = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    verified = checkpoint(tasks.mapInArrow(tidied(_verified(threshold)), "a binary, b binary, links long"))
    links = verified.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("n_links"))
    found = components(verified.filter(F.col("b").isNotNull())).toDF("a", "component")
    linked = checkpoint(links.join(found, "a").select(F.col("a").alias("set_key"), "n_links", "component"))

    named = linked.join(classes.select("set_key", place.alias("first")), "set_key")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    linked_classes = checkpoint(named.join(heads, "component").select("set_key", "n_links", "head"))
    told = classes.select("set_key", "n", place.alias("first")).join(linked_classes, "set_key", "left")
    told = told.select(
        "set_key",
        F.coalesce("head", "first").alias("head"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("n") - 1).alias("n_copies"),
    )
    return members.join(told, "set_key").select(
        *KEY,
        F.col("head._place").alias("class_place"),
        F.col("head._text_hash").alias("class_text_hash"),
        "n_links",
        "n_copies",
    )


def id_of(place: str) -> Column:
    """The doc_id of a place; null where it was null."""
    return F.when(F.col(place) != NO_ID, F.col(place))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, less all but the first document of each class.

    Of wholly repeated rows (doc_id and text) one stays.
    """
    place, key = (free_name(n, docs.columns) for n in KEY)
    marked = docs.withColumn(place, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        key, F.xxhash64("text")
    )
    classes = near_copies(docs, threshold)
    later = F.struct(*KEY) != F.struct(F.col("class_place").alias("_place"), F.col("class_text_hash").alias("_text_hash"))
    gone = checkpoint(classes.filter(later).select(F.col("_place").alias(place), F.col("_text_hash").alias(key)))
    kept = join_few(marked, gone, [place, key], "left_anti")
    again = checkpoint(marked.groupBy(place, key).count().filter("count > 1").select(place, key))
    if not again.isEmpty():
        once = join_few(kept, again, [place, key], "left_semi").dropDuplicates([place, key])
        kept = join_few(kept, again, [place, key], "left_anti").unionByName(once)
    return kept.drop(place, key)
