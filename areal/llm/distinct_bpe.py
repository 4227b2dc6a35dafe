"""Byte-level BPE by a global shuffle of distinct words, and decoding by a join with the token-byte table.

Texts are cut into pretokens by the pattern of the vocabulary. A pretoken is encoded
by itself, so each distinct one needs to be encoded once for the whole corpus: each
block of documents gives out its distinct pretokens with their positions, they are
shuffled by their bytes, encoded once, and their ids go back to the blocks and into
the positions (see blocks.py). Merging takes the adjacent pair whose joined bytes have
the lowest rank, leftmost first, until no pair has one; words of any length take
n log n steps.

The rank file is a parameter and only the driver reads it.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from areal.llm import blocks
from areal.llm.common import free_name

#: Bytes of a word from which pairs are kept in a heap.
LONG_WORD = 100
#: Tokens decoded at a time.
DECODED = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token's bytes; a rank is the token's id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def merge_by_rank(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of the tokens of a word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if not word:
        return []
    borders = _merged_short(word, ranks) if len(word) < LONG_WORD else _merged_long(word, ranks)
    return [ranks[word[a:b]] for a, b in zip(borders, borders[1:])]


def _merged_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Borders of the tokens: the lowest pair is looked for anew after each merge."""
    rank, none = ranks.get, 1 << 62
    borders = list(range(len(word) + 1))
    pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        del borders[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank(word[borders[i] : borders[i + 2]], none)
        if i:
            pairs[i - 1] = rank(word[borders[i - 1] : borders[i + 1]], none)
    return borders


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs and linked tokens."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    now: list[int | None] = [None] * (n + 1)  # rank of the pair of the token that begins here and the next one
    heap = []

    def look(i: int) -> None:
        j = after[i]
        now[i] = ranks.get(word[i : after[j]]) if j < n else None
        if now[i] is not None:
            heapq.heappush(heap, (now[i], i))

    for i in range(n):
        look(i)
    while heap:
        low, i = heapq.heappop(heap)
        if now[i] != low:
            continue
        j = after[i]
        now[j] = None
        after[i] = after[j]
        before[after[j]] = i
        look(i)
        if i:
            look(before[i])
    borders, at = [], 0
    while at < n:
        borders.append(at)
        at = after[at]
    return [*borders, n]


def _described(pattern: str, buckets: int):  # noqa: ANN202
    find = regex.compile(pattern).findall

    def describe(others: pa.RecordBatch, texts: list[str | None]) -> tuple[bytes, dict[int, bytes]]:
        chunks, codes, counts = blocks.chunked(texts, prefixed=False)
        numbers, flat, sizes = blocks.Numbers(), [], []
        for chunk in chunks:
            found = find(chunk)
            sizes.append(len(found))
            flat.extend(map(numbers.__getitem__, found))
        flat, sizes = np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64)
        starts, ends = blocks.begins(sizes), np.concatenate([[0], np.cumsum(sizes[codes])])
        positions = blocks.unfold(flat, starts[codes], sizes[codes])
        words = [w.encode() for w in numbers]
        dealt = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int64)
        order = np.argsort(dealt, kind="stable")
        entries, cuts = {}, np.searchsorted(dealt[order], np.arange(buckets + 1))
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            own = [words[i] for i in order[cuts[bucket] : cuts[bucket + 1]].tolist()]
            entries[bucket] = blocks.pack(blocks.to_planes(np.array([len(w) for w in own])), b"".join(own))
        last = np.cumsum(counts)
        per_text = ends[last] - ends[last - counts]
        payload = blocks.pack(
            blocks.to_ipc(others), blocks.to_planes(per_text), blocks.to_planes(positions), blocks.to_planes(dealt)
        )
        return payload, entries

    return describe


def _solved(shared):  # noqa: ANN001, ANN202  a broadcast of ranks
    def solve(payloads: list[bytes]) -> Iterator[bytes]:
        ranks, known, flat, sizes = shared.value, {}, [], []
        held = []
        for payload in payloads:
            lengths, joined = blocks.unpack(payload)
            own, at = [], 0
            for length in blocks.from_planes(lengths).tolist():
                word = joined[at : at + length]
                at += length
                if (number := known.get(word)) is None:
                    number = known[word] = len(known)
                    ids = merge_by_rank(word, ranks)
                    flat.extend(ids)
                    sizes.append(len(ids))
                own.append(number)
            held.append(np.array(own, dtype=np.int64))
        flat, sizes = np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64)
        starts = blocks.begins(sizes)
        for own in held:
            ids = blocks.unfold(flat, starts[own], sizes[own])
            yield blocks.pack(blocks.to_planes(sizes[own]), blocks.to_planes(ids))

    return solve


Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def token_table(ranks: dict[bytes, int]) -> Table:
    """The token-byte table: bytes of all tokens, where each one's begin, and how many they are."""
    tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 2)  # the last one stands for all unknown ids
    for token, rank in ranks.items():
        tokens[rank] = token
    sizes = np.array(list(map(len, tokens)), dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), blocks.begins(sizes), sizes


def decode(packed: bytes, table: Table) -> bytes:
    """Bytes of ids given as little-endian unsigned 32-bit numbers: ids meet the table by their number; one without a
    token gives nothing."""
    joined, starts, sizes = table
    numbers, out = np.frombuffer(packed, dtype="<u4"), []
    for at in range(0, len(numbers), DECODED):
        own = np.minimum(numbers[at : at + DECODED].astype(np.int64), len(sizes) - 1)
        out.append(blocks.unfold(joined, starts[own], sizes[own]).tobytes())
    return b"".join(out)


def _composed(names: list[str], shared):  # noqa: ANN001, ANN202  a broadcast of a token table
    def compose(block: list[bytes], found: list[list[bytes]]) -> pa.Table:
        others, (per_text, positions, dealt) = blocks.from_ipc(block[0]), map(blocks.from_planes, block[1:])
        none = np.zeros(0, dtype=np.int64)
        by_bucket = np.concatenate([none, *[blocks.from_planes(sizes) for sizes, _ in found]])
        known = np.concatenate([none, *[blocks.from_planes(ids) for _, ids in found]])
        order = np.argsort(dealt, kind="stable")
        starts, sizes = np.empty_like(by_bucket), np.empty_like(by_bucket)
        starts[order], sizes[order] = blocks.begins(by_bucket), by_bucket
        ends, out = np.cumsum(per_text), []
        for part in blocks.strips(per_text):
            first = int(ends[part.start] - per_text[part.start])
            own = positions[first : int(ends[part.stop - 1])]
            packed = blocks.unfold(known, starts[own], sizes[own]).astype("<u4").tobytes()
            cuts = 4 * np.concatenate([[0], np.cumsum(sizes[own])])[np.concatenate([[0], ends[part] - first])]
            out += [packed[a:b] for a, b in zip(cuts.tolist(), cuts.tolist()[1:])]
        made = [others.append_column(names[0], pa.array(out, pa.binary()))]
        for name in names[1:]:
            made.append(made[-1].append_column(name, pa.array([decode(ids, shared.value) for ids in out], pa.binary())))
        return made[-1]

    return compose


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with a column ids in place of its text: ids as little-endian unsigned 32-bit numbers.

    path is a file of ranks, pattern the one that cuts pretokens. decoded adds a column
    decoded: the ids' bytes again, in the same pass. A null or empty text has no ids.
    Rows stay apart, also where they repeat; other columns are kept as they are, and
    where one is called like a new column, the new one gets underscores behind. An empty
    table gives no rows.
    """
    context, ranks = docs.sparkSession.sparkContext, read_ranks(path)
    fields = [f for f in docs.schema.fields if f.name != text]
    names: list[str] = []
    for name in ["ids", "decoded"][: 1 + decoded]:
        names.append(free_name(name, [*[f.name for f in fields], *names]))
    schema = StructType([*fields, *[StructField(name, BinaryType()) for name in names]])
    made = blocks.make(docs, text, _described(pattern, blocks.buckets_for(docs)))
    values = blocks.settle(made, _solved(context.broadcast(ranks)))
    return blocks.finish(made, values, _composed(names, context.broadcast(token_table(ranks))), schema)


def decode_of(coded: DataFrame, path: str, ids: str = "ids") -> Column:
    """Binary column of the bytes of a column made by encode.

    The token-byte table has as many rows as the vocabulary and goes to every worker.
    Null counts as no ids.
    """
    shared = coded.sparkSession.sparkContext.broadcast(token_table(read_ranks(path)))

    @F.pandas_udf("binary")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ids: decode(ids, shared.value))

    return rows(F.coalesce(F.col(f"`{ids}`"), F.lit(b"")))
