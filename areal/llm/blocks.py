"""Blocks of documents, the distinct entries of each block, and what is known of entries brought back to the blocks.

Tokens of a large corpus repeat, so the work on them is done for distinct ones. A
block is a run of whole rows of a task, of about BLOCK_BYTES of text. For each block
a task writes one row with the documents as numbers of entries, and the distinct
entries of the block dealt by their hash into buckets, a row for each bucket. A
bucket gets its entries from all blocks (an entry once from each block, so frequent
ones weigh no more than others), settles each distinct one, and sends the values
back to the blocks, where documents are put together by position. Nothing is
gathered by key: a bucket is a share of the hash space, and there are as many as
spark.sql.shuffle.partitions asks for, times PER_PARTITION.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text of a block, or one longer text; bounds the memory of a task.
BLOCK_BYTES = 4 << 20
#: Buckets for each shuffle partition.
PER_PARTITION = 4
#: Entries of flat arrays that are unfolded at a time.
STRIP = 1 << 20
#: place: number of the block, or -1 - bucket for entries.
MADE = pa.schema([("place", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
VALUES = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary())])


class Numbers(dict):
    """Numbers from 0 in order of first appearance."""

    def __missing__(self, key):  # noqa: ANN001, ANN204
        number = self[key] = len(self)
        return number


def pack(*parts: bytes) -> bytes:
    """Byte strings as one, compressed."""
    data = struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)
    return struct.pack("<Q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def unpack(payload: bytes) -> list[bytes]:
    data = pa.decompress(payload[8:], struct.unpack_from("<Q", payload)[0], codec="zstd", asbytes=True)
    (count,) = struct.unpack_from("<I", data)
    sizes, at, out = struct.unpack_from(f"<{count}Q", data, 4), 4 + 8 * count, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def to_planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as planes of equal bytes, which compress well; as many planes as the largest one needs."""
    numbers = np.asarray(numbers, dtype="<u8")
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = np.empty((width, len(numbers)), dtype=np.uint8)
    for i in range(width):
        planes[i] = (numbers >> np.uint64(8 * i)).astype(np.uint8)
    return bytes([width]) + planes.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros(planes.shape[1], dtype=np.int64)
    for i in range(width):
        out |= planes[i].astype(np.int64) << (8 * i)
    return out


def begins(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive stretches begins."""
    return np.cumsum(sizes) - sizes


def unfold(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at starts, one behind the other."""
    total = int(sizes.sum())
    return values[np.repeat(starts - begins(sizes), sizes) + np.arange(total)]


def strips(weights: np.ndarray, most: int = STRIP) -> Iterator[slice]:
    """Slices of consecutive items of about so much weight in all, or of one heavier item."""
    if len(weights):
        cuts = np.flatnonzero(np.diff(np.cumsum(weights) // most)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(weights)], strict=True):
            yield slice(start, stop)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def chunked(texts: list[str | None], prefixed: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cut texts before each space that follows something other than white space.

    No token of a tokenizer that takes a space only at its beginning crosses such a
    cut. Returns the distinct chunks, the chunk numbers of all texts and their count
    for each text. prefixed: each text that is not empty has a space put before it.
    Null counts as empty; an empty text has no chunks.
    """
    number, bare, rows, firsts = Numbers(), Numbers(), [], []
    for text in texts:
        pieces = text.split(" ") if text else []
        rows.append(np.array(list(map(number.__getitem__, pieces)), dtype=np.int64))
    closed = np.array([p != "" and not p[-1].isspace() for p in number], dtype=bool)
    names = list(number)
    for i, row in enumerate(rows):
        if not len(row):
            firsts.append(0)
            continue
        if not closed[row[:-1]].all():  # pieces that end in white space go with what follows
            joined, part = [], []
            for j, code in enumerate(row.tolist()):
                part.append(names[code])
                if closed[code] or j == len(row) - 1:
                    joined.append(" ".join(part))
                    part = []
            if not prefixed:
                firsts.append(bare[joined[0]])
            rows[i] = np.array([number[p] for p in joined], dtype=np.int64)
        elif not prefixed:
            firsts.append(bare[names[row[0]]])
    counts = np.array([len(row) for row in rows], dtype=np.int64)
    codes = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    if not prefixed and len(codes):
        full = counts > 0
        codes[begins(counts)[full]] = len(number) + np.array(firsts, dtype=np.int64)[full]
    chunks = [" " + p for p in number] + list(bare)
    used = np.zeros(len(chunks), dtype=bool)
    used[codes] = True
    renumbered = np.cumsum(used) - 1
    return [c for c, u in zip(chunks, used.tolist(), strict=True) if u], renumbered[codes], counts


def buckets_for(docs: DataFrame) -> int:
    return PER_PARTITION * max(4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def make(
    docs: DataFrame,
    text: str,
    describe: Callable[[pa.RecordBatch, list], tuple[bytes, dict[int, bytes]]],
    size: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of MADE. describe gets the rows of a block without their text, and the texts; it gives the block's payload
    and a payload of entries for each bucket. size: bytes of text of a block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, filled = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal made, held, filled
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            texts = whole[text].to_pylist()
            number, made, held, filled = task << 32 | made, made + 1, [], 0
            payload, entries = describe(whole.drop_columns([text]), texts)
            places = [number, *[-1 - bucket for bucket in entries]]
            return pa.record_batch([places, [number] * len(places), [payload, *entries.values()]], schema=MADE)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            for i, length in enumerate(lengths.tolist()):
                filled += length + 1
                if filled >= size:
                    held.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    yield block()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield block()

    return docs.mapInArrow(rows, "place long, block long, payload binary")


def settle(made: DataFrame, solve: Callable[[list[bytes]], Iterator[bytes]]) -> DataFrame:
    """Rows of VALUES. solve gets the payloads of a bucket, one for each block that has entries in it, and gives as many back.

    Blocks themselves pass by unread: like this, settle and finish read one and the same
    exchange of made, which is computed once.
    """

    def bucket(table: pa.Table) -> pa.Table:
        place = table["place"][0].as_py()
        if place >= 0:
            return VALUES.empty_table()
        found = list(solve(table["payload"].to_pylist()))
        return pa.table([table["block"], [-1 - place] * len(found), found], schema=VALUES)

    return made.groupBy("place").applyInArrow(bucket, "block long, bucket long, payload binary")


def finish(
    made: DataFrame, values: DataFrame, compose: Callable[[list[bytes], list[list[bytes]]], pa.Table], schema: StructType
) -> DataFrame:
    """The rows that compose makes of a block's payload and the payloads of its buckets in ascending order."""
    empty = to_arrow_schema(schema).empty_table()

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left["place"][0].as_py() < 0:
            return empty
        found = sorted(zip(right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True))
        return compose(unpack(left["payload"][0].as_py()), [unpack(p) for _, p in found])

    return made.groupBy("place").cogroup(values.groupBy("block")).applyInArrow(block, schema)
