"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts, and corpus-wide counts of aligned pairs.

Two token sequences of the same bytes are cut where a token of each ends. The
intervals are worked through level by level, all of a block at once: in each, a common
end near the middle is looked for, by bisecting the other side's ends for the middle
end, then for ends around it in windows that double; it parts the interval, and both
halves are taken up again. Intervals without a common end are the leaf groups. Every
end is bisected once.

Neither tokenizer has a token that crosses from something other than white space to a
space, so texts are first cut there (blocks.chunked), and each distinct piece of a
block is encoded and aligned once. The tokens of a group are linked each with each; a
block gives out its distinct linked pairs with the number of its documents that hold
them, these are added up by pair, and the totals go back to the blocks (see
blocks.py). The highest total of each id is one number for each entry of the
vocabulary, which bounds what is broadcast.

Vocabulary files are parameters and only the driver reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from areal.llm import blocks
from areal.llm.common import free_name
from areal.plans.sizing import checkpoint

#: Result columns; other columns of the same names win and these get underscores behind.
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
#: Bytes of text of a block.
BLOCK_BYTES = 6 << 20
PAIR_MIX = np.uint64(0x9E3779B97F4A7C15)


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side end where one of the other side ends.

    ends are ascending byte offsets. Interval i holds the tokens begin[i] to
    stop[i] - 1 of a and the tokens of b with the same bytes; its own end is known to
    be common.
    """
    cut_a, cut_b = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    cut_a[stop[stop > begin] - 1] = True
    cut_b[np.searchsorted(ends_b, ends_a[cut_a])] = True
    lo, hi = begin, stop - 1
    lo, hi = lo[lo < hi], hi[lo < hi]
    left = right = (lo + hi) // 2  # ends left to right - 1 of an interval are known not to be common
    while len(lo):
        step = np.maximum(1, right - left)
        wider_left, wider_right = np.maximum(lo, left - step), np.minimum(hi, right + step)
        starts, sizes = np.concatenate([wider_left, right]), np.concatenate([left - wider_left, wider_right - right])
        tried = np.repeat(starts - blocks.begins(sizes), sizes) + np.arange(int(sizes.sum()))
        owner = np.repeat(np.tile(np.arange(len(lo)), 2), sizes)
        place = np.searchsorted(ends_b, ends_a[tried])
        common = ends_b[place] == ends_a[tried]
        cut_a[tried[common]] = cut_b[place[common]] = True
        parted = np.zeros(len(lo), dtype=bool)
        parted[owner[common]] = True
        going = ~parted & ((wider_left > lo) | (wider_right < hi))
        lo, hi, left, right = (
            np.concatenate([lo[parted], wider_right[parted], lo[going]]),
            np.concatenate([wider_left[parted], hi[parted], hi[going]]),
            np.concatenate([np.full(2 * int(parted.sum()), -1), wider_left[going]]),
            np.concatenate([np.full(2 * int(parted.sum()), -1), wider_right[going]]),
        )
        fresh = left < 0
        left, right = np.where(fresh, (lo + hi) // 2, left), np.where(fresh, (lo + hi) // 2, right)
        some = lo < hi
        lo, hi, left, right = lo[some], hi[some], left[some], right[some]
    return cut_a, cut_b


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, json_a: str, model_b: bytes, pattern: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        signs = byte_signs()
        self.a = Tokenizer.from_str(json_a).model
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.find = regex.compile(pattern).findall
        self.sign = {byte: sign for sign, byte in signs.items()}
        vocabulary = Tokenizer.from_str(json_a).get_vocab(with_added_tokens=False)
        self.size_a, self.size_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(signs[s] for s in token) if all(s in signs for s in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.size_b)]
        self.space = self.b.piece_to_id("▁")
        # as text: an id, and whether it is the last of its group; a's ids first
        self.text = [f"{i}{end}" for i in range(self.size_a) for end in ",|"]
        self.text += [f"{i}{end}" for i in range(self.size_b) for end in ",;"]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        known: dict[str, list[int]] = {}
        out = []
        for chunk in chunks:
            ids: list[int] = []
            for word in self.find(chunk):
                if (own := known.get(word)) is None:
                    signs = word.encode().decode("latin-1").translate(self.sign)
                    own = known[word] = [t.id for t in self.a.tokenize(signs)]
                ids += own
            out.append(ids)
        return out

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """chunks begin with a space, which the tokenizer puts before any text itself."""
        found = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else [self.space] for c, ids in zip(chunks, found, strict=True)]


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and its byte."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum())), sizes


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


class Aligned:
    """Distinct chunks of a block: their numbers of tokens and groups, groups as text, and linked pairs."""

    def __init__(self, pair: Pair, chunks: list[str]) -> None:
        lists_a, lists_b = pair.encode_a(chunks), pair.encode_b(chunks)
        self.exact = np.ones(len(chunks), dtype=bool)
        for i, (chunk, a, b) in enumerate(zip(chunks, lists_a, lists_b, strict=True)):
            data = chunk.encode()
            if b"".join([pair.bytes_a[t] for t in a]) != data or b"".join([pair.bytes_b[t] for t in b]) != data:
                self.exact[i], lists_a[i], lists_b[i] = False, [], []
        (a, self.n_a), (b, self.n_b) = _flat(lists_a), _flat(lists_b)
        ends_a = np.cumsum(np.array([len(t) for t in pair.bytes_a], dtype=np.int64)[a])
        ends_b = np.cumsum(np.array([len(t) for t in pair.bytes_b], dtype=np.int64)[b])
        stop = np.cumsum(self.n_a)
        cut_a, cut_b = common_cuts(ends_a, ends_b, stop - self.n_a, stop)
        self.n_groups = _sums(cut_a, self.n_a)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        count = int(cut_a.sum())
        of_a, of_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        merged = np.empty(len(a) + len(b), dtype=np.int64)
        merged[np.arange(len(a)) + blocks.begins(of_b)[group_a]] = 2 * a + cut_a
        merged[np.arange(len(b)) + np.cumsum(of_a)[group_b]] = 2 * (pair.size_a + b) + cut_b
        joined = "".join(map(pair.text.__getitem__, merged.tolist()))
        lengths = np.array([len(t) for t in pair.text], dtype=np.int64)[merged]
        cuts = np.concatenate([[0], np.cumsum(_sums(lengths, self.n_a + self.n_b))]).tolist()
        self.text = [joined[x:y] for x, y in zip(cuts, cuts[1:])]
        self._link(pair, a, b, of_a, of_b)

    def _link(self, pair: Pair, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> None:
        """keys: distinct linked pairs; pairs, times: those of each chunk, one chunk behind the other."""
        links = of_a * of_b
        self.n_links = _sums(links, self.n_groups)
        chunk_of = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        first_a, first_b = blocks.begins(of_a), blocks.begins(of_b)
        width = pair.size_a * pair.size_b
        found, times = [], []
        for part in blocks.strips(links):
            own = links[part]
            place = np.arange(int(own.sum())) - np.repeat(blocks.begins(own), own)
            wide = np.repeat(of_b[part], own)
            key = a[np.repeat(first_a[part], own) + place // wide] * pair.size_b + b[np.repeat(first_b[part], own) + place % wide]
            key, n = np.unique(np.repeat(chunk_of[part], own) * width + key, return_counts=True)
            found.append(key)
            times.append(n)
        found = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        times = np.concatenate(times) if times else found
        self.n_pairs = np.bincount(found // width, minlength=len(self.n_groups))
        self.keys, self.pairs = np.unique(found % width, return_inverse=True)
        self.times = times


def _described(shared, buckets: int, names: dict[str, str], digest: bool):  # noqa: ANN001, ANN202
    tokenizers: list[Pair] = []

    def describe(others: pa.RecordBatch, texts: list[str | None]) -> tuple[bytes, dict[int, bytes]]:
        if not tokenizers:
            tokenizers.append(Pair(*shared.value))
        pair = tokenizers[0]
        chunks, codes, counts = blocks.chunked(texts, prefixed=True)
        known = Aligned(pair, chunks)
        inexact = _sums(~known.exact[codes], counts) > 0
        codes, counts = codes[~np.repeat(inexact, counts)], np.where(inexact, 0, counts)
        columns = {n: _sums(getattr(known, n)[codes], counts) for n in ("n_a", "n_b", "n_groups", "n_links")}
        groups, ends = [], np.cumsum(counts).tolist()
        get, flat = known.text.__getitem__, codes.tolist()
        for end, count in zip(ends, counts.tolist(), strict=True):
            text = "".join(map(get, flat[end - count : end]))[:-1]
            groups.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
        n_docs = np.zeros(len(known.keys), dtype=np.int64)
        per_text, numbers, times = [], [], []
        first, starts = blocks.begins(counts), blocks.begins(known.n_pairs)
        for part in blocks.strips(columns["n_links"]):
            own = codes[first[part.start] : first[part.stop - 1] + counts[part.stop - 1]]
            sizes = known.n_pairs[own]
            of_text = np.repeat(np.repeat(np.arange(part.stop - part.start), counts[part]), sizes)
            linked = blocks.unfold(known.pairs, starts[own], sizes)
            weight = blocks.unfold(known.times, starts[own], sizes)
            marked, where = np.unique(of_text * len(known.keys) + linked, return_inverse=True)
            numbers.append(marked % len(known.keys) if len(marked) else marked)
            times.append(np.bincount(where, weights=weight, minlength=len(marked)).astype(np.int64))
            of = marked // len(known.keys) if len(marked) else marked
            per_text.append(np.bincount(of, minlength=part.stop - part.start))
            n_docs += np.bincount(numbers[-1], minlength=len(known.keys))
        none = np.zeros(0, dtype=np.int64)
        per_text, numbers, times = (np.concatenate([none, *x]) for x in (per_text, numbers, times))
        used = n_docs > 0
        keys, n_docs, numbers = known.keys[used], n_docs[used], (np.cumsum(used) - 1)[numbers]
        dealt = (((keys.astype(np.uint64) * PAIR_MIX) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(dealt, kind="stable")
        entries, cuts = {}, np.searchsorted(dealt[order], np.arange(buckets + 1))
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[bucket] : cuts[bucket + 1]]
            entries[bucket] = blocks.pack(
                blocks.to_planes(keys[own] // pair.size_b), blocks.to_planes(keys[own] % pair.size_b), blocks.to_planes(n_docs[own])
            )
        for name, values in [*columns.items(), ("groups", groups)]:
            others = others.append_column(names[name], pa.array(values))
        return blocks.pack(blocks.to_ipc(others), *map(blocks.to_planes, (per_text, numbers, times, dealt))), entries

    return describe


def _add_up(payloads: list[bytes]) -> Iterator[bytes]:
    """(a, documents of the whole corpus) of the pairs of each block."""
    rows = [[blocks.from_planes(x) for x in blocks.unpack(p)] for p in payloads]
    a, b, n_docs = (np.concatenate(x) for x in zip(*rows, strict=True))
    keys, where = np.unique(a << 32 | b, return_inverse=True)
    totals = np.bincount(where, weights=n_docs, minlength=len(keys)).astype(np.int64)[where]
    at = 0
    for own, *_ in rows:
        yield blocks.pack(blocks.to_planes(own), blocks.to_planes(totals[at : at + len(own)]))
        at += len(own)


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for payload in batch["payload"]:
            a, totals = map(blocks.from_planes, blocks.unpack(payload.as_py()))
            if (size := int(a.max(initial=-1)) + 1) > len(most):
                most = np.concatenate([most, np.zeros(size - len(most), dtype=np.int64)])
            np.maximum.at(most, a, totals)
    ids = np.flatnonzero(most)
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(most[ids], pa.int64())], names=["a", "most"])


def _composed(shared, n_best: str, count_sum: str):  # noqa: ANN001, ANN202
    def compose(block: list[bytes], found: list[list[bytes]]) -> pa.Table:
        rows, (per_text, numbers, times, dealt) = blocks.from_ipc(block[0]), map(blocks.from_planes, block[1:])
        none, order = np.zeros(0, dtype=np.int64), np.argsort(dealt, kind="stable")
        a, total = np.empty(len(dealt), dtype=np.int64), np.empty(len(dealt), dtype=np.int64)
        a[order] = np.concatenate([none, *[blocks.from_planes(x) for x, _ in found]])
        total[order] = np.concatenate([none, *[blocks.from_planes(x) for _, x in found]])
        best = total == shared.value[a]
        rows = rows.append_column(n_best, pa.array(_sums(times * best[numbers], per_text), pa.int64()))
        return rows.append_column(count_sum, pa.array(_sums(times * total[numbers], per_text), pa.int64()))

    return compose


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with the columns of COLUMNS in place of its text.

    path_a is a byte-level BPE of the tokenizers library whose pretokens pattern cuts,
    path_b a sentencepiece model that keeps white space, puts a space before a text
    and has no piece with a space behind another character (checked). a sees the text
    with a space before it. groups lists the groups of ids, `a1,a2|b1;a3|b2,b3`, or
    their SHA-256 in hexadecimal if digest is set. A pair's total is the number of
    documents that hold it linked; n_best counts the links whose total is the highest
    of their a id, ties included, and count_sum adds up the totals of all links.

    Texts that are null, empty, or not given back byte by byte by both tokenizers have
    zeros and an empty text. Rows stay apart and count as documents, also where they
    repeat; other columns are kept as they are, and where one is called like a new
    column, the new one gets underscores behind. An empty table gives no rows.
    """
    import sentencepiece

    with open(path_a, encoding="utf-8") as file_a, open(path_b, "rb") as file_b:
        vocabularies = (file_a.read(), file_b.read(), pattern)
    pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabularies[1])
    if any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.get_piece_size())):
        raise ValueError("a piece has a space behind another character")
    context = docs.sparkSession.sparkContext
    taken, names = [c for c in docs.columns if c != text], {}
    for name in COLUMNS:
        names[name] = free_name(name, [*taken, *names.values()])
    kinds = {n: StringType() if n == "groups" else LongType() for n in COLUMNS}
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = StructType([*fields, *[StructField(names[n], kinds[n]) for n in COLUMNS]])
    # read by two jobs: written once instead of aligned again
    described = _described(context.broadcast(vocabularies), blocks.buckets_for(docs), names, digest)
    made = checkpoint(blocks.make(docs, text, described, BLOCK_BYTES))
    totals = checkpoint(blocks.settle(made.filter("place < 0"), _add_up))
    # at most one row for each id of the vocabulary
    highest = totals.select("payload").mapInArrow(_highest, "a long, most long").groupBy("a").agg(F.max("most").alias("most"))
    rows = highest.collect()
    most = np.zeros(max([r["a"] for r in rows], default=-1) + 1, dtype=np.int64)
    for row in rows:
        most[row["a"]] = row["most"]
    return blocks.finish(made.filter("place >= 0"), totals, _composed(context.broadcast(most), names["n_best"], names["count_sum"]), schema)
