"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding reads a pretoken's bytes once, from left to right; an automaton over the
vocabulary tells at each byte which tokens end there. For each prefix the transducer
keeps the last token of that prefix's encoding: the token that ends there and is
compatible with the last token of what precedes it (two tokens are compatible if
the merge list encodes their joined bytes as just these two; a sequence is the
merge list's encoding exactly if all its neighbours are compatible). A token is
stable once the encodings of all prefixes that can still be extended share it.
The merge list bounds how far that lies back (sufficient_lookahead), so the
transducer emits stable tokens and forgets them, in constant memory and in time
linear in the bytes, however long a pretoken is.

Decoding is a state machine that takes the bytes of a token at a time and gives
out characters as soon as they are complete.

The vocabulary file is that of the tokenizers library (byte-level BPE without
normalizer); its path is a parameter and only the driver reads it.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import json
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.llm.common import give_back, portions

#: Pretokens of byte-level BPE (fixed by the vocabulary files).
SPACE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Bounds on memory: pieces, pretokens and pairs remembered by a worker, some 50 MB each; characters of a piece or
#: pretoken worth remembering.
KNOWN_PIECES, KNOWN_PRETOKENS, KNOWN_PAIRS, KNOWN_CHARS = 120_000, 300_000, 400_000, 48
#: Characters, pretokens or tokens taken at a time.
BLOCK = 50_000


def _byte_signs() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of each token, merges (left, right) in order of rank, and added tokens by their text."""

    tokens: dict[int, bytes]
    merges: tuple[tuple[int, int], ...]
    added: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, signs = said["model"], _byte_signs()
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        tokens = {i: bytes(signs[s] for s in token) for token, i in ids.items()}
        added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        tokens = {i: b for i, b in tokens.items() if i not in added.values()}
        tokens |= {i: text.encode() for text, i in added.items()}
        return Vocabulary(tokens, tuple((ids[a], ids[b]) for a, b in pairs), added)


def sufficient_lookahead(tokens: dict[int, bytes], merged: Iterable[tuple[int, int, int]]) -> int:
    """Bytes behind a token after which no further byte can change it.

    merged gives (left, right, result) by rank. Bytes to the right undo a merge
    only by taking a tail of its right part into a merge of lower rank, which bytes
    further right may undo in turn, and so on. Ranks fall along such a chain; the
    longest one, in bytes, is the bound.
    """
    right_part: dict[int, int] = {}
    reach: dict[int, int] = {}
    most = 0
    for left, right, result in merged:
        length, tail = len(tokens[right]), right
        longest = reach.get(tail, 0)
        while tail in right_part:
            tail = right_part[tail]
            longest = max(longest, reach.get(tail, 0))
        reach[left] = max(reach.get(left, 0), length + longest)
        most = max(most, length + longest)
        right_part.setdefault(result, right)
    return most


class Recent(dict):
    """A memory of bounded size: the older half goes when the younger one is full."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most // 2, {}

    def keep(self, key, value):  # noqa: ANN001, ANN201
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def again(self, key):  # noqa: ANN001, ANN201
        """The value of a key that is only in the older half, kept once more; None if it is not there."""
        value = self.older.get(key)
        return value if value is None else self.keep(key, value)


class Automaton:
    """Which tokens end at a byte: one step for each byte, along failure links where no longer token goes on.

    A state is the longest beginning of a token that the bytes so far end in. children
    are keyed by state and byte, ends has the tokens that end in a state, longest first.
    """

    def __init__(self, ids: dict[bytes, int]) -> None:
        self.children: dict[int, int] = {}
        own: list[int] = [-1]
        level = [(0, sorted(ids))]
        self.fail: list[int] = [0]
        self.ends: list[tuple[int, ...]] = [()]
        depth = 0
        while level:  # states level by level, so links lead to states that are there
            deeper = []
            for state, tokens in level:
                for byte, group in itertools.groupby(tokens, lambda token, at=depth: token[at]):
                    found, child = list(group), len(own)
                    link = self.step(self.fail[state], byte) if state else 0
                    self.children[state << 8 | byte] = child
                    whole = ids[found[0]] if len(found[0]) == depth + 1 else -1
                    own.append(whole)
                    self.fail.append(link)
                    self.ends.append((whole, *self.ends[link]) if whole >= 0 else self.ends[link])
                    if rest := found[whole >= 0 :]:
                        deeper.append((child, rest))
            level, depth = deeper, depth + 1

    def step(self, state: int, byte: int) -> int:
        while (child := self.children.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return child


class Transducer:
    """Encoder of bytes by a merge list."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens = vocabulary.tokens
        ordinary = {i: b for i, b in vocabulary.tokens.items() if i not in vocabulary.added.values()}
        self.ids = {b: i for i, b in ordinary.items()}
        self.longest = max(map(len, ordinary.values()))
        self.size = [len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(vocabulary.merges):
            self.rank.setdefault((left, right), (rank, self.ids[ordinary[left] + ordinary[right]]))
        self.parts: dict[int, tuple[int, int]] = {}
        for pair, (_, result) in self.rank.items():
            self.parts.setdefault(result, pair)
        by_rank = [(left, right, result) for (left, right), (_, result) in self.rank.items()]
        self.lookahead = sufficient_lookahead(ordinary, by_rank)
        # rank of the merge that makes a token; -1 for single bytes
        self.formed = [self.rank[self.parts[i]][0] if i in self.parts else -1 for i in range(len(self.size))]
        self.proper = all(
            self.formed[left] < rank and self.formed[right] < rank for (left, right), (rank, _) in self.rank.items()
        )
        self.alone: dict[int, bool] = {}
        self.fits = Recent(KNOWN_PAIRS)
        self.automaton = Automaton(self.ids)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge list to a short sequence; serves to compare neighbouring tokens."""
        while len(ids) > 1:
            none = (len(self.rank), 0)
            (rank, result), at = min((self.rank.get(pair, none), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == none[0]:
                break
            ids = [*ids[:at], result, *ids[at + 2 :]]
        return ids

    def fit(self, first: int, second: int) -> bool:
        """Whether two tokens can stand side by side; first -1: whether second can begin."""
        if first < 0:
            if (known := self.alone.get(second)) is None:
                data = self.tokens[second]
                known = self.alone[second] = self.merge([self.ids[data[i : i + 1]] for i in range(len(data))]) == [second]
            return self.fits.keep(second, known)
        if (known := self.fits.again((first + 1) << 20 | second)) is not None:
            return known
        if self.proper:
            known = self.fit(-1, second) and not self._crossed(first, second)
        else:
            joined = self.tokens[first] + self.tokens[second]
            known = self.merge([self.ids[joined[i : i + 1]] for i in range(len(joined))]) == [first, second]
        return self.fits.keep((first + 1) << 20 | second, known)

    def _crossed(self, first: int, second: int) -> bool:
        """Whether a merge joins the two before both are complete.

        Goes back in time from the complete tokens: of the two parts at the border, the
        one made later is taken apart, so each pair of parts that stand there together
        is met once. A merge over the border needs both its parts there at its rank. Of
        equal ranks the one further left comes first: the first token's own merge
        precedes one over the border, the second token's own follows it.
        """
        formed, parts, rank = self.formed, self.parts, self.rank
        used_left = used_right = len(rank)
        while True:
            made_left, made_right = formed[first], formed[second]
            found = rank.get((first, second))
            if found is not None and made_left < found[0] < used_left and made_right < found[0] <= used_right:
                return True
            if made_left > made_right:
                used_left, first = made_left, parts[first][1]
            elif made_right >= 0:
                used_right, second = made_right, parts[second][0]
            else:
                return False

    def _read(self, data: bytes, begin: int, stop: int, start: int, state: int, last: list[int]) -> int:
        """Read bytes of a pretoken and append the last token of each prefix to last, which begins at start; the state after them."""
        fits, fit, size = self.fits.get, self.fit, self.size
        step, fail, ends = self.automaton.children.get, self.automaton.fail, self.automaton.ends
        for at in range(begin, stop):
            byte = data[at]
            while (child := step(state << 8 | byte)) is None and state:
                state = fail[state]
            state = child or 0
            beyond = at + 1 - start
            for token in ends[state]:
                before = last[beyond - size[token]]
                known = fits(before + 1 << 20 | token)
                if known or known is None and fit(before, token):
                    last.append(token)
                    break
        return state

    def encode(self, data: bytes) -> Iterator[int]:
        """Tokens of one pretoken, each as soon as it is stable."""
        window, n = 4 * (self.lookahead + self.longest), len(data)
        start, state, last = 0, 0, [-1]  # last[i]: last token of the bytes from start to start + i, or of all before
        for begin in range(0, n, window):
            state = self._read(data, begin, min(n, begin + window), start, state, last)
            if begin + window < n:
                path, shared = self._shared(last)
                yield from path
                start += shared
                last = last[shared:]
        yield from self._path(last, len(last) - 1)[0]

    def encode_short(self, data: bytes) -> list[int]:
        """The same at once, for a pretoken of few bytes: last tokens are looked up from the end, so only prefixes that
        end with a token in question are."""
        if (token := self.ids.get(data)) is not None and self.fit(-1, token):
            return [token]
        step, fail = self.automaton.children.get, self.automaton.fail
        state, states = 0, [0]
        for byte in data:
            while (child := step(state << 8 | byte)) is None and state:
                state = fail[state]
            state = child or 0
            states.append(state)
        end = len(data)
        last: list[int | None] = [None] * (end + 1)
        last[0] = -1
        self._last(states, last, end)
        size, tokens = self.size, []
        while end > 0:
            token = last[end]
            tokens.append(token)
            end -= size[token]
        tokens.reverse()
        return tokens

    def _last(self, states: list[int], last: list[int | None], end: int) -> int:
        """The last token of a prefix; last has those known."""
        size, fits = self.size, self.fits
        for token in self.automaton.ends[states[end]]:
            begin = end - size[token]
            if (before := last[begin]) is None:
                before = self._last(states, last, begin)
            known = fits.get(before + 1 << 20 | token)
            if known or known is None and self.fit(before, token):
                last[end] = token
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _path(self, last: list[int], end: int) -> tuple[list[int], list[int]]:
        """Tokens up to a place, and the places where they end."""
        tokens, ends = [], []
        while end > 0:
            tokens.append(last[end])
            ends.append(end)
            end -= self.size[last[end]]
        return tokens[::-1], ends[::-1]

    def _shared(self, last: list[int]) -> tuple[list[int], int]:
        """The tokens that the encodings of all prefixes still open share, and where these end."""
        tokens, ends = self._path(last, len(last) - 1)
        common = set(ends)
        for end in range(max(1, len(last) - self.longest), len(last) - 1):
            common &= set(self._path(last, end)[1])
        shared = max(common, default=0)
        return tokens[: ends.index(shared) + 1] if shared else [], shared


class Codec:
    """Texts to ids and back, with a bounded memory of pieces and pretokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.transducer = Transducer(vocabulary)
        self.added = vocabulary.added
        texts = sorted(vocabulary.added, key=lambda t: (-len(t), t))
        self.mark = regex.compile("|".join(map(regex.escape, texts))) if texts else None
        size = max(vocabulary.tokens) + 1
        self.bytes_of = [vocabulary.tokens.get(i, b"") for i in range(size)]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.pieces, self.known = Recent(KNOWN_PIECES), Recent(KNOWN_PRETOKENS)

    def forget(self) -> None:
        """Give back the memory of what was remembered; a worker lives on after its task."""
        self.pieces, self.known, self.transducer.fits = Recent(KNOWN_PIECES), Recent(KNOWN_PRETOKENS), Recent(KNOWN_PAIRS)
        give_back()

    def _pretoken(self, pretoken: str) -> bytes:
        """Ids of a pretoken as little-endian 32-bit numbers."""
        if (ids := self.known.again(pretoken)) is not None:
            return ids
        short = len(pretoken) <= KNOWN_CHARS
        tokens = (self.transducer.encode_short if short else self.transducer.encode)(pretoken.encode())
        ids = b"".join(map(self.packed.__getitem__, tokens))
        return self.known.keep(pretoken, ids) if short else ids

    def _pretokens(self, text: str) -> bytes:
        get, other = self.known.get, self._pretoken
        if len(text) <= BLOCK:
            return b"".join([get(p) or other(p) for p in PRETOKEN.findall(text)])
        out, found = [], map(operator.itemgetter(0), PRETOKEN.finditer(text))
        while block := [get(p) or other(p) for p in islice(found, BLOCK)]:
            out.append(b"".join(block))
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece with the space before it; empty for one that belongs to what follows it."""
        if (ids := self.pieces.again(piece)) is None:
            if not piece or piece[-1].isspace():
                return b""
            ids = self._pretokens(" " + piece)
            if len(piece) <= KNOWN_CHARS:
                self.pieces.keep(piece, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        No pretoken crosses from something other than white space to a space, so a text
        falls into pieces there. A piece that is empty or ends in white space goes with
        the pieces behind it.
        """
        first, *pieces = text.split(" ")
        get, other = self.pieces.get, self._piece
        out = [get(p) or other(p) for p in pieces]
        if b"" not in out and first and not first[-1].isspace():
            return self._pretokens(first) + b"".join(out)
        joined, held = [], [first]
        for piece, ids in zip(pieces, out, strict=True):
            if held and held[-1] and not held[-1][-1].isspace():
                joined.append(self._pretokens(" ".join(held)))
                held = []
            if ids and not held:
                joined.append(ids)
            else:
                held = [*held, piece] if held else ["", piece]
        return b"".join([*joined, self._pretokens(" ".join(held))])

    def _parts(self, text: str) -> Iterator[str]:
        """Text and added tokens by turns; a text comes first."""
        at = 0
        for found in self.mark.finditer(text) if self.mark else ():
            yield text[at : found.start()]
            yield found[0]
            at = found.end()
        yield text[at:]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers; null counts as empty."""
        out = []
        for i, part in enumerate(self._parts(text or "")):
            if i % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        numbers, out = np.frombuffer(ids, dtype="<u4"), []
        for at in range(0, len(numbers), BLOCK):
            tokens = map(self.bytes_of.__getitem__, numbers[at : at + BLOCK].tolist())
            out.append(machine.decode(b"".join(tokens)))
        out.append(machine.decode(b"", True))
        return "".join(out)


@functools.lru_cache(maxsize=1)
def _codec(shared) -> Codec:  # noqa: ANN001  a broadcast of a Vocabulary; a worker keeps the codec it has built
    return Codec(shared.value)


def encode_of(docs: DataFrame, path: str, text: str = "text") -> Column:
    """Binary column of a text column of docs: ids as little-endian unsigned 32-bit numbers. Null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    @F.pandas_udf("binary")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for batch in batches:
            yield batch.map(codec.encode)
        codec.forget()

    return rows(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def decode_of(docs: DataFrame, path: str, ids: str = "ids") -> Column:
    """Text column of a column made by encode_of. Null counts as no ids, numbers without a token give nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    @F.pandas_udf("string")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for batch in batches:
            yield batch.map(codec.decode)

    return rows(F.coalesce(F.col(f"`{ids}`"), F.lit(b"")))


def round_trip_of(docs: DataFrame, path: str, text: str = "text") -> Column:
    """Struct column (ids, text): the encoding of a text column of docs and its decoding, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    @F.pandas_udf("ids binary, text string")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for batch in batches:
            texts = batch.tolist()
            for part in portions(texts):
                ids = [codec.encode(t) for t in texts[part]]
                yield pd.DataFrame({"ids": ids, "text": [codec.decode(i) for i in ids]})
        codec.forget()

    return rows(F.coalesce(F.col(f"`{text}`"), F.lit("")))
