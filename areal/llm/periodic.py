"""Periodic runs of words: a suffix automaton whose link tree is accessed word by word.

A run is a maximal stretch of words with smallest period q and at least LEAST_WORDS and
LEAST_TIMES times q words. The states of the suffix automaton that hold the suffixes of
a prefix lie on a path of the link tree. Appending a word accesses that path, as in a
link-cut tree, and recolours it with the place of the word; so the path always falls
into segments of equal last occurrence. A segment with strings of lo + 1 to hi words
that last ended q words before, lo < q <= hi, is a square of period q that ends here: a
string of q words twice in a row. It is the last occurrence, so q is the smallest
period. The square is extended both ways to its run. The tree is known in whole before
the first access, so its heavy paths stay as they are, and a path's colours are a stack.

A text is first searched for stretches that can hold a run at all: behind its first
period, each group of three words of a run stood at most that period before. That needs
one sort; all other words go into no automaton. Stretches of more than WINDOW words are
worked through in windows that overlap by four periods, which bounds the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructField, StructType

from areal.llm.blocks import Numbers, begins
from areal.llm.common import free_name, portions

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words that are compared at once for a candidate.
GROUP = 3
#: Words of a stretch that one automaton takes, unless eight periods are more.
WINDOW = 1 << 17
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("runs", pa.list_(RUN)), ("collapsed", pa.string()), ("n_words", pa.int64())])


def _distances(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word the distance to the last place in its text where the same GROUP words begin; 0 where there is none."""
    out = np.zeros(len(codes), dtype=np.int64)
    n = len(codes) - GROUP + 1
    if n <= 0:
        return out
    mixed = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)[:n]
    for i in range(GROUP):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def candidates(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, first, last + 1, longest period) of the stretches that hold all runs; numbers of words in the text.

    A run of period q holds at least max(LEAST_WORDS, LEAST_TIMES q) - q - GROUP + 1
    places in a row at a distance of at most q. Periods are tried by powers of two.
    Equal sums of different words only make further candidates.
    """
    starts, away = begins(sizes), _distances(codes, sizes)
    places = np.flatnonzero(away)
    away = away[places]
    text = np.searchsorted(starts, places, side="right") - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    least, most = 1, 1
    while len(places) and LEAST_TIMES * least <= int(sizes.max()):
        needed = max(LEAST_WORDS, LEAST_TIMES * least) - least - GROUP + 1
        near = away <= most
        own, own_text = places[near], text[near]
        if len(own) >= needed:
            apart = np.flatnonzero((np.diff(own) != 1) | (np.diff(own_text) != 0))
            first, last = np.concatenate([[0], apart + 1]), np.concatenate([apart, [len(own) - 1]])
            long = last - first + 1 >= needed
            for a, b in zip(first[long].tolist(), last[long].tolist()):
                t = int(own_text[a])
                begin, end = int(own[a] - starts[t]), int(own[b] - starts[t])
                found.setdefault(t, []).append((max(0, begin - most), min(int(sizes[t]), end + GROUP), most))
        least, most = most + 1, 2 * most
    for t, stretches in sorted(found.items()):
        stretches.sort()
        begin, end, most = stretches[0]
        for other_begin, other_end, other_most in stretches[1:]:
            if other_begin > end:
                yield t, begin, end, most
                begin, end, most = other_begin, other_end, other_most
            else:
                end, most = max(end, other_end), max(most, other_most)
        yield t, begin, end, most


def _automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and longest lengths of the states, and the state of each prefix; state 0 is the empty string."""
    after: list[dict[int, int]] = [{}]
    link, length, ends, last = [-1], [0], [], 0
    for word in words:
        state = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in after[p]:
            after[p][word] = state
            p = link[p]
        if p >= 0:
            q = after[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(after)
                after.append(after[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(word) == q:
                    after[p][word] = copy
                    p = link[p]
                link[q] = link[state] = copy
        ends.append(state)
        last = state
    return link, length, ends


def _heavy_tops(link: list[int], length: list[int]) -> list[int]:
    """The top of each state's heavy path in the link tree."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size, heavy = [1] * len(link), [-1] * len(link)
    for v in reversed(order[1:]):
        p = link[v]
        size[p] += size[v]
        if heavy[p] < 0 or size[v] > size[heavy[p]]:
            heavy[p] = v
    top = list(range(len(link)))
    for v in order[1:]:
        if heavy[link[v]] == v:
            top[v] = top[link[v]]
    return top


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(last word, period) of the squares of words, at least one for each run; periods are the smallest ones."""
    link, length, ends = _automaton(words)
    top = _heavy_tops(link, length)
    colours: dict[int, list[tuple[int, int]]] = {}  # of a heavy path: (longest length, last occurrence), the top at the end
    for i, state in enumerate(ends):
        while state > 0:
            head = top[state]
            to, lo = length[state], length[link[head]] if head else 0
            stack = colours.setdefault(head, [])
            while stack:
                hi, last = stack[-1]
                if lo < i - last <= (hi if hi < to else to):
                    yield i, i - last
                if hi > to:
                    break
                lo = hi
                stack.pop()
                if hi == to:
                    break
            stack.append((to, i))
            state = link[head] if head else 0


def _same(codes: np.ndarray, at: int, other: int, step: int) -> int:
    """How many words from at and from other on, forward or backward, are equal."""
    count, width = 0, 16
    while True:
        if step > 0:
            a, b = codes[at + count : at + count + width], codes[other + count : other + count + width]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
        else:
            n = max(0, min(width, at - count + 1, other - count + 1))
            a, b = codes[at - count - n + 1 : at - count + 1], codes[other - count - n + 1 : other - count + 1]
            differ = np.flatnonzero((a != b)[::-1])
        if len(differ):
            return count + int(differ[0])
        count += n
        if n < width:
            return count
        width = min(2 * width, 1 << 16)


def runs_of(codes: np.ndarray, begin: int, end: int, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text within a candidate stretch, by start and period."""
    found, reached = set(), {}
    width = max(WINDOW, 8 * longest)
    for first in range(begin, max(begin + 1, end - 4 * longest), max(1, width - 4 * longest)):
        for last, period in squares(codes[first : min(end, first + width)].tolist()):
            last += first
            if last <= reached.get(period, -1):
                continue
            start = last - period - _same(codes, last, last - period, -1) + 1
            stop = last + 1 + _same(codes, last + 1, last + 1 - period, 1)
            reached[period] = stop - 1
            if stop - start >= max(LEAST_WORDS, LEAST_TIMES * period):
                found.add((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def find(texts: list[str | None]) -> list[dict]:
    """Runs and collapsed text of each text; see find_runs."""
    words = [t.encode().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    number = Numbers()
    codes = np.fromiter((number[w] for own in words for w in own), dtype=np.int64, count=int(sizes.sum()))
    starts, runs = begins(sizes), {}
    for text, begin, end, longest in candidates(codes, sizes):
        own = codes[starts[text] : starts[text] + sizes[text]]
        runs.setdefault(text, set()).update(runs_of(own, begin, end, longest))
    out = []
    for i, own in enumerate(words):
        mine = sorted(runs.get(i, ()), key=lambda r: (r[0], r[2]))
        if mine:
            change = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(change, [s + q for s, _, q in mine], 1)
            np.add.at(change, [s + n for s, n, _ in mine], -1)
            own = [own[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        out.append({
            "runs": [{"start": s, "length": n, "period": q} for s, n, q in mine],
            "collapsed": b" ".join(own).decode(),
            "n_words": int(sizes[i]),
        })
    return out


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with runs, collapsed and n_words in place of a text column.

    Words are what ASCII white space parts, numbered from 0. runs are (start, length,
    period) by start, then period. collapsed are the words that no run holds behind its
    first period, joined by a space. Null and empty texts have no words, no runs and an
    empty text. Rows do not depend on one another; ties need no order, as no two runs
    have the same start and period. Other columns are kept as they are; where one is
    called like a new column, the new one gets underscores behind. An empty table gives
    no rows.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    names: list[str] = []
    for kind in FOUND:
        names.append(free_name(kind.name, [*[f.name for f in kept], *names]))
    made = [StructField(n, f.dataType) for n, f in zip(names, from_arrow_schema(pa.schema(list(FOUND))), strict=True)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, others = batch[text].to_pylist(), batch.drop_columns([text])
            for part in portions(texts):
                found = pa.array(find(texts[part]), FOUND)
                own = others.slice(part.start, part.stop - part.start)
                yield pa.record_batch([*own.columns, *found.flatten()], names=[*own.schema.names, *names])

    return docs.mapInArrow(rows, StructType([*kept, *made]))


def planted(doc_id: Column, text: Column) -> Column:
    """Texts of which some are made periodic from a word on, by the crc32 of the id: the input of the registered query.

    With h the crc32 of the decimal id (null: empty) and g = floor(h / 10), texts with h
    divisible by ten and n > 0 words repeat, from word g % n on, the 1 + floor((n - g %
    n) / (3 + g % 8)) words there to the end. Null texts are empty.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.array(F.struct((g % n).alias("a"), n.alias("n"))), lambda x: F.struct(
            x["a"].alias("a"), x["n"].alias("n"), (F.lit(1) + F.floor((x["n"] - x["a"]) / (3 + g % 8))).alias("p")
        ))[0]

    def again(w: Column) -> Column:
        return F.transform(F.array(repeated(w)), lambda x: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), (x["n"] - 1).cast("long")),
            lambda i: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int")),
        ), " "))[0]

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, F.coalesce(changed, F.lit(""))).otherwise(F.coalesce(text, F.lit("")))
