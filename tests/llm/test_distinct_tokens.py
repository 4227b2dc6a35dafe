"""Distinct-word BPE, alignment and periodic runs against the libraries and brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from areal.llm import alignment, blocks, distinct_bpe, periodic, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN
ODD = [
    None, "", " ", "   ", "\n", "  a  b \n c\t d  ", "a\r\nb ;\r\n  \r x", "x" * 3000 + " " + "ab" * 2000, "nul\x00 x", "a \x1c b \x85c",
    "don't 12³½ 漢字  😀😀 é", "<|endoftext|> a <s> </s> <0x41>", "a▁b c", "  a  b \n c\t d  ", "no cut " * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    given_rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i // 2, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return given_rows.union(odd).cache()


def ranked():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_librarys(spark, docs):
    library = ranked()
    coded = distinct_bpe.encode(docs, RANKS, PATTERN, decoded=True)
    coded = coded.withColumn("again", distinct_bpe.decode_of(coded, RANKS))
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded), bytes(r.again)) for r in coded.collect())
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        want[r.doc_id, np.array(library.encode_ordinary(r.text or ""), dtype="<u4").tobytes(), data, data] += 1
    assert got == want


def test_small_blocks_give_the_same_ids(spark, docs, monkeypatch):
    monkeypatch.setattr(blocks.make, "__defaults__", (3000,))
    library = ranked()
    got = Counter((r.doc_id, bytes(r.ids)) for r in distinct_bpe.encode(docs.repartition(3), RANKS, PATTERN).collect())
    assert got == Counter((r.doc_id, np.array(library.encode_ordinary(r.text or ""), dtype="<u4").tobytes()) for r in docs.collect())


def test_encode_keeps_other_columns(spark):
    schema = "ids string, place long, block long, payload string, text string, decoded int"
    rows = spark.createDataFrame([("a", 1, 2, None, "hello there", 3), ("a", 1, 2, None, "hello there", 3), (None, None, None, "p", None, None)], schema)
    coded = distinct_bpe.encode(rows, RANKS, PATTERN, decoded=True)
    assert coded.columns == ["ids", "place", "block", "payload", "decoded", "ids_", "decoded_"]
    assert Counter((r.ids, r.place, r.payload, r.decoded, bytes(r.decoded_)) for r in coded.collect()) == Counter(
        {("a", 1, None, 3, b"hello there"): 2, (None, None, "p", None, b""): 1}
    )
    assert distinct_bpe.encode(rows.limit(0), RANKS, PATTERN).collect() == []
    unknown = spark.createDataFrame([(np.array([0, 60000, 1], dtype="<u4").tobytes(),), (None,)], "ids binary")
    assert [bytes(r[0]) for r in unknown.select(distinct_bpe.decode_of(unknown, RANKS)).collect()] == [b'!"', b""]


@given(st.binary(min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_long_and_short_words_merge_alike(data):
    ranks = test_long_and_short_words_merge_alike.__dict__.setdefault("ranks", distinct_bpe.read_ranks(RANKS))
    assert distinct_bpe._merged_short(data, ranks) == distinct_bpe._merged_long(data, ranks)


@given(st.lists(st.text(alphabet=" \n\ta.é", max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chunks_put_texts_together(texts):
    find = regex.compile(PATTERN).findall
    for prefixed in (False, True):
        chunks, codes, counts = blocks.chunked(texts, prefixed)
        at = 0
        for text, count in zip(texts, counts.tolist(), strict=True):
            own = [chunks[c] for c in codes[at : at + count]]
            at += count
            whole = " " + text if prefixed and text else text
            assert "".join(own) == whole
            assert [w for chunk in own for w in find(chunk)] == find(whole)


def test_planes_round_trip():
    for numbers in ([], [0], [255, 256, 0], [2**40, 1]):
        assert blocks.from_planes(blocks.to_planes(np.array(numbers, dtype=np.int64))).tolist() == numbers
    assert blocks.unpack(blocks.pack(b"", b"ab" * 100, b"c")) == [b"", b"ab" * 100, b"c"]


def brute_alignment(rows):
    """Rows of the query by walking both token lists."""
    a_tok, b_tok = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_tok.encode_special_tokens = True
    signs = alignment.byte_signs()
    a_bytes = {i: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t, i in a_tok.get_vocab().items()}
    b_bytes = [
        bytes([int(b_tok.id_to_piece(i)[3:-1], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b_tok.get_piece_size())
    ]
    found, totals, best = [], Counter(), defaultdict(int)
    for r in rows:
        groups = []
        if r.text:
            a, b, data = a_tok.encode(" " + r.text, add_special_tokens=False).ids, b_tok.encode(r.text), (" " + r.text).encode()
            if b"".join(a_bytes[i] for i in a) == data == b"".join(b_bytes[i] for i in b):
                ends_a, ends_b = (np.cumsum([len(x) for x in xs]).tolist() for xs in ([a_bytes[i] for i in a], [b_bytes[i] for i in b]))
                i = j = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    p, q = ends_a.index(cut) + 1, ends_b.index(cut) + 1
                    groups.append((a[i:p], b[j:q]))
                    i, j = p, q
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        totals.update(links.keys())
        found.append((r.doc_id, groups, links))
    for (x, _), n in totals.items():
        best[x] = max(best[x], n)
    out = Counter()
    for doc_id, groups, links in found:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        counts = (sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups), sum(links.values()))
        n_best = sum(n for (x, y), n in links.items() if totals[x, y] == best[x])
        out[doc_id, *counts, text, n_best, sum(n * totals[k] for k, n in links.items())] += 1
    return out


def test_alignment_equals_a_walk(spark, docs, monkeypatch):
    some = docs.filter("length(text) < 6000 or text is null")
    want = brute_alignment(some.collect())
    columns = ["doc_id", *alignment.COLUMNS]
    assert Counter(map(tuple, alignment.align(some, JSON, MODEL, PATTERN).select(columns).collect())) == want
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    digests = alignment.align(some.repartition(3), JSON, MODEL, PATTERN, digest=True).select(columns).collect()
    hashed = Counter()
    for row, n in want.items():
        hashed[*row[:5], hashlib.sha256(row[5].encode()).hexdigest() if row[5] else "", *row[6:]] += n
    assert Counter(map(tuple, digests)) == hashed


def test_alignment_keeps_other_columns(spark):
    rows = spark.createDataFrame([("x", 5, "one two", 1), ("x", 5, "one two", 1), (None, None, None, None)], "n_a string, groups int, text string, a int")
    found = alignment.align(rows, JSON, MODEL, PATTERN)
    assert found.columns == ["n_a", "groups", "a", "n_a_", "n_b", "n_groups", "n_links", "groups_", "n_best", "count_sum"]
    assert Counter((r.n_a, r.groups, r.n_a_, r.n_best, r.count_sum) for r in found.collect()) == Counter({("x", 5, 2, 2, 4): 2, (None, None, 0, 0, 0): 1})
    assert alignment.align(rows.limit(0), JSON, MODEL, PATTERN).collect() == []


def test_common_cuts_of_one_interval():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n})) for _ in range(2))
        cut_a, cut_b = alignment.common_cuts(a, b, np.array([0]), np.array([len(a)]))
        assert a[cut_a].tolist() == b[cut_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def brute_runs(words):
    """All runs by comparing every word with the one a period later."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and all(words[i : i + length - r] != words[i + r : i + length] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def periodic_words(rng, n, letters):
    words = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 8:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 6))
            for i in range(a, min(n, a + rng.randint(1, 9) * p)):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("window", [16, 1 << 17])
def test_runs_equal_brute_force(window, monkeypatch):
    monkeypatch.setattr(periodic, "WINDOW", window)
    rng = random.Random(9)
    texts = [periodic_words(rng, rng.randint(0, 120), "abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(800)]
    for words, found in zip(texts, periodic.find([" ".join(w) for w in texts]), strict=True):
        want = brute_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in found["runs"]] == want
        assert found["collapsed"] == collapsed(words, want) and found["n_words"] == len(words)


def test_squares_are_primitive():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.randint(0, 1) for _ in range(30)]
        for last, q in periodic.squares(words):
            half = words[last - q + 1 : last + 1]
            assert last - 2 * q + 1 >= 0 and words[last - 2 * q + 1 : last - q + 1] == half
            assert not any(q % r == 0 and half == half[:r] * (q // r) for r in range(1, q))


def test_long_texts_run_in_bounded_windows():
    words = ["a"] * 150_000 + [str(i % 4000) for i in range(150_000)]
    found = periodic.find([" ".join(words)])[0]
    assert [(r["start"], r["length"], r["period"]) for r in found["runs"]] == [(0, 150_000, 1), (150_000, 150_000, 4000)]


def test_find_runs_of_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, "x"), (2, "", None), (3, "a a a a a a", "x"), (3, "a a a a a a", "x"), (4, " a b\ta b \n" * 6, "y"), (5, "a " * 5, "z")],
        "n_words long, text string, runs string",
    )
    found = periodic.find_runs(rows)
    assert found.columns == ["n_words", "runs", "runs_", "collapsed", "n_words_"]
    got = Counter((r.n_words, r.runs, tuple(map(tuple, r.runs_)), r.collapsed, r.n_words_) for r in found.collect())
    assert got == Counter({
        (1, "x", (), "", 0): 1, (2, None, (), "", 0): 1, (3, "x", ((0, 6, 1),), "a", 6): 2,
        (4, "y", ((0, 12, 1),), "a b", 12): 1, (5, "z", (), "a a a a a", 5): 1,
    })
    assert periodic.find_runs(rows.limit(0)).collect() == []


def test_run_query_equals_brute_force(spark):
    got = {}
    for r in queries.QUERIES["op13_periodic_runs"](spark, SF_DIR).collect():
        got[r.doc_id] = tuple(r)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        words = [w for w in regex.split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs, top = brute_runs(words), None
        for run in runs:
            if top is None or run[1] * top[2] > top[1] * run[2]:
                top = run
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        milli = 1000 * top[1] // top[2] if top else None
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (text, collapsed(words, runs))]
        assert got[r.doc_id] == (r.doc_id, len(runs), *(top or (None,) * 3), milli, *digests)
