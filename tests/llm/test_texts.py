"""Operators on single texts: formats, models, fingerprints, codecs, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from areal.llm import bpe, chat, fingerprints, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# chat

PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "\n", "[\\INST]", "a", "é", " ", "[", "<", "INST]", "s>", "\\n", "assistant"]


def test_chat_round_trip_of_hostile_texts(spark):
    draw = random.Random(3)
    text = lambda: "".join(draw.choice(PIECES) for _ in range(draw.randrange(9)))
    rows = [(c, t, draw.choice(["user", "assistant", text()]), text()) for c in range(60) for t in range(4)]
    rows += [(100, 0, "user", None), (100, 1, None, "x"), (101, 1, "user", "b"), (101, 1, "user", "a"), (101, None, "s", "c")]
    rows += [(102, 0, "user", "same"), (102, 0, "user", "same"), (None, 0, "user", "no id"), (None, 1, "assistant", "y")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    formatted = chat.format_conversations(table)
    assert formatted.filter("not identical").count() == 0
    source = {}
    for conv, turn, role, said in rows:
        source.setdefault(conv, []).append((turn is not None, turn or 0, role or "", said or ""))
    for row in chat.digest(formatted).collect():
        turns = [(r, t) for _, _, r, t in sorted(source[row["conv_id"]])]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_leaves_content_without_conflict_as_it_is(spark):
    rows = [(1, 0, "user", "hi [INST"), (1, 1, "assistant", "yes"), (2, 0, "user", "[INST]")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.format_conversations(table).collect()}
    assert found[1]["formatted"] == "[INST]user\nhi [INST[/INST]<s>assistant\nyes</s>" and not found[1]["escaped"]
    assert found[2]["formatted"] == "[INST]user\n[\\INST][/INST]" and found[2]["escaped"]
    assert chat.digest(chat.format_conversations(table.limit(0))).collect() == []


# quality


def test_quality_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    found = queries.QUERIES["op8_quality_discriminant"](spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id"
    )
    right, n = found.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_quality_of_odd_tables(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (3, "some words here."), (3, "again"), (None, "x"), (4, "word " * 50_000)])
    described = docs.select("doc_id", quality.features_of(F.col("text")).alias("features"))
    labels = spark.createDataFrame([(3, 1), (4, None), (2, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    for chosen in (labels, labels.limit(0)):
        model = quality.fit_labelled(described, chosen, "quality")
        scores = [r[0] for r in described.select(quality.score_of(F.col("features"), model)).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert all(abs(s - 0.5) < 1e-9 for s in scores)
    assert described.limit(0).select(quality.score_of(F.col("features"), model)).collect() == []
    assert quality.features(None) == quality.features("") == [0.0] * len(quality.FEATURES)


def test_quality_score_is_the_density_ratio():
    draw = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = [draw.normal(size=(400, d)), draw.normal(1, 2, size=(300, d))]

    class Rows:
        pass

    moments = {k: (float(len(v)), v.sum(axis=0), v.T @ v) for k, v in enumerate(x)}
    original, quality._moments = quality._moments, lambda rows: moments
    try:
        model = quality.fit(Rows(), to_pooled=0.0, to_diagonal=0.0)
    finally:
        quality._moments = original
    logs = []
    for v in x:
        covariance = np.cov(v.T, bias=True)
        away = x[1][:5] - v.mean(axis=0)
        form = np.einsum("ij,jk,ik->i", away, np.linalg.inv(covariance), away)
        logs.append(np.log(len(v)) - 0.5 * (form + np.linalg.slogdet(covariance)[1]))
    assert np.allclose(model.score(x[1][:5]), 1 / (1 + np.exp(logs[0] - logs[1])), atol=2e-2)


# toxicity


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    found = queries.QUERIES["op1_toxicity_kneser_ney"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rates = {r["toxic"]: r["p"] for r in found.filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] > 0.85 and rates[0] < 0.04


def test_toxicity_of_odd_tables(spark):
    rows = [(i, "you idiot and fool" if i % 2 else "what a lovely day") for i in range(200)]
    docs = docs_of(spark, [*rows, (1000, None), (1001, ""), (1002, "!!!"), (1, "you idiot"), (None, "idiot")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 0), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r[0]: r[1] for r in docs.select("doc_id", toxicity.score_of(docs, model)).collect()}
    assert scores[3] > 0.9 > 0.1 > scores[2]
    assert 0 <= scores[1000] == scores[1001] == scores[1002] <= 1
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r[0] for r in docs.select(toxicity.score_of(docs, empty)).collect()} == {0.5}
    assert docs.limit(0).select(toxicity.score_of(docs, model)).collect() == []


def test_toxicity_ratio_is_kneser_ney(spark):
    """A word's ratio against the formula, by hand: all words as long as their stems, so they hang on the root."""
    texts = ["aaa bbb"] * 20 + ["ccc"] * 2
    ordinary = ["ccc ddd"] * 25
    rows = [(t, 1) for t in texts] + [(t, 0) for t in ordinary]
    counted = toxicity.count_pairs(spark.createDataFrame(rows, "text string, label int"))
    model = toxicity._ratios(counted)
    d, kinds, n = toxicity.DISCOUNT, (3, 2), (42, 50)
    shared = 1 / 4  # aaa was met in one of four contexts
    wanted = np.log((20 - d) / n[0] + d * kinds[0] / n[0] * shared) - np.log(d * kinds[1] / n[1] * shared)
    level = toxicity._hashes(np.array(["aaa"], dtype=object)) ^ toxicity.STEMS[-1]
    assert np.allclose(toxicity._look_up(model.units, model.unit_ratio, level)[1], [wanted])


# personal data


def brute_spans(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", *m.span()) for m in email.finditer(text)]
    found += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in card.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [("phone", *m.span()) for m in phone.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab@@..0123456789 +-()%é\n", max_size=60))
def test_base_spans_equal_the_plain_rules(text):
    assert pii.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "+1-" + "-" * 200_000])
def test_base_spans_are_linear(text):
    assert pii.base_spans(text) is not None


def test_pii_query_and_added_spans(spark):
    found = {r["doc_id"]: r for r in queries.QUERIES["op3_pii_boosted_spans"](spark, SF).collect()}
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = [f"{k}:{a}:{b}" for k, a, b in brute_spans(row["text"])]
        assert found[row["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[row["doc_id"]]["spans"].split(",")) | {""}
    draw = random.Random(5)
    rows = []
    for i in range(600):
        number = lambda n: "".join(str(draw.randrange(10)) for _ in range(n))
        rows.append((i, f"call +1 ({number(3)}) {number(3)}-{number(4)} or id {number(13)}x or v {number(3)}.999.1.2 end"))
    docs = docs_of(spark, [*rows, (9000, None), (9001, ""), (9002, "ring (212) 555-0101 now"), (9002, "a@b.cc")])
    trees = pii.fit(docs)
    out = docs.select("doc_id", "text", pii.spans_of(docs, trees).alias("f"))
    told = out.select("doc_id", pii.listed(F.col("f.base")), pii.listed(F.col("f.spans")), pii.redact(F.col("text"), F.col("f.spans")))
    found = {(r[0], r[1]): r for r in told.collect()}
    assert found[9000, ""][2:] == ("", None) and found[9001, ""][2:] == ("", "")
    assert found[9002, "email:0:6"][3] == "[email]"
    assert found[9002, ""][2].startswith("phone:")  # a variant that the rules miss
    assert pii.fit(docs.limit(0)) is None
    assert docs.limit(0).select(pii.spans_of(docs, None)).collect() == []


def test_pii_fit_reads_every_candidate(spark):
    texts = ["call +1 (212) 555-0101 or 1.2.3.4", "v 1.999.1.2 or id 1234567890123x", "a@b.cc and (212) 555-0101", None]
    docs = docs_of(spark, [(i, texts[i % 4]) for i in range(30_000)])
    n = {r["kept"]: r["n"] for r in pii._described(docs).groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    told = [s for t in texts[:3] for s in pii.candidates(t) if s in pii.base_spans(t) or pii.broken(t, s)]
    assert sum(n.values()) == 7500 * len(told) > 20_000
    # cuts are the quantiles of all values, bins and trees do not depend on how rows are dealt
    x = np.repeat([pii.describe(texts[0], s) for s in pii.candidates(texts[0])], 3, axis=0)
    rows = [(False, 0, 1, list(map(float, v)), 1) for v in x]
    table = spark.createDataFrame(rows, "kept boolean, kind int, label int, x array<double>, n long")
    for cut, column in zip(pii._cuts(table), x.T, strict=True):
        assert np.allclose(cut, np.unique(np.quantile(column.astype(float), np.linspace(0, 1, pii.BINS + 1)[1:-1])))
    trees = [pii.fit(docs.repartition(k)) for k in (2, 7)]
    assert np.array_equal(trees[0].features, trees[1].features) and np.allclose(trees[0].leaves, trees[1].leaves)


def test_pii_tasks_of_a_level_follow_the_descriptions(spark, monkeypatch):
    said = "call +1 ({0}) {0}-{1} or id {1}{0}{1}{0}x or v {0}.999.1.2 end{2}"
    docs = docs_of(spark, [(i, said.format(100 + i * 7 % 900, 1000 + i * 31 % 9000, "," * (i % 9))) for i in range(400)])
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    try:
        described = pii._described(docs)
        cuts = pii._cuts(described)
        coded = pii._binned(described, cuts)
        assert coded.rdd.getNumPartitions() == 1
        rows = sorted(map(tuple, coded.collect()))
        monkeypatch.setattr(pii, "TREES", 5)
        trees = pii.fit(docs)
        monkeypatch.setattr(pii, "TASK_ROWS", math.ceil(len(rows) / 3))
        spread, wide = pii._binned(described, cuts), pii.fit(docs)
        assert sorted(map(tuple, spread.collect())) == rows
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert spread.rdd.getNumPartitions() == len(sizes) == 3 and max(sizes) < len(rows) / 2
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert np.array_equal(trees.features, wide.features) and np.allclose(trees.leaves, wide.leaves)
    assert trees.thresholds == pytest.approx(wide.thresholds)


# fingerprints


def test_fingerprints_by_brute_force(spark):
    found = {r["doc_id"]: r for r in queries.QUERIES["op2_merkle_fingerprints"](spark, SF).collect()}
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert len(found) == len(docs)
    for k, (doc_id, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        row, tree = found[doc_id], fingerprints.tree_of(text)
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == tree.root
        assert row["edited_fingerprint"] == fingerprints.tree_of(edited).root
        assert row["near_next"] == fingerprints.likeness(tree, fingerprints.tree_of(following))
        assert row["near_edited"] == fingerprints.likeness(tree, fingerprints.tree_of(edited))


def test_fingerprints_of_odd_tables(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "first", 7), (5, "a b\n\nc", 7), (5, "a b\n\nc", 7), (5, "other", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie int").repartition(4)
    found = fingerprints.compare_neighbours(docs).collect()
    assert len(found) == 6
    assert sum(r["doc_id"] is None for r in found) == 1
    assert len({r["fingerprint"] for r in found}) == 4  # null and empty are alike, as are the two equal texts
    one = fingerprints.compare_neighbours(docs.filter("doc_id = 2")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert fingerprints.compare_neighbours(docs.limit(0)).collect() == []


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.\n ", max_size=120), st.text(alphabet="ab.\n ", max_size=120))
def test_roots_tell_texts_apart(a, b):
    left, right = fingerprints.tree_of(a), fingerprints.tree_of(b)
    assert (left.root == right.root) == (a == b)
    assert sum(left.leaves().values()) == len(a)
    assert 0 <= fingerprints.likeness(left, right) <= 1


def test_differing_branches_locate_edits():
    before = "one.\ntwo.\n\nthree.\nfour.\n\nfive.\n"
    after = before.replace("four", "fourth")
    assert fingerprints.edited_paragraphs(fingerprints.tree_of(before), fingerprints.tree_of(after)) == [3]


# tokens


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary.read(queries.tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="abcdethinrs  \n\t'’é0½²._-=<|>endoftxß日😀\x1c\x85\x00", max_size=60))
def test_codec_equals_the_library(codec, library, text):
    wanted = library.encode(text, add_special_tokens=False).ids
    assert ids(codec, text) == wanted
    assert codec.decode(codec.encode(text)) == library.decode(wanted, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text", ["a" * 9000, "ab" * 6000, "=-" * 5000, " " * 8000 + "x", "x<|endoftext|><|endoftext|> y<|endoftext", "aAbB" * 3000]
)
def test_long_pretokens_stream(codec, library, text):
    assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_transducer_emits_before_the_end_and_stays_small(codec):
    machine = codec.transducer
    draw = random.Random(1)
    data = "".join(draw.choice("theinrsta") for _ in range(30_000)).encode()
    assert max(map(len, machine.ids)) == machine.longest < machine.lookahead < 2000
    seen = []

    class Watched(bytes):
        def __getitem__(self, key):
            if isinstance(key, int):
                seen.append(key)
            return super().__getitem__(key)

    first = next(machine.encode(Watched(data)))
    assert machine.tokens[first] == data[: len(machine.tokens[first])]
    assert max(seen) < 5 * (machine.lookahead + machine.longest)


def test_decoder_state_machine(codec):
    half = [i for i, b in codec.transducer.tokens.items() if b == "é".encode()[:1]][0]
    assert codec.decode(np.array([half, half], "<u4").tobytes()) == b"\xc3\xc3".decode("utf-8", "replace")
    assert codec.decode(b"") == "" and codec.encode(None) == b""


def test_codec_columns(spark, library):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "héllo wörld", "x")], "doc_id long, text string, ids string")
    path = queries.tokenizer_path()
    coded = docs.select("doc_id", bpe.encode_of(docs, path).alias("coded"))
    told = {r[0]: r[1] for r in coded.select("doc_id", bpe.decode_of(coded, path, "coded")).collect()}
    assert told == {1: "", 2: "", 3: "héllo wörld"}
    assert coded.filter("doc_id = 3").first()["coded"] == np.array(library.encode("héllo wörld").ids, "<u4").tobytes()
    assert docs.limit(0).select(bpe.encode_of(docs, path)).collect() == []
