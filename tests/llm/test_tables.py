"""Operators on whole tables against brute force, on small fixtures and the smallest test tables."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from areal.llm import common, components, decontamination, jaccard_join, line_dedup, queries, sharding

SF = "/root/testdata/sf0.001"


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# line dedup


def brute_dedup(docs, min_words):
    """Numbers of the lines to delete of each (id, text), in order: every run of whole lines is looked up."""
    seen, out = set(), {}
    for doc, text in docs:
        lines = [(i, s.strip()) for i, s in enumerate(text.split("\n")) if s.strip()]
        gone = set()
        for first in range(len(lines)):
            words = 0
            for last in range(first, len(lines)):
                words += len(lines[last][1].split())
                if words >= min_words:
                    run = tuple(s for _, s in lines[first : last + 1])
                    if run in seen:
                        gone.update(range(lines[first][0], lines[last][0] + 1))
                    seen.add(run)
        out[doc] = sorted(gone)
    return out


def test_line_dedup_by_brute_force(spark):
    draw = random.Random(4)
    line = lambda: draw.choice(["one two", "three", "four five six", "", " seven ", "eight nine ten eleven twelve"])
    docs = [(i, "\n".join(line() for _ in range(draw.randrange(14)))) for i in range(60)]
    table = spark.createDataFrame([(*d, len(d[1]), "x") for d in docs], "doc_id long, text string, n_chars int, lines string")
    wanted = brute_dedup(docs, 8)
    assert sum(map(bool, wanted.values())) > 20
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(table.repartition(5), 8, detail=True).collect()}
    for doc, text in docs:
        assert found[doc]["removed_lines"] == wanted[doc]
        kept = "\n".join(s for i, s in enumerate(text.split("\n")) if i not in set(wanted[doc]))
        assert (found[doc]["text"], found[doc]["n_chars"], found[doc]["lines"]) == (kept, len(kept), "x")
        assert bool(found[doc]["copied_from"]) == bool(wanted[doc])


def test_line_dedup_of_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (1, long), (1, "other " + long), (2, None), (3, ""), (4, f"{long}\n{long}\nend"), (4, f"{long}\n{long}\nend")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(str, (tuple(r) for r in line_dedup.dedup_lines(table).collect())))
    wanted = [(None, long), (1, ""), (1, "other " + long), (2, None), (3, ""), (4, "end"), (4, "end")]
    assert found == sorted(map(str, wanted))
    assert line_dedup.dedup_lines(table.limit(0)).collect() == []
    assert line_dedup.dedup_lines(table).columns == table.columns


def test_line_dedup_query(spark):
    wanted = brute_dedup(sorted(texts(spark).items()), line_dedup.MIN_WORDS)
    found = queries.QUERIES["op5_line_dedup_winnowing"](spark, SF).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in found} == {d: ",".join(map(str, n)) for d, n in wanted.items()}


def test_windows_select_the_same_fingerprint_in_every_place():
    draw = random.Random(9)
    run = "\n".join(" ".join(draw.choice("abcdefgh") * 3 for _ in range(draw.randrange(1, 9))) for _ in range(12))
    prints = []
    for _ in range(20):
        around = ["\n".join(str(draw.random()) for _ in range(draw.randrange(9))) for _ in range(2)]
        prints.append(set(line_dedup.select(f"{around[0]}\n{run}\n{around[1]}", 20)))
    assert set.intersection(*prints)


# Jaccard join


def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(docs, threshold=0.8):
    """(class, links, copies) of each id of (id, text), from all pairs of different sets."""
    groups = collections.defaultdict(list)
    for doc, text in docs:
        groups[shingles(text) or doc].append(doc)
    keys = list(groups)
    root, links = list(range(len(keys))), collections.Counter()
    for i, a in enumerate(keys):
        for j in range(i):
            b = keys[j]
            if isinstance(a, frozenset) and isinstance(b, frozenset):
                common_ones = len(a & b)
                if common_ones and common_ones / len(a | b) >= threshold - 1e-12:
                    links[i] += 1
                    links[j] += 1
                    root = [root[j] if r == root[i] else r for r in root]
    least = collections.defaultdict(lambda: float("inf"))
    for i, key in enumerate(keys):
        least[root[i]] = min(least[root[i]], *groups[key])
    return {d: (least[root[i]], links[i], len(groups[k]) - 1) for i, k in enumerate(keys) for d in groups[k]}


def edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def near_fixture():
    """Chains, copies and a larger group of near copies."""
    draw = random.Random(8)
    docs = []
    for _ in range(6):
        words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            docs.append(" ".join(words))
            words = edited(draw, words, draw.randrange(3)).split()
    base = [f"v{draw.randrange(10**6)}" for _ in range(150)]
    docs += [edited(draw, base, draw.randrange(1, 4)) for _ in range(80)]
    docs += ["a b c", "A  B\nc", "a b d", "", "  ", "one"]
    return list(enumerate(docs))


@pytest.mark.parametrize("block_bytes", [jaccard_join.BLOCK_BYTES, 20_000])
def test_jaccard_join_by_brute_force(spark, block_bytes):
    docs = near_fixture()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, size int, group string")
    found = jaccard_join.near_copies(table.repartition(4), block_bytes=block_bytes).collect()
    assert {r["_place"]: (r["class_place"], r["n_links"], r["n_copies"]) for r in found} == brute_classes(docs)


@pytest.mark.parametrize("block_sets", [7, 50])
def test_jaccard_join_in_blocks_of_few_sets(spark, block_sets):
    docs = near_fixture()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = jaccard_join.near_copies(table.repartition(4), block_sets=block_sets).collect()
    assert {r["_place"]: (r["class_place"], r["n_links"], r["n_copies"]) for r in found} == brute_classes(docs)


@pytest.mark.parametrize("sides", [1, 2])
def test_jaccard_block_of_many_short_sets_stays_small(sides):
    draw, n = np.random.default_rng(5), 4000
    base = draw.integers(0, 2**63, 20, dtype=np.uint64)
    sets = [np.append(base, own).tobytes() for own in np.arange(n, dtype=np.uint64)]
    batch = pa.RecordBatch.from_pydict({
        "group": [1] * n, "i": [0] * n, "j": [sides - 1] * n, "side": [k % sides for k in range(n)],
        "set_key": [str(k).encode() for k in range(n)], "shingles": sets,
    })
    tracemalloc.start()
    try:
        rows = [r for b in jaccard_join._verified(0.8)(iter([batch])) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6  # a matrix of all pairs in double precision alone has 128 MB, or 32 MB for two sides
    wanted = n - 1 if sides == 1 else n // 2
    assert [r["links"] for r in rows if r["b"] is None] == [wanted] * n
    assert sum(r["b"] is not None for r in rows) == n - 1


def test_jaccard_blocks_are_bounded_in_sets(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join([*words, f"own{k}"])) for k in range(4100)]
    seen = spark.sparkContext.accumulator(0)
    verified = jaccard_join._verified

    def counted(threshold):
        inner = verified(threshold)

        def verify(batches):
            held = [b for b in batches]
            for task in {(r["i"], r["j"]) for b in held for r in b.to_pylist()}:
                seen.add(1)
            yield from inner(iter(held))

        return verify

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    found = jaccard_join.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    assert {(r["class_place"], r["n_links"]) for r in found} == {(0, 4099)}
    assert seen.value == 6  # three blocks, each with each


def test_jaccard_join_of_odd_tables(spark):
    same = "five words are one shingle"
    rows = [(None, same), (1, same), (2, None), (3, ""), (3, ""), (4, "a b"), (4, "c d"), (5, same), (5, same)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.one_of_each(table)
    assert kept.columns == ["doc_id", "text"]
    wanted = [(None, same), (2, None), (3, ""), (4, "a b"), (4, "c d")]
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, wanted))
    assert jaccard_join.one_of_each(table.limit(0)).collect() == []


def test_jaccard_query(spark):
    wanted = brute_classes(sorted(texts(spark).items()))
    found = queries.QUERIES["op4_ngram_jaccard_join"](spark, SF).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in found} == wanted


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = jaccard_join.bands_for(threshold)
        assert bands * rows <= jaccard_join.MOST_HASHES
    bands, rows = jaccard_join.bands_for(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 1 - jaccard_join.MISSED


def test_signature_agreement_estimates_similarity():
    draw = np.random.default_rng(2)
    shared = draw.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, draw.integers(0, 2**63, 100, dtype=np.uint64)])) for _ in range(2))
    one, other = jaccard_join.signatures([a, b], 3000, 1)
    assert abs((one == other).mean() - 0.8) < 0.04


def test_components_by_brute_force(spark):
    draw = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + draw.randrange(60), 100 + draw.randrange(60)) for _ in range(45)]
    pairs = [(a, b) for a, b in pairs if a != b]
    label = {n: n for p in pairs for n in p}
    for _ in pairs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == label


# decontamination


def brute_leaks(docs, items, threshold=0.8):
    def sets(text):
        words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    held = [(d, sets(t)) for d, t in docs]
    return {
        (d, i): len(s & own) / len(own)
        for i, t in items
        if (own := sets(t))
        for d, s in held
        if len(s & own) / len(own) >= threshold - 1e-12
    }


@pytest.mark.parametrize("most", [common.BROADCAST_ROWS, 0])
def test_decontamination_by_brute_force(spark, monkeypatch, most):
    """Once with broadcasts, once with every join shuffled."""
    monkeypatch.setattr(decontamination, "SKETCH_ROWS", most)
    monkeypatch.setattr(common.join_few, "__defaults__", (most,))
    draw = random.Random(2)
    word = lambda: f"w{draw.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 5, 6, 9, 14, 30, 60])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "...")]
    docs = []
    for i in range(60):
        words = [word() for _ in range(draw.randrange(80))]
        if i % 2:
            part = items[draw.randrange(25)][1].split()
            if i % 3 == 0 and len(part) > 8:
                part[draw.randrange(3)] = "changed"
            words[draw.randrange(len(words) + 1) :] = part
        docs.append((i, (" ".join(words)).upper().replace(" W1", ", w1")))
    docs += [(200, None), (201, "")]
    table = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, item_id int, n int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(table.repartition(3), bench).collect()
    wanted = brute_leaks(docs, items)
    assert len(wanted) > 15
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in found} == pytest.approx(wanted)
    left = decontamination.without_leaks(table, bench)
    assert left.columns == table.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in wanted}


def test_decontamination_of_odd_tables(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "x"), (1, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, "A, b c d e")], "item_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in decontamination.leaks(docs, items).collect()))) == ["1", "None"]
    assert [tuple(r) for r in decontamination.without_leaks(docs, items).collect()] == [(1, "x")]
    assert decontamination.leaks(docs.limit(0), items).collect() == []
    assert decontamination.without_leaks(docs, items.limit(0)).count() == 4


def test_decontamination_plan_runs_no_python(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    plan = decontamination.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# sharding


def test_shards_by_the_law(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("mine")).withColumn("_hash", F.lit(1))
    dealt = sharding.shuffle_into_shards(docs)
    rows = dealt.collect()
    assert dealt.columns == ["doc_id", "text", "lang", "source", "n_chars", "_hash", "shard", "slot"]
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == docs.count()
    assert {r["doc_id"]: r["text"] for r in rows} == texts(spark)
    again = sharding.shuffle_into_shards(docs.repartition(7)).collect()
    place = lambda found: {r["doc_id"]: (r["shard"], r["slot"]) for r in found}
    assert place(rows) == place(again) != place(sharding.shuffle_into_shards(docs, seed=1).collect())


def test_shards_of_odd_tables(spark):
    rows = [(None, None), (1, None), (1, ""), (1, "x"), (1, "x"), (2, "y" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shuffle_into_shards(docs, shards=4).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in found))) == sorted(map(str, rows))
    assert len({(r["shard"], r["slot"]) for r in found}) == 6
    assert sharding.shuffle_into_shards(docs.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    dealt = sharding.shuffle_into_shards(spark.read.parquet(f"{SF}/documents.parquet"), shards=3)
    sharding.write_shards(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 67, 1: 67, 2: 66}


def test_fisher_yates_is_uniform():
    tally = collections.Counter(tuple(sharding.fisher_yates(3, seed)) for seed in range(6000))
    assert len(tally) == 6 and all(850 < n < 1150 for n in tally.values())


# pipeline


def test_pipeline_by_brute_force(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    table = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in corpus_pipeline.classify_quality(spark, table, SF).collect()}
    docs = sorted((d, t) for d, t in texts(spark).items() if d in good)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(d in good) == bool(q) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.95
    gone = brute_dedup(docs, line_dedup.MIN_WORDS)
    docs = [(d, "\n".join(s for i, s in enumerate(t.split("\n")) if i not in set(gone[d]))) for d, t in docs]
    classes = brute_classes(docs)
    docs = [(d, t) for d, t in docs if classes[d][0] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks(docs, items)}
    wanted = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs if d not in leaked}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in found} == wanted
    assert all(r["exact"] and r["n_tokens"] == len(wanted[r["doc_id"]]) for r in found)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_tables(spark, name, stage):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "x y", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema).withColumn("n", F.lit(1)).withColumn("size", F.lit("z"))
    last = stage is corpus_pipeline.STAGES[-1][1]
    out = stage(spark, docs, SF)
    assert out.count() <= 4
    assert last or out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0


# registered queries


def test_every_operator_is_registered_once():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import glob
    import os

    import duckdb

    base = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    wanted = base.execute(queries.ORACLES[name]).fetch_df()
    found = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    tell = lambda frame: sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))
    assert tell(found) == tell(wanted)
