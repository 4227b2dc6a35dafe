"""Delimited text, workbooks, feature collections and writers."""

import contextlib
import io
import json
import random
import re
import shutil
import zipfile
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from areal.catalog import QUERIES
from areal.operators import geometry, labels, registry
from areal.sources import delimited, features, pieces, sinks, workbook
from areal.sources import lines as lines_module
from conftest import SF_DIR


def parse(spark, text, delimiter="auto", budget=None):
    df = spark.createDataFrame([("s", "csv", text)], "source_key string, source_type string, text string")
    summary, rows = delimited.parse(df, delimiter, budget)
    return summary.first(), rows.orderBy("row_number").collect()


def test_quotes_blank_records_and_mismatch(spark):
    summary, rows = parse(spark, '﻿a,b,A\r\n , ,\r\n"x, ""y""\nz" tail,2\r\nmid"quote,"",3,4\r\n')
    assert summary.status == "ok" and summary.headers == ["a", "b", "A__2"] and summary.encoding == "utf-8-bom"
    assert [r.row_number for r in rows] == [2, 3]
    assert rows[0].cells == {"a": 'x, "y"\nz tail', "b": "2", "A__2": ""} and rows[0].mismatch
    assert rows[1].cells == {"a": 'mid"quote', "b": "", "A__2": "3"} and rows[1].mismatch


def test_unclosed_quote_rejects_the_source(spark):
    summary, rows = parse(spark, 'a,b\n1,"open\n2,3')
    assert summary.status == "unclosed-quote" and rows == []


def test_detection(spark):
    samples = {"a,b\n1,2\n": "comma", "a;b\n1,5;2\n": "semicolon", "a\tb\n1\t2\n": "tab", "plain\n": "comma"}
    for text, name in samples.items():
        assert parse(spark, text)[0].delimiter == name
    assert parse(spark, "plain\n")[0].confidence == "low"


def test_budget(spark):
    assert parse(spark, "a,b\n1,2\n3,4", budget={"rows": 1})[0].status == "too-many-rows"
    assert parse(spark, "a,b\n1,22222", budget={"cell_length": 4})[0].status == "cell-too-long"


def _messy_text(rng, n):
    def cell():
        k = rng.random()
        if k < 0.1:
            return '"a\n,b"'
        if k < 0.15:
            return '"q""x\n\n""z" tail"x'
        if k < 0.2:
            return ""
        if k < 0.25:
            return 'mid"quote'
        if k < 0.28:
            return '"long\n' + "\n".join(f"line{i}" for i in range(60)) + '"'
        return f"v{rng.randint(0, 999)}"

    lines = [",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))) if rng.random() > 0.05 else " " for _ in range(n)]
    return "h1,h2,h1\n" + "\n".join(lines)


def test_large_files_give_the_same_rows(spark, tmp_path):
    text = _messy_text(random.Random(1), 150)
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "bad.csv").write_text(text + '\n"open\nx,y')
    _, whole = parse(spark, text, "comma")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rejected, rows = delimited.read_large(spark, str(tmp_path), "comma")
        got = sorted((r.row_number, tuple(sorted(r.cells.items())), r.mismatch) for r in rows.collect())
        assert sorted(r.status for r in rejected.collect()) == ["ok", "unclosed-quote"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((r.row_number, tuple(sorted(r.cells.items())), r.mismatch) for r in whole)


def test_strict_reader_drops_misfits(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    rows = delimited.read_strict(spark, str(tmp_path)).select("a", "b").collect()
    assert sorted(map(tuple, rows)) == [("1", "2"), ("7", "8")]


def test_workbook_triage_names_the_reason(spark):
    from areal.catalog.sources_and_headers import _workbook_bytes
    import pandas as pd

    good = _workbook_bytes(pd.Series([["a"]]), pd.Series([["1.5"]]), pd.Series([False]))[0]
    bad = _workbook_bytes(pd.Series([["a"]]), pd.Series([["1.5"]]), pd.Series([True]))[0]
    files = spark.createDataFrame(
        [("g.xlsx", len(good), bytearray(good)), ("m.xlsx", len(bad), bytearray(bad)), ("t.xlsx", 60, bytearray(good[:60]))],
        "path string, length bigint, content binary",
    )
    verdicts = {r.path: r.verdict for r in workbook.triage(workbook.entries(files)).collect()}
    assert verdicts == {"g.xlsx": "ok", "m.xlsx": "blocked-part", "t.xlsx": "damaged"}
    row = workbook.rows_of(workbook.cells(files.filter("path = 'g.xlsx'"))).first()
    assert row.sheet == "Data" and row.cells["Name"] == "a" and row.cells["Amount"] == "1.5" and row.cells["Day"] == "2023-03-18"


def test_feature_collection_and_partition_pruning(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    collection = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"shapeID": "X1", "name": "One", "type_name": "Kota"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
            {"type": "Feature", "properties": {"id": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
        ],
    }
    (tmp_path / "c.geojson").write_text(json.dumps(collection))
    got = {r.region_id: r for r in features.read(spark, str(tmp_path / "c.geojson")).collect()}
    assert got["gb-X1"].display_name == "Kota One" and len(got["gb-X1"].polygons) == 1
    assert len(got["two"].polygons) == 2
    table = features.read(spark, str(tmp_path / "c.geojson")).withColumn("province_code", F.when(F.col("region_id") == "two", "11").otherwise("12"))
    geometry.write_partitioned(table.select("region_id", "province_code", "polygons"), str(tmp_path / "out"))
    one = geometry.read_province(spark, str(tmp_path / "out"), "11")
    assert [r.region_id for r in one.collect()] == ["two"]
    assert "PartitionFilters: [isnotnull(province_code" in one._jdf.queryExecution().toString()


def test_province_query_reads_one_written_partition(spark):
    df = QUERIES["s10_province_scan"](spark, SF_DIR)
    assert "dynamicpruning" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.collect()
    leaves = df._jdf.queryExecution().executedPlan().executedPlan().plan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    read = [s.metrics().apply("numPartitions").value() for s in scans if "province_code" in s.simpleString(100) and "Scan parquet" in s.nodeName()]
    assert read == [1]


def test_partition_store_replaces_and_verifies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geometry, "FILE_REGIONS", 10)
    path = str(tmp_path / "store")
    square = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    rows = [(f"r{i}", "11" if i < 60 else "1x", square) for i in range(63)]
    schema = f"region_id string, province_code string, polygons {geometry.GEOMETRY_TYPE}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        geometry.write_partitioned(spark.createDataFrame(rows, schema), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {p.parent.name: len(list(p.parent.glob("*.parquet"))) for p in (tmp_path / "store").glob("province_code=*/*.parquet")}
    assert files["province_code=1x"] == 1 and 1 < files["province_code=11"] <= 6
    state = lambda: {r.province_code: (r.features, r.status) for r in geometry.verify_partitions(spark, path).collect()}
    assert state() == {"11": (60, "ok"), "1x": (3, "ok")}
    geometry.write_partitioned(spark.createDataFrame([("new", "1x", square)], schema), path)
    assert state() == {"11": (60, "ok"), "1x": (1, "ok")}
    shutil.rmtree(tmp_path / "store" / "province_code=11")
    assert state() == {"11": (0, "missing"), "1x": (1, "ok")}
    names = spark.createDataFrame([("1x", "One"), ("11", "Eleven")], "province_code string, province_name string")
    for wanted in ("One", "1x"):
        assert [r.region_id for r in geometry.read_province(spark, path, wanted, names).collect()] == ["new"]
    assert geometry.read_province(spark, path, "nowhere", names).collect() == []


def test_written_registry_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"x', "")], "x string, y string, z string").coalesce(1)
    sinks.write_registry(df, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    assert text == 'x,y,z\n"a,b","q""x",\n'


def _line_table(spark, texts, rng):
    """Texts as lines, cut into blocks at random."""
    rows = []
    for key, whole in texts.items():
        block = 0
        for i, value in enumerate(re.split("\r\n|\r|\n", whole)):
            block += rng.random() < 0.3
            rows.append((key, block, i, value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "source_key string, block long, line long, value string")


def _random_text(rng):
    mark = rng.choice([",", ";", "\t"])
    cell = lambda: rng.choice(["a", "", "x y", '"q"', f'"in{mark}side"', '"two\nlines"', '"say ""hi"""', '"a\r\n\r\nb"', "7", "﻿z", ' "late', "a;b", "1,5"])
    lines = [mark.join(cell() for _ in range(rng.choice([1, 3, 3, 3, 4]))) for _ in range(rng.randint(0, 40))]
    return rng.choice(["", "﻿", "﻿﻿"]) + rng.choice(["", "\n \n"]) + rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n", '\n"open'])


def test_lines_give_the_rows_of_whole_texts(spark, monkeypatch):
    rng = random.Random(8)
    texts = {f"t{i}": _random_text(rng) for i in range(60)} | {"empty": "", "blank": " \n\t\n", "quote": '"'}
    sources = spark.createDataFrame([(k, "csv", v) for k, v in texts.items()], "source_key string, source_type string, text string")
    fields = ["source_key", "status", "delimiter", "confidence", "headers", "n_rows", "n_columns", "n_cells"]
    for budget, head in ((None, 1000), ({"rows": 20, "columns": 3, "cells": 60, "cell_length": 9}, 2)):
        monkeypatch.setattr(lines_module, "HEAD_LINES", head)
        whole, rows = delimited.parse(sources, budget=budget)
        cut, line_rows = lines_module.parse_lines(_line_table(spark, texts, rng), budget=budget)
        by_key = lambda df: {r.source_key: tuple(r) for r in df.select(fields).collect()}
        wanted, got = by_key(whole), by_key(cut)
        for key in wanted:
            if wanted[key][1] == "unclosed-quote" or got[key][1] == "unclosed-quote":
                assert wanted[key][1] == got[key][1], (key, texts[key])
            else:
                assert wanted[key] == got[key], (key, texts[key])
        content = lambda df: Counter((r.source_key, r.row_number, tuple(r.headers), tuple(sorted(r.cells.items())), r.mismatch) for r in df.collect())
        assert content(rows) == content(line_rows)


def test_line_tables_with_odd_rows(spark):
    schema = "source_key string, block long, line long, value string, headers int, _block string"
    assert [df.collect() for df in lines_module.parse_lines(spark.createDataFrame([], schema))] == [[], []]
    rows = [("a", 0, 0, "x;y", 1, "k"), ("a", 0, 1, None, 1, None), ("a", 1, 0, "1;2", 1, "k"), ("a", 1, 1, "1;2", 1, "k")]
    sources, found = lines_module.parse_lines(spark.createDataFrame(rows, schema))
    assert [(r.status, r.delimiter, r.n_rows) for r in sources.collect()] == [("ok", "semicolon", 2)]
    assert sorted((r.row_number, r.cells["x"], r.cells["y"]) for r in found.collect()) == [(2, "1", "2"), (3, "1", "2")]
    assert len({r.row_id for r in found.collect()}) == 2


def test_large_files_find_their_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿h1;h2\n﻿x;1\n\"two\nlines\";2\n")
    (tmp_path / "b.tsv").write_text("h1\th2\n3\t4\n")
    (tmp_path / "bad.csv").write_text("a,b\n\"open\n1,2\n")
    sources, rows = delimited.read_large(spark, str(tmp_path))
    assert {r.source_key.rsplit("/", 1)[1]: (r.status, r.delimiter) for r in sources.collect()} == {
        "a.csv": ("ok", "semicolon"), "b.tsv": ("ok", "tab"), "bad.csv": ("unclosed-quote", "comma")
    }
    assert sorted(tuple(sorted(r.cells.items())) for r in rows.collect()) == [
        (("h1", "3"), ("h2", "4")), (("h1", "two\nlines"), ("h2", "2")), (("h1", "﻿x"), ("h2", "1"))
    ]


def _collection(rng, name):
    square = [[0, 0], [1, 0], [1, 1.5], [0, 0]]
    feature = lambda i: {
        "type": "Feature",
        "properties": {"id": f"{name}{i}", "name": rng.choice(['a "}" b', "x{[", "back\\slash\\", '"features":[', "é"])},
        "geometry": rng.choice([{"type": "Polygon", "coordinates": [square]}, {"type": "MultiPolygon", "coordinates": [[square], [square]]}]),
    }
    members = [("type", "FeatureCollection"), ("crs", {"features": [{"a": {}}, 1]}), ("features", [feature(i) for i in range(rng.randint(0, 9))]), ("n", [{}, {"type": "x"}])]
    rng.shuffle(members)
    return json.dumps(dict(members), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


def test_large_collections_give_the_features_of_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"c{i}.json": _collection(rng, f"c{i}-") for i in range(25)}
    texts |= {"none.json": '{"type":"FeatureCollection","features":[]}', "other.json": '{"type":"Topology","features":[{"properties":{}}]}', "cut.json": texts["c0.json"][:-1]}
    for name, body in texts.items():
        (tmp_path / name).write_text(body + rng.choice(["", "\n", " \n"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        sources, found = pieces.read_large(spark, str(tmp_path))
        checked = {r.source_key.rsplit("/", 1)[1]: tuple(r)[1:] for r in pieces.check(sources, found).collect()}
        got = sorted((r.source_key.rsplit("/", 1)[1], r.ordinal, r.region_id, r.region_name, r.geometry_type, r.polygons) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = {k: v for k, v in texts.items() if k != "cut.json"}
    table = spark.createDataFrame(list(whole.items()), "source_key string, text string")
    normalised = registry.normalize_features(features.with_properties(features.parse(table), features.PROPERTIES))
    assert got == sorted((r.source_key, r.ordinal, r.region_id, r.region_name, r.geometry_type, r.polygons) for r in normalised.collect())
    assert checked.pop("cut.json")[0] == "unclosed" and checked.pop("other.json")[0] == "no-collection"
    for name, (status, count, ids, verdict) in checked.items():
        own = json.loads(texts[name])["features"]
        assert (status, count, ids, verdict) == ("ok", len(own), len(own), "accepted")


def test_collections_with_a_repeated_id_are_rejected(spark):
    body = '{"type":"FeatureCollection","features":[{"properties":{"id":"a"}},{"properties":{"id":"a"}}]}'
    rows = [("s", 0, i, part, True) for i, part in enumerate(body[:-1].split("}"))]
    sources, parsed = pieces.parse_pieces(spark.createDataFrame(rows, "source_key string, block long, line long, value string, braced boolean"))
    found = registry.normalize_features(features.with_properties(parsed, features.PROPERTIES))
    assert [tuple(r) for r in pieces.check(sources, found).collect()] == [("s", "ok", 2, 1, "rejected")]


@contextlib.contextmanager
def _spread(spark, monkeypatch, module):
    """Partitions that hold rows of each table with texts that a module writes; nothing is small enough to broadcast."""
    held, write = [], module.checkpoint

    def checkpoint(df):
        done = write(df)
        if "_value" in done.columns:
            held.append(done.select(F.spark_partition_id()).distinct().count())
        return done

    monkeypatch.setattr(module, "checkpoint", checkpoint)
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield held
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_one_large_collection_is_read_by_many_tasks(spark, monkeypatch):
    feature = '{{"type":"Feature","properties":{{"region_id":"r{0}"}},"geometry":{{"type":"Polygon","coordinates":[[[{0},0],[1,0],[1,1],[{0},0]]]}}}}'
    whole = '{"type":"FeatureCollection","features":[' + ",".join(feature.format(i) for i in range(200)) + "]}"
    rows = [("s", i // 10, i, part, True) for i, part in enumerate(whole.split("}")[:-1])]
    table = spark.createDataFrame(rows, "source_key string, block long, line long, value string, braced boolean")
    # dealt by the source, as a join by it leaves the pieces
    with _spread(spark, monkeypatch, pieces) as held:
        sources, parsed = pieces.parse_pieces(table.repartition("source_key"))
        assert sources.collect() == [("s", "ok", 200)]
        assert sorted((r.ordinal, r.properties["region_id"]) for r in parsed.collect()) == [(i, f"r{i}") for i in range(200)]
    assert held and min(held) > 1


def test_one_large_line_source_is_read_by_many_tasks(spark, monkeypatch):
    body = [("s", i // 10, i, f'{i};"a\nb"' if i % 5 else f'{i};x') for i in range(1, 4000)]
    body = [(key, block, line * 2 + n, part) for key, block, line, value in body for n, part in enumerate(value.split("\n"))]
    table = spark.createDataFrame([("s", 0, 0, "\ufeffn;v"), *body], "source_key string, block long, line long, value string")
    with _spread(spark, monkeypatch, lines_module) as held:
        sources, rows = lines_module.parse_lines(table.repartition("source_key"))
        assert [(r.status, r.delimiter, r.headers, r.n_rows) for r in sources.collect()] == [("ok", "semicolon", ["n", "v"], 3999)]
        got = rows.select("row_number", F.element_at("cells", "n").alias("n"), F.element_at("cells", "v").alias("v"), F.spark_partition_id().alias("p")).collect()
        assert sorted(r[:3] for r in got) == [(i + 1, str(i), "a\nb" if i % 5 else "x") for i in range(1, 4000)]
        assert len({r.p for r in got}) > 1
    assert held and min(held) > 1


def test_workbook_entries_come_in_bounded_batches(monkeypatch):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name in ("xl/workbook.xml", "[Content_Types].xml", "x"):
            archive.writestr(name, "<a/>")
    contents = [buffer.getvalue(), b"no archive"] * 5
    files = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(10)], "length": [len(c) for c in contents], "content": contents})
    monkeypatch.setattr(workbook, "BATCH_ROWS", 4)
    found = list(workbook._list_entries([files]))
    assert max(b.num_rows for b in found) <= 6 and len(found) > 3
    rows = [r for b in found for r in b.to_pylist()]
    assert Counter(r["path"] for r in rows) == {f"f{i}": 1 if i % 2 else 3 for i in range(10)}
    assert {r["problem"] for r in rows if r["name"] is None} == {"damaged"}


def test_planted_documents_are_dealt_to_all_cores(spark):
    assert QUERIES["m7_planted_faults"](spark, SF_DIR).rdd.getNumPartitions() > 1


def test_anchors_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def place(x):
        seen.add(1)
        return float(x)

    n = F.col("n").cast("string")
    anchors = spark.range(50).withColumnRenamed("id", "n").select(
        n.alias("id"), n.alias("name"), F.lit("Kota").alias("type"), F.lit("p").alias("province"), F.lit(3).alias("priority"),
        place.asNondeterministic()("n").alias("lng"), F.lit(1.0).alias("lat"),
    )
    schema = "view_id string, min_x double, max_x double, min_y double, max_y double, zoom double, density string, selected_id string, presentation boolean"
    views = spark.createDataFrame([("far", 0.0, 9.0, 0.0, 2.0, 5.0, "detailed", None, False), ("near", 0.0, 9.0, 0.0, 2.0, 8.0, "detailed", "3", False)], schema)
    marks = spark.createDataFrame([("near", "4")], "view_id string, id string")
    got = sorted((r.view_id, r.id, r["rank"], r.text) for r in labels.candidates(anchors, views, marks).collect())
    ranks = {"3": 100, "4": 90}
    assert got == [("far", "0", 80, "p"), *[("near", str(i), ranks.get(str(i), 80), str(i)) for i in range(10)]]
    assert seen.value == 50
