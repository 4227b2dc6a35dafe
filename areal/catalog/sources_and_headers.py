"""Delimited texts, headers, feature collections, sinks."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from areal.catalog.registered import Tables, query
from areal.catalog.shapes import shaped
from areal.operators import geometry, headers, lineage, registry
from areal.plans import inputs
from areal.plans.sizing import shared_folder
from areal.sources import delimited, features, lines, pieces, sinks, workbook

# One delimited text per batch of 100 order numbers, its lines the orders of the batch.
inputs.DERIVED["order_lines"] = """
SELECT CAST(CAST(floor(o_orderkey / 100) AS BIGINT) AS STRING) AS day, CASE CAST(floor(o_orderkey / 100) AS BIGINT) % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS mark,
       o_orderkey, o_orderpriority, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS price
FROM {orders}"""
inputs.DERIVED["text_lines"] = """
SELECT day, mark, o_orderkey, concat(CASE WHEN o_orderstatus = 'F' THEN concat('"Region ', CAST(o_orderkey AS STRING), mark, ' ""north""', chr(10), 'side" kept') ELSE concat('Region ', CAST(o_orderkey AS STRING)) END, mark,
       CASE WHEN o_orderstatus = 'P' THEN concat('"', price, '"') ELSE price END, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE concat(mark, o_orderpriority) END,
       CASE WHEN o_orderpriority = '1-URGENT' THEN concat(mark, 'surplus') ELSE '' END) AS line
FROM {order_lines}"""
_HEADER = "concat('Wilayah', mark, 'Nilai', mark, 'nilai_')"


def _texts(t: Tables):
    texts = t.text_lines.groupBy("day", "mark").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("l"))
    header = F.concat(F.lit("﻿Wilayah"), "mark", F.lit("Nilai"), "mark", F.lit("nilai_"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\r\n")
    return texts.select(F.col("day").alias("source_key"), F.lit("csv").alias("source_type"), F.concat(header, F.lit("\r\n \r\n"), body, F.lit("\n")).alias("text"))


_ROWS = """(SELECT day AS source_key, CAST(row_number() OVER (PARTITION BY day ORDER BY o_orderkey) + 1 AS INTEGER) AS row_number,
    CASE WHEN o_orderstatus = 'F' THEN concat('Region ', CAST(o_orderkey AS VARCHAR), mark, ' "north"', chr(10), 'side kept') ELSE concat('Region ', CAST(o_orderkey AS VARCHAR)) END AS wilayah,
    price AS nilai, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS third, o_orderpriority IN ('5-LOW', '1-URGENT') AS mismatch FROM {order_lines})"""


@query("s1_delimited_scan", f"SELECT * FROM {_ROWS}")
def s1(t):
    _, rows = delimited.parse(_texts(t))
    cell = lambda name: F.element_at("cells", F.lit(name))
    return rows.select("source_key", "row_number", cell("Wilayah").alias("wilayah"), cell("Nilai").alias("nilai"), cell("nilai___2").alias("third"), "mismatch")


@query("s2_record_splitter", "SELECT day AS source_key, count(*) + 1 AS records FROM {order_lines} GROUP BY 1")
def s2(t):
    summary, _ = delimited.parse(_texts(t))
    return summary.select("source_key", (F.col("n_rows") + 1).cast("bigint").alias("records"))


@query(
    "s3_delimiter_detection",
    "SELECT day AS source_key, CASE mark WHEN ',' THEN 'comma' WHEN ';' THEN 'semicolon' ELSE 'tab' END AS delimiter FROM {order_lines} GROUP BY 1, 2",
)
def s3(t):
    return _texts(t).select("source_key", delimited.detect_delimiter("text")["delimiter"].alias("delimiter"))


def _lines(t: Tables, source):  # noqa: ANN001, ANN202
    """The same texts as a table of lines; blocks end behind every seventh order, some inside a quoted cell."""
    parts = t.text_lines.select(source.alias("source_key"), "mark", "o_orderkey", F.posexplode(F.split("line", "\n")).alias("part", "value"))
    body = parts.select(
        "source_key",
        F.floor((F.col("o_orderkey") + F.col("part")) / 7).alias("block"),
        (F.col("o_orderkey") * 2 + F.col("part")).alias("line"),
        "value",
    )
    head = F.concat(F.lit("\ufeffWilayah"), "mark", F.lit("Nilai"), "mark", F.lit("nilai_"))
    heads = t.text_lines.groupBy(source.alias("source_key")).agg(F.first("mark").alias("mark"))
    heads = heads.select("source_key", F.lit(-1).cast("bigint").alias("block"), F.posexplode(F.array(head, F.lit(" "))).alias("line", "value"))
    return body.unionByName(heads)


def _line_rows(t: Tables, source):  # noqa: ANN001, ANN202
    _, rows = lines.parse_lines(_lines(t, source))
    cell = lambda name: F.element_at("cells", F.lit(name))
    return rows.select(
        "source_key", F.col("row_number").cast("int").alias("row_number"), cell("Wilayah").alias("wilayah"), cell("Nilai").alias("nilai"), cell("nilai___2").alias("third"), "mismatch"
    )


@query("s1_large_lines", f"SELECT * FROM {_ROWS}")
def s1_large(t):
    return _line_rows(t, F.col("day"))


# One source for each delimiter: a third of all lines in each.
@query("s1_three_large_sources", f"SELECT * FROM {_ROWS.replace('day AS source_key', 'mark AS source_key').replace('PARTITION BY day', 'PARTITION BY mark')}")
def s1_three(t):
    return _line_rows(t, F.col("mark"))


@query(
    "s3_large_detection",
    "SELECT mark AS source_key, CASE mark WHEN ',' THEN 'comma' WHEN ';' THEN 'semicolon' ELSE 'tab' END AS delimiter, 'ok' AS status, count(*) AS n_rows FROM {order_lines} GROUP BY 1",
)
def s3_large(t):
    sources, _ = lines.parse_lines(_lines(t, F.col("mark")))
    return sources.select("source_key", "delimiter", "status", "n_rows")


# Without quotes or line breaks in cells the scoring can be repeated in SQL.
@query(
    "s3_detection_score",
    """WITH head AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT CAST(floor(o_orderkey / 25) AS BIGINT) AS o_custkey, o_orderkey, o_orderpriority FROM {orders})),
    counts AS (SELECT o_custkey, mark, length(l) - length(replace(l, mark, '')) + 1 AS c, n FROM (SELECT o_custkey, n, CASE WHEN o_orderpriority = '5-LOW' THEN 'a,b;c,d' WHEN o_orderpriority = '2-HIGH' THEN 'plain' ELSE 'a;b;c,d' END AS l FROM head WHERE n <= 20), (SELECT unnest([',', ';']) AS mark)),
    modes AS (SELECT o_custkey, mark, c, count(*) AS f, min(n) AS first_n FROM counts WHERE c > 1 GROUP BY ALL),
    best AS (SELECT o_custkey, mark, c, f, sum(f) OVER (PARTITION BY o_custkey, mark) AS used, row_number() OVER (PARTITION BY o_custkey, mark ORDER BY f DESC, first_n) AS r FROM modes)
    SELECT k.o_custkey, coalesce(arg_max(CASE mark WHEN ',' THEN 'comma' ELSE 'semicolon' END, s), 'comma') AS delimiter, round(coalesce(max(s // 1e-9), 0) * 1e-9, 6) AS score
    FROM (SELECT DISTINCT CAST(floor(o_orderkey / 25) AS BIGINT) AS o_custkey FROM {orders}) k LEFT JOIN (SELECT o_custkey, mark, c * (f / used) * used + CASE mark WHEN ',' THEN 1e-12 ELSE 0 END AS s FROM best WHERE r = 1) b ON b.o_custkey = k.o_custkey GROUP BY 1""",
)
def s3_score(t):
    line = F.when(F.col("o_orderpriority") == "5-LOW", "a,b;c,d").when(F.col("o_orderpriority") == "2-HIGH", "plain").otherwise("a;b;c,d")
    batched = t.orders.withColumn("o_custkey", F.floor(F.col("o_orderkey") / 25))
    texts = batched.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return texts.select("o_custkey", delimited.detect_delimiter(body).alias("d")).select("o_custkey", "d.delimiter", F.round("d.score", 6).alias("score"))


inputs.DERIVED["listing"] = """SELECT concat(replace(p_name, ' ', '_'), CAST(p_partkey AS STRING), CASE p_size % 8 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.csv' WHEN 2 THEN '.Tsv' WHEN 3 THEN '.txt' WHEN 4 THEN '.xlsm' WHEN 5 THEN '.ods' WHEN 6 THEN '.csv' ELSE '.pdf' END) AS path,
    CAST(floor(p_retailprice * 2600) AS BIGINT) AS length FROM {part}"""


@query(
    "s6_file_routing",
    """SELECT path, length, CASE WHEN ends_with(lower(path), '.xlsx') THEN 'workbook' WHEN regexp_matches(lower(path), '\\.(csv|tsv|txt)$') AND length <= 2500000 THEN 'delimited'
       WHEN regexp_matches(lower(path), '\\.(xlsm|xlsb|xls|ods)$') THEN 'unsupported' WHEN regexp_matches(lower(path), '\\.(csv|tsv|txt)$') THEN 'too-large' ELSE 'rejected' END AS route FROM {listing}""",
)
def s6(t):
    return delimited.route(t.listing)


@query(
    "s7_budget_report",
    """SELECT source_id, rows, cells, cell_length, rows <= 5 AND cells <= 12 AND cell_length <= 20 AS accepted FROM (SELECT CAST(source_id AS VARCHAR) AS source_id, count(*) AS rows, count(*) * 2 AS cells, CAST(max(greatest(length(region_name), length(numeric_value))) AS INTEGER) AS cell_length FROM {messy} GROUP BY 1)""",
)
def s7(t):
    rows = t.messy.select(F.col("source_id").cast("string").alias("source_id"), F.create_map(F.lit("n"), "region_name", F.lit("v"), "numeric_value").alias("cells"))
    report = delimited.budget_report(rows, {"rows": 5, "cells": 12, "cell_length": 20})
    return report.select("source_id", "rows", "cells", "cell_length", "accepted")


# Every limit of a budget; sources differ in each of them.
@query(
    "s7_all_limits",
    """SELECT source_id, rows, columns, cells, cell_length, bytes, sheets, concat_ws(',', CASE WHEN bytes > 60 THEN 'bytes' END, CASE WHEN cell_length > 18 THEN 'cell_length' END, CASE WHEN cells > 16 THEN 'cells' END,
       CASE WHEN columns > 2 THEN 'columns' END, CASE WHEN rows > 5 THEN 'rows' END, CASE WHEN sheets > 1 THEN 'sheets' END) AS exceeded
       FROM (SELECT CAST(source_id AS VARCHAR) AS source_id, count(*) AS rows, CAST(max(CASE WHEN source_id % 5 = 0 THEN 3 ELSE 2 END) AS INTEGER) AS columns, count(*) * max(CASE WHEN source_id % 5 = 0 THEN 3 ELSE 2 END) AS cells,
        CAST(max(greatest(length(region_name), length(numeric_value), CASE WHEN source_id % 5 = 0 THEN length(period) ELSE 0 END)) AS INTEGER) AS cell_length,
        CAST(sum(strlen(region_name) + strlen(numeric_value) + CASE WHEN source_id % 5 = 0 THEN strlen(period) ELSE 0 END) AS BIGINT) AS bytes, count(DISTINCT CASE WHEN source_id % 7 = 0 THEN period ELSE '' END) AS sheets
        FROM {messy} GROUP BY 1)""",
)
def s7_all(t):
    two = F.create_map(F.lit("n"), "region_name", F.lit("v"), "numeric_value")
    three = F.create_map(F.lit("n"), "region_name", F.lit("v"), "numeric_value", F.lit("p"), "period")
    rows = t.messy.select(
        F.col("source_id").cast("string").alias("source_id"),
        F.when(F.col("source_id") % 5 == 0, three).otherwise(two).alias("cells"),
        F.when(F.col("source_id") % 7 == 0, F.col("period")).otherwise("").alias("sheet"),
    )
    report = delimited.budget_report(rows, {"rows": 5, "columns": 2, "cells": 16, "cell_length": 18, "bytes": 60, "sheets": 1})
    return report.select("source_id", "rows", "columns", "cells", "cell_length", "bytes", "sheets", F.array_join("exceeded", ",").alias("exceeded"))


@query("s12_strict_rows", f"SELECT source_key, count(*) AS rows FROM {_ROWS} WHERE NOT mismatch GROUP BY 1")
def s12(t):
    _, rows = delimited.parse(_texts(t))
    return delimited.strict_rows(rows).groupBy("source_key").agg(F.count("*").alias("rows"))


def _listed(t: Tables):
    """A GeoJSON feature per cell, in several property spellings."""
    key = F.col("region_id")
    properties = F.when(F.col("parts") == 2, F.to_json(F.struct(key.alias("shapeID"), F.col("display_name").alias("shapeName"), F.col("province_name").alias("province")))).otherwise(
        F.to_json(F.struct(key.alias("region_id"), F.lit("").alias("geometry_source_id"), F.col("region_type"), F.col("display_name").alias("name"), F.col("province_name")))
    )
    nested = F.transform("polygons", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    coordinates = F.when(F.size("polygons") == 1, F.to_json(F.get(nested, F.lit(0)))).otherwise(F.to_json(nested))
    kind = F.when(F.size("polygons") == 1, "Polygon").otherwise("MultiPolygon")
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}")
    )
    return shaped(t).select("region_id", "parts", feature.alias("feature"))


def _collections(t: Tables):
    """One GeoJSON text per batch of cells."""
    batch = F.floor(F.substring("region_id", 2, 20).cast("bigint") / 200).cast("string")
    listed = _listed(t).select(batch.alias("source_key"), "feature")
    texts = listed.groupBy("source_key").agg(F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("f"))
    return texts.select("source_key", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("text"))


def _features(t: Tables):
    parsed = features.with_properties(features.parse(_collections(t)), features.PROPERTIES)
    return registry.normalize_features(parsed)


def _workbook_bytes(names, values, blocked) -> list[bytes]:
    """A workbook per row: two sheets, the first one empty, cells of every kind."""

    def book(labels, amounts, extra):
        lines = ['<row r="1"><c r="A1" t="inlineStr"><is><t>Name</t></is></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Day</t></is></c></row>']
        for i, (label, amount) in enumerate(zip(labels, amounts, strict=True), start=3):
            flag = f'<c r="D{i}" t="b"><v>1</v></c>' if i % 2 else ""
            lines.append(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{label}</t></is></c><c r="B{i}"><v>{amount}</v></c><c r="C{i}" s="1"><v>{45000 + i}</v></c>{flag}</row>')
        parts = {
            "[Content_Types].xml": "<Types/>",
            "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Empty" r:id="r1"/><sheet name="Data" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
            "xl/sharedStrings.xml": "<sst><si><t>Am</t><t>ount</t></si></sst>",
            "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": "<worksheet><sheetData/></worksheet>",
            "xl/worksheets/sheet2.xml": f"<worksheet><sheetData>{''.join(lines)}</sheetData></worksheet>",
        }
        if extra:
            parts["xl/vbaProject.bin"] = "x"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, body in parts.items():
                archive.writestr(name, body)
        return buffer.getvalue()

    return [book(*row) for row in zip(names, values, blocked, strict=True)]


def _workbook_column(names: pa.Array, values: pa.Array, blocked: pa.Array) -> pa.Array:
    # one row at a time as Python objects
    return pa.array(_workbook_bytes(*((v.as_py() for v in column) for column in (names, values, blocked))), pa.binary())


def _workbooks(t: Tables):
    """One workbook file per order day."""
    days = t.order_lines.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "price"))).alias("l"))
    make = F.arrow_udf(_workbook_column, "binary")
    labels = F.transform("l", lambda x: F.concat(F.lit("Order "), x["o_orderkey"]))
    amounts = F.transform("l", lambda x: x["price"])
    files = days.select(F.concat(F.lit("/in/"), "day", F.lit(".xlsx")).alias("path"), make(labels, amounts, F.col("day").endswith("3")).alias("content"))
    return files.withColumn("length", F.length("content").cast("bigint"))


@query(
    "s4_workbook_scan",
    """SELECT concat('/in/', day, '.xlsx') AS source_key, CAST(n + 1 AS INTEGER) AS row_number, concat('Order ', CAST(o_orderkey AS VARCHAR)) AS name, CAST(price AS DOUBLE) AS amount, CAST(DATE '1899-12-30' + CAST(45000 + n + 2 AS INTEGER) AS VARCHAR) AS day, n % 2 = 1 AS mismatch
       FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY o_orderkey) AS n FROM {order_lines})""",
)
def s4(t):
    rows = workbook.rows_of(workbook.cells(_workbooks(t)))
    cell = lambda name: F.element_at("cells", F.lit(name))
    return rows.select("source_key", "row_number", cell("Name").alias("name"), cell("Amount").cast("double").alias("amount"), cell("Day").alias("day"), "mismatch")


@query(
    "s5_workbook_triage",
    "SELECT DISTINCT concat('/in/', day, '.xlsx') AS path, CAST(CASE WHEN ends_with(day, '3') THEN 8 ELSE 7 END AS BIGINT) AS entries, CASE WHEN ends_with(day, '3') THEN 'blocked-part' ELSE 'ok' END AS verdict FROM {order_lines}",
)
def s5(t):
    return workbook.triage(workbook.entries(_workbooks(t))).select("path", "entries", "verdict")


@query("s8_feature_collection_scan", "SELECT CASE parts WHEN 2 THEN concat('gb-', c.region_id) ELSE c.region_id END AS region_id, CAST(count(*) AS INTEGER) AS vertices, round(sum(v.x), 4) AS sum_x FROM {cells} c JOIN {vertices} v ON v.region_id = c.region_id GROUP BY 1")
def s8(t):
    points = F.flatten(F.flatten("polygons"))
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"])
    return _features(t).select("region_id", geometry.vertex_count().alias("vertices"), F.round(total, 4).alias("sum_x"))


def _pieces(t: Tables):
    """Two collections, of cells with one part and with two, as pieces that a closing brace ends.

    Blocks hold the pieces of fifty cells; the last ends behind the array, with a member that has braces too.
    """
    listed = _listed(t).select(F.col("parts").cast("string").alias("source_key"), F.substring("region_id", 2, 20).cast("bigint").alias("key"), "feature")
    first = listed.groupBy("source_key").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    opening = F.lit('{"name":"\\"features\\":[ }","crs":{"features":[1,{}]},"type" : "FeatureCollection","features": [')
    head = F.when(F.col("key") == F.col("first"), opening).otherwise(F.lit(","))
    tail = F.when(F.col("key") == F.col("last"), '],"more":[{"id":"none"},{}]}').otherwise("")
    # parts is 1 or 2: two rows
    whole = listed.join(F.broadcast(first), "source_key").withColumn("text", F.concat(head, "feature", tail))
    cut = whole.select("source_key", "key", F.posexplode(F.split(F.regexp_replace("text", "}$", ""), "}")).alias("n", "value"))
    return cut.select(
        "source_key", F.floor(F.col("key") / 50).alias("block"), (F.col("key") * 100 + F.col("n")).alias("line"), "value", F.lit(True).alias("braced")
    )


def _large_features(t: Tables):
    sources, parsed = pieces.parse_pieces(_pieces(t))
    return sources, registry.normalize_features(features.with_properties(parsed, features.PROPERTIES))


@query("s8_large_collection", "SELECT CASE parts WHEN 2 THEN concat('gb-', c.region_id) ELSE c.region_id END AS region_id, CAST(count(*) AS INTEGER) AS vertices, round(sum(v.x), 4) AS sum_x FROM {cells} c JOIN {vertices} v ON v.region_id = c.region_id GROUP BY 1")
def s8_large(t):
    _, parsed = _large_features(t)
    total = F.aggregate(F.flatten(F.flatten("polygons")), F.lit(0.0), lambda s, p: s + p["x"])
    return parsed.select("region_id", geometry.vertex_count().alias("vertices"), F.round(total, 4).alias("sum_x"))


@query(
    "s8_collection_check",
    "SELECT CAST(parts AS VARCHAR) AS source_key, 'ok' AS status, count(*) AS features, count(*) AS unique_ids, 'accepted' AS verdict FROM {cells} GROUP BY 1",
)
def s8_check(t):
    return pieces.check(*_large_features(t))


@query(
    "s9_feature_normalisation",
    """SELECT CASE parts WHEN 2 THEN concat('gb-', region_id) ELSE region_id END AS region_id, CASE parts WHEN 2 THEN region_id ELSE '' END AS geometry_source_id, display_name AS region_name, province_name,
       CASE parts WHEN 2 THEN '' ELSE region_type END AS region_type, CASE WHEN parts = 2 OR region_type = '' THEN display_name ELSE concat(region_type, ' ', display_name) END AS display_name FROM {cells}""",
)
def s9(t):
    return _features(t).select("region_id", "geometry_source_id", "region_name", "province_name", "region_type", "display_name")


@query("a7_property_inventory", "SELECT DISTINCT unnest(['shapeID', 'shapeName', 'province', 'region_id', 'geometry_source_id', 'region_type', 'name', 'province_name']) AS property FROM {orders}")
def a7(t):
    return features.property_names(features.parse(_collections(t)))


def _stored_cells(t: Tables):
    code = F.concat(F.lit("P"), F.substring("province_name", 1, 1)).alias("province_code")
    return shaped(t).select("region_id", code, "province_name", "polygons")


# The store is written; then one province is replaced and one added, past the index.
@query(
    "k5_verified_store",
    """SELECT concat('P', substr(province_name, 1, 1)) AS province_code, count(*) FILTER (substr(province_name, 1, 1) <> '3' OR x % 2 = 0) AS features, CASE substr(province_name, 1, 1) WHEN '3' THEN 'changed' ELSE 'ok' END AS status FROM {cells} GROUP BY ALL
    UNION ALL SELECT 'P9', count(*), 'unlisted' FROM {cells} WHERE substr(province_name, 1, 1) = '2'""",
)
def k5_store(t):
    folder = f"{shared_folder(t.spark)}/verified-{zlib.crc32(t.sf_dir.encode())}"
    cells = _stored_cells(t).drop("province_name")
    geometry.write_partitioned(cells, folder)
    half = cells.filter("province_code = 'P3' AND polygons[0][0][0].x % 2 = 0")
    extra = cells.filter("province_code = 'P2'").withColumn("province_code", F.lit("P9"))
    # dealt by region: a task sorts what it writes by province
    half.unionByName(extra).repartition("region_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("province_code").parquet(folder)
    return geometry.verify_partitions(t.spark, folder)


@query("s10_province_scan", "SELECT region_id FROM {cells} WHERE province_name = '5-LOW'")
def s10(t):
    cells = _stored_cells(t)
    folder = f"{shared_folder(t.spark)}/provinces-{zlib.crc32(t.sf_dir.encode())}"
    geometry.write_partitioned(cells.drop("province_name"), folder)
    provinces = cells.select("province_code", "province_name").distinct()
    return geometry.read_province(t.spark, folder, "5-LOW", provinces).select("region_id")


@query("s11_checksum_scan", "SELECT doc_id AS path, CASE WHEN source = 'src0' THEN 'changed' WHEN source = 'src1' THEN 'unlisted' ELSE 'ok' END AS status FROM {documents}")
def s11(t):
    files = t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    listed = t.documents.filter("source <> 'src1'").select(
        F.col("doc_id").alias("path"), F.when(F.col("source") == "src0", "0").otherwise(F.sha2("text", 256)).alias("sha256")
    )
    return lineage.verify(files, listed)


# Header rows: one per customer, spelled in many ways.
inputs.DERIVED["header_cells"] = """
SELECT c_custkey AS source_id, 1 AS position, CASE c_custkey % 4 WHEN 0 THEN 'Wilayah' WHEN 1 THEN 'Region_Name' WHEN 2 THEN 'Kode-BPS' ELSE ' nama  wilayah' END AS header FROM {customer}
UNION ALL SELECT c_custkey, 2, CASE c_custkey % 3 WHEN 0 THEN 'Provinsi' WHEN 1 THEN 'Nilai Penjualan' ELSE '' END FROM {customer}
UNION ALL SELECT c_custkey, 3, CASE c_custkey % 5 WHEN 0 THEN 'Provínsi' WHEN 1 THEN 'Total' WHEN 2 THEN 'wilayah' WHEN 3 THEN 'Kategori produk' ELSE 'nilai penjualan' END FROM {customer}
UNION ALL SELECT c_custkey, 4, CASE WHEN c_acctbal > 5000 THEN 'Tahun' WHEN c_acctbal > 0 THEN 'Total' ELSE 'xyz' END FROM {customer}"""
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({c})), '[_-]+', ' ', 'g'), '[^a-z0-9/% ]+', ' ', 'g'), ' +', ' ', 'g'))"
_BASE = "CASE WHEN trim(header) = '' THEN concat('Column ', CAST(position AS VARCHAR)) ELSE trim(header) END"
inputs.DERIVED["named_headers"] = f"""SELECT source_id, position, header, normalized, CASE WHEN n = 1 THEN base ELSE concat(base, '__', CAST(n AS VARCHAR)) END AS name FROM
    (SELECT *, row_number() OVER (PARTITION BY source_id, normalized ORDER BY position) AS n FROM (SELECT *, {_NORM.format(c='base')} AS normalized FROM (SELECT *, {_BASE} AS base FROM {{header_cells}})))"""


@query("h1_normalize_header", f"SELECT source_id, position, {_NORM.format(c='header')} AS v FROM {{header_cells}}")
def h1(t):
    from areal.functions import text

    return t.header_cells.select("source_id", "position", text.normalize_header("header").alias("v"))


@query("h2_unique_headers", "SELECT source_id, position, name FROM {named_headers}")
def h2(t):
    return headers.unique(t.header_cells).select("source_id", "position", "name")


@query("h3_duplicate_headers", f"SELECT source_id, v AS normalized, count(*) AS columns FROM (SELECT source_id, {_NORM.format(c='header')} AS v FROM {{header_cells}}) WHERE v <> '' GROUP BY ALL HAVING count(*) > 1")
def h3(t):
    return headers.duplicates(t.header_cells)


_ALIAS_ROWS = ", ".join(f"('{role}', '{' '.join(a.replace('_', ' ').split())}')" for role, names in headers.ROLE_ALIASES.items() for a in names)
inputs.DERIVED["roles"] = f"""SELECT source_id, role, arg_min(name, tier * 1000 + position) AS name, CASE min(tier) WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM
    (SELECT source_id, position, name, role, min(CASE WHEN h = alias THEN 0 WHEN contains(h, alias) OR contains(alias, h) THEN 1 END) AS tier
     FROM (SELECT *, {_NORM.format(c='name')} AS h FROM {{named_headers}}), (VALUES {_ALIAS_ROWS}) AS a(role, alias) GROUP BY ALL) WHERE tier IS NOT NULL GROUP BY source_id, role"""


@query("h4_infer_roles", "SELECT * FROM {roles}")
def h4(t):
    return headers.infer_roles(headers.unique(t.header_cells))


# More aliases than any fixed list has: one per order, and a few that the headers hold.
inputs.DERIVED["many_aliases"] = """
SELECT 'category' AS role, concat('produk ', CAST(o_orderkey AS STRING)) AS alias FROM {orders}
UNION ALL SELECT 'period', concat('tahun ', CAST(o_orderkey AS STRING)) FROM {orders} UNION ALL SELECT 'regionName', 'wilayah'"""


@query(
    "h4_infer_roles_many",
    f"""SELECT source_id, role, arg_min(name, tier * 1000 + position) AS name, CASE min(tier) WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM
    (SELECT n.source_id, n.position, n.name, a.role, a.tier FROM (SELECT *, {_NORM.format(c='name')} AS h FROM {{named_headers}}) n
     JOIN (SELECT h, role, min(CASE WHEN h = alias THEN 0 ELSE 1 END) AS tier FROM (SELECT DISTINCT {_NORM.format(c='name')} AS h FROM {{named_headers}}) JOIN {{many_aliases}}
           ON contains(h, alias) OR contains(alias, h) GROUP BY ALL) a ON a.h = n.h) GROUP BY source_id, role""",
)
def h4_many(t):
    return headers.infer_roles(headers.unique(t.header_cells), t.many_aliases)


@query("h4_ignored_columns", "SELECT source_id, name FROM {named_headers} n WHERE NOT EXISTS (SELECT 1 FROM {roles} r WHERE r.source_id = n.source_id AND r.name = n.name)")
def h4_ignored(t):
    named = headers.unique(t.header_cells)
    return headers.ignored(named, headers.infer_roles(named))


@query(
    "h5_role_projection",
    """SELECT h.source_id, coalesce(max(CASE WHEN r.role = 'regionName' THEN trim(cell) END), '') AS region_name, coalesce(max(CASE WHEN r.role = 'province' THEN trim(cell) END), '') AS province,
       coalesce(max(CASE WHEN r.role = 'numericValue' THEN trim(cell) END), '') AS numeric_value, coalesce(max(CASE WHEN r.role = 'period' THEN trim(cell) END), '') AS period
       FROM (SELECT source_id, name, concat(' cell ', CAST(position AS VARCHAR), ' ') AS cell FROM {named_headers}) h LEFT JOIN {roles} r ON r.source_id = h.source_id AND r.name = h.name GROUP BY h.source_id""",
)
def h5(t):
    named = headers.unique(t.header_cells)
    cell = F.concat(F.lit(" cell "), "position", F.lit(" "))
    rows = named.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("name", cell.alias("cell")))).alias("cells"))
    joined = rows.join(headers.role_map(headers.infer_roles(named)), "source_id", "left").withColumn("roles", F.coalesce("roles", F.create_map().cast("map<string,string>")))
    return headers.project_roles(joined).select("source_id", "region_name", "province", "numeric_value", "period")


@query(
    "h6_mapping_override",
    """SELECT source_id, role, CASE WHEN c.k IS NULL THEN r.name ELSE c.name END AS name FROM {roles} r FULL OUTER JOIN (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'source' ELSE 'period' END AS role, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'Column 2' END AS name FROM {customer}) c
       ON c.k = r.source_id AND c.role = r.role WHERE (c.k IS NULL OR c.name IS NOT NULL) AND r.source_id IS NOT NULL
       UNION ALL SELECT k, role, name FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN 'source' ELSE 'period' END AS role, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'Column 2' END AS name FROM {customer}) c WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {roles} r WHERE r.source_id = c.k AND r.role = c.role)""".replace("SELECT source_id, role, CASE WHEN c.k", "SELECT r.source_id, r.role, CASE WHEN c.k"),
)
def h6(t):
    chosen = t.customer.select(
        F.col("c_custkey").alias("source_id"),
        F.when(F.col("c_acctbal") > 5000, "source").otherwise("period").alias("role"),
        F.when(F.col("c_acctbal") >= 0, "Column 2").alias("name"),
    )
    return headers.override(headers.infer_roles(headers.unique(t.header_cells)), chosen).select("source_id", "role", "name")


@query(
    "k4_csv_lines",
    """SELECT concat_ws(',', CAST(doc_id AS VARCHAR), CASE WHEN regexp_matches(text, '[",\n\r]') THEN concat('"', replace(text, '"', '""'), '"') ELSE text END, lang) AS line FROM {documents}""",
)
def k4(t):
    return sinks.csv_lines(t.documents.select("doc_id", "text", "lang"))


inputs.DERIVED["project_rows"] = """
SELECT CAST(o_custkey AS STRING) AS project_id, concat('gb-B', CAST(o_orderkey % 40 AS STRING)) AS region_id, max(CASE WHEN o_orderstatus = 'F' THEN '#4472C4' ELSE '#ED7D31' END) AS color, max(o_orderpriority) AS category, CAST(count(*) AS STRING) AS value
FROM {orders} GROUP BY o_custkey, o_orderkey % 40"""


@query(
    "k3_project_documents",
    """SELECT CAST(c_custkey AS VARCHAR) AS project_id, coalesce(string_agg(concat('"', region_id, '":{"color":"', color, '","category":"', category, '","value":"', value, '"}'), ',' ORDER BY region_id), '') AS highlights, substr(concat(c_name, ' ', c_mktsegment), 1, 90) AS title,
       CASE WHEN c_custkey % 3 > 0 THEN concat('[{"label":"', c_mktsegment, '"}]') END AS legend,
       CASE WHEN c_custkey % 3 = 1 THEN concat('{"r":"', c_mktsegment, '"}') ELSE '{}' END AS unresolved, '[]' AS import_rows
       FROM {customer} LEFT JOIN {project_rows} ON project_id = CAST(c_custkey AS VARCHAR) GROUP BY c_custkey, c_name, c_mktsegment""",
)
def k3(t):
    projects = t.customer.select(
        F.col("c_custkey").cast("string").alias("project_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("title"), F.lit("match").alias("workflow_stage"), F.lit("basic").alias("ui_mode"),
        F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit('[{"label":"'), "c_mktsegment", F.lit('"}]'))).alias("legend"),
        F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"r":"'), "c_mktsegment", F.lit('"}'))).otherwise("no json").alias("unresolved_highlights"),
    )
    rows = t.project_rows.withColumns({"canonical_region_id": F.concat(F.lit("idn-adm2-gb-"), F.lower("region_id")), "migration_status": F.lit("mapped")})
    provider = {"boundaryProviderId": "areal-local", "boundaryVersion": registry.BOUNDARY_VERSION, "registryVersion": registry.REGISTRY_VERSION}
    documents = sinks.project_documents(projects, rows, provider, "Region map")
    parts = F.from_json("document", "struct<title:string,highlights:string,legend:string,unresolvedHighlights:string,importRows:string>")
    inner = F.regexp_replace(parts["highlights"], r"\A\{|\}\z", "")
    return documents.select(
        "project_id", inner.alias("highlights"), parts["title"].alias("title"), parts["legend"].alias("legend"),
        parts["unresolvedHighlights"].alias("unresolved"), parts["importRows"].alias("import_rows"),
    )


@query("k6_label_anchor_table", "SELECT * FROM {anchored}")
def k6(t):
    return geometry.anchors(shaped(t))


@query("k8_run_report", """SELECT 'orders' AS name, concat('{"name":"orders","status":"', CASE WHEN bad > 0 THEN 'failed' ELSE 'passed' END, '","rows":', n, ',"errors":', bad, '}') AS json FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 400000) AS bad FROM {orders})""")
def k8(t):
    return lineage.report(t.orders, "orders", t.orders.filter("o_totalprice > 400000")).select("name", "json")
