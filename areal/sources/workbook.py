"""Workbooks: safety triage of the archive and sheets as cell rows.

Files are read with the binaryFile source, one file per task; only the archive
directory and the sheet parts are decoded in Python.
"""

from __future__ import annotations

import datetime
import io
import struct
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areal.sources.delimited import cells_by_header, unique_names

# Limits and forbidden parts.
BUDGET = {"compressed": 2097152, "uncompressed": 12582912, "entries": 256, "ratio": 80, "sheets": 20}
BLOCKED_PARTS = [
    r"(^|/)vbaproject\.bin$",
    r"^xl/macrosheets/",
    r"^xl/embeddings/",
    r"^xl/activex/",
    r"^xl/ctrlprops/",
    r"^xl/externallinks/",
    r"^encryptioninfo$",
    r"^encryptedpackage$",
]
REQUIRED_PARTS = ["[content_types].xml", "xl/workbook.xml"]

ENTRY_SCHEMA = "path string, length bigint, name string, compressed bigint, uncompressed bigint, method int, problem string"
CELL_SCHEMA = "path string, sheet_position int, sheet string, row int, column int, value string, problem string"
_WORD = pa.string()
ENTRY_TYPES = pa.schema([
    ("path", _WORD), ("length", pa.int64()), ("name", _WORD), ("compressed", pa.int64()), ("uncompressed", pa.int64()),
    ("method", pa.int32()), ("problem", _WORD),
])
CELL_TYPES = pa.schema([
    ("path", _WORD), ("sheet_position", pa.int32()), ("sheet", _WORD), ("row", pa.int32()), ("column", pa.int32()),
    ("value", _WORD), ("problem", _WORD),
])
#: Rows that a task gives back at once.
BATCH_ROWS = 10_000


def _entries(content: bytes):
    """Central directory of an archive as (name, compressed, uncompressed, method)."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return [(i.filename.replace("\\", "/"), i.compress_size, i.file_size, i.compress_type) for i in archive.infolist()]


def _files(batches, *columns: str):
    """Files of Arrow batches one by one; only one content at a time becomes a Python object."""
    for batch in batches:
        for values in zip(*[batch.column(c) for c in columns], strict=True):
            yield [v.as_py() for v in values]


def _in_batches(found, schema: pa.Schema):
    """Record batches of about BATCH_ROWS rows from lists of rows."""
    rows: list[tuple] = []

    def batch():
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for part in found:
        rows += part
        if len(rows) >= BATCH_ROWS:
            yield batch()
            rows.clear()
    yield batch()


def _list_entries(batches):
    def listed():
        for path, length, content in _files(batches, "path", "length", "content"):
            try:
                if content[:4] != b"PK\x03\x04":
                    raise zipfile.BadZipFile
                yield [(path, length, *entry, None) for entry in _entries(content)]
            except (zipfile.BadZipFile, struct.error, ValueError, NotImplementedError):
                yield [(path, length, None, None, None, None, "damaged")]

    yield from _in_batches(listed(), ENTRY_TYPES)


def entries(files: DataFrame) -> DataFrame:
    """Archive entries of files (path, length, content)."""
    return files.select("path", "length", "content").mapInArrow(_list_entries, ENTRY_SCHEMA)


def triage(entry_rows: DataFrame, budget: dict = BUDGET) -> DataFrame:
    """Verdict per workbook from its entries: 'ok' or the first reason of rejection."""
    name = F.lower("name")
    blocked = F.lit(False)
    for pattern in BLOCKED_PARTS:
        blocked = blocked | name.rlike(pattern)
    measured = entry_rows.groupBy("path").agg(
        F.max("length").alias("length"),
        F.count("name").alias("entries"),
        F.sum("uncompressed").alias("uncompressed"),
        F.max(F.when(F.col("compressed") > 0, F.col("uncompressed") / F.col("compressed"))).alias("ratio"),
        F.bool_or(~F.col("method").isin(0, 8)).alias("odd_method"),
        F.bool_or(blocked).alias("blocked"),
        *[F.coalesce(F.bool_or(name == part), F.lit(False)).alias(f"part{i}") for i, part in enumerate(REQUIRED_PARTS)],
        F.max("problem").alias("problem"),
    )
    verdict = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("length") > budget["compressed"], "too-large")
        .when((F.col("entries") == 0) | (F.col("entries") > budget["entries"]), "too-many-parts")
        .when(F.col("uncompressed") > budget["uncompressed"], "too-large-opened")
        .when(F.col("ratio") > budget["ratio"], "compression-ratio")
        .when(F.col("odd_method"), "compression-method")
        .when(~(F.col("part0") & F.col("part1")), "no-workbook")
        .when(F.col("blocked"), "blocked-part")
        .otherwise("ok")
    )
    return measured.select("path", "length", "entries", "uncompressed", verdict.alias("verdict"))


def inspect(spark: SparkSession, path: str, budget: dict = BUDGET) -> DataFrame:
    opened, refused = _by_size(spark, path, budget)
    return triage(entries(opened), budget).unionByName(refused, allowMissingColumns=True)


def _by_size(spark: SparkSession, path: str, budget: dict) -> tuple[DataFrame, DataFrame]:
    """Files within the limit of bytes, and verdicts of the others, which are not opened."""
    files = spark.read.format("binaryFile").load(path)
    refused = files.filter(F.col("length") > budget["compressed"]).select("path", "length", F.lit("too-large").alias("verdict"))
    return files.filter(F.col("length") <= budget["compressed"]), refused


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def _column(reference: str) -> int:
    number = 0
    for ch in reference:
        if not ch.isalpha():
            break
        number = number * 26 + ord(ch.upper()) - 64
    return number - 1


# Built-in number formats that show a date.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(archive, names) -> set[int]:
    if "xl/styles.xml" not in names:
        return set()
    root = ET.fromstring(archive.read("xl/styles.xml"))
    custom = set()
    for node in root.iter():
        if _tag(node) == "numFmt":
            code = "".join(p for i, p in enumerate(node.get("formatCode", "").split('"')) if i % 2 == 0).lower()
            if any(ch in code for ch in "ymdhs") and "general" not in code:
                custom.add(int(node.get("numFmtId")))
    formats = next((n for n in root.iter() if _tag(n) == "cellXfs"), [])
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | custom}


def _plain_number(value: str) -> str:
    number = float(value)
    return str(int(number)) if number.is_integer() and abs(number) < 1e21 else repr(number)


def _cell_text(cell, shared, dates) -> str:
    kind, value = cell.get("t", "n"), next((v.text or "" for v in cell if _tag(v) == "v"), "")
    if kind == "s":
        return shared[int(value)] if value else ""
    if kind == "inlineStr":
        return _texts(cell)
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if value == "" or kind in ("str", "e"):
        return value
    if int(cell.get("s", -1)) in dates:
        return (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(value))).date().isoformat()
    return _plain_number(value)


def _sheet_cells(content: bytes):
    """(position, sheet name, row, column, text) of all filled cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(si) for si in ET.fromstring(archive.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
        dates = _date_styles(archive, names)
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        sheets = [s for s in ET.fromstring(archive.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
        for position, sheet in enumerate(sheets):
            target = targets[next(v for k, v in sheet.attrib.items() if k.rsplit("}", 1)[-1] == "id")]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for _, row in ET.iterparse(io.BytesIO(archive.read(part))):
                if row.tag != "row" and not row.tag.endswith("}row"):
                    continue
                for place, cell in enumerate(row):
                    text = _cell_text(cell, shared, dates)
                    if text != "":
                        reference = cell.get("r")
                        yield position, sheet.get("name"), int(row.get("r", 0)) - 1, _column(reference) if reference else place, text
                row.clear()


def _read_cells(batches):
    def read_files():
        for path, content in _files(batches, "path", "content"):
            try:
                yield [(path, *cell, None) for cell in _sheet_cells(content)]
            except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError):
                yield [(path, None, None, None, None, None, "unreadable")]

    yield from _in_batches(read_files(), CELL_TYPES)


def cells(files: DataFrame) -> DataFrame:
    """Filled cells of workbooks (path, content)."""
    return files.select("path", "content").mapInArrow(_read_cells, CELL_SCHEMA)


def sheets(cell_rows: DataFrame) -> DataFrame:
    """(path, sheet, rows, columns) of the sheets that hold data."""
    return cell_rows.filter("sheet IS NOT NULL").groupBy("path", "sheet_position", "sheet").agg(
        F.max("row").alias("rows"), (F.max("column") + 1).alias("columns")
    )


def read(spark: SparkSession, path: str, sheet: str | None = None, budget: dict = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Rows (source_key, sheet, row_number, headers, cells) of accepted workbooks, and a verdict for every file.

    A file that passes the triage and cannot be read, or has more sheets than the
    budget, has the verdict 'unreadable' or 'too-many-sheets' and gives no rows.
    """
    files, refused = _by_size(spark, path, budget)
    verdicts = triage(entries(files), budget)
    accepted = files.join(verdicts.filter("verdict = 'ok'").select("path"), "path")
    found = cells(accepted)
    problems = found.groupBy("path").agg(
        F.when(F.max("problem").isNotNull(), "unreadable")
        .when(F.max("sheet_position") >= budget["sheets"], "too-many-sheets")
        .alias("_problem")
    ).filter("_problem IS NOT NULL")
    told = verdicts.join(problems, "path", "left").withColumn("verdict", F.coalesce("_problem", "verdict")).drop("_problem")
    rows = rows_of(found.join(problems.select("path"), "path", "left_anti"), sheet)
    return rows, told.unionByName(refused, allowMissingColumns=True)


def rows_of(cell_rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows of the named sheet, or of the first sheet with data where it is absent.

    The first row is the header; blank rows drop out before numbering. All windows
    run over one file, which is bounded by the size limit of the reader.
    """
    per_row = (
        cell_rows.filter("sheet IS NOT NULL")
        .groupBy("path", "sheet_position", "sheet", "row")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_cells"),
            F.max("column").alias("_last"),
            F.bool_or(F.trim("value") != "").alias("_filled"),
        )
    )
    file = Window.partitionBy("path")
    place = F.struct((F.col("sheet") != F.lit(sheet or "")).alias("other"), "sheet_position")
    chosen = per_row.withColumns({"_place": place, "_first": F.min(place).over(file)}).filter("_place = _first AND _filled")
    items = F.transform(
        F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.try_element_at(F.col("_cells"), i), F.lit(""))
    )
    numbered = chosen.withColumns({"_items": items, "row_number": F.row_number().over(file.orderBy("row"))})
    headed = numbered.withColumn("_header", F.max(F.when(F.col("row_number") == 1, F.col("_items"))).over(file))
    named = headed.filter("row_number > 1").withColumn("headers", unique_names(F.col("_header")))
    return named.select(
        F.col("path").alias("source_key"),
        "sheet",
        "row_number",
        "headers",
        cells_by_header("headers", "_items").alias("cells"),
        (F.size("_items") != F.size("headers")).alias("mismatch"),
    )
