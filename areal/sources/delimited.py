"""Delimited text: delimiter detection, record splitting, typed-free rows.

parse() works on a column of whole texts (one source per row) and on files up to
a size limit; read_large() works on files of any size, split over tasks.
Quoting: a quote opens a field only at its start, "" stands for a quote, text
after the closing quote is kept, an unclosed quote rejects the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areal.functions import text

DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t"}
DETECTION_RECORDS = 20  # fixed value

# Budgets of the reference; parse() applies none unless told to.
REFERENCE_BUDGET = {"bytes": 1048576, "rows": 5000, "columns": 50, "cells": 100000, "cell_length": 2000}
UPLOAD_BYTES = 2_500_000  # fixed value

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'


def normalize_newlines(c) -> Column:
    return F.regexp_replace(F.regexp_replace(text.text_of(c), "^﻿", ""), "\r\n?", "\n")


def _with(value: Column, body) -> Column:
    """body(value) with the value computed once per row instead of once per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _score(counts: Column, name: str) -> Column:
    """Score of one delimiter from the column counts of its usable records."""
    modes = F.transform(
        counts,
        lambda n, i: F.struct(F.size(F.filter(counts, lambda m: m == n)).alias("times"), (-i).alias("place"), n.alias("columns")),
    )

    def scored(mode: Column) -> Column:
        used = F.size(counts)
        columns = F.coalesce(mode["columns"], F.lit(1))
        consistency = F.coalesce(mode["times"] / F.nullif(used, F.lit(0)), F.lit(0.0))
        return F.struct(
            (columns * consistency * F.greatest(used, F.lit(1))).alias("score"),
            F.lit(-list(DELIMITERS).index(name)).alias("place"),
            F.lit(name).alias("delimiter"),
            columns.alias("columns"),
            consistency.alias("consistency"),
        )

    return _with(F.array_max(modes), scored)


def detect_delimiter(c) -> Column:
    """struct<delimiter, confidence, columns, consistency, score> of the best candidate."""
    bare = F.regexp_replace(normalize_newlines(c), rf'{_QUOTED}(?:"|\z)', "")

    def best_of(lines: Column) -> Column:
        def columns(mark: str) -> Column:
            return F.transform(lines, lambda line: F.char_length(line) - F.char_length(F.replace(line, F.lit(mark), F.lit(""))) + 1)

        return best_delimiter({name: columns(mark) for name, mark in DELIMITERS.items()})

    return _with(F.slice(F.split(bare, "\n"), 1, DETECTION_RECORDS), best_of)


def best_delimiter(columns: dict[str, Column]) -> Column:
    """The best candidate, from the column counts that each delimiter gives the first records."""

    def scored(name: str) -> Column:
        return _with(F.filter(columns[name], lambda n: n > 1), lambda n: _score(n, name))

    def described(best: Column) -> Column:
        confidence = (
            F.when((best["score"] >= 6) & (best["consistency"] >= 0.8), "high").when(best["score"] >= 3, "medium").otherwise("low")
        )
        return F.struct(
            best["delimiter"].alias("delimiter"),
            confidence.alias("confidence"),
            best["columns"].alias("columns"),
            best["consistency"].alias("consistency"),
            best["score"].alias("score"),
        )

    return _with(F.array_max(F.array(*[scored(name) for name in columns])), described)


def _field(mark: str) -> str:
    return rf'(?:{_QUOTED}"[^{mark}\n]*+|[^"{mark}\n][^{mark}\n]*+|)'


def _by_mark(delimiter: Column, build) -> Column:
    """One expression per delimiter, since patterns must be literals."""
    chosen = None
    for name, mark in DELIMITERS.items():
        chosen = F.when(delimiter == name, build(mark)) if chosen is None else chosen.when(delimiter == name, build(mark))
    return chosen


def records_of(normalized: Column, delimiter: Column) -> Column:
    """Raw records, each with its line end."""

    def build(mark: str) -> Column:
        field = _field(mark)
        return F.regexp_extract_all(normalized, F.lit(rf"({field}(?:{mark}{field})*+(?:\n|\z))"), F.lit(1))

    return _by_mark(delimiter, build)


def cells_of(record: Column, delimiter: Column) -> Column:
    """Cells of one raw record, quotes resolved."""

    def build(mark: str) -> Column:
        raw = F.regexp_extract_all(F.concat(F.lit(mark), F.regexp_replace(record, r"\n\z", "")), F.lit(rf"{mark}({_field(mark)})"), F.lit(1))
        return raw

    parts = rf'(?s)\A"([^"]*+(?:""[^"]*+)*+)"(.*)\z'
    return F.transform(
        _by_mark(delimiter, build),
        lambda cell: F.when(
            cell.startswith('"'),
            F.concat(F.replace(F.regexp_extract(cell, parts, 1), F.lit('""'), F.lit('"')), F.regexp_extract(cell, parts, 2)),
        ).otherwise(cell),
    )


def _not_blank(cells: Column) -> Column:
    return F.exists(cells, lambda cell: text.trim(cell) != "")


def unique_names(headers: Column) -> Column:
    """Names of a header array: empty ones numbered, repeats suffixed with their count."""
    def numbered(named: Column, forms: Column) -> Column:
        def one(name: Column, i: Column) -> Column:
            form = F.get(forms, i)
            times = F.size(F.filter(F.slice(forms, F.lit(1), i + 1), lambda f: f == form))
            return F.when(times > 1, F.concat(name, F.lit("__"), times.cast("string"))).otherwise(name)

        return F.transform(named, one)

    named = F.transform(
        headers, lambda h, i: F.coalesce(F.nullif(text.trim(h), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string")))
    )
    return _with(named, lambda n: _with(F.transform(n, text.normalize_header), lambda forms: numbered(n, forms)))


def parse(sources: DataFrame, delimiter: str = "auto", budget: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse whole texts (source_key, source_type, text).

    Returns (sources, rows): sources has one row per text with source_id, status
    ('ok' or the reason of rejection), delimiter, confidence and counts; rows has
    row_id, source_id, row_number, headers, cells (map) and mismatch (cell count
    differs from the header row). Blank records are dropped before numbering.
    """
    detected = detect_delimiter("text") if delimiter == "auto" else F.struct(F.lit(delimiter).alias("delimiter"), F.lit("manual").alias("confidence"))
    read = sources.withColumns({"_text": normalize_newlines("text"), "_detected": detected})
    read = read.withColumn("_delimiter", F.col("_detected.delimiter"))
    read = read.withColumn("_raw", records_of(F.col("_text"), F.col("_delimiter")))
    covered = F.aggregate("_raw", F.lit(0), lambda n, r: n + F.char_length(r)) == F.char_length("_text")
    read = read.withColumn("_records", F.filter(F.transform("_raw", lambda r: cells_of(r, F.col("_delimiter"))), _not_blank)).withColumn(
        "_closed", covered
    )
    read = read.withColumns(
        {
            "headers": unique_names(F.coalesce(F.get("_records", F.lit(0)), F.array().cast("array<string>"))),
            "_lengths": F.array_max(F.transform(F.flatten("_records"), lambda c: F.char_length(c))),
        }
    )
    counted = read.withColumns(
        {
            "n_columns": F.size("headers"),
            "n_rows": F.greatest(F.size("_records") - 1, F.lit(0)),
        }
    ).withColumn("n_cells", F.col("n_rows") * F.col("n_columns"))
    limits = budget or {}
    status = F.when(text.trim("text") == "", "empty")
    checks = {
        "bytes": F.octet_length("text"),
        "columns": F.col("n_columns"),
        "rows": F.col("n_rows"),
        "cells": F.col("n_cells"),
        "cell_length": F.col("_lengths"),
    }
    if "bytes" in limits:
        status = status.when(checks["bytes"] > limits["bytes"], "too-many-bytes")
    status = status.when(~F.col("_closed"), "unclosed-quote")
    for name in ("columns", "rows", "cells", "cell_length"):
        if name in limits:
            status = status.when(checks[name] > limits[name], f"too-many-{name}" if name != "cell_length" else "cell-too-long")
    status = status.otherwise("ok")
    # Wide ids over the whole text: two sources share one only if they are equal.
    identity = F.concat_ws("|", text.text_of("source_type"), "_delimiter", "_text")
    described = counted.withColumns({"status": status, "source_id": F.concat(F.lit("src_"), F.sha2(identity, 256))})
    summary = described.select(
        "source_key", "source_type", "source_id", "status", F.col("_delimiter").alias("delimiter"), F.col("_detected.confidence").alias("confidence"),
        F.when(F.col("text").startswith("﻿"), "utf-8-bom").otherwise("utf-8").alias("encoding"), "headers", "n_rows", "n_columns", "n_cells",
    )
    rows = (
        described.filter("status = 'ok'")
        .select("source_key", "source_id", "headers", F.posexplode(F.slice("_records", F.lit(2), F.greatest(F.size("_records"), F.lit(1)))).alias("_i", "_items"))
        .withColumn("row_number", F.col("_i") + 2)
    )
    return summary, _finish_rows(rows)


def cells_by_header(headers: str, items: str) -> Column:
    """Map from header to cell; of equal headers the last one counts, missing cells are empty."""
    entries = F.transform(headers, lambda h, i: F.struct(h.alias("key"), F.coalesce(F.get(items, i), F.lit("")).alias("value")))
    last = F.filter(
        entries, lambda e, i: ~F.exists(F.slice(F.col(headers), i + 2, F.size(headers)), lambda later: later == e["key"])
    )
    distinct = F.size(F.array_distinct(headers)) == F.size(headers)
    return F.map_from_entries(F.when(distinct, entries).otherwise(last))


def _finish_rows(rows: DataFrame, row_id: Column | None = None) -> DataFrame:
    """Cells as a map by header, row id and the mismatch flag.

    row_id is wide; short_id is the 32-bit hash kept for compatibility, which
    rows can share.
    """
    identity = F.concat_ws("|", "source_id", F.col("row_number").cast("string"), F.array_join("_items", "\x1f"))
    return rows.select(
        "source_key",
        "source_id",
        (F.concat(F.lit("row_"), F.sha2(identity, 256)) if row_id is None else row_id).alias("row_id"),
        F.concat(F.lit("row_"), text.fnv1a36(identity)).alias("short_id"),
        "row_number",
        "headers",
        cells_by_header("headers", "_items").alias("cells"),
        (F.size("_items") != F.size("headers")).alias("mismatch"),
    )


def route(files: DataFrame) -> DataFrame:
    """Which reader a file (path, length) goes to, by extension and size."""
    name = F.lower("path")
    return files.withColumn(
        "route",
        F.when(name.endswith(".xlsx"), "workbook")
        .when(name.rlike(r"\.(csv|tsv|txt)$") & (F.col("length") <= UPLOAD_BYTES), "delimited")
        .when(name.rlike(r"\.(xlsm|xlsb|xls|ods)$"), "unsupported")
        .when(name.rlike(r"\.(csv|tsv|txt)$"), "too-large")
        .otherwise("rejected"),
    )


def budget_report(rows: DataFrame, limits: dict = REFERENCE_BUDGET) -> DataFrame:
    """Per source: counts against limits, for rows that carry a cells map; sheets where rows carry a sheet."""
    longest = F.array_max(F.transform(F.map_values("cells"), lambda c: F.char_length(c)))
    size = F.aggregate(F.map_values("cells"), F.lit(0).cast("bigint"), lambda n, c: n + F.octet_length(c))
    sheets = [F.count_distinct("sheet").alias("sheets")] if "sheet" in rows.columns else []
    counted = rows.groupBy("source_id").agg(
        *sheets,
        F.count("*").alias("rows"),
        F.max(F.size("cells")).alias("columns"),
        F.sum(size).alias("bytes"),
        F.max(longest).alias("cell_length"),
    ).withColumn("cells", F.col("rows") * F.col("columns"))
    over = F.array_compact(F.array(*[F.when(F.col(name) > limit, name) for name, limit in sorted(limits.items())]))
    return counted.withColumns({"exceeded": over, "accepted": F.size(over) == 0})


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Strict scan: records whose cell count differs from the header are dropped."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("escape", '"')
    return reader.option("multiLine", True).csv(path)


def strict_rows(rows: DataFrame) -> DataFrame:
    """The strict rule on rows of parse(): keep only those that fit their header."""
    return rows.filter(~F.col("mismatch"))


def read_files(spark: SparkSession, path: str, delimiter: str = "auto", budget: dict | None = None, max_bytes: int | None = None):
    """Parse every file under a path, one file per row.

    With max_bytes, larger files are not opened: their source row has the status
    'too-many-bytes' and no rows follow; read_large takes files of any size.
    """
    listed = spark.read.format("binaryFile").load(path)
    files = listed if max_bytes is None else listed.filter(F.col("length") <= max_bytes)
    kind = F.when(F.lower("path").endswith(".tsv"), "tsv").otherwise("csv")
    texts = files.select(F.col("path").alias("source_key"), kind.alias("source_type"), F.decode("content", "UTF-8").alias("text"))
    summary, rows = parse(texts, delimiter, budget)
    if max_bytes is not None:
        refused = listed.filter(F.col("length") > max_bytes).select(
            F.col("path").alias("source_key"), kind.alias("source_type"), F.lit("too-many-bytes").alias("status")
        )
        summary = summary.unionByName(refused, allowMissingColumns=True)
    return summary, rows


def read_large(spark: SparkSession, path: str, delimiter: str = "auto", budget: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse files of any size in parallel, with the same rules; see lines.parse_lines.

    A byte order mark counts only at the start of a file, where Spark's reader drops it.
    """
    from areal.sources.lines import parse_lines

    found = spark.read.text(path).withColumn("_meta", F.col("_metadata"))
    lines = found.select(
        F.col("_meta.file_path").alias("source_key"),
        F.col("_meta.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    return parse_lines(lines, delimiter, budget, byte_order_marks=False)
