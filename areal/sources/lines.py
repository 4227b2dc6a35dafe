"""Delimited texts as a table of lines: sources of any size, many tasks for each.

A source is cut into blocks of lines. Whether a line starts inside a quoted cell
depends on all lines before it, so each line is read as a map of the two states
(outside, inside) to a state; maps are composed within blocks, and those of the
blocks over a source. No task holds more than a block, or one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.functions import text
from areal.plans.sizing import checkpoint, lookup_join
from areal.sources import delimited
from areal.sources.delimited import DELIMITERS, DETECTION_RECORDS

#: Lines of a source that detection looks at first; all are looked at where these hold too few records.
HEAD_LINES = 1000
BLOCK = ["source_key", "_block"]


def _up_to_here() -> Window:
    return Window.partitionBy(*BLOCK).orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _blocks_before() -> Window:
    return Window.partitionBy("source_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _first_records(lines: DataFrame) -> DataFrame:
    """(source_key, _record, n_<delimiter>): columns of the first records, quoted parts left out.

    Every quote changes between inside and outside; a record ends with a line that
    ends outside. Blocks are composed by the parity of their quotes.
    """
    so_far = _up_to_here()
    quotes = F.size(F.split("_value", '"')) - 1
    after = F.sum("_quotes").over(so_far) % 2
    read = lines.withColumn("_quotes", quotes).withColumn("_odd", after)
    read = read.withColumns({
        "_even_ends": F.sum((F.col("_odd") == 0).cast("bigint")).over(so_far),
        "_odd_ends": F.sum(F.col("_odd")).over(so_far),
    })
    ends = read.groupBy(*BLOCK).agg(F.max_by(F.struct("_odd", "_even_ends", "_odd_ends"), "_line").alias("_end"))
    starts = ends.withColumn("_start", F.coalesce(F.sum("_end._odd").over(_blocks_before()), F.lit(0)) % 2)
    ended = F.when(F.col("_start") == 0, F.col("_end._even_ends")).otherwise(F.col("_end._odd_ends"))
    starts = starts.withColumn("_ended", ended)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_ended").over(_blocks_before()), F.lit(0)))
    placed = lookup_join(read, starts.filter(F.col("_before") < DETECTION_RECORDS).select(*BLOCK, "_start", "_before"), BLOCK, "inner")
    begins_odd = (F.col("_start") + F.col("_odd") + F.col("_quotes")) % 2
    own_end = ((F.col("_odd") + F.col("_start")) % 2 == 0).cast("bigint")
    ended_here = F.when(F.col("_start") == 0, F.col("_even_ends")).otherwise(F.col("_odd_ends")) - own_end
    placed = placed.withColumns({"_record": F.col("_before") + ended_here, "_inside": begins_odd})
    outside = F.array_join(F.filter(F.split("_value", '"'), lambda part, i: (i + F.col("_inside")) % 2 == 0), "")
    bare = placed.filter(F.col("_record") < DETECTION_RECORDS).withColumn("_bare", outside)
    marks = {n: F.char_length("_bare") - F.char_length(F.replace("_bare", F.lit(mark), F.lit(""))) for n, mark in DELIMITERS.items()}
    return bare.groupBy("source_key", "_record").agg(
        *[(F.sum(count) + 1).cast("int").alias(f"n_{name}") for name, count in marks.items()],
        F.max(((F.col("_odd") + F.col("_start")) % 2 == 0)).alias("_closed"),
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """(source_key, _block, _n, _first): lines of each block and its first line."""
    none = F.count_if(F.col("_line").isNull()) > 0
    return lines.groupBy(*BLOCK).agg(F.count("*").alias("_n"), F.when(~none, F.min("_line")).alias("_first"))


def detect(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(source_key, detected) as detect_delimiter finds it, for a table (source_key, _block, _line, _value).

    Only lines of the blocks that the first lines of a source lie in are ordered.
    """
    blocks = _blocks(lines) if blocks is None else blocks
    in_source = Window.partitionBy("source_key").orderBy("_block", "_line")
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(_blocks_before()), F.lit(0)))
    near = lookup_join(lines, before.filter(F.col("_before") <= HEAD_LINES).select(*BLOCK), BLOCK, "left_semi")
    heads = near.withColumn("_n", F.row_number().over(in_source)).filter(F.col("_n") <= HEAD_LINES + 1)
    heads = heads.select("source_key", F.lit(0).alias("_block"), F.col("_n").alias("_line"), "_value")
    size = heads.groupBy("source_key").agg(F.count("*").alias("_lines"))

    def best(records: DataFrame) -> DataFrame:
        # at most DETECTION_RECORDS rows of a source
        counts = records.groupBy("source_key").agg(
            F.array_sort(F.collect_list(F.struct("_record", *[f"n_{name}" for name in DELIMITERS]))).alias("_records"),
            F.sum(F.col("_closed").cast("int")).alias("_whole"),
        )
        columns = {name: F.col(f"_records.n_{name}") for name in DELIMITERS}
        return counts.select("source_key", delimited.best_delimiter(columns).alias("detected"), "_whole")

    first = checkpoint(best(_first_records(heads)).join(size, "source_key"))
    more = first.filter((F.col("_lines") > HEAD_LINES) & (F.col("_whole") < DETECTION_RECORDS)).select("source_key")
    if more.isEmpty():
        return first.select("source_key", "detected")
    wanted = lookup_join(blocks.select(*BLOCK), more, ["source_key"], "left_semi")
    rest = best(_first_records(lookup_join(lines, wanted, BLOCK, "left_semi")))
    return first.join(more, "source_key", "left_anti").select("source_key", "detected").unionByName(rest.drop("_whole"))


def _moves(delimiter: Column, inside: bool) -> Column:
    """State (0 outside, 1 inside a quote) after a line that starts in the given one."""

    def pattern(mark: str) -> Column:
        field = delimited._field(mark)
        closed, opened = rf"(?:{field}{mark})*+", rf"{delimited._QUOTED}\z"
        if inside:
            return F.col("_value").rlike(rf'\A[^"]*+(?:""[^"]*+)*+(?:\z|"[^{mark}]*+{mark}{closed}{opened})').cast("int")
        return F.col("_value").rlike(rf"\A{closed}{opened}").cast("int")

    return delimited._by_mark(delimiter, pattern)


def parse_lines(
    lines: DataFrame, delimiter: str = "auto", budget: dict | None = None, byte_order_marks: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Parse a table of lines (source_key, block, line, value) by the rules of parse().

    Lines have no line ends and are ordered by block, then line, within a source.
    byte_order_marks: a first line may still begin with one. Returns (sources, rows) as
    parse() does; as no task holds a whole source, source_id is a digest of its key,
    bytes count one for each line end, and the columns source_type and encoding are missing.
    A null value is an empty line; an empty table gives no sources and no rows.
    """
    lines = lines.select(
        "source_key", F.col("block").alias("_block"), F.col("line").alias("_line"), text.text_of("value").alias("_value")
    )
    blocks = checkpoint(_blocks(lines))
    if delimiter == "auto":
        known = detect(lines, blocks)
    else:
        known = blocks.select("source_key").distinct().withColumn(
            "detected", F.struct(F.lit(delimiter).alias("delimiter"), F.lit("manual").alias("confidence"))
        )
    known = known.select("source_key", F.col("detected.delimiter").alias("_delimiter"), F.col("detected.confidence").alias("confidence"))
    # What a source is known by reaches its lines by their blocks: a join by the source alone would bring its lines
    # into one task.
    facts = lookup_join(blocks.select(*BLOCK, "_first"), known.drop("confidence"), ["source_key"], "inner")
    if byte_order_marks:
        opening = blocks.groupBy("source_key").agg(F.min("_block").alias("_opening"))
        facts = lookup_join(facts, opening, ["source_key"], "inner").withColumn("_opens", F.col("_block") == F.col("_opening"))
    lines = lookup_join(lines.repartition(*BLOCK), facts, BLOCK, "inner")
    if byte_order_marks:
        first = F.col("_opens") & F.col("_line").eqNullSafe(F.col("_first"))
        lines = lines.withColumn("_value", F.when(first, F.regexp_replace("_value", "^\ufeff", "")).otherwise(F.col("_value")))

    moved = lines.withColumns({"_out": _moves(F.col("_delimiter"), False), "_in": _moves(F.col("_delimiter"), True)}).withColumns(
        {
            "_fixed": F.when(F.col("_out") == F.col("_in"), F.col("_out")),
            "_swap": F.when(F.col("_out") > F.col("_in"), 1).otherwise(0),
        }
    )
    so_far = _up_to_here()
    moved = moved.withColumn("_parity", F.sum("_swap").over(so_far) % 2)
    # State after a line, if a line up to here fixed it; else relative to the start of the block.
    settled = F.last(F.when(F.col("_fixed").isNotNull(), F.col("_fixed").cast("bigint").bitwiseXOR(F.col("_parity"))), True).over(so_far)
    moved = moved.withColumn("_settled", settled).withColumn("_after", F.col("_settled").bitwiseXOR(F.col("_parity")))
    # Read several times below: written once instead of composed again each time.
    moved = checkpoint(moved.select("source_key", "_block", "_line", "_value", "_delimiter", "_parity", "_after"))

    ends = moved.groupBy(*BLOCK).agg(
        F.max_by(F.struct("_after", "_parity"), "_line").alias("_end"),
        F.max(F.col("_value").rlike(f"[^{text.SPACE}]")).alias("_written"),
        F.sum(F.octet_length("_value") + 1).alias("_bytes"),
    )
    over_source = Window.partitionBy("source_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = F.when(F.col("_end._after").isNull(), F.col("_end._parity")).otherwise(0)
    ends = ends.withColumn("_p", F.sum(free).over(over_source) % 2)
    fixed = F.last(F.when(F.col("_end._after").isNotNull(), F.col("_end._after").bitwiseXOR(F.col("_p"))), True).over(over_source)
    ends = ends.withColumn("_state", F.coalesce(fixed, F.lit(0)).bitwiseXOR(F.col("_p")))
    by_block = Window.partitionBy("source_key").orderBy("_block")
    start = F.coalesce(F.lag("_state").over(by_block), F.lit(0))
    ends = checkpoint(ends.select(*BLOCK, start.alias("_start"), "_state", "_written", "_bytes"))
    unclosed = ends.groupBy("source_key").agg(F.max_by("_state", "_block").alias("_state")).filter("_state = 1").select("source_key")
    closed = lookup_join(ends.select(*BLOCK, "_start"), unclosed, ["source_key"], "left_anti")

    placed = lookup_join(moved, closed, BLOCK, "inner")
    state = F.coalesce("_after", F.col("_start").bitwiseXOR(F.col("_parity")))
    in_block = Window.partitionBy(*BLOCK).orderBy("_line")
    placed = placed.withColumn("_ends", state).withColumn("_begins", F.coalesce(F.lag("_ends").over(in_block), F.col("_start")))
    placed = placed.withColumn("_record", F.sum((F.col("_begins") == 0).cast("int")).over(so_far))
    whole = placed.filter("_begins = 0 AND _ends = 0").select("source_key", "_block", "_line", "_value", "_delimiter")
    # Only lines of multi-line records are gathered, one group per record.
    parts = checkpoint(
        placed.filter("NOT (_begins = 0 AND _ends = 0)").select(
            "source_key", "_block", "_line", "_value", "_delimiter", "_begins", "_record"
        )
    )
    numbered = _carry_over(parts, closed)
    joined = numbered.groupBy("source_key", "_first_block", "_first_record").agg(
        F.min_by("_line", F.struct("_block", "_line")).alias("_line"),
        F.first("_delimiter").alias("_delimiter"),
        F.array_sort(F.collect_list(F.struct("_block", "_line", "_value"))).alias("_lines"),
    )
    assembled = joined.select(
        "source_key", F.col("_first_block").alias("_block"), "_line",
        F.array_join(F.transform("_lines", lambda x: x["_value"]), "\n").alias("_value"), "_delimiter",
    )
    # Most records show a plain character; only the others are cut into cells to see.
    shown = F.col("_value").rlike(f'[^{text.SPACE},;"]')
    full = F.when(shown, True).otherwise(delimited._not_blank(delimited.cells_of(F.col("_value"), F.col("_delimiter"))))
    records = checkpoint(whole.unionByName(assembled).filter(full))
    counts = records.groupBy(*BLOCK).agg(F.count("*").alias("_n"))
    offsets = counts.select(*BLOCK, F.coalesce(F.sum("_n").over(_blocks_before()), F.lit(0)).alias("_before"))
    cells = delimited.cells_of(F.col("_value"), F.col("_delimiter"))
    opening = lookup_join(records, offsets.filter("_before = 0").select(*BLOCK), BLOCK, "left_semi")
    opening = opening.withColumn("_place", F.row_number().over(in_block)).filter("_place = 1")
    headers = checkpoint(opening.select("source_key", delimited.unique_names(cells).alias("headers")))

    sources = ends.groupBy("source_key").agg(
        F.max("_written").alias("_written"), (F.max_by("_state", "_block") == 1).alias("_unclosed"), F.sum("_bytes").alias("bytes")
    )
    sources = sources.join(known, "source_key").join(counts.groupBy("source_key").agg(F.sum("_n").alias("_n")), "source_key", "left")
    sources = sources.join(headers, "source_key", "left").withColumns({
        "headers": F.coalesce("headers", F.array().cast("array<string>")),
        "n_rows": F.greatest(F.coalesce("_n", F.lit(0)) - 1, F.lit(0)),
    })
    sources = sources.withColumn("n_columns", F.size("headers")).withColumn("n_cells", F.col("n_rows") * F.col("n_columns"))
    limits = budget or {}
    if "cell_length" in limits:
        longest = F.array_max(F.transform(cells, lambda c: F.char_length(c)))
        lengths = records.groupBy("source_key").agg(F.max(longest).alias("_longest"))
        sources = sources.join(lengths, "source_key", "left")
    status = F.when(~F.col("_written"), "empty")
    if "bytes" in limits:
        status = status.when(F.col("bytes") > limits["bytes"], "too-many-bytes")
    status = status.when(F.col("_unclosed"), "unclosed-quote")
    for name, column in {"columns": "n_columns", "rows": "n_rows", "cells": "n_cells"}.items():
        if name in limits:
            status = status.when(F.col(column) > limits[name], f"too-many-{name}")
    if "cell_length" in limits:
        status = status.when(F.col("_longest") > limits["cell_length"], "cell-too-long")
    sources = sources.select(
        "source_key",
        _source_id().alias("source_id"),
        status.otherwise("ok").alias("status"),
        F.col("_delimiter").alias("delimiter"),
        "confidence", "headers", "n_rows", "n_columns", "n_cells", "bytes",
    )
    wanted = lookup_join(offsets, headers, ["source_key"], "inner")
    if limits:
        wanted = lookup_join(wanted, sources.filter("status = 'ok'").select("source_key"), ["source_key"], "left_semi")
    rows = lookup_join(records.withColumn("_place", F.row_number().over(in_block)), wanted, BLOCK, "inner")
    rows = rows.withColumn("row_number", F.col("_place") + F.col("_before")).filter("row_number > 1")
    rows = rows.withColumns({"_items": cells, "source_id": _source_id()})
    return sources, delimited._finish_rows(rows)


def _source_id() -> Column:
    return F.concat(F.lit("src_"), F.sha2(text.text_of("source_key"), 256))


def _carry_over(parts: DataFrame, closed: DataFrame) -> DataFrame:
    """Key of the record a line belongs to: the block and record number of its first line.

    A record may run over several blocks; the block it began in is the last one
    before that holds the beginning of a multi-line record.
    """
    begins = parts.filter("_begins = 0").groupBy(*BLOCK).agg(F.max("_record").alias("_last_record"))
    carried = (
        closed.join(begins, BLOCK, "left")
        .withColumn("_open", F.last(F.when(F.col("_last_record").isNotNull(), F.struct("_block", "_last_record")), True).over(_blocks_before()))
        .select(*BLOCK, "_open")
    )
    linked = lookup_join(parts, carried, BLOCK, "left")
    own = F.col("_record") > 0
    return linked.withColumns(
        {
            "_first_block": F.when(own, F.col("_block")).otherwise(F.col("_open._block")),
            "_first_record": F.when(own, F.col("_record")).otherwise(F.col("_open._last_record")),
        }
    )
