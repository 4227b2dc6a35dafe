"""Feature collections of any size: one file is cut into features by many tasks.

A text is a table of pieces that a closing brace ends. Where a piece stands in the
document (inside a text or not, how deep in braces and brackets) depends on all
pieces before it; as a quote changes between inside and outside wherever it stands,
a piece adds one of two depths, by the state it begins in. States and depths are
added up within blocks of pieces and then over the blocks of a source. Features are
the values two levels down in the array `features` of the outermost object; only the
pieces of one feature are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areal.functions import text
from areal.plans.sizing import checkpoint, lookup_join
from areal.sources import features

BLOCK = ["source_key", "_block"]
_ARRAY = r'"features"\s*:\s*\['
_KIND = r'"type"\s*:\s*"FeatureCollection"'
FEATURE = "properties map<string,string>, geometry struct<type:string,coordinates:string>"


def _cut(value: Column) -> Column:
    """A piece cut at its quotes; escaped characters are left out."""
    return F.split(F.when(F.contains(value, F.lit("\\")), F.regexp_replace(value, r"(?s)\\.", "")).otherwise(value), '"')


def _outside(parts: Column, inside: Column | int) -> Column:
    """The characters of a cut piece that stand in no text; inside: 1 if the piece begins in one."""
    return F.array_join(F.filter(parts, lambda part, i: (i + inside) % 2 == 0), "")


def _quotes(parts: Column) -> Column:
    return F.size(parts) - 1


def _depth(outside: Column) -> Column:
    def without(first: str, second: str) -> Column:
        return F.char_length(F.replace(F.replace(outside, F.lit(first), F.lit("")), F.lit(second), F.lit("")))

    return (without("}", "]") - without("{", "[")).cast("bigint")


def _placed(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, blocks): pieces with _inside and _above (state and depth where they begin), _depth (where they end) and
    _closes (the brace at the end counts); of each block the depth _end_depth where it ends."""
    so_far = Window.partitionBy(*BLOCK).orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("source_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    read = pieces.withColumn("_parts", _cut(F.col("_value")))
    # what a piece adds that begins outside a text, and one that begins inside
    adds = [_depth(_outside(F.col("_parts"), inside)).alias(f"_adds{inside}") for inside in (0, 1)]
    read = read.select("source_key", "_block", "_line", "_value", "_braced", _quotes(F.col("_parts")).alias("_quotes"), *adds)
    # By blocks, whatever the pieces were dealt by: pieces dealt by their source would meet in one task for each.
    read = read.repartition(*BLOCK)
    read = read.withColumn("_odd", F.sum("_quotes").over(so_far) % 2)
    read = read.withColumn("_own", (F.col("_odd") + F.col("_quotes")) % 2)
    # by the state in which the block begins
    for start in (0, 1):
        state = (F.col("_own") + start) % 2
        closes = F.when(F.col("_braced") & ((F.col("_odd") + start) % 2 == 0), 1).otherwise(0)
        read = read.withColumn(f"_step{start}", F.when(state == 0, F.col("_adds0")).otherwise(F.col("_adds1")) - closes)
        read = read.withColumn(f"_deep{start}", F.sum(f"_step{start}").over(so_far))
    read = checkpoint(read.drop("_adds0", "_adds1"))
    ends = read.groupBy(*BLOCK).agg(F.max_by(F.struct("_odd", "_deep0", "_deep1"), "_line").alias("_end"))
    ends = ends.withColumn("_start", F.coalesce(F.sum("_end._odd").over(before), F.lit(0)) % 2)
    ends = ends.withColumn("_adds", F.when(F.col("_start") == 0, F.col("_end._deep0")).otherwise(F.col("_end._deep1")))
    ends = ends.withColumn("_base", F.coalesce(F.sum("_adds").over(before), F.lit(0)))
    ends = checkpoint(ends.filter("source_key IS NOT NULL AND _block IS NOT NULL").select(*BLOCK, "_start", "_adds", "_base"))
    known = lookup_join(read, ends.select(*BLOCK, "_start", "_base"), BLOCK, "inner")
    first = F.col("_start") == 0
    known = known.withColumns({
        "_inside": (F.col("_own") + F.col("_start")) % 2,
        "_depth": F.col("_base") + F.when(first, F.col("_deep0")).otherwise(F.col("_deep1")),
        "_closes": F.col("_braced") & ((F.col("_odd") + F.col("_start")) % 2 == 0),
    })
    known = known.withColumn("_above", F.col("_depth") - F.when(first, F.col("_step0")).otherwise(F.col("_step1")))
    known = known.select("source_key", "_block", "_line", "_value", "_braced", "_inside", "_above", "_depth", "_closes")
    return known, ends.select(*BLOCK, (F.col("_base") + F.col("_adds")).alias("_end_depth"))


def _first_at(pattern: str) -> Column:
    """What stands before the first match of a pattern at depth 1 in a piece; null if it does not match there."""
    head = F.regexp_extract(F.col("_value"), rf"(?s)\A(.*?){pattern}", 1)
    open_text = (_quotes(_cut(head)) + F.col("_inside")) % 2 == 0
    at_top = F.col("_above") + _depth(_outside(_cut(head), F.col("_inside"))) == 1
    found = F.when(F.col("_value").rlike(pattern) & open_text & at_top, head)
    return F.when(F.contains("_value", F.lit(pattern[: pattern.index('"', 1) + 1])), found)


def parse_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of texts in pieces (source_key, block, line, value, braced), ordered by block, then line.

    value is what stands up to a closing brace; braced tells that the brace follows
    (false only behind the last one). Returns (sources, features): sources has one row
    per text with status ('ok', 'no-collection', 'unclosed') and the count of features,
    features what features.parse gives, for texts that are ok; ordinal counts from 0.
    Null values are empty pieces; an empty table gives no sources.
    """
    pieces = pieces.select(
        "source_key", F.col("block").alias("_block"), F.col("line").alias("_line"), text.text_of("value").alias("_value"), F.col("braced").alias("_braced")
    )
    placed, blocks = _placed(pieces)
    placed = checkpoint(placed.withColumns({"_head": _first_at(_ARRAY), "_kind": _first_at(_KIND).isNotNull()}))
    place = F.struct("_block", "_line")
    begin = placed.filter("_head IS NOT NULL").groupBy("source_key").agg(F.min(place).alias("_begin"))
    # The array ends with the first bracket that follows one of its values, or its beginning.
    ended = placed.filter((F.col("_above") == 2) & (F.col("_inside") == 0) & F.col("_value").rlike(r"\A\s*\]"))
    ended = ended.join(begin, "source_key").filter(place > F.col("_begin")).groupBy("source_key").agg(F.min(place).alias("_stop"))
    empty = placed.filter(F.col("_value").rlike(rf"{_ARRAY}\s*\]") & F.col("_head").isNotNull()).select("source_key", place.alias("_none"))
    last = blocks.groupBy("source_key").agg(F.max_by("_end_depth", "_block").alias("_last"))
    state = last.join(placed.filter("_kind").select("source_key", "_kind").distinct(), "source_key", "left")
    state = state.withColumn("_kind", F.coalesce("_kind", F.lit(False)))
    bounds = checkpoint(state.join(begin, "source_key", "left").join(ended, "source_key", "left").join(
        empty.withColumnRenamed("source_key", "_key"), (F.col("source_key") == F.col("_key")) & (F.col("_begin") == F.col("_none")), "left"
    ))
    found = F.col("_kind") & F.col("_begin").isNotNull()
    status = F.when(F.col("_last") != 0, "unclosed").when(found, "ok").otherwise("no-collection")
    bounds = bounds.withColumn("status", status).withColumn("_full", F.col("_none").isNull())

    wanted = bounds.filter("status = 'ok' AND _full").select("source_key", "_begin", "_stop")
    # Bounds reach the pieces by their blocks: a join by the source alone would bring its pieces into one task.
    own = lookup_join(placed, lookup_join(blocks.drop("_end_depth"), wanted, ["source_key"], "inner"), BLOCK, "inner")
    own = own.filter((place >= F.col("_begin")) & (F.col("_stop").isNull() | (place < F.col("_stop"))))
    own = own.withColumn("_ends", (F.col("_closes") & (F.col("_depth") == 2)).cast("bigint"))
    so_far = Window.partitionBy(*BLOCK).orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("source_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    own = checkpoint(own.withColumn("_n", F.sum("_ends").over(so_far) - F.col("_ends")))
    totals = own.groupBy(*BLOCK).agg(F.sum("_ends").alias("_ended"))
    totals = totals.select(*BLOCK, "_ended", F.coalesce(F.sum("_ended").over(before), F.lit(0)).alias("_earlier"))
    numbered = lookup_join(own, totals.drop("_ended"), BLOCK, "inner").withColumn("ordinal", F.col("_n") + F.col("_earlier"))
    begins = F.when(place == F.col("_begin"), F.regexp_replace("_value", rf"(?s)\A.*?{_ARRAY}", "")).otherwise(F.col("_value"))
    numbered = numbered.withColumn("_value", F.concat(begins, F.when(F.col("_braced"), "}").otherwise("")))
    # the pieces of one feature
    whole = numbered.groupBy("source_key", "ordinal").agg(
        F.max("_ends").alias("_whole"), F.array_sort(F.collect_list(F.struct("_block", "_line", "_value"))).alias("_parts")
    )
    joined = F.regexp_replace(F.array_join(F.transform("_parts", lambda p: p["_value"]), ""), r"\A[^{]*", "")
    read = whole.filter("_whole = 1").select("source_key", F.col("ordinal"), F.from_json(joined, FEATURE).alias("f"))
    counts = totals.groupBy("source_key").agg(F.sum("_ended").alias("_n"))
    sources = bounds.select("source_key", "status").join(counts, "source_key", "left").select(
        "source_key", "status", F.coalesce("_n", F.lit(0)).alias("features")
    )
    return sources, read.select(
        "source_key", "ordinal", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"),
        features._polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons"),
    )


def read_large(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sources, normalised features) of all collections under a path; files of any size are read by many tasks."""
    from areal.operators import registry

    found = spark.read.option("lineSep", "}").text(path).withColumn("_meta", F.col("_metadata"))
    pieces = found.select(
        F.col("_meta.file_path").alias("source_key"),
        F.col("_meta.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    # The reader does not tell whether the last piece of a file has its brace: without one, the pieces and a
    # brace for each are longer than the file. Of compressed files, a last piece of white space has none.
    sized = found.select("_meta.file_path", "_meta.file_size", "value").groupBy(F.col("file_path").alias("source_key"))
    sized = sized.agg(F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("file_size").alias("_size"))
    last = pieces.groupBy("source_key").agg(F.max(F.struct("block", "line")).alias("_last")).join(sized, "source_key")
    tagged = lookup_join(pieces, last, ["source_key"], "inner")
    packed = F.col("source_key").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)\z")
    bare = F.when(packed, F.col("value").rlike(r"\A\s*\z")).otherwise(F.col("_bytes") > F.col("_size"))
    at_end = (F.struct("block", "line") == F.col("_last")) & bare
    sources, parsed = parse_pieces(tagged.withColumn("braced", ~at_end))
    return sources, registry.normalize_features(features.with_properties(parsed, features.PROPERTIES))


def check(sources: DataFrame, normalised: DataFrame) -> DataFrame:
    """Per source: status, features, unique_ids and verdict: accepted if it is whole and every feature has an id of its own."""
    ids = normalised.groupBy("source_key", "region_id").agg(F.count("*").alias("_n"))
    ids = ids.groupBy("source_key").agg(F.count("region_id").alias("unique_ids"))
    checked = sources.join(ids, "source_key", "left").withColumn("unique_ids", F.coalesce("unique_ids", F.lit(0)))
    accepted = (F.col("status") == "ok") & (F.col("features") == F.col("unique_ids"))
    return checked.withColumn("verdict", F.when(accepted, "accepted").otherwise("rejected"))
