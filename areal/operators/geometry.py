"""Region polygons: measures, meshes, adjacency, anchors, projection and storage.

Geometry is polygons: array of polygons, each an array of rings, each an array
of struct<x, y>. A plain polygon is a list of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areal.functions import text
from areal.plans.sizing import checkpoint, is_small, lookup_join

GEOMETRY_TYPE = "array<array<array<struct<x:double,y:double>>>>"
EMPTY_BOX = {"min_x": 94.0, "min_y": -12.0, "max_x": 142.0, "max_y": 8.0}  # fixed values
VALID_RANGE = (95.0, 142.0, -12.0, 7.0)  # fixed values: west, east, south, north
UNRESOLVED_PROVINCE = "__unresolved"  # fixed value


def rings(df: DataFrame) -> DataFrame:
    """One row per ring: polygon, ring, points beside the other columns."""
    other = [c for c in df.columns if c != "polygons"]
    by_polygon = df.select(*other, F.posexplode("polygons").alias("polygon", "_rings"))
    return by_polygon.select(*other, "polygon", F.posexplode("_rings").alias("ring", "points"))


def vertices(df: DataFrame) -> DataFrame:
    """One row per vertex: polygon, ring, pos, x, y."""
    ring_rows = rings(df)
    other = [c for c in ring_rows.columns if c != "points"]
    return ring_rows.select(*other, F.posexplode("points").alias("pos", "_p")).select(*other, "pos", "_p.x", "_p.y")


def _points(polygons) -> Column:
    return F.flatten(F.flatten(F.col(polygons) if isinstance(polygons, str) else polygons))


def bbox(polygons="polygons") -> Column:
    """struct<min_x, min_y, max_x, max_y>; the default box where there is no vertex."""
    xs = F.transform(_points(polygons), lambda p: p["x"])
    ys = F.transform(_points(polygons), lambda p: p["y"])
    values = {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}
    return F.struct(*[F.coalesce(v, F.lit(EMPTY_BOX[k])).alias(k) for k, v in values.items()])


def vertex_count(polygons="polygons") -> Column:
    return F.greatest(F.size(_points(polygons)), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def mean_centroid(polygons="polygons") -> Column:
    """Mean of all ring vertices, closing ones included."""
    points = _points(polygons)
    count = F.nullif(F.size(points), F.lit(0))
    return F.struct(
        F.coalesce(_total(F.transform(points, lambda p: p["x"])) / count, F.lit(0.0)).alias("x"),
        F.coalesce(_total(F.transform(points, lambda p: p["y"])) / count, F.lit(0.0)).alias("y"),
    )


def _following(points: Column) -> Column:
    """Every point's successor; the first one follows the last."""
    return F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def ring_area(points) -> Column:
    """Signed shoelace area."""
    points = F.col(points) if isinstance(points, str) else points
    return _total(F.zip_with(points, _following(points), _cross)) / 2


def area_centroid(points) -> Column:
    """Centroid by area, six decimals; the first vertex where the area is zero."""
    points = F.col(points) if isinstance(points, str) else points

    def edge(p: Column, q: Column) -> Column:
        cross = _cross(p, q)
        return F.struct(cross.alias("area"), ((p["x"] + q["x"]) * cross).alias("x"), ((p["y"] + q["y"]) * cross).alias("y"))

    def add(total: Column, e: Column) -> Column:
        return F.struct(*[(total[k] + e[k]).alias(k) for k in ("area", "x", "y")])

    def center(total: Column) -> Column:
        area = F.nullif(total["area"] / 2, F.lit(0.0))
        first = F.get(points, F.lit(0))
        return F.struct(
            *[F.coalesce(F.round(total[k] / (area * 6), 6), F.coalesce(first[k], F.lit(0.0))).alias(k) for k in ("x", "y")]
        )

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("area", "x", "y")])
    return F.aggregate(F.zip_with(points, _following(points), edge), zero, add, center)


def largest_ring(polygons="polygons") -> Column:
    """Ring of the largest absolute area: outer rings only where there are several polygons."""
    polygons = F.col(polygons) if isinstance(polygons, str) else polygons
    outer = F.transform(polygons, lambda polygon: F.get(polygon, F.lit(0)))
    choices = F.filter(F.when(F.size(polygons) == 1, F.get(polygons, F.lit(0))).otherwise(outer), lambda r: F.size(r) > 2)
    sized = F.transform(choices, lambda r, i: F.struct(F.abs(ring_area(r)).alias("area"), (-i).alias("place"), r.alias("points")))
    return F.array_max(sized)["points"]


def anchors(df: DataFrame) -> DataFrame:
    """Label anchors: id, name, type, province, priority and the centre of the largest ring."""
    ring = df.withColumn("_ring", F.coalesce(largest_ring(), F.array().cast("array<struct<x:double,y:double>>")))
    kind = F.when(F.col("region_type").isin("Kota", "Kabupaten"), F.col("region_type")).otherwise("Unresolved")
    area = F.coalesce(F.col("area_sqkm").cast("double"), F.lit(0.0))
    priority = (
        F.when(kind == "Kota", 3).when((kind == "Kabupaten") & (area > 0) & (area <= 1500), 2).when(kind == "Kabupaten", 1).otherwise(0)
    )
    center = area_centroid("_ring")
    return ring.select(
        F.col("region_id").alias("id"),
        F.coalesce(F.nullif(text.text_of("display_name"), F.lit("")), F.lit("Region")).alias("name"),
        kind.alias("type"),
        text.text_of("province_name").alias("province"),
        priority.alias("priority"),
        # A generator, so that filters on the anchor do not repeat the geometry work.
        F.inline(F.array(center)).alias("lng", "lat"),
    )


def segments(df: DataFrame) -> DataFrame:
    """Directed ring edges of non-zero length, with an undirected key a-b."""
    ring_rows = rings(df.select("region_id", "polygons"))
    edges = F.zip_with(
        F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0))),
        F.slice("points", F.lit(2), F.greatest(F.size("points") - 1, F.lit(0))),
        lambda p, q: F.struct(p.alias("p"), q.alias("q")),
    )
    exploded = ring_rows.select("region_id", "polygon", "ring", F.posexplode(edges).alias("pos", "_e")).filter("_e.p <> _e.q")
    low, high = F.least("_e.p", "_e.q"), F.greatest("_e.p", "_e.q")
    flat = exploded.select("region_id", "polygon", "ring", "pos", low.alias("a"), high.alias("b"), (F.col("_e.p") == low).alias("forward"))
    return flat.select(
        "region_id", "polygon", "ring", "pos", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "forward"
    )


_KEY = ["ax", "ay", "bx", "by"]


def mesh(df: DataFrame) -> DataFrame:
    """Each boundary segment once, in the direction first seen, with how often it occurs."""
    order = F.struct("region_id", "polygon", "ring", "pos")
    return segments(df).groupBy(*_KEY).agg(F.count("*").alias("uses"), F.min_by("forward", order).alias("forward"))


def mesh_stats(meshed: DataFrame) -> DataFrame:
    return meshed.agg(
        F.coalesce(F.sum("uses"), F.lit(0)).alias("input_segments"),
        F.count("*").alias("unique_segments"),
        F.coalesce(F.sum(F.col("uses") - 1), F.lit(0)).alias("shared_segments"),
    )


def _sharing(df: DataFrame) -> DataFrame:
    per_region = segments(df).select(*_KEY, "region_id").distinct()
    return per_region.groupBy(*_KEY).agg(
        F.count("*").alias("regions"), F.min("region_id").alias("left_id"), F.max("region_id").alias("right_id")
    )


def adjacency(df: DataFrame) -> DataFrame:
    """(left_id, right_id, shared_segments) of regions on the two sides of a segment."""
    pairs = _sharing(df).filter("regions = 2")
    return pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("shared_segments"))


def crowded_segments(df: DataFrame) -> DataFrame:
    """Segments that more than two regions claim: overlapping geometry, no pairs are built."""
    return _sharing(df).filter("regions > 2").select(*_KEY, "regions")


def validate(df: DataFrame) -> DataFrame:
    """Ring rules as boolean columns per region."""
    every_ring = F.flatten("polygons")
    points = _points("polygons")
    west, east, south, north = VALID_RANGE

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))

    return df.select(
        "region_id",
        (F.coalesce(F.size(every_ring), F.lit(0)) <= 0).alias("no_rings"),
        (F.coalesce(F.size(points), F.lit(0)) <= 0).alias("no_vertices"),
        F.coalesce(F.exists(every_ring, lambda r: F.size(r) < 4), F.lit(False)).alias("few_points"),
        F.coalesce(F.exists(every_ring, lambda r: F.get(r, F.lit(0)) != F.element_at(r, -1)), F.lit(False)).alias("unclosed"),
        (~F.coalesce(F.exists(every_ring, lambda r: F.abs(ring_area(r)) > 0), F.lit(False))).alias("no_area"),
        F.coalesce(F.exists(points, lambda p: ~(finite(p["x"]) & finite(p["y"]))), F.lit(False)).alias("not_finite"),
        F.coalesce(
            F.exists(points, lambda p: ~((p["x"] >= west) & (p["x"] <= east) & (p["y"] >= south) & (p["y"] <= north))), F.lit(False)
        ).alias("out_of_range"),
    )


def _offset(a: Column, b: Column) -> Column:
    """Distance of the vertex of a row from the line through two points, or from the point if both are one."""
    dx, dy, px, py = b["x"] - a["x"], b["y"] - a["y"], F.col("x") - a["x"], F.col("y") - a["y"]
    length = F.sqrt(dx * dx + dy * dy)
    return F.when(length > 0, F.abs(dx * py - dy * px) / length).otherwise(F.sqrt(px * px + py * py))


def simplify_vertices(vertex_rows: DataFrame, keys: list[str], tolerance: float = 0.018) -> DataFrame:
    """The vertices (keys, pos, x, y) of rings or lines that Douglas-Peucker keeps; pos orders a ring, without ties.

    A closed ring of more than three vertices is split at its farthest vertex first, the
    earliest one of several. Each round takes all open spans of all rings at once: the
    farthest vertex of a span, the earliest of several, splits it if it lies beyond the
    tolerance, else the span is done and its vertices leave the table. So a ring of any
    length is spread over tasks. Rounds are as many as spans are nested: some logarithm
    of the kept vertices, but up to one for each peak of a line of equal peaks. Rings
    that would keep fewer than four vertices keep all. Keys must tell rings apart; an
    empty table gives no rows.
    """
    point = F.struct("x", "y")
    rows = checkpoint(vertex_rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), "x", "y"))
    ends = rows.groupBy(*keys).agg(
        F.min("pos").alias("_lo"), F.max("pos").alias("_hi"), F.count("*").alias("_n"),
        F.min_by(point, "pos").alias("_a"), F.max_by(point, "pos").alias("_b"),
    )
    closed = (F.col("_n") > 3) & (F.col("_a") == F.col("_b"))
    away = (F.col("x") - F.col("_a.x")) * (F.col("x") - F.col("_a.x")) + (F.col("y") - F.col("_a.y")) * (F.col("y") - F.col("_a.y"))
    spread = lookup_join(rows, ends, keys, "inner").withColumns({"_closed": closed, "_away": away})
    still_open = checkpoint(spread)
    at_end = (F.col("pos") == F.col("_lo")) | (F.col("pos") == F.col("_hi"))
    kept = still_open.filter(at_end).select(*keys, "pos", "x", "y")
    still_open = still_open.filter(~at_end)
    split_at = F.max(F.struct(F.col("_away").alias("far"), (-F.col("pos")).alias("place"), "x", "y")).alias("_split")
    splits = still_open.filter("_closed").groupBy(*keys, "_lo").agg(split_at)
    flat = still_open.filter("NOT _closed")
    rounds, first = [kept], True
    while True:
        splits = checkpoint(splits.withColumn("_at", -F.col("_split.place")))
        rounds.append(splits.select(*keys, F.col("_at").alias("pos"), "_split.x", "_split.y"))
        parted = lookup_join(still_open, splits, [*keys, "_lo"], "inner").filter(F.col("pos") != F.col("_at"))
        below, corner = F.col("pos") < F.col("_at"), F.struct("_split.x", "_split.y")
        parted = parted.select(
            *keys, "pos", "x", "y",
            F.when(below, F.col("_lo")).otherwise(F.col("_at")).alias("_lo"),
            F.when(below, F.col("_a")).otherwise(corner).alias("_a"),
            F.when(below, corner).otherwise(F.col("_b")).alias("_b"),
        )
        if first:
            parted, first = parted.unionByName(flat.select(*parted.columns)), False
        still_open = checkpoint(parted)
        if still_open.isEmpty():
            break
        measured = still_open.withColumn("_away", _offset(F.col("_a"), F.col("_b")))
        splits = measured.groupBy(*keys, "_lo").agg(split_at).filter(F.col("_split.far") > tolerance)
    kept = rounds[0]
    for more in rounds[1:]:
        kept = kept.unionByName(more)
    kept = checkpoint(kept.distinct())
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).join(kept.groupBy(*keys).agg(F.count("*").alias("_kept")), keys)
    short = sizes.filter(F.col("_kept") < F.least(F.lit(4), F.col("_n"))).select(*keys)
    whole = lookup_join(rows, short, keys, "left_semi")
    return lookup_join(kept, short, keys, "left_anti").unionByName(whole)


def simplify(ring_rows: DataFrame, tolerance: float = 0.018) -> DataFrame:
    """Rings with fewer vertices (output of rings()); a ring never falls below four points.

    Rings without points stay as they are; other columns are kept.
    """
    keyed = checkpoint(ring_rows.withColumn("_ring", F.monotonically_increasing_id()))
    spread = keyed.select("_ring", F.posexplode("points").alias("pos", "_p")).select("_ring", "pos", "_p.x", "_p.y")
    kept = simplify_vertices(spread, ["_ring"], tolerance)
    # one value again, as it came
    lists = kept.groupBy("_ring").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("_kept"))
    shorter = F.transform("_kept", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    joined = keyed.join(lists, "_ring", "left").withColumn("points", F.coalesce(shorter, F.col("points")))
    return joined.select(*ring_rows.columns)


def assemble(ring_rows: DataFrame) -> DataFrame:
    """Rings back to one row per region (a region's own rings are one geometry value)."""
    polygons = ring_rows.groupBy("region_id", "polygon").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("_rings"))
    whole = polygons.select("region_id", "polygon", F.transform("_rings", lambda r: r["points"]).alias("_rings"))
    return (
        whole.groupBy("region_id")
        .agg(F.array_sort(F.collect_list(F.struct("polygon", "_rings"))).alias("_all"))
        .select("region_id", F.transform("_all", lambda p: p["_rings"]).alias("polygons"))
    )


def summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("features"),
        F.countDistinct("region_id").alias("unique_regions"),
        F.count_if(F.size("polygons") == 1).alias("polygons"),
        F.count_if(F.size("polygons") > 1).alias("multi_polygons"),
        F.sum(vertex_count()).cast("bigint").alias("vertices"),
    )


# Fixed values of the page layout: outer margin, room for the legend, title strip.
MARGIN, LEGEND_ROOM, PLAIN_ROOM, TITLE_ROOM, FOOT_ROOM = 58, 142, 72, 92, 88


def fit(bounds: DataFrame, width, height, legend: bool = True) -> DataFrame:
    """Projection of each bounding box (min_x...max_y) into a page: scale, offset_x, offset_y."""
    width, height = (F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in (width, height))
    room = LEGEND_ROOM if legend else PLAIN_ROOM
    span_x, span_y = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    scale = F.least(
        (width - 2 * MARGIN) / F.greatest(span_x, F.lit(0.001)), (height - 2 * MARGIN - room) / F.greatest(span_y, F.lit(0.001))
    )
    return bounds.withColumn("scale", scale).withColumns(
        {
            "offset_x": (width - span_x * F.col("scale")) / 2,
            "offset_y": F.lit(float(TITLE_ROOM)) + (height - FOOT_ROOM - room - span_y * F.col("scale")) / 2,
        }
    )


def project_x(x: Column) -> Column:
    return F.col("offset_x") + (x - F.col("min_x")) * F.col("scale")


def project_y(y: Column) -> Column:
    return F.col("offset_y") + (F.col("max_y") - y) * F.col("scale")


def path(polygons="polygons") -> Column:
    """Path text over projected points (two decimals); needs the columns of fit()."""

    def ring_path(points: Column) -> Column:
        steps = F.transform(
            points, lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), F.format_string("%.2f %.2f", project_x(p["x"]), project_y(p["y"])))
        )
        return F.when(F.size(points) > 0, F.concat(F.array_join(steps, " "), F.lit(" Z"))).otherwise("")

    every_ring = F.flatten(F.col(polygons) if isinstance(polygons, str) else polygons)
    return F.array_join(F.filter(F.transform(every_ring, ring_path), lambda p: p != ""), " ")


# Map extent of the compact paths.
COMPACT_BOUNDS = {"min_x": 94.7, "max_x": 141.1, "min_y": -11.2, "max_y": 6.2}


def compact_path(points, x: float, y: float, width: float, height: float) -> Column:
    """Path of a ring in a box, one decimal, repeated rounded points left out."""
    points = F.col(points) if isinstance(points, str) else points
    b = COMPACT_BOUNDS

    def tenth(v: Column) -> Column:
        return F.regexp_replace((F.floor(v * 10 + 0.5) / 10).cast("string"), r"\.0$", "")

    placed = F.transform(
        points,
        lambda p: F.concat_ws(
            " ",
            tenth(F.lit(x) + (p["x"] - b["min_x"]) / (b["max_x"] - b["min_x"]) * width),
            tenth(F.lit(y) + (F.lit(b["max_y"]) - p["y"]) / (b["max_y"] - b["min_y"]) * height),
        ),
    )
    kept = F.filter(placed, lambda p, i: (i == 0) | (p != F.get(placed, i - 1)))
    return F.when(F.size(kept) < 3, "").otherwise(F.concat(F.lit("M"), F.array_join(kept, "L"), F.lit("Z")))


def longitude_band(x: Column) -> Column:
    """0 to 3 by longitude (fixed bounds 105, 116, 127)."""
    return F.when(x < 105, 0).when(x < 116, 1).when(x < 127, 2).otherwise(3)


def inside(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Anchors inside a box, edges included."""
    return df.filter(F.col("lng").between(min_x, max_x) & F.col("lat").between(min_y, max_y))


# Spellings of the properties that identify a region, the first filled one counts.
SPELLINGS = {
    "region": ["region_id", "id", "ID"],
    "shape": ["geometry_source_id", "shapeID", "shapeId", "shape_id", "ShapeID"],
    "code": ["official_code", "official_code_normalized", "ADM2_PCODE", "ADM2_CODE", "kode", "KODE"],
    "province": ["province_name", "ADM1_EN", "ADM1_ID", "PROVINSI", "Province", "province"],
    "name": [
        "region_name", "display_name", "shapeName", "ShapeName", "ADM2_EN", "ADM2_ID", "KAB_KOTA", "NAME_2", "name", "NAME",
    ],
}


def match_keys(df: DataFrame) -> Column:
    """Ranked keys under which two geometry sources recognise a region."""
    from areal.operators.registry import optional

    source = F.regexp_replace(optional(df, *SPELLINGS["shape"]), "(?i)^gb-", "")
    place = text.normalize_text(optional(df, *SPELLINGS["province"]), "import")
    name = text.normalize_text(optional(df, *SPELLINGS["name"]), "import")
    keys = [
        ("region:", optional(df, *SPELLINGS["region"])),
        ("shape:", source),
        ("code:", text.normalize_code(optional(df, *SPELLINGS["code"]), "import")),
        ("name:", F.concat(place, F.lit("|"), name)),
        ("region-name:", name),
    ]
    ranked = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(p), k).alias("key")) for i, (p, k) in enumerate(keys)])
    return F.filter(ranked, lambda k: ~k["key"].endswith(":"))


def merge_detail(base: DataFrame, detail: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Base regions with the detailed geometry of their best shared key.

    Applied only if more than min_share of the regions find one, else base is kept.
    kept_because tells why a region has its base geometry: 'no-match', or
    'too-few-matches' for all of them. detail needs an ordinal: the first feature
    of a key wins.
    """
    keyed = detail.filter("polygons IS NOT NULL").select("ordinal", "region_id", F.inline(match_keys(detail)))
    first = keyed.groupBy("key").agg(F.min_by("ordinal", "ordinal").alias("_detail"))
    wanted = base.select("region_id", F.inline(match_keys(base)))
    best = (
        lookup_join(wanted, first, ["key"], "inner", spread=["region_id"])
        .groupBy("region_id")
        .agg(F.min_by("_detail", "rank").alias("_detail"))
    )
    if best.count() <= min_share * base.count():
        return base.withColumns({"detailed": F.lit(False), "kept_because": F.lit("too-few-matches")})
    shapes = detail.select(F.col("ordinal").alias("_detail"), F.col("polygons").alias("_polygons"))
    found = best.join(shapes, "_detail").select("region_id", "_polygons")
    return (
        base.join(found, "region_id", "left")
        .withColumn("detailed", F.col("_polygons").isNotNull())
        .withColumn("kept_because", F.when(F.col("_polygons").isNull(), "no-match"))
        .withColumn("polygons", F.coalesce("_polygons", "polygons"))
        .drop("_polygons")
    )


def strict_detail(base: DataFrame, detail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detail features with base properties, and those without a base region.

    An unknown province code becomes '__unresolved'.
    """
    properties = base.select(
        F.col("geometry_source_id").alias("shapeID"),
        "region_id",
        F.when(F.col("province_code").rlike("^[0-9]{2}$"), F.col("province_code")).otherwise(UNRESOLVED_PROVINCE).alias("province_code"),
    )
    joined = lookup_join(detail.select("shapeID", "polygons"), properties, ["shapeID"], "left", spread=["shapeID"])
    return joined.filter("region_id IS NOT NULL"), joined.filter("region_id IS NULL")


#: Regions of a file of the partition store.
FILE_REGIONS = 20_000


def write_partitioned(df: DataFrame, path_: str) -> None:
    """One folder per province, and an index of the provinces beside them.

    Only the provinces that df holds are replaced. A province has as many files as its
    regions need, so a large one is written by many tasks and a small one is one file.
    """
    index = checkpoint(partition_index(df))
    files = index.select("province_code", F.ceil(F.col("features") / FILE_REGIONS).cast("int").alias("_files"))
    # A join by the province would bring a province into one task: the counts go to the rows wherever they fit.
    told = F.broadcast(files) if is_small(files) else files
    dealt = df.join(told, df["province_code"].eqNullSafe(files["province_code"])).drop(files["province_code"])
    dealt = dealt.withColumn("_file", F.pmod(F.xxhash64("region_id"), F.col("_files"))).drop("_files")
    for rows, folder in ((dealt.repartition("province_code", "_file").drop("_file"), path_), (index, f"{path_}/_index")):
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("province_code").parquet(folder)


def read_province(spark: SparkSession, path_: str, province: str, provinces: DataFrame | None = None) -> DataFrame:
    """One province by code, or by name through (province_code, province_name).

    A name is looked up by a join: its codes are known at run time and prune the folders
    then, so no job runs while this plans. A text that is no name or code of provinces
    counts as a code.
    """
    stored = spark.read.parquet(path_)
    if provinces is None:
        return stored.filter(F.col("province_code") == province)
    wanted = (F.col("province_code") == province) | (F.col("province_name") == province)
    # the codes of one name
    codes = provinces.filter(wanted).groupBy().agg(F.collect_set("province_code").alias("_codes"))
    codes = codes.select(F.explode(F.when(F.size("_codes") > 0, F.col("_codes")).otherwise(F.array(F.lit(province)))).alias("province_code"))
    return stored.join(F.broadcast(codes), "province_code", "left_semi")


def verify_partitions(spark: SparkSession, path_: str) -> DataFrame:
    """(province_code, features, status) of a store read back: ok, changed, missing or unlisted, against its index."""
    listed = spark.read.parquet(f"{path_}/_index").select(
        F.col("province_code").cast("string").alias("_code"), F.col("features").alias("_listed"), F.col("fingerprint").alias("_print")
    )
    stored = spark.read.parquet(path_).withColumn("province_code", F.col("province_code").cast("string"))
    both = partition_index(stored).join(listed, F.col("province_code").eqNullSafe(F.col("_code")), "full_outer")
    same = (F.col("features") == F.col("_listed")) & (F.col("fingerprint") == F.col("_print"))
    status = F.when(F.col("features").isNull(), "missing").when(F.col("_listed").isNull(), "unlisted").when(same, "ok").otherwise("changed")
    return both.select(F.coalesce("province_code", "_code").alias("province_code"), F.coalesce("features", F.lit(0)).alias("features"), status.alias("status"))


def partition_index(df: DataFrame) -> DataFrame:
    """(province_code, features, fingerprint) of a partitioned geometry table."""
    from areal.operators.lineage import group_fingerprint

    return group_fingerprint(df.select("province_code", "region_id", "polygons"), ["province_code"]).withColumnRenamed("rows", "features")


def best_label_per_province(candidates: DataFrame) -> DataFrame:
    """Best-ranked anchor per province, the first seen wins ties."""
    order = Window.partitionBy("province").orderBy(F.desc("rank"), "ordinal")
    return candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
