"""Colour groups, legend resolution and export specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.functions import text
from areal.operators import registry
from areal.plans.sizing import lookup_join

FALLBACK_COLOR = "#087F73"  # fixed value

# Names of the colours people pick most.
GROUP_NAMES = {
    "#4472C4": "Blue group",
    "#5B9BD5": "Light blue group",
    "#E74C3C": "Red group",
    "#70AD47": "Green group",
    "#FFC000": "Yellow group",
    "#A64D79": "Purple group",
    "#00A388": "Teal group",
    "#7F6000": "Brown group",
    "#087F73": "Teal group",
    "#2D79B7": "Blue group",
    "#194F68": "Deep blue group",
    "#D58A16": "Amber group",
    "#6E55A5": "Violet group",
    "#45A99B": "Sea green group",
    "#B8CBD5": "Light slate group",
}

# Picture sizes by ratio; anything else is 16:9.
FRAMES = {"4:3": (1600, 1200), "a4": (1754, 1240), "a3": (2480, 1754), "1:1": (1400, 1400), "16:9": (1600, 900)}


def color_key(c) -> Column:
    return F.upper(F.coalesce(F.nullif(text.text_of(c), F.lit("")), F.lit(FALLBACK_COLOR)))


def default_group_name(color) -> Column:
    name = None
    for value, label in GROUP_NAMES.items():
        name = F.when(F.col(color) == value, label) if name is None else name.when(F.col(color) == value, label)
    return name.otherwise(F.concat(F.lit("Color group "), F.col(color)))


def members(highlights: DataFrame) -> DataFrame:
    """(color, region_id): which regions a colour group has, one row each."""
    return highlights.select(color_key("color").alias("color"), "region_id").distinct()


def color_groups(highlights: DataFrame, names: DataFrame) -> DataFrame:
    """(color, label, regions) per colour; names is (color, name, category, value)."""
    counts = members(highlights).groupBy("color").agg(F.count("*").alias("regions"))
    named = lookup_join(counts, names.withColumn("color", F.upper("color")), ["color"], "left")
    name = F.coalesce(F.nullif(text.text_of("name"), F.lit("")), default_group_name("color"))
    return named.select("color", text.label_text(text.trim(name), "category", "value").alias("label"), "regions")


def in_label_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.collate("label", "id"), "color")


def resolve(*sources: DataFrame) -> DataFrame:
    """Legend per map: the first non-empty of several sources (map_id, position, label, color)."""
    tagged = None
    for priority, source in enumerate(sources):
        part = source.select("map_id", "position", "label", "color", F.lit(priority).alias("priority"))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy("map_id").agg(F.min("priority").alias("priority"))
    return tagged.join(best, ["map_id", "priority"])


def frame_size(ratio) -> Column:
    size = None
    for name, (width, height) in FRAMES.items():
        value = F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"))
        size = F.when(ratio == name, value) if size is None else size.when(ratio == name, value)
    return size.otherwise(F.struct(F.lit(1600).alias("width"), F.lit(900).alias("height")))


def export_spec(maps: DataFrame, bounds: DataFrame, provider_id: str, default_title: str, default_prefix: str) -> DataFrame:
    """One row per map: cleaned metadata, extent, bounds, size and versions.

    maps: map_id, title, subtitle, source, period, footnote, legend_title,
    filename_slug, extent, ratio, png_size, labels, transparent, geometry_detail.
    bounds: map_id, min_x, min_y, max_x, max_y.
    """

    def cleaned(name: str, size: int, default: str = "") -> Column:
        return text.sanitize(F.coalesce(F.col(name), F.lit(default)), size).alias(name)

    pixels = F.split("png_size", "x")
    sized = F.when(
        text.text_of("png_size") != "",
        F.struct(F.get(pixels, F.lit(0)).try_cast("int").alias("width"), F.get(pixels, F.lit(1)).try_cast("int").alias("height")),
    ).otherwise(frame_size(F.col("ratio")))
    joined = maps.join(bounds, "map_id", "left")
    default_box = {"min_x": 94.0, "min_y": -12.0, "max_x": 142.0, "max_y": 8.0}  # fixed values
    return joined.select(
        "map_id",
        cleaned("title", 90, default_title),
        *[cleaned(c, 180) for c in ("subtitle", "source", "period", "footnote")],
        cleaned("legend_title", 180, "Legend"),
        cleaned("filename_slug", 80, default_prefix),
        F.when(F.col("extent") == "national", "national").otherwise("current-view").alias("extent"),
        *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in default_box.items()],
        sized["width"].alias("width"),
        sized["height"].alias("height"),
        F.coalesce(F.col("labels"), F.lit(True)).alias("labels"),
        F.coalesce(F.col("transparent"), F.lit(False)).alias("transparent"),
        F.when(F.col("geometry_detail") == "detailed", "detailed").otherwise("lite").alias("geometry_detail"),
        F.lit(provider_id).alias("boundary_provider_id"),
        F.lit(registry.BOUNDARY_VERSION).alias("boundary_version"),
        F.lit(registry.REGISTRY_VERSION).alias("registry_version"),
    )


def first_entries(entries: DataFrame, limit: int) -> DataFrame:
    """Bounded list per map, in position order."""
    ranked = entries.withColumn("_n", F.row_number().over(Window.partitionBy("map_id").orderBy("position")))
    return ranked.filter(F.col("_n") <= limit).drop("_n")
