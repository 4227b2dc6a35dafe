"""Feature collections (GeoJSON) as region tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areal.operators import registry
from areal.operators.geometry import GEOMETRY_TYPE

# Coordinates stay text in the first reading: their depth depends on the type.
COLLECTION = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def _polygons(kind: Column, coordinates: Column) -> Column:
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    single = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    nested = F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", single)

    def point(p: Column) -> Column:
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    return F.transform(nested, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point))).cast(GEOMETRY_TYPE)


def parse(collections: DataFrame) -> DataFrame:
    """Features of GeoJSON texts (source_key, text): properties and polygons, one row each."""
    parsed = collections.select("source_key", F.from_json("text", COLLECTION).alias("c")).filter("c.type = 'FeatureCollection'")
    exploded = parsed.select("source_key", F.posexplode("c.features").alias("ordinal", "f"))
    return exploded.select(
        "source_key", "ordinal", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geometry_type"),
        _polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polygons"),
    )


def with_properties(features: DataFrame, names: list[str]) -> DataFrame:
    return features.withColumns({n: F.try_element_at("properties", F.lit(n)) for n in names}).drop("properties")


# Properties that are read.
PROPERTIES = [
    "region_id", "stable_region_id", "id", "geometry_source_id", "shapeID", "shape_id", "region_name", "name",
    "geometry_source_name", "shapeName", "province_name", "province", "region_type", "type_name",
    "display_name", "official_code", "alternative_names", "match_status", "area_sqkm",
]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Normalised features of all collections under a path; files are read whole, one per task."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_key"), F.col("value").alias("text"))
    return registry.normalize_features(with_properties(parse(texts), PROPERTIES))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for files with one feature per line, of any size."""
    schema = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
    lines = spark.read.schema(schema).json(path)
    flat = lines.select("properties", F.col("geometry.type").alias("geometry_type"), _polygons(F.col("geometry.type"), F.col("geometry.coordinates")).alias("polygons"))
    return registry.normalize_features(with_properties(flat, PROPERTIES))


def property_names(features: DataFrame) -> DataFrame:
    return features.select(F.explode(F.map_keys("properties")).alias("property")).distinct()


def check(features: DataFrame, expected: int | None = None) -> DataFrame:
    """(features, unique_ids, status): the count must be the expected one and ids unique."""
    counted = features.agg(F.count("*").alias("features"), F.countDistinct("region_id").alias("unique_ids"))
    wrong = F.col("features") != F.col("unique_ids")
    if expected is not None:
        wrong = wrong | (F.col("features") != expected)
    return counted.withColumn("status", F.when(wrong, "rejected").otherwise("ok"))
