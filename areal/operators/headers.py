"""Header rows: normalisation, unique names, role inference and projection.

Headers come as a long table (source_id, position, header), position from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.functions import text
from areal.plans.sizing import checkpoint, is_small, literal_table, lookup_join

# Header spellings of the seven roles.
ROLE_ALIASES = {
    "regionCode": ["official_code", "kode", "kode wilayah", "kode bps", "adm2_pcode", "code", "region code"],
    "regionName": ["region", "region_name", "wilayah", "nama", "nama wilayah", "kabupaten/kota", "kab kota", "region name"],
    "province": ["province", "provinsi", "nama provinsi", "propinsi"],
    "numericValue": ["value", "nilai", "jumlah", "total", "angka", "persen", "percentage", "percent"],
    "category": ["category", "kategori", "kelas", "status", "label"],
    "source": ["source", "sumber"],
    "period": ["period", "periode", "tahun", "year"],
}
ROLE_COLUMN = {
    "regionCode": "region_code",
    "regionName": "region_name",
    "province": "province",
    "numericValue": "numeric_value",
    "category": "category",
    "source": "source",
    "period": "period",
}
COLOR_HEADERS = ["color", "warna"]  # fixed values


def aliases(spark) -> DataFrame:
    """(role, alias), the alias normalised like a header."""
    rows = [(role, alias) for role, names in ROLE_ALIASES.items() for alias in names]
    table = literal_table(spark, ["role", "alias"], rows)
    return table.select("role", F.trim(F.regexp_replace("alias", "[_-]+", " ")).alias("alias")).distinct()


def unique(headers: DataFrame) -> DataFrame:
    """Names for all columns: empty ones numbered, repeats suffixed with their count."""
    base = F.coalesce(F.nullif(text.trim("header"), F.lit("")), F.concat(F.lit("Column "), F.col("position")))
    named = headers.withColumn("_base", base).withColumn("normalized", text.normalize_header("_base"))
    # A header row is bounded: it is one record of one source.
    occurrence = F.row_number().over(Window.partitionBy("source_id", "normalized").orderBy("position"))
    name = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("__"), "_n"))
    return named.withColumn("_n", occurrence).withColumn("name", name).drop("_base", "_n")


def duplicates(headers: DataFrame) -> DataFrame:
    """Normalised headers that a source repeats."""
    return (
        headers.select("source_id", text.normalize_header("header").alias("normalized"))
        .filter("normalized <> ''")
        .groupBy("source_id", "normalized")
        .agg(F.count("*").alias("columns"))
        .filter("columns > 1")
    )


def _pieces(table: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """table with each part of the text of a column, of the lengths that the texts of others have; parts may repeat."""
    lengths = others.select(F.length(other).alias("_length")).filter("_length IS NOT NULL").distinct()
    fitting = table.withColumn("_length", F.explode(F.sequence(F.lit(0), F.length(column))))
    # As many lengths as the longest text has letters, at most.
    sized = fitting.join(F.broadcast(lengths), "_length")
    at = sized.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(column) - F.col("_length") + 1)))
    return at.withColumn("piece", F.substring(column, F.col("_at"), F.col("_length"))).drop("_at", "_length")


def _tiers(heads: DataFrame, role_aliases: DataFrame) -> DataFrame:
    """(header, role, tier) of distinct headers and a table of aliases: one holds the other if a part of it is equal."""
    names = role_aliases.select("role", "alias").distinct()
    held = _pieces(heads, "header", names, "alias").distinct()
    inside = lookup_join(names.withColumnRenamed("alias", "piece"), held, ["piece"], "inner", small=is_small(held))
    inside = inside.select("header", "role", F.when(F.col("piece") == F.col("header"), 0).otherwise(1).alias("tier"))
    parts = _pieces(names, "alias", heads, "header").withColumnRenamed("piece", "header")
    around = lookup_join(parts, heads, ["header"], "inner", small=is_small(heads)).select("header", "role", F.lit(1).alias("tier"))
    return inside.union(around).groupBy("header", "role").agg(F.min("tier").alias("tier"))


def infer_roles(named: DataFrame, role_aliases: DataFrame | None = None) -> DataFrame:
    """(source_id, role, name, confidence): an equal header is high, containment either way medium.

    named is the output of unique(). The built-in aliases are looked through in an
    array for each role. A table of aliases (role, alias) of any length stays a
    table: the parts of each distinct header and alias meet the other side by equality.
    """
    tested = named.withColumn("_header", text.normalize_header("name"))
    if role_aliases is None:
        tiers = []
        for role, spelled in ROLE_ALIASES.items():
            names = sorted({" ".join(a.replace("_", " ").split()) for a in spelled})
            held = F.exists(F.lit(names), lambda alias: F.col("_header").contains(alias) | alias.contains(F.col("_header")))
            tier = F.when(F.col("_header").isin(names), 0).when(held, 1)
            tiers.append(F.struct(F.lit(role).alias("role"), tier.alias("tier")))
        found = tested.select("source_id", "position", "name", F.inline(F.array(*tiers))).filter("tier IS NOT NULL")
    else:
        heads = checkpoint(tested.select(F.col("_header").alias("header")).filter("header IS NOT NULL").distinct())
        told = checkpoint(_tiers(heads, role_aliases).withColumnRenamed("header", "_header"))
        found = lookup_join(tested, told, ["_header"], "inner", small=is_small(told))
    return (
        found.groupBy("source_id", "role")
        .agg(F.min(F.struct("tier", "position", "name")).alias("best"))
        .select(
            "source_id", "role", "best.name", F.when(F.col("best.tier") == 0, "high").otherwise("medium").alias("confidence")
        )
    )


def ignored(named: DataFrame, mapping: DataFrame) -> DataFrame:
    """Headers that serve no role."""
    return named.select("source_id", "name").join(mapping.select("source_id", "name").distinct(), ["source_id", "name"], "left_anti")


def override(inferred: DataFrame, chosen: DataFrame) -> DataFrame:
    """User mapping (source_id, role, name) over the inferred one; a NULL name clears the role."""
    picked = chosen.select("source_id", "role", F.struct("name", F.lit("manual").alias("confidence")).alias("_chosen"))
    base = inferred.select("source_id", "role", F.struct("name", "confidence").alias("_inferred"))
    return (
        base.join(picked, ["source_id", "role"], "full_outer")
        .select("source_id", "role", F.inline(F.array(F.coalesce("_chosen", "_inferred"))))
        .filter("name IS NOT NULL")
    )


def role_map(mapping: DataFrame) -> DataFrame:
    """One row per source: map from role to column name (at most seven entries)."""
    return mapping.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "name"))).alias("roles"))


def project_roles(rows: DataFrame, roles: Column | str = "roles") -> DataFrame:
    """Cells (map of column name to text) and a role map as trimmed role columns."""
    roles = F.col(roles) if isinstance(roles, str) else roles
    columns = {
        column: text.trim(F.try_element_at("cells", F.coalesce(F.try_element_at(roles, F.lit(role)), F.lit(""))))
        for role, column in ROLE_COLUMN.items()
    }
    color_cells = F.map_filter("cells", lambda name, _: F.lower(F.trim(name)).isin(COLOR_HEADERS))
    columns["color"] = text.trim(F.get(F.map_values(color_cells), F.lit(0)))
    return rows.withColumns(columns)
