"""Writers: CSV reports, registry tables, project documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.functions import text


def csv_cell(c, quote_all: bool = False) -> Column:
    value = text.text_of(c)
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if quote_all else F.when(value.rlike('[",\n\r]'), quoted).otherwise(value)


def csv_lines(df: DataFrame, quote_all: bool = False) -> DataFrame:
    """Each row as one CSV line; quotes only where needed unless quote_all."""
    return df.select(F.concat_ws(",", *[csv_cell(c, quote_all) for c in df.columns]).alias("line"))


def write_report(df: DataFrame, path: str) -> None:
    """A report with every cell quoted."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_registry(df: DataFrame, path: str) -> None:
    """A registry table, quoted only where needed; empty cells stay empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


# Schema of a saved project.
PROJECT_SCHEMA = "1.1"
TITLE_LENGTH = 90
STAGES = ["input", "match", "visualize", "export"]


# Further fields of a saved project; the column of projects with their JSON text, and what stands for a
# missing or unreadable one (None: the field is left out).
FURTHER_FIELDS = {
    "manualHighlights": ("manual_highlights", "{}"),
    "unresolvedHighlights": ("unresolved_highlights", "{}"),
    "legend": ("legend", None),
    "legendVisible": ("legend_visible", None),
    "legendPosition": ("legend_position", None),
    "groupNames": ("group_names", "{}"),
    "groupMeta": ("group_meta", "{}"),
    "importCorrections": ("import_corrections", "{}"),
    "importRows": ("import_rows", "[]"),
    "visualization": ("visualization", None),
    "exportMeta": ("export_meta", None),
    "exportSettings": ("export_settings", None),
    "migrationReport": ("migration_report", "null"),
    "savedAt": ("saved_at", None),
}


def _with_further(document: Column, columns: list[str]) -> Column:
    """Document text with the further fields behind its own."""
    parts = []
    for name, (column, default) in FURTHER_FIELDS.items():
        value = F.lit(default)
        if column in columns:
            value = F.when(F.try_parse_json(column).isNotNull(), F.col(column)).otherwise(value)
        parts.append(F.coalesce(F.concat(F.lit(f',"{name}":'), value.cast("string")), F.lit("")))
    return F.concat(F.substr(document, F.lit(1), F.char_length(document) - 1), *parts, F.lit("}"))


def project_documents(projects: DataFrame, highlights: DataFrame, provider: dict[str, str], default_title: str) -> DataFrame:
    """(project_id, document): project state as JSON text.

    projects: project_id, title, workflow_stage, ui_mode, and the columns of
    FURTHER_FIELDS that it has. highlights: project_id,
    region_id, canonical_region_id, migration_status, color, category, value. A
    project's highlights are one document value, so they are gathered by project.
    """
    style = F.struct("color", "category", "value")
    reference = F.struct(
        F.col("canonical_region_id").alias("canonicalRegionId"),
        F.col("region_id").alias("legacyRegionId"),
        F.col("region_id").alias("geometryFeatureId"),
        F.col("migration_status").alias("migrationStatus"),
        F.lit(provider["boundaryVersion"]).alias("boundaryVersion"),
        F.lit(provider["registryVersion"]).alias("registryVersion"),
    )
    per_project = highlights.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("region_id", style.alias("style"), reference.alias("ref")))).alias("_h")
    )
    joined = projects.join(per_project, "project_id", "left")

    def mapped(name: str) -> Column:
        entries = F.transform("_h", lambda h: F.struct(h["region_id"].alias("key"), h[name].alias("value")))
        return F.map_from_entries(F.coalesce(entries, F.array().cast(joined.select(entries.alias("e")).schema["e"].dataType)))

    document = F.struct(
        F.lit(PROJECT_SCHEMA).alias("schemaVersion"),
        *[F.lit(v).alias(k) for k, v in provider.items()],
        F.substring(F.coalesce(F.nullif(text.text_of("title"), F.lit("")), F.lit(default_title)), 1, TITLE_LENGTH).alias("title"),
        mapped("style").alias("highlights"),
        mapped("ref").alias("regionRefs"),
        F.when(F.col("workflow_stage").isin(STAGES), F.col("workflow_stage")).otherwise("input").alias("workflowStage"),
        F.when(F.col("ui_mode") == "advanced", "advanced").otherwise("basic").alias("uiMode"),
    )
    return joined.select("project_id", _with_further(F.to_json(document), projects.columns).alias("document"))
