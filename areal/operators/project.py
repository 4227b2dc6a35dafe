"""Saved projects: reconciliation with the current registry, reports, document checks.

projects: project_id, document (JSON text of a saved project).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.functions import text
from areal.operators.registry import BOUNDARY_VERSION, REGISTRY_VERSION
from areal.plans.sizing import lookup_join

CURRENT_SCHEMA = "1.1"
SUPPORTED_SCHEMAS = ["1.1", "1.0"]
# Limits of a project document.
LIMITS = {"depth": 25, "items": 5000, "bytes": 20_000_000}
COLLECTION_LIMITS = {
    "highlights": 2000,
    "unresolvedHighlights": 2000,
    "manualHighlights": 2000,
    "legend": 200,
    "groupNames": 500,
    "groupMeta": 500,
    "importCorrections": 5000,
    "importRows": 5000,
}
FORBIDDEN_KEYS = ["__proto__", "constructor", "prototype"]
# Known fields of a project document.
KNOWN_FIELDS = [
    "appVersion", "schemaVersion", "boundaryProviderId", "boundaryVersion", "registryVersion",
    "sourceVersion", "title", "highlights", "manualHighlights", "regionRefs", "unresolvedHighlights",
    "legend", "legendVisible", "legendPosition", "groupNames", "groupMeta", "importCorrections",
    "workflowStage", "uiMode", "importRows", "visualization", "exportMeta", "exportSettings",
    "migrationReport", "brandMigrationReport", "storageMigrationReport", "savedAt",
]
# Longest text kept per field of an imported row and of a highlight.
ROW_LENGTHS = {
    "row_id": 120, "region_code": 120, "province": 120, "region_name": 160, "numeric_value": 120, "category": 120,
    "source": 160, "period": 80, "matched_id": 120, "matched_name": 180, "match_status": 60, "class_key": 80,
}
HIGHLIGHT_LENGTHS = {"category": 80, "value": 80}
# Choices of the export settings, the default first.
SETTING_CHOICES = {
    "ratio": ["16:9", "4:3", "a4", "a3", "1:1", "bounds"],
    "extent": ["national", "current-view"],
    "png_size": ["1920x1080", "2560x1440", "3840x2160"],
    "ui_mode": ["basic", "advanced"],
    "workflow_stage": ["input", "match", "visualize", "export"],
}

_STYLE = "map<string,struct<color:string,category:string,value:string>>"
DOCUMENT = (
    "struct<schemaVersion:string,boundaryProviderId:string,boundaryVersion:string,registryVersion:string,title:string,"
    f"highlights:{_STYLE},manualHighlights:{_STYLE},unresolvedHighlights:{_STYLE},"
    "regionRefs:map<string,struct<canonicalRegionId:string>>,"
    "importCorrections:map<string,struct<action:string,targetId:string,registryVersion:string,decidedAt:string>>>"
)
SOURCES = ["highlights", "unresolvedHighlights", "manualHighlights"]


def parse(projects: DataFrame) -> DataFrame:
    return projects.withColumn("doc", F.from_json("document", DOCUMENT))


def compatibility(parsed: DataFrame, provider_id: str, boundary_version: str = BOUNDARY_VERSION) -> DataFrame:
    """Add provider_status: compatible, legacy-compatible, legacy-unpinned or review-required."""
    provider, boundary = text.text_of("doc.boundaryProviderId"), text.text_of("doc.boundaryVersion")
    status = (
        F.when((provider == "") & (boundary == boundary_version), "legacy-compatible")
        .when((provider == "") & (boundary == ""), "legacy-unpinned")
        .when((provider != provider_id) | (boundary != boundary_version), "review-required")
        .otherwise("compatible")
    )
    return parsed.withColumn("provider_status", status)


def adapter(regions: DataFrame) -> DataFrame:
    """(region_id, canonical_region_id, ref_status) of the current registry."""
    return regions.filter(text.text_of("region_id") != "").select(
        "region_id",
        text.canonical_region_id("geometry_source_id", "region_id").alias("canonical_region_id"),
        F.when(F.col("match_status") == "ambiguous_name", "ambiguous_metadata").otherwise("mapped").alias("ref_status"),
    )


def saved_regions(parsed: DataFrame) -> DataFrame:
    """All region ids a project names, with source and style, one row per mention."""
    parts = None
    for priority, name in enumerate(SOURCES):
        part = parsed.select(
            "project_id",
            F.lit(priority).alias("priority"),
            F.explode(f"doc.{name}").alias("region_id", "style"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def stable_ids(parsed: DataFrame) -> DataFrame:
    """Distinct region ids of a project over all its collections."""
    keys = F.array_distinct(
        F.flatten(F.array(*[F.coalesce(F.map_keys(f"doc.{n}"), F.array().cast("array<string>")) for n in [*SOURCES, "regionRefs"]]))
    )
    return parsed.select("project_id", F.explode(keys).alias("region_id"))


def reconcile(parsed: DataFrame, regions: DataFrame, provider_id: str) -> DataFrame:
    """One row per project and region id: outcome and kept style.

    Of several mentions the first source wins (highlights, unresolved, manual).
    Nothing is lost: ids the registry lacks, and all ids of a project that needs a
    provider review, are kept as missing.
    """
    checked = compatibility(parsed, provider_id)
    first = saved_regions(checked).groupBy("project_id", "region_id").agg(F.min(F.struct("priority", "style")).alias("_m"))
    facts = checked.select(
        "project_id",
        F.col("doc.schemaVersion").alias("_schema"),
        (F.col("provider_status") == "review-required").alias("_frozen"),
    )
    pinned = checked.select("project_id", F.explode("doc.regionRefs").alias("region_id", "_ref")).select(
        "project_id", "region_id", F.col("_ref.canonicalRegionId").alias("_pinned")
    )
    joined = first.join(facts, "project_id").join(pinned, ["project_id", "region_id"], "left")
    joined = lookup_join(joined, adapter(regions), ["region_id"], "left", spread=["project_id", "region_id"])
    source = F.element_at(F.lit(SOURCES), F.col("_m.priority") + 1)
    outcome = (
        F.when(F.col("_frozen") | F.col("canonical_region_id").isNull(), "missing")
        .when(F.col("_m.priority") == 2, "manual")
        .when((F.col("_m.priority") == 0) & (F.col("_schema") == CURRENT_SCHEMA) & (F.col("_pinned") == F.col("canonical_region_id")), "unchanged")
        .when(F.col("ref_status") == "ambiguous_metadata", "ambiguous")
        .otherwise("mapped")
    )
    return joined.select(
        "project_id",
        "region_id",
        source.alias("source"),
        outcome.alias("outcome"),
        F.when(outcome != "missing", F.col("canonical_region_id")).alias("canonical_region_id"),
        F.col("_m.style.color").alias("color"),
        *[F.substring(text.text_of(f"_m.style.{c}"), 1, n).alias(c) for c, n in HIGHLIGHT_LENGTHS.items()],
    )


def stale_decisions(parsed: DataFrame, registry_version: str = REGISTRY_VERSION) -> DataFrame:
    """Saved match decisions; those of another registry version are reported and dropped."""
    listed = parsed.select("project_id", F.explode("doc.importCorrections").alias("row_id", "decision"))
    version = text.text_of("decision.registryVersion")
    return listed.select(
        "project_id",
        F.substring("row_id", 1, 120).alias("row_id"),
        F.col("decision.action").alias("action"),
        F.when((version != "") & (version != registry_version), "dropped").otherwise("kept").alias("outcome"),
    )


def report(reconciled: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Counts per outcome and the review flag; unsupported is (project_id, entries)."""
    outcomes = ["unchanged", "mapped", "ambiguous", "missing"]
    counts = reconciled.groupBy("project_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])
    joined = counts.join(unsupported, "project_id", "full_outer").na.fill(0)
    return joined.select(
        "project_id",
        *outcomes,
        F.col("entries").alias("unsupported"),
        ((F.col("missing") + F.col("ambiguous") + F.col("entries")) > 0).alias("requires_review"),
    )


def unsupported_entries(parsed: DataFrame, provider_id: str) -> DataFrame:
    """(project_id, entries): unknown fields, provider review and stale decisions."""
    unknown = F.size(F.array_except(F.json_object_keys("document"), F.lit(KNOWN_FIELDS)))
    review = (F.col("provider_status") == "review-required").cast("int")
    base = compatibility(parsed, provider_id).select("project_id", (F.greatest(unknown, F.lit(0)) + review).alias("n"))
    stale = stale_decisions(parsed).filter("outcome = 'dropped'").select("project_id", F.lit(1).alias("n"))
    return base.unionByName(stale).groupBy("project_id").agg(F.sum("n").cast("bigint").alias("entries"))


def field_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, field, change): retained, migrated or dropped, by JSON value of each field."""

    def fields(df: DataFrame, name: str) -> DataFrame:
        return df.select("project_id", F.explode(F.from_json("document", "map<string,string>")).alias("field", name))

    joined = fields(before, "old").withColumn("_old", F.lit(True)).join(
        fields(after, "new").withColumn("_new", F.lit(True)), ["project_id", "field"], "full_outer"
    )
    change = F.when(F.col("_new").isNull(), "dropped").when(F.col("_old") & F.col("old").eqNullSafe(F.col("new")), "retained").otherwise("migrated")
    return joined.select("project_id", "field", change.alias("change"))


def migrate_defaults(df: DataFrame, column: str, old_defaults: list[str], new_default: str) -> DataFrame:
    """Exact old default texts become the new one; the report column says which did."""
    old = text.text_of(column).isin(old_defaults)
    return df.withColumns(
        {f"{column}_migration": F.when(old, "migrated").otherwise("retained"), column: F.when(old, new_default).otherwise(F.col(column))}
    )


def cut_fields(df: DataFrame, lengths: dict[str, int] = ROW_LENGTHS) -> DataFrame:
    return df.withColumns({c: F.substring(text.text_of(c), 1, n) for c, n in lengths.items() if c in df.columns})


def default_choices(df: DataFrame, choices: dict[str, list[str]] = SETTING_CHOICES) -> DataFrame:
    """Values outside their choices fall back to the first choice."""
    return df.withColumns(
        {c: F.when(F.col(c).isin(values), F.col(c)).otherwise(values[0]) for c, values in choices.items() if c in df.columns}
    )


def _structure(value: Column) -> Column:
    """struct<nodes, depth, items, forbidden> of a variant: its depth (to one more than allowed), the most entries
    of one of its parts, and whether a key is forbidden. Level by level: nodes holds the parts of the next one."""

    def keyed(node: Column) -> Column:
        return F.try_variant_get(node, "$", "map<string,variant>")

    def listed(node: Column) -> Column:
        return F.coalesce(F.map_values(keyed(node)), F.try_variant_get(node, "$", "array<variant>"))

    def deeper(found: Column, depth: Column) -> Column:
        inside = F.filter(F.transform(found["nodes"], listed), lambda parts: parts.isNotNull())
        keys = F.flatten(F.transform(found["nodes"], lambda node: F.coalesce(F.map_keys(keyed(node)), F.array().cast("array<string>"))))
        return F.struct(
            F.flatten(inside).alias("nodes"),
            F.when(F.size(found["nodes"]) > 0, depth).otherwise(found["depth"]).alias("depth"),
            F.greatest(found["items"], F.array_max(F.transform(inside, lambda parts: F.size(parts)))).alias("items"),
            (found["forbidden"] | F.arrays_overlap(keys, F.array(*map(F.lit, FORBIDDEN_KEYS)))).alias("forbidden"),
        )

    start = F.struct(
        F.array(value).alias("nodes"), F.lit(-1).alias("depth"), F.lit(0).alias("items"), F.lit(False).alias("forbidden")
    )
    levels = F.aggregate(F.sequence(F.lit(0), F.lit(LIMITS["depth"])), start, deeper)
    last = F.when(F.size(levels["nodes"]) > 0, F.lit(LIMITS["depth"] + 1)).otherwise(levels["depth"])
    return F.struct(last.alias("depth"), levels["items"].alias("items"), levels["forbidden"].alias("forbidden"))


def _version() -> Column:
    """Schema version of a document's outermost object; where the text is no JSON, the first one that a pattern finds."""
    found = F.variant_get("_tree", "$.schemaVersion", "variant")
    said = F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get("_tree", "$.schemaVersion", "string"))
    seen = F.regexp_extract("document", r'"schemaVersion"\s*:\s*"([^"]*)"', 1)
    return F.when(F.col("_tree").isNull(), seen).otherwise(F.coalesce(said, F.lit("")))


def document_checks(projects: DataFrame) -> DataFrame:
    """(project_id, issues): safety verdict of each document, an array that is empty where it is fine.

    A document that cannot be read as one JSON value, that nests beyond what the parser
    takes, or that repeats a key within an object, is not-json; so is a null one.
    """
    # Styles are read where a text can hold them: a key is spelled out, or escaped.
    styled = F.contains("document", F.lit("ighlights")) | F.contains("document", F.lit("\\"))
    read = projects.withColumns({"doc": F.when(styled, F.from_json("document", DOCUMENT)), "_tree": F.try_parse_json("document")})
    checked = read.withColumn("_s", _structure(F.col("_tree")))

    def entries(name: str) -> Column:
        part = f"$.{name}"
        keyed = F.map_keys(F.try_variant_get("_tree", part, "map<string,variant>"))
        return F.coalesce(F.size(keyed), F.size(F.try_variant_get("_tree", part, "array<variant>")), F.lit(0))

    styles = F.flatten(F.array(*[F.coalesce(F.map_values(f"doc.{n}"), F.array().cast("array<struct<color:string,category:string,value:string>>")) for n in SOURCES]))
    conditions = {
        "not-json": F.col("_tree").isNull(),
        "too-deep": F.col("_s.depth") > LIMITS["depth"],
        "too-many-items": F.col("_s.items") > LIMITS["items"],
        "forbidden-key": F.col("_s.forbidden"),
        "too-large": F.octet_length("document") > LIMITS["bytes"],
        "schema-version": ~_version().isin(SUPPORTED_SCHEMAS),
        "color": F.exists(styles, lambda s: ~text.is_color(s["color"])),
        **{f"too-many-{n}": entries(n) > limit for n, limit in COLLECTION_LIMITS.items()},
    }
    return checked.select(
        "project_id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in conditions.items()])).alias("issues")
    )
