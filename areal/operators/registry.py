"""Region registry: feature normalisation, lookup keys, canonical ids, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal.functions import text
from areal.plans.sizing import checkpoint, is_small, lookup_join

CANDIDATE_LIMIT = 20  # fixed value: candidates listed per row

# Release labels carried by every derived row.
BOUNDARY_VERSION = "IDN-ADM2-2020-geoboundaries-22746128"
PREVIOUS_BOUNDARY_VERSION = "IDN-ADM2-2020-CODAB-geoboundaries"
REGISTRY_VERSION = "IDN-ADM-REGISTRY-v1-2025-06-23"
INDEX_VERSION = REGISTRY_VERSION + ":matching-v2"
ACCESS_DATE = "2026-07-12"
PROVINCE_SOURCE_VERSION = "Kepmendagri-300.2.2-2138-2025-as-amended-by-300.2.2-2430-2025"

# Tiers of the cascade, strongest first. A code is tried dotted, then undotted.
TIERS = {
    10: ("official-code", "exact-code"),
    11: ("official-code", "exact-code"),
    20: ("canonical-name-province", "exact-name-province"),
    30: ("alias-province", "exact-alias-province"),
    40: ("normalized-name-province", "normalized-name-province"),
    50: ("name-only", "ambiguous"),
}


def optional(df: DataFrame, *names: str) -> Column:
    """First non-empty of the named columns that exist, else the empty text."""
    present = [F.nullif(text.text_of(name), F.lit("")) for name in names if name in df.columns]
    return F.coalesce(*present, F.lit(""))


def parse_aliases(c) -> Column:
    """'name | province | code ; ...' as array of structs; entries without a name drop out."""
    entries = F.transform(
        F.split(text.text_of(c), ";"),
        lambda entry: F.filter(F.transform(F.split(entry, r"\|"), text.trim), lambda part: part != ""),
    )

    def part(parts: Column, position: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(position)), F.lit(""))

    structs = F.transform(
        entries,
        lambda parts: F.struct(part(parts, 0).alias("name"), part(parts, 1).alias("province"), part(parts, 2).alias("code")),
    )
    return F.filter(structs, lambda alias: alias["name"] != "")


def normalize_features(df: DataFrame) -> DataFrame:
    """Bring the property spellings of different sources to one schema.

    Rows without any id keep a NULL region_id; see reject_unidentified().
    """
    source_id = text.trim(optional(df, "geometry_source_id", "shapeID", "shape_id"))
    named = df.withColumns(
        {
            "_source": source_id,
            "_region": text.trim(optional(df, "region_name", "name", "geometry_source_name", "shapeName")),
            "_province": text.trim(optional(df, "province_name", "province")),
            "_type": text.trim(optional(df, "region_type", "type_name")),
            "_shown": optional(df, "display_name"),
            "_id": optional(df, "region_id", "stable_region_id", "id"),
        }
    )
    derived_id = F.when(F.col("_source") != "", F.concat(F.lit("gb-"), F.col("_source"))).otherwise("")
    region_id = text.trim(F.when(F.col("_id") != "", F.col("_id")).otherwise(derived_id))
    composed = F.concat_ws(" ", F.nullif("_type", F.lit("")), F.nullif("_region", F.lit("")))
    shown = F.coalesce(F.nullif("_shown", F.lit("")), F.nullif(composed, F.lit("")), region_id)
    return named.withColumns(
        {
            "region_id": F.nullif(region_id, F.lit("")),
            "geometry_source_id": F.col("_source"),
            "region_name": F.col("_region"),
            "province_name": F.col("_province"),
            "region_type": F.col("_type"),
            "display_name": text.trim(shown),
        }
    ).drop("_source", "_region", "_province", "_type", "_shown", "_id")


def reject_unidentified(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    return features.filter("region_id IS NOT NULL"), features.filter("region_id IS NULL")


def records(regions: DataFrame) -> DataFrame:
    """The descriptive fields used by matching, one row per region."""
    region_type = optional(regions, "region_type")
    name = optional(
        regions, "official_current_name_verified", "region_name", "geometry_source_name", "display_name"
    )
    composed = F.concat_ws(" ", F.nullif(region_type, F.lit("")), F.nullif(name, F.lit("")))
    source_id = optional(regions, "geometry_source_id", "region_id")
    return regions.filter(optional(regions, "region_id") != "").select(
        F.col("region_id"),
        text.canonical_region_id(source_id).alias("canonical_region_id"),
        F.coalesce(F.nullif(optional(regions, "display_name"), F.lit("")), composed).alias("display_name"),
        name.alias("region_name"),
        region_type.alias("region_type"),
        optional(regions, "province_name", "geometry_snapshot_province").alias("province"),
        optional(regions, "official_code", "official_code_normalized").alias("official_code"),
        optional(regions, "geometry_source_name").alias("source_name"),
        optional(regions, "match_status").alias("match_status"),
        parse_aliases(optional(regions, "alternative_names")).alias("aliases"),
    )


def build_keys(regions: DataFrame) -> DataFrame:
    """Long lookup table (key_type, tier, key, region_id), distinct."""
    base = records(regions)
    alias = base.select("region_id", "province", F.inline("aliases").alias("name", "alias_province", "code")).select(
        "region_id",
        F.when(F.col("alias_province") != "", F.col("alias_province")).otherwise(F.col("province")).alias("province"),
        "name",
        "code",
    )
    names = base.select(
        "region_id", "province", F.explode(F.array_distinct(F.array("region_name", "display_name", "source_name"))).alias("name")
    ).filter("name <> ''")
    # Every name is folded once; the keys of all tiers come from the folded text.
    folded = (
        names.select("region_id", "province", "name", F.lit(20).alias("tier"))
        .unionByName(alias.select("region_id", "province", "name", F.lit(30).alias("tier")))
        .select("region_id", "tier", text.ascii_fold("province").alias("province"), text.ascii_fold("name").alias("name"))
    )

    def keyed(tier, key) -> Column:
        return F.struct(F.lit(tier).alias("tier") if isinstance(tier, int) else tier.alias("tier"), key.alias("key"))

    by_name = folded.select(
        "region_id",
        F.inline(
            F.array(
                keyed(F.col("tier"), F.concat(text.exact_key("province"), F.lit("|"), text.exact_key("name"))),
                keyed(40, F.concat(text.text_key("province"), F.lit("|"), text.text_key("name"))),
                keyed(50, text.text_key("name")),
            )
        ),
    )
    codes = base.select("region_id", F.col("official_code").alias("code")).unionByName(alias.select("region_id", "code"))
    by_code = codes.select("region_id", F.lit(10).alias("tier"), F.explode(text.code_variants("code")).alias("key"))
    long = by_code.unionByName(by_name).filter("key <> ''").distinct()
    key_type = None
    for tier, (name, _) in TIERS.items():
        key_type = F.when(F.col("tier") == tier, name) if key_type is None else key_type.when(F.col("tier") == tier, name)
    return long.select(key_type.alias("key_type"), "tier", "key", "region_id")


def lookup_index(keys: DataFrame, listed: int = CANDIDATE_LIMIT) -> DataFrame:
    """One row per key: how many regions it names and the first listed ones (match.all_candidates gives every one).

    The exact count comes from a plain aggregate; the list is cut by a ranked
    window, which Spark limits before the shuffle, so no key is gathered whole.
    """
    counts = keys.groupBy("tier", "key").agg(F.count("*").alias("n_candidates"))
    first = (
        keys.withColumn("_n", F.row_number().over(Window.partitionBy("tier", "key").orderBy("region_id")))
        .filter(F.col("_n") <= listed)
        .groupBy("tier", "key")
        .agg(F.sort_array(F.collect_list("region_id")).alias("candidates"))
    )
    return counts.join(first, ["tier", "key"])


def shared_index(regions: DataFrame) -> tuple[DataFrame, bool]:
    """The lookup index of a registry, written once for all its uses, and whether it is small."""
    index = checkpoint(lookup_index(build_keys(regions)))
    return index, is_small(index)


def canonical(df: DataFrame) -> DataFrame:
    """Canonical region registry; ambiguous rows never carry verified values."""
    unsure = F.col("match_status") == "ambiguous_name"
    blank = F.lit("")
    reason = F.coalesce(F.nullif(optional(df, "notes"), blank), F.lit("Several administrative candidates share this name."))
    return df.select(
        text.canonical_region_id("geometry_source_id").alias("canonical_region_id"),
        F.col("internal_id").alias("geometry_feature_id"),
        F.col("internal_id").alias("legacy_region_id"),
        "geometry_source_id",
        "geometry_source_name",
        F.coalesce(F.nullif(text.text_of("display_name"), blank), F.col("geometry_source_name")).alias("geometry_snapshot_name"),
        blank.alias("official_current_name_verified"),
        F.when(unsure, "unresolved").otherwise(F.col("region_type")).alias("region_type"),
        blank.alias("current_province_id_verified"),
        F.col("province_name").alias("geometry_snapshot_province"),
        blank.alias("kemendagri_code_verified"),
        blank.alias("bps_code_verified"),
        F.col("alternative_names").alias("aliases"),
        F.when(unsure, "").otherwise("2020-01-01").alias("valid_from"),
        blank.alias("valid_to"),
        F.when(unsure, "ambiguous_metadata_unresolved").otherwise("geometry_snapshot_metadata_only").alias("status"),
        "match_status",
        F.when(unsure, reason).otherwise("").alias("ambiguity_reason"),
        F.lit(BOUNDARY_VERSION).alias("geometry_boundary_version"),
        F.when(unsure, "HDX-COD-AB-2020-candidates-unresolved")
        .otherwise("HDX-COD-AB-2020-geometry-metadata")
        .alias("metadata_source_version"),
        F.lit(ACCESS_DATE).alias("source_access_date"),
        F.when(unsure, "Needs row-level evidence before any official value is set.")
        .otherwise("Values describe the 2020 snapshot; verified fields stay blank.")
        .alias("notes"),
    )


def crosswalk(df: DataFrame) -> DataFrame:
    """Legacy id to canonical id, with the review flag and both versions."""
    unsure = F.col("match_status") == "ambiguous_name"
    return df.select(
        F.col("internal_id").alias("legacy_region_id"),
        text.canonical_region_id("geometry_source_id").alias("canonical_region_id"),
        F.col("internal_id").alias("geometry_feature_id"),
        F.when(unsure, "ambiguous_metadata").otherwise("remapped_to_canonical_id").alias("mapping_status"),
        F.lit(PREVIOUS_BOUNDARY_VERSION).alias("boundary_version_from"),
        F.lit(BOUNDARY_VERSION).alias("boundary_version_to"),
        F.when(unsure, "yes").otherwise("no").alias("requires_user_review"),
        F.when(unsure, "Usable by legacy id; official metadata is unresolved.")
        .otherwise("Legacy id maps to the canonical id; the geometry id is unchanged.")
        .alias("notes"),
    )


def provinces(df: DataFrame, source_url: str = "") -> DataFrame:
    """Province registry from (canonical_province_id, official_display_name, aliases_legacy_names) and, where they
    are there, official_code_verified, valid_from, valid_to, status and notes."""
    return df.select(
        "canonical_province_id",
        "official_display_name",
        text.normalize_name("official_display_name").alias("normalized_name"),
        "aliases_legacy_names",
        optional(df, "official_code_verified").alias("official_code_verified"),
        F.coalesce(F.nullif(optional(df, "valid_from"), F.lit("")), F.lit("2025-04-25")).alias("valid_from"),
        optional(df, "valid_to").alias("valid_to"),
        F.coalesce(F.nullif(optional(df, "status"), F.lit("")), F.lit("current")).alias("status"),
        F.lit(PROVINCE_SOURCE_VERSION).alias("source_version"),
        F.lit(source_url).alias("source_url"),
        F.lit(ACCESS_DATE).alias("source_access_date"),
        optional(df, "notes").alias("notes"),
    )


def province_aliases(provinces_df: DataFrame) -> DataFrame:
    """(alias_key, canonical_province_id) over names and '|'-separated aliases."""
    names = F.concat(
        F.array("official_display_name"), F.filter(F.split("aliases_legacy_names", r"\|"), lambda a: a != "")
    )
    return (
        provinces_df.select("canonical_province_id", F.explode(names).alias("name"))
        .select(text.normalize_name("name").alias("alias_key"), "canonical_province_id")
        .distinct()
    )


def resolve_province(df: DataFrame, name_col: str, aliases: DataFrame) -> DataFrame:
    keyed = df.withColumn("alias_key", text.normalize_name(name_col))
    return lookup_join(keyed, aliases, ["alias_key"], "left").drop("alias_key")


def enrich_unique(regions: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach reference metadata where the normalised name is unique; report the rest.

    regions: (geometry_source_id, geometry_source_name); reference:
    (official_code, province_name, region_name, alternative_names as '|' list).
    Returns (regions with candidate_count and, where unique, the metadata;
    mismatch report).
    """
    names = F.concat(F.array("region_name"), F.split(text.text_of("alternative_names"), r"\|"))
    reference_keys = (
        reference.withColumn("_name", F.explode(names))
        .withColumn("name_key", text.normalize_text("_name"))
        .filter("name_key <> ''")
        .select("name_key", "official_code", "province_name", "region_name")
        .distinct()
    )
    meta = F.struct("official_code", "province_name", "region_name")
    per_key = reference_keys.groupBy("name_key").agg(
        F.count("*").alias("candidate_count"), F.min(meta).alias("reference")
    )
    keyed = regions.withColumn("name_key", text.normalize_text("geometry_source_name"))
    joined = lookup_join(keyed, per_key, ["name_key"], "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0)).cast("bigint")
    )
    unique = F.col("candidate_count") == 1
    matched = joined.select(
        *regions.columns,
        "candidate_count",
        *[F.when(unique, F.col(f"reference.{c}")).otherwise("").alias(c) for c in ("official_code", "province_name", "region_name")],
        F.when(unique, "matched").when(F.col("candidate_count") > 1, "ambiguous_name").otherwise("unmatched").alias("match_status"),
    )
    used = matched.filter("match_status = 'matched'").select("official_code", "province_name", "region_name").distinct()
    columns = [
        "issue_type", "geometry_source_name", "geometry_source_id", "official_code", "province_name", "region_name", "candidate_count",
    ]
    left_over = matched.filter("match_status <> 'matched'").select(
        F.when(F.col("match_status") == "unmatched", "geometry_without_candidate").otherwise("ambiguous_geometry_name").alias("issue_type"),
        *columns[1:],
    )
    unused = lookup_join(reference, used, ["official_code", "province_name", "region_name"], "left_anti").select(
        F.lit("official_without_unique_geometry_match").alias("issue_type"),
        F.lit("").alias("geometry_source_name"),
        F.lit("").alias("geometry_source_id"),
        "official_code",
        "province_name",
        "region_name",
        F.lit(None).cast("bigint").alias("candidate_count"),
    )
    return matched, left_over.unionByName(unused)


def by_stable_id(features: DataFrame, region_id: str) -> DataFrame:
    return features.filter(F.col("region_id") == region_id)


def search(regions: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Registry search: the normalised query inside the normalised descriptive text."""
    fields = F.concat_ws(" ", *[text.text_of(c) for c in ("display_name", "province_name", "official_code", "geometry_source_name")])
    needle = text.normalize_text(F.lit(query), "import")
    hits = regions.filter((needle != "") & text.normalize_text(fields, "import").contains(needle))
    return hits.orderBy("region_id").limit(limit)


def in_province(regions: DataFrame, choice: str | None) -> DataFrame:
    """'__all' or None: every region; '__unresolved': no province; else one province."""
    province = text.text_of("province_name")
    if choice == "__unresolved":
        return regions.filter(province == "")
    if not choice or choice == "__all":
        return regions
    return regions.filter(province == choice)

