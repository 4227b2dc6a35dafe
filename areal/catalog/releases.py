"""Registry build, quality rules, set comparisons, lineage and saved projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from areal.catalog.matching import ALIASES_SQL  # noqa: F401  (defines the aliases input)
from areal.catalog.registered import Tables, query
from areal.catalog.scalars import sql_text
from areal.operators import lineage, project, quality, registry
from areal.plans import inputs
from areal.plans.sizing import spread

_B, _R, _P = registry.BOUNDARY_VERSION, registry.REGISTRY_VERSION, registry.PREVIOUS_BOUNDARY_VERSION

# A registry release as large as the supplier and customer tables: one region per customer.
inputs.DERIVED["old_registry"] = """
SELECT concat('gb-C', CAST(c_custkey AS STRING)) AS internal_id, concat('gb-C', CAST(c_custkey AS STRING)) AS region_id, concat('C', CAST(c_custkey AS STRING)) AS geometry_source_id,
       c_name AS geometry_source_name, CASE WHEN c_acctbal > 9000 THEN '' ELSE concat('Kota ', c_name) END AS display_name, c_mktsegment AS region_name, CASE WHEN c_nationkey % 2 = 0 THEN 'Kota' ELSE 'Kabupaten' END AS region_type,
       n_name AS province_name, concat(CAST(c_nationkey + 10 AS STRING), '.', CAST(c_custkey % 1400 AS STRING)) AS official_code, 'x | y' AS alternative_names, CASE WHEN c_acctbal < 1000 THEN 'ambiguous_name' ELSE 'matched' END AS match_status,
       CASE WHEN c_acctbal < 0 THEN 'two candidates' ELSE '' END AS notes
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"""
_UNSURE = "match_status = 'ambiguous_name'"


@query(
    "r1_canonical_registry",
    f"""SELECT concat('idn-adm2-gb-', lower(geometry_source_id)) AS canonical_region_id, internal_id AS geometry_feature_id, internal_id AS legacy_region_id, geometry_source_id, geometry_source_name,
        CASE WHEN display_name = '' THEN geometry_source_name ELSE display_name END AS geometry_snapshot_name, '' AS official_current_name_verified, CASE WHEN {_UNSURE} THEN 'unresolved' ELSE region_type END AS region_type,
        '' AS current_province_id_verified, province_name AS geometry_snapshot_province, '' AS kemendagri_code_verified, '' AS bps_code_verified, alternative_names AS aliases, CASE WHEN {_UNSURE} THEN '' ELSE '2020-01-01' END AS valid_from, '' AS valid_to,
        CASE WHEN {_UNSURE} THEN 'ambiguous_metadata_unresolved' ELSE 'geometry_snapshot_metadata_only' END AS status, match_status,
        CASE WHEN {_UNSURE} THEN CASE WHEN notes = '' THEN 'Several administrative candidates share this name.' ELSE notes END ELSE '' END AS ambiguity_reason, '{_B}' AS geometry_boundary_version,
        CASE WHEN {_UNSURE} THEN 'HDX-COD-AB-2020-candidates-unresolved' ELSE 'HDX-COD-AB-2020-geometry-metadata' END AS metadata_source_version, '2026-07-12' AS source_access_date,
        CASE WHEN {_UNSURE} THEN 'Needs row-level evidence before any official value is set.' ELSE 'Values describe the 2020 snapshot; verified fields stay blank.' END AS notes FROM {{old_registry}}""",
)
def r1(t):
    return registry.canonical(t.old_registry)


@query(
    "r2_crosswalk",
    f"""SELECT internal_id AS legacy_region_id, concat('idn-adm2-gb-', lower(geometry_source_id)) AS canonical_region_id, internal_id AS geometry_feature_id, CASE WHEN {_UNSURE} THEN 'ambiguous_metadata' ELSE 'remapped_to_canonical_id' END AS mapping_status,
        '{_P}' AS boundary_version_from, '{_B}' AS boundary_version_to, CASE WHEN {_UNSURE} THEN 'yes' ELSE 'no' END AS requires_user_review,
        CASE WHEN {_UNSURE} THEN 'Usable by legacy id; official metadata is unresolved.' ELSE 'Legacy id maps to the canonical id; the geometry id is unchanged.' END AS notes FROM {{old_registry}}""",
)
def r2(t):
    return registry.crosswalk(t.old_registry)


inputs.DERIVED["province_rows"] = """SELECT concat('prov-', CAST(s_suppkey AS STRING)) AS canonical_province_id, concat('Provinsi ', s_name) AS official_display_name, concat('Old ', CAST(s_suppkey AS STRING), '|Daerah ', s_name, ' Baru|') AS aliases_legacy_names, CASE WHEN s_suppkey % 10 = 4 THEN '31' ELSE '' END AS official_code_verified, CASE WHEN s_suppkey % 10 = 3 THEN 'former' ELSE '' END AS status, CASE WHEN s_suppkey % 10 = 3 THEN '2024-01-01' ELSE '' END AS valid_to, concat('note ', s_name) AS notes FROM {supplier}"""
_NAME = r"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '\b(daerah|provinsi|province)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "r3_province_registry",
    f"""SELECT canonical_province_id, official_display_name, {_NAME.format(c='official_display_name')} AS normalized_name, aliases_legacy_names, official_code_verified, '2025-04-25' AS valid_from, valid_to, CASE WHEN status = '' THEN 'current' ELSE status END AS status,
        '{registry.PROVINCE_SOURCE_VERSION}' AS source_version, 'https://example.org/decree' AS source_url, '2026-07-12' AS source_access_date, notes FROM {{province_rows}}""",
)
def r3(t):
    return registry.provinces(t.province_rows, "https://example.org/decree")


@query(
    "j16_province_aliases",
    f"""WITH a AS (SELECT DISTINCT {_NAME.format(c='name')} AS k, canonical_province_id FROM (SELECT canonical_province_id, official_display_name AS name FROM {{province_rows}} UNION ALL
        SELECT canonical_province_id, unnest(string_split(aliases_legacy_names, '|')) FROM {{province_rows}}) WHERE name <> '')
        SELECT l_orderkey, l_linenumber, canonical_province_id FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN concat('OLD ', CAST(l_suppkey AS VARCHAR)) ELSE concat('Nowhere ', CAST(l_suppkey AS VARCHAR)) END AS place FROM {{lineitem}}) l LEFT JOIN a ON a.k = lower(place)""",
)
def j16(t):
    places = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat(F.when(F.col("l_returnflag") == "A", "OLD ").otherwise("Nowhere "), "l_suppkey").alias("place")
    )
    resolved = registry.resolve_province(places, "place", registry.province_aliases(t.province_rows))
    return resolved.select("l_orderkey", "l_linenumber", "canonical_province_id")


# Reference rows with repeated names, enriched onto the registry.
inputs.DERIVED["reference_rows"] = """SELECT concat('R', CAST(p_partkey AS STRING)) AS official_code, p_type AS province_name, concat('Part ', CAST(p_partkey % 1200 AS STRING)) AS region_name, CASE WHEN p_size > 40 THEN concat('Alt ', CAST(p_partkey AS STRING), '|Other ', CAST(p_size AS STRING)) ELSE '' END AS alternative_names FROM {part}"""
inputs.DERIVED["shape_rows"] = """SELECT CAST(o_orderkey AS STRING) AS geometry_source_id, CASE o_orderkey % 4 WHEN 0 THEN concat('Alt ', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('Other ', CAST(o_orderkey % 60 AS STRING)) ELSE concat('Kab. Part ', CAST(o_orderkey % 1300 AS STRING)) END AS geometry_source_name FROM {orders}"""
inputs.DERIVED["per_name"] = f"""SELECT k, count(*) AS n, min(ROW(official_code, province_name, region_name)) AS r FROM (SELECT DISTINCT {sql_text('name')} AS k, official_code, province_name, region_name FROM
    (SELECT *, region_name AS name FROM {{reference_rows}} UNION ALL SELECT *, unnest(string_split(alternative_names, '|')) FROM {{reference_rows}}) WHERE name <> '') GROUP BY k"""
inputs.DERIVED["enriched"] = f"""SELECT s.*, coalesce(p.n, 0) AS candidate_count, CASE WHEN p.n = 1 THEN p.r[1] ELSE '' END AS official_code, CASE WHEN p.n = 1 THEN p.r[2] ELSE '' END AS province_name, CASE WHEN p.n = 1 THEN p.r[3] ELSE '' END AS region_name,
    CASE WHEN p.n = 1 THEN 'matched' WHEN p.n > 1 THEN 'ambiguous_name' ELSE 'unmatched' END AS match_status FROM {{shape_rows}} s LEFT JOIN {{per_name}} p ON p.k = {sql_text('geometry_source_name')}"""


@query("j14_unique_name_enrichment", "SELECT * FROM {enriched}")
def j14(t):
    return registry.enrich_unique(t.shape_rows, t.reference_rows)[0]


@query(
    "j14_mismatch_report",
    """SELECT CASE WHEN match_status = 'unmatched' THEN 'geometry_without_candidate' ELSE 'ambiguous_geometry_name' END AS issue_type, geometry_source_name, geometry_source_id, official_code, province_name, region_name, candidate_count FROM {enriched} WHERE match_status <> 'matched'
       UNION ALL SELECT 'official_without_unique_geometry_match', '', '', r.official_code, r.province_name, r.region_name, NULL FROM {reference_rows} r WHERE NOT EXISTS (SELECT 1 FROM {enriched} e WHERE e.match_status = 'matched' AND e.official_code = r.official_code)""",
)
def j14_report(t):
    return registry.enrich_unique(t.shape_rows, t.reference_rows)[1]


@query("j15_orphan_check", "SELECT DISTINCT s_nationkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT c_nationkey FROM {customer} WHERE c_acctbal > 9900)")
def j15(t):
    return quality.orphans(t.supplier, "s_nationkey", t.customer.filter("c_acctbal > 9900"), "c_nationkey")


def _release(t: Tables):
    """A release with faults: verified values on unsure rows, lost rows, wrong flags."""
    canonical = registry.canonical(t.old_registry).withColumns(
        {
            "kemendagri_code_verified": F.when(F.col("geometry_source_id").endswith("7"), "99").otherwise(""),
            "ambiguity_reason": F.when(F.col("geometry_source_id").endswith("3"), "").otherwise(F.col("ambiguity_reason")),
            "current_province_id_verified": F.when(F.col("geometry_source_id").endswith("5"), F.concat(F.lit("prov-"), F.substring("geometry_source_id", 2, 9))).otherwise(""),
        }
    ).filter(~F.col("geometry_source_id").endswith("99"))
    crosswalk = registry.crosswalk(t.old_registry).withColumn(
        "requires_user_review", F.when(F.col("legacy_region_id").endswith("8"), "no").otherwise(F.col("requires_user_review"))
    )
    return {"regions": t.old_registry, "canonical": canonical, "crosswalk": crosswalk, "provinces": registry.provinces(t.province_rows)}


_ENDS = "ends_with(geometry_source_id, '{}')"


@query(
    "r5_quality_rules",
    f"""WITH o AS (SELECT *, {_UNSURE} AS u, NOT {_ENDS.format('99')} AS kept FROM {{old_registry}}),
    f(rule, sample) AS (SELECT 'region.missing.display_name', region_id FROM o WHERE display_name = ''
      UNION ALL SELECT 'canonical.hidden-assignment', internal_id FROM o WHERE u AND kept AND ({_ENDS.format('7')} OR {_ENDS.format('5')})
      UNION ALL SELECT 'canonical.reason-missing', internal_id FROM o WHERE u AND kept AND {_ENDS.format('3')}
      UNION ALL SELECT 'canonical.code-without-evidence', internal_id FROM o WHERE u AND kept AND {_ENDS.format('7')}
      UNION ALL SELECT 'crosswalk.review-flag', internal_id FROM o WHERE u AND ends_with(internal_id, '8')
      UNION ALL SELECT 'province.not-current', canonical_province_id FROM {{province_rows}} WHERE status <> ''
      UNION ALL SELECT 'province.code-filled', canonical_province_id FROM {{province_rows}} WHERE official_code_verified <> ''
      UNION ALL SELECT 'region.duplicate-code', official_code FROM o GROUP BY official_code HAVING count(*) > 1
      UNION ALL SELECT 'canonical.lost-legacy-id', region_id FROM o WHERE NOT kept
      UNION ALL SELECT 'crosswalk.unknown-canonical-id', concat('idn-adm2-gb-', lower(geometry_source_id)) FROM o WHERE NOT kept
      UNION ALL SELECT 'canonical.orphan-province', concat('prov-', geometry_source_id[2:10]) FROM o WHERE kept AND {_ENDS.format('5')} AND concat('prov-', geometry_source_id[2:10]) NOT IN (SELECT canonical_province_id FROM {{province_rows}})),
    names AS (SELECT unnest(['region.missing.region_id', 'region.missing.display_name', 'region.missing.geometry_source_name', 'region.missing.geometry_source_id', 'region.missing.match_status', 'canonical.hidden-assignment', 'canonical.reason-missing', 'canonical.code-without-evidence',
      'canonical.unsure-type', 'canonical.unsure-validity', 'crosswalk.review-flag', 'province.not-current', 'province.code-filled', 'region.duplicate-id', 'region.duplicate-code', 'canonical.duplicate-id', 'province.duplicate-id', 'canonical.lost-legacy-id', 'crosswalk.not-covering', 'crosswalk.unknown-legacy-id', 'crosswalk.unknown-canonical-id', 'canonical.orphan-province']) AS rule FROM (SELECT count(*) FROM {{customer}}))
    SELECT n.rule, count(f.sample) AS failures, min(f.sample) AS sample FROM names n LEFT JOIN f ON f.rule = n.rule GROUP BY n.rule""",
)
def r5(t):
    return quality.run_rules(_release(t), quality.region_rules())


# Source and licence records, one per supplier, with faults by balance.
inputs.DERIVED["source_records"] = """SELECT concat('src-', CAST(s_suppkey - CASE WHEN s_acctbal > 9000 THEN 1 ELSE 0 END AS STRING)) AS id, s_name AS title, CASE WHEN s_acctbal < 0 THEN '' ELSE 'CC-BY' END AS licenseId, concat('file-', CAST(s_suppkey AS STRING)) AS localSnapshotPath, CASE WHEN s_acctbal > 7000 THEN 'aa' ELSE 'bb' END AS sha256 FROM {supplier}"""
inputs.DERIVED["snapshot_files"] = """SELECT concat('file-', CAST(s_suppkey AS STRING)) AS path, 'bb' AS sha256 FROM {supplier} WHERE s_nationkey > 3"""


@query(
    "r6_source_inventory_rules",
    """WITH s AS (SELECT s.*, f.sha256 AS actual, count(*) OVER (PARTITION BY id) AS n FROM {source_records} s LEFT JOIN {snapshot_files} f ON f.path = s.localSnapshotPath)
    SELECT DISTINCT * FROM (SELECT id, 'missing:licenseId' AS issue FROM s WHERE licenseId = '' UNION ALL SELECT id, 'duplicate-id' FROM s WHERE n > 1 UNION ALL SELECT id, 'snapshot-missing' FROM s WHERE actual IS NULL UNION ALL SELECT id, 'checksum-changed' FROM s WHERE actual <> sha256)""",
)
def r6(t):
    return lineage.source_issues(t.source_records, t.snapshot_files, ["title", "licenseId", "sha256"])


inputs.DERIVED["assets"] = """SELECT concat('a-', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_size < 20 THEN 'production-data' ELSE 'tooling' END AS category, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('p/', CAST(p_partkey AS STRING)) END AS path, CASE WHEN p_size = 7 THEN '' ELSE 'hash' END AS sha256,
    CASE WHEN p_size = 9 THEN '' ELSE 'MIT' END AS licenseId, 'https://x' AS exactSource, CASE WHEN p_type = 'ECONOMY' THEN 'Pending review' ELSE 'allowed' END AS commercialUseStatus, CASE WHEN p_size = 11 THEN '' ELSE 'allowed' END AS redistributionStatus,
    p_size > 25 AS attributionRequired, CASE WHEN p_size % 2 = 0 THEN '  ' ELSE 'Credit' END AS attributionText, CASE WHEN p_size % 3 = 0 THEN concat('pkg', CAST(p_size AS STRING)) ELSE '' END AS lockfilePackage, p_retailprice > 950 AS productionApproved FROM {part}"""
inputs.DERIVED["asset_files"] = "SELECT concat('p/', CAST(p_partkey AS STRING)) AS path, CASE WHEN p_size = 4 THEN 'other' ELSE 'hash' END AS sha256 FROM {part} WHERE p_size <> 5"
inputs.DERIVED["locked"] = "SELECT DISTINCT concat('pkg', CAST(p_size AS STRING)) AS package, CASE WHEN p_size > 30 THEN 'GPL' ELSE 'MIT' END AS license FROM {part} WHERE p_size > 12"


@query(
    "r7_license_gate",
    """WITH j AS (SELECT a.*, f.sha256 AS actual, l.license AS locked FROM {assets} a LEFT JOIN {asset_files} f ON f.path = a.path LEFT JOIN {locked} l ON l.package = a.lockfilePackage)
    SELECT DISTINCT * FROM (SELECT id, 'license-missing' AS issue FROM j WHERE licenseId = '' UNION ALL SELECT id, 'commercial-use-unclear' FROM j WHERE commercialUseStatus = 'Pending review' UNION ALL SELECT id, 'redistribution-unclear' FROM j WHERE redistributionStatus = ''
    UNION ALL SELECT id, 'attribution-missing' FROM j WHERE attributionRequired AND trim(attributionText) = '' UNION ALL SELECT id, 'file-missing' FROM j WHERE path <> '' AND actual IS NULL UNION ALL SELECT id, 'sha256-missing' FROM j WHERE path <> '' AND actual IS NOT NULL AND sha256 = ''
    UNION ALL SELECT id, 'checksum-changed' FROM j WHERE path <> '' AND sha256 <> '' AND actual <> sha256 UNION ALL SELECT id, 'not-approved' FROM j WHERE path <> '' AND starts_with(category, 'production') AND NOT productionApproved
    UNION ALL SELECT id, 'package-missing' FROM j WHERE lockfilePackage <> '' AND locked IS NULL UNION ALL SELECT id, 'package-license-changed' FROM j WHERE lockfilePackage <> '' AND locked <> licenseId
    UNION ALL SELECT concat('p/', CAST(p_partkey AS VARCHAR)), 'path-not-covered' FROM {part} WHERE concat('p/', CAST(p_partkey AS VARCHAR)) NOT IN (SELECT path FROM {assets}))""",
)
def r7(t):
    required = t.part.select(F.concat(F.lit("p/"), "p_partkey").alias("path"))
    return lineage.license_gate(t.assets, t.asset_files, t.locked, required)


@query(
    "r8_canonical_text",
    r"SELECT doc_id, sha256(concat(rtrim(replace(concat(text, '  ', chr(13), chr(10)), chr(13), ''), E' \n\t\r'), chr(10))) AS digest FROM {documents}",
)
def r8(t):
    raw = F.concat("text", F.lit("  \r\n"))
    return t.documents.select("doc_id", lineage.digest(lineage.canonical_text(raw)).alias("digest"))


@query("f26_stable_json", """SELECT event_id, concat('{"a":{"k":', regexp_extract(props, '(\\d+)', 1), ',"z":1},"b":"', event_type, '"}') AS v FROM {events}""")
def f26(t):
    mixed = F.concat(F.lit('{"b": "'), "event_type", F.lit('", "a": {"z": 1, "k": '), F.regexp_extract("props", r"(\d+)", 1), F.lit("}}"))
    return t.events.select("event_id", lineage.stable_json(mixed).alias("v"))


@query("r9_fingerprints", "SELECT doc_id AS path, sha256(text) AS sha256 FROM {documents}")
def r9(t):
    return t.documents.select(F.col("doc_id").alias("path"), lineage.digest("text").alias("sha256"))


inputs.DERIVED["pinned"] = "SELECT CAST(o_custkey AS STRING) AS path, CAST(count(*) AS STRING) AS sha256, count(*) AS features, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS vertices FROM {orders} WHERE o_totalprice > 20000 GROUP BY o_custkey"
inputs.DERIVED["rebuilt"] = "SELECT CAST(o_custkey AS STRING) AS path, CAST(count(*) AS STRING) AS sha256, count(*) AS features, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS vertices FROM {orders} WHERE o_totalprice < 450000 GROUP BY o_custkey"


@query(
    "r10_drift_report",
    """SELECT path, CASE WHEN changes = '' THEN 'no_drift' ELSE 'review_required' END AS status, changes FROM (SELECT coalesce(p.path, a.path) AS path,
       concat_ws(',', CASE WHEN p.path IS NULL THEN 'added' END, CASE WHEN a.path IS NULL THEN 'removed' END, CASE WHEN p.sha256 IS DISTINCT FROM a.sha256 THEN 'checksum' END, CASE WHEN p.features IS DISTINCT FROM a.features THEN 'feature_count' END, CASE WHEN p.vertices IS DISTINCT FROM a.vertices THEN 'vertex_count' END) AS changes
       FROM {pinned} p FULL OUTER JOIN {rebuilt} a ON a.path = p.path)""",
)
def r10(t):
    return lineage.drift(t.pinned, t.rebuilt)


@query("u4_keyed_difference", "SELECT coalesce(p.path, a.path) AS path, p.sha256 AS first, a.sha256 AS second FROM {pinned} p FULL OUTER JOIN {rebuilt} a ON a.path = p.path WHERE p.sha256 IS DISTINCT FROM a.sha256")
def u4(t):
    return lineage.same_run(t.pinned, t.rebuilt)


@query(
    "r11_reproducibility",
    """SELECT count(*) AS rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(CAST(concat('0x', d[1:12]) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', d[13:24]) AS BIGINT)) AS VARCHAR))) AS fingerprint
       FROM (SELECT sha256(concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '"}')) AS d FROM {customer})""",
)
def r11(t):
    return lineage.fingerprint(t.customer.select("c_name", "c_custkey").repartition(7))


@query(
    "r12_simplification_gate",
    """SELECT p_type AS layer, CASE WHEN count(*) FILTER (WHERE p_size > 1) = count(*) THEN 'passed' ELSE 'failed' END AS status FROM {part} GROUP BY 1""",
)
def r12(t):
    def layer(df):
        return df.groupBy(F.col("p_type").alias("layer")).agg(
            F.count("*").alias("features"), F.sum("p_size").alias("vertices"), F.lit("Douglas-Peucker per ring").alias("algorithm"), F.lit(0.018).alias("tolerance")
        )

    return lineage.simplification_gate(layer(t.part.filter("p_size > 1")), layer(t.part))


@query("r13_threshold_gate", "SELECT event_type, count(*) AS requests, round(sum(value), 2) AS size, CASE WHEN event_type = 'click' AND count(*) > 10 THEN 'count' WHEN event_type = 'error' AND sum(value) > 5 THEN 'size' ELSE 'ok' END AS verdict FROM {events} GROUP BY 1")
def r13(t):
    limits = t.events.select("event_type").distinct().select(
        "event_type", F.when(F.col("event_type") == "click", 10).alias("max_count"), F.when(F.col("event_type") == "error", 5.0).alias("max_size")
    )
    return lineage.threshold_gate(t.events, "value", limits, "event_type")


@query("r13_forbidden_urls", "SELECT page_id FROM {pages} WHERE contains(lower(url), '/en/') OR contains(lower(url), '.net')")
def r13_urls(t):
    return lineage.forbidden(t.pages, "url", ["/EN/", ".net"]).select("page_id")


@query("a4_duplicate_keys", "SELECT o_custkey, count(*) AS rows FROM {orders} GROUP BY 1 HAVING count(*) > 1")
def a4(t):
    return quality.duplicates(t.orders, "o_custkey")


@query("a6_chunk_size_profile", "SELECT count(*) AS parts, max(b) AS largest, CAST(sum(b) FILTER (WHERE n <= 3) AS BIGINT) AS largest_three, CAST(sum(b) AS BIGINT) AS total FROM (SELECT b, row_number() OVER (ORDER BY b DESC) AS n FROM (SELECT CAST(sum(n_chars) AS BIGINT) AS b FROM {documents} GROUP BY source))")
def a6(t):
    return quality.size_profile(t.documents.groupBy("source").agg(F.sum("n_chars").alias("bytes")), "bytes")


@query("u1_union_of_ids", "SELECT DISTINCT id FROM (SELECT c_custkey AS id FROM {customer} UNION ALL SELECT o_custkey FROM {orders} UNION ALL SELECT s_suppkey FROM {supplier})")
def u1(t):
    return quality.union_of(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id")))


@query("u2_set_equality", "SELECT c_custkey AS id, 'first' AS side FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders}) UNION ALL SELECT DISTINCT o_custkey, 'second' FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer})")
def u2(t):
    return quality.set_difference(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id")))


@query("u3_difference", "SELECT DISTINCT l_suppkey FROM {lineitem} WHERE l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 0)")
def u3(t):
    return quality.orphans(t.lineitem, "l_suppkey", t.supplier.filter("s_acctbal > 0"), "s_suppkey")


@query("u5_subset_test", "SELECT o_custkey, (count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND count(*) FILTER (WHERE o_orderstatus = 'O') > 0) AS complete FROM {orders} GROUP BY 1")
def u5(t):
    seen = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return seen.select("o_custkey", (F.size(quality.missing_values(["F", "O"], F.col("s"))) == 0).alias("complete"))


@query("p6_export_subset", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)")
def p6(t):
    visible = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return registry.lookup_join(t.orders, visible, ["o_custkey"], "left_semi").select("o_orderkey")


# Saved projects, one per customer: highlights from orders, some pinned, some of other providers.
inputs.DERIVED["mentions"] = f"""
SELECT CAST(o_custkey AS STRING) AS project_id, concat('gb-B', CAST(o_orderkey % 32 AS STRING)) AS region_id, CASE o_orderkey % 5 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS priority, CASE WHEN max(o_totalprice) > 450000 THEN 'blue' ELSE '#4472C4' END AS color,
       max(o_orderpriority) AS category, max(o_orderstatus) AS status FROM {{orders}} GROUP BY 1, 2, 3"""
inputs.DERIVED["project_facts"] = f"""SELECT CAST(c_custkey AS STRING) AS project_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '1.0' WHEN c_mktsegment = 'FURNITURE' AND c_acctbal < 0 THEN '9.9' ELSE '1.1' END AS schema_version,
    CASE WHEN c_acctbal > 6000 THEN 'areal-local' WHEN c_acctbal > 5000 THEN 'elsewhere' ELSE '' END AS provider, CASE WHEN c_acctbal < 500 THEN '' WHEN c_acctbal > 9500 THEN 'OLD' ELSE '{_B}' END AS boundary, c_name AS title FROM {{customer}}"""


def _documents(t: Tables):
    """Project documents as JSON text, assembled per project from its mentions."""
    style = F.struct("color", "category", F.lit("v").alias("value"))
    pinned = F.when(F.col("status") == "P", F.struct(F.concat(F.lit("idn-adm2-gb-"), F.lower(F.replace("region_id", F.lit("gb-"), F.lit("")))).alias("canonicalRegionId")))
    grouped = t.mentions.groupBy("project_id").agg(
        *[
            F.collect_list(F.when(F.col("priority") == i, F.struct(F.col("region_id").alias("k"), style.alias("v")))).alias(name)
            for i, name in enumerate(project.SOURCES)
        ],
        F.collect_set(F.when((F.col("priority") == 0) & pinned.isNotNull(), F.struct(F.col("region_id").alias("k"), pinned.alias("v")))).alias("refs"),
        F.collect_list(F.when(F.col("priority") == 1, F.struct(F.col("region_id").alias("k"), F.struct(F.lit("resolve").alias("action"), F.when(F.col("status") == "F", "stale").otherwise(_R).alias("registryVersion")).alias("v")))).alias("fixes"),
    )
    joined = t.project_facts.join(grouped, "project_id")
    doc = F.struct(
        F.col("schema_version").alias("schemaVersion"),
        F.nullif("provider", F.lit("")).alias("boundaryProviderId"),
        F.nullif("boundary", F.lit("")).alias("boundaryVersion"),
        "title",
        *[F.map_from_entries(name).alias(name) for name in project.SOURCES],
        F.map_from_entries("refs").alias("regionRefs"),
        F.map_from_entries("fixes").alias("importCorrections"),
        F.when(F.col("title").endswith("7"), "x").alias("surprise"),
    )
    return joined.select("project_id", F.to_json(doc).alias("document"))


_STATUS = f"CASE WHEN provider = '' AND boundary = '{_B}' THEN 'legacy-compatible' WHEN provider = '' AND boundary = '' THEN 'legacy-unpinned' WHEN provider <> 'areal-local' OR boundary <> '{_B}' THEN 'review-required' ELSE 'compatible' END"
inputs.DERIVED["reconciled"] = f"""SELECT m.project_id, m.region_id, CASE m.priority WHEN 0 THEN 'highlights' WHEN 1 THEN 'unresolvedHighlights' ELSE 'manualHighlights' END AS source, m.color, m.category,
    CASE WHEN {_STATUS} = 'review-required' OR r.region_id IS NULL THEN 'missing' WHEN m.priority = 2 THEN 'manual' WHEN m.priority = 0 AND schema_version = '1.1' AND m.status = 'P' THEN 'unchanged' WHEN r.match_status = 'ambiguous_name' THEN 'ambiguous' ELSE 'mapped' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id, region_id ORDER BY priority) AS n FROM {{mentions}}) m JOIN {{project_facts}} f ON f.project_id = m.project_id LEFT JOIN {{regions}} r ON r.region_id = m.region_id WHERE n = 1"""


@query("m1_region_adapter", "SELECT region_id, concat('idn-adm2-gb-', lower(geometry_source_id)) AS canonical_region_id, CASE WHEN match_status = 'ambiguous_name' THEN 'ambiguous_metadata' ELSE 'mapped' END AS ref_status FROM {old_registry}")
def m1(t):
    return project.adapter(t.old_registry)


@query("m2_highlight_reconciliation", "SELECT project_id, region_id, source, outcome, color, category FROM {reconciled} WHERE source = 'highlights'")
def m2(t):
    out = project.reconcile(project.parse(_documents(t)), t.regions, "areal-local")
    return out.filter("source = 'highlights'").select("project_id", "region_id", "source", "outcome", "color", "category")


@query("m3_unresolved_and_manual", "SELECT project_id, region_id, source, outcome FROM {reconciled} WHERE source <> 'highlights'")
def m3(t):
    out = project.reconcile(project.parse(_documents(t)), t.regions, "areal-local")
    return out.filter("source <> 'highlights'").select("project_id", "region_id", "source", "outcome")


@query("m4_provider_compatibility", f"SELECT project_id, {_STATUS} AS provider_status FROM {{project_facts}} WHERE project_id IN (SELECT project_id FROM {{mentions}})")
def m4(t):
    return project.compatibility(project.parse(_documents(t)), "areal-local").select("project_id", "provider_status")


@query(
    "m5_migration_report",
    f"""SELECT f.project_id, c.unchanged, c.mapped, c.ambiguous, c.missing, e.n AS unsupported, c.missing + c.ambiguous + e.n > 0 AS requires_review FROM {{project_facts}} f
        JOIN (SELECT project_id, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'mapped') AS mapped, count(*) FILTER (WHERE outcome = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE outcome = 'missing') AS missing FROM {{reconciled}} GROUP BY 1) c ON c.project_id = f.project_id
        JOIN (SELECT project_id, CAST((CASE WHEN ends_with(title, '7') THEN 1 ELSE 0 END) + (CASE WHEN {_STATUS} = 'review-required' THEN 1 ELSE 0 END) + (SELECT count(*) FROM {{mentions}} m WHERE m.project_id = g.project_id AND m.priority = 1 AND m.status = 'F') AS BIGINT) AS n FROM {{project_facts}} g) e ON e.project_id = f.project_id""",
)
def m5(t):
    parsed = project.parse(_documents(t))
    reconciled = project.reconcile(parsed, t.regions, "areal-local")
    return project.report(reconciled, project.unsupported_entries(parsed, "areal-local"))


@query("m6_stale_decisions", "SELECT project_id, region_id AS row_id, CASE WHEN status = 'F' THEN 'dropped' ELSE 'kept' END AS outcome FROM {mentions} WHERE priority = 1")
def m6(t):
    return project.stale_decisions(project.parse(_documents(t))).select("project_id", "row_id", "outcome")


@query(
    "m7_document_checks",
    """SELECT f.project_id, concat_ws(',', CASE WHEN schema_version = '9.9' THEN 'schema-version' END, CASE WHEN b.bad THEN 'color' END) AS issues FROM {project_facts} f JOIN (SELECT project_id, bool_or(color = 'blue') AS bad FROM {mentions} GROUP BY 1) b ON b.project_id = f.project_id""",
)
def m7(t):
    return project.document_checks(_documents(t)).select("project_id", F.array_join("issues", ",").alias("issues"))


_WRONG = {
    1: ("not-json", """'{"schemaVersion":"1.1"'"""),
    2: ("too-deep", """concat('{"schemaVersion":"1.1","a":', repeat('[', 26), repeat(']', 26), '}')"""),
    3: ("too-many-items", """concat('{"schemaVersion":"1.1","a":[', repeat('1,', 5000), '1]}')"""),
    4: ("forbidden-key", """'{"schemaVersion":"1.1","a":[{"constructor":{}}]}'"""),
    6: ("schema-version", """'{"migrationReport":{"schemaVersion":"1.0"},"schemaVersion":"9.9"}'"""),
    7: ("color", """'{"schemaVersion":"1.0","highlights":{"a":{"color":"blue"}}}'"""),
    8: ("schema-version", """'{"schemaVersion":1.1}'"""),
    9: ("not-json,schema-version", "'plain text'"),
    10: ("", """concat('{"schemaVersion":"1.1","a":', repeat('[', 25), repeat(']', 25), '}')"""),
}
for _i, (_name, _most) in enumerate(project.COLLECTION_LIMITS.items()):
    _also = "too-many-items," if _most >= project.LIMITS["items"] else ""
    _WRONG[20 + _i] = (f"{_also}too-many-{_name}", f"""concat('{{"schemaVersion":"1.1","{_name}":[', repeat('1,', {_most}), '1]}}')""")
    _WRONG[30 + _i] = ("", f"""concat('{{"schemaVersion":"1.1","{_name}":[', repeat('1,', {_most - 1}), '1]}}')""")
_PICK = "CASE WHEN c_custkey % 1000 = 999 THEN {large} ELSE CASE c_custkey % 500 {cases} ELSE {other} END END"
_PLANTED = _PICK.format(
    large="""concat('{"schemaVersion":"1.1"', repeat(' ', 20000000), '}')""",
    cases=" ".join(f"WHEN {k} THEN {text}" for k, (_, text) in _WRONG.items()),
    other="""concat('{"schemaVersion":"1.0","title":"', c_name, '"}')""",
)


@query(
    "m7_planted_faults",
    "SELECT CAST(c_custkey AS VARCHAR) AS project_id, "
    + _PICK.format(large="'too-large'", cases=" ".join(f"WHEN {k} THEN '{issue}'" for k, (issue, _) in _WRONG.items()), other="''")
    + " AS issues FROM {customer}",
)
def m7_planted(t):
    planted = spread(t.customer, "c_custkey").select(F.col("c_custkey").cast("string").alias("project_id"), F.expr(_PLANTED).alias("document"))
    return project.document_checks(planted).select("project_id", F.array_join("issues", ",").alias("issues"))


@query("m8_field_limits", "SELECT doc_id, substr(text, 1, 120) AS region_code, substr(text, 1, 160) AS region_name, CASE WHEN source IN ('src0') THEN '4:3' ELSE '16:9' END AS ratio FROM {documents}")
def m8(t):
    rows = t.documents.select(
        "doc_id", F.col("text").alias("region_code"), F.col("text").alias("region_name"), F.when(F.col("source") == "src0", "4:3").otherwise(F.col("source")).alias("ratio")
    )
    return project.default_choices(project.cut_fields(rows))


@query("m9_default_titles", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Region map' ELSE p_type END AS title, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'migrated' ELSE 'retained' END AS title_migration FROM {part}")
def m9(t):
    titled = t.part.select("p_partkey", F.col("p_type").alias("title"))
    return project.migrate_defaults(titled, "title", ["ECONOMY", "PROMO"], "Region map")


@query(
    "m10_field_diff",
    """SELECT CAST(c_custkey AS VARCHAR) AS project_id, field, CASE field WHEN 'kept' THEN 'retained' WHEN 'balance' THEN CASE WHEN c_acctbal > 0 THEN 'retained' ELSE 'migrated' END WHEN 'old' THEN 'dropped' ELSE 'migrated' END AS change FROM {customer}, (SELECT unnest(['kept', 'balance', 'old', 'new']) AS field)""",
)
def m10(t):
    key = F.col("c_custkey").cast("string").alias("project_id")
    base = F.struct(F.col("c_name").alias("n")).alias("kept")
    before = t.customer.select(key, F.to_json(F.struct(base, F.col("c_acctbal").alias("balance"), F.lit(1).alias("old"))).alias("document"))
    after = t.customer.select(key, F.to_json(F.struct(base, F.greatest("c_acctbal", F.lit(0.5)).alias("balance"), F.lit(2).alias("new"))).alias("document"))
    return project.field_diff(before, after)


