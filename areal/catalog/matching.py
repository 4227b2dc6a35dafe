"""Registry keys, the matching cascade, its reports and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from areal.catalog.registered import Tables, query
from areal.catalog.scalars import sql_code, sql_code_import, sql_exact, sql_text
from areal.functions import text
from areal.operators import classify, match, registry
from areal.plans import inputs
from areal.plans.sizing import checkpoint

ALIASES_SQL = """SELECT region_id, province_name, parts[1] AS name, coalesce(parts[2], '') AS province, coalesce(parts[3], '') AS code
    FROM (SELECT region_id, province_name,
                 list_filter(list_transform(string_split(entry, '|'), lambda x: trim(x)), lambda x: x <> '') AS parts
          FROM (SELECT region_id, province_name, unnest(string_split(alternative_names, ';')) AS entry FROM {regions}))
    WHERE len(parts) > 0"""

inputs.DERIVED["aliases"] = ALIASES_SQL

# The long key table as the oracle sees it.
_NAMES = """(SELECT DISTINCT region_id, province_name AS province, unnest([region_name, display_name, geometry_source_name]) AS name FROM {regions})"""
_ALIAS = "(SELECT region_id, CASE WHEN province <> '' THEN province ELSE province_name END AS province, name, code FROM {aliases})"


def _variants(source: str) -> str:
    code = sql_code("c")
    return f"""SELECT region_id, unnest([k, replace(k, '.', ''), concat('ID', replace(k, '.', '')), concat('ID-', replace(k, '.', ''))]) AS key
        FROM (SELECT region_id, {code} AS k FROM ({source})) WHERE k <> ''"""


inputs.DERIVED["keys"] = f"""
SELECT DISTINCT key_type, tier, key, region_id FROM (
  SELECT 'official-code' AS key_type, 10 AS tier, key, region_id FROM ({_variants("SELECT region_id, official_code AS c FROM {regions}")}
     UNION ALL {_variants("SELECT region_id, code AS c FROM {aliases}")})
  UNION ALL SELECT 'canonical-name-province', 20, concat({sql_exact('province')}, '|', {sql_exact('name')}), region_id FROM {_NAMES}
  UNION ALL SELECT 'alias-province', 30, concat({sql_exact('province')}, '|', {sql_exact('name')}), region_id FROM {_ALIAS}
  UNION ALL SELECT 'normalized-name-province', 40, concat({sql_text('province')}, '|', {sql_text('name')}), region_id
     FROM (SELECT region_id, province, name FROM {_NAMES} UNION ALL SELECT region_id, province, name FROM {_ALIAS})
  UNION ALL SELECT 'name-only', 50, {sql_text('name')}, region_id
     FROM (SELECT region_id, province, name FROM {_NAMES} UNION ALL SELECT region_id, province, name FROM {_ALIAS}))
WHERE key <> ''"""

inputs.DERIVED["row_keys"] = f"""
SELECT row_id, 10 AS tier, code AS key FROM (SELECT row_id, {sql_code('region_code')} AS code FROM {{messy}}) WHERE code <> ''
UNION ALL SELECT row_id, 11, replace(code, '.', '') FROM (SELECT row_id, {sql_code('region_code')} AS code FROM {{messy}}) WHERE replace(code, '.', '') <> ''
UNION ALL SELECT row_id, 20, concat({sql_exact('province')}, '|', {sql_exact('region_name')}) FROM {{messy}} WHERE trim(province) <> '' AND trim(region_name) <> ''
UNION ALL SELECT row_id, 30, concat({sql_exact('province')}, '|', {sql_exact('region_name')}) FROM {{messy}} WHERE trim(province) <> '' AND trim(region_name) <> ''
UNION ALL SELECT row_id, 40, concat({sql_text('province')}, '|', {sql_text('region_name')}) FROM {{messy}} WHERE trim(province) <> '' AND trim(region_name) <> ''
UNION ALL SELECT row_id, 50, {sql_text('region_name')} FROM {{messy}} WHERE trim(region_name) <> '' AND {sql_text('region_name')} <> ''"""

inputs.DERIVED["best"] = """
SELECT row_id, min(tier) AS tier, arg_min(n, tier) AS n, arg_min(region_id, tier) AS region_id, arg_min(key, tier) AS key,
       arg_min(candidates, tier) AS candidates
FROM (SELECT r.row_id, r.tier, any_value(r.key) AS key, count(*) AS n, min(k.region_id) AS region_id,
             string_agg(k.region_id, ',' ORDER BY k.region_id) AS candidates
      FROM {row_keys} r JOIN {keys} k ON k.key = r.key AND k.tier = CASE WHEN r.tier = 11 THEN 10 ELSE r.tier END
      GROUP BY r.row_id, r.tier) GROUP BY row_id"""

inputs.DERIVED["tiered"] = """
SELECT m.*, b.tier, b.n, b.key, b.candidates,
       CASE WHEN b.n = 1 AND b.tier < 50 THEN b.region_id END AS found,
       CASE WHEN trim(m.region_code) = '' AND trim(m.region_name) = '' THEN 'invalid'
            WHEN b.tier IS NULL THEN 'unmatched'
            WHEN b.n > 1 OR b.tier = 50 THEN 'ambiguous'
            WHEN b.tier IN (10, 11) THEN 'exact-code' WHEN b.tier = 20 THEN 'exact-name-province'
            WHEN b.tier = 30 THEN 'exact-alias-province' ELSE 'normalized-name-province' END AS tier_status
FROM {messy} m LEFT JOIN {best} b ON b.row_id = m.row_id"""

_DECIDED = """
SELECT t.*, CASE WHEN d.action = 'ignore' THEN 'ignored' WHEN r.region_id IS NOT NULL THEN 'user-resolved' ELSE tier_status END AS s0,
       CASE WHEN d.action = 'ignore' THEN NULL WHEN r.region_id IS NOT NULL THEN r.region_id ELSE found END AS region
FROM {tiered} t LEFT JOIN {decisions} d ON d.row_id = t.row_id
LEFT JOIN {regions} r ON d.action = 'resolve' AND d.registry_version = 'IDN-ADM-REGISTRY-v1-2025-06-23'
     AND d.target_id IN (r.region_id, concat('idn-adm2-gb-', lower(r.geometry_source_id)))"""
inputs.DERIVED["decided"] = _DECIDED
inputs.DERIVED["matched"] = """
SELECT *, CASE WHEN region IS NOT NULL AND count(region) OVER (PARTITION BY source_id, region) > 1 THEN 'duplicate-target' ELSE s0 END AS status
FROM {decided}"""


def _matched(t: Tables, **options):
    return match.match_rows(t.messy.drop("true_region", "amount"), t.regions, t.decisions, **options)


@query("s13_alternative_names", "SELECT region_id, name, province, code FROM {aliases}")
def s13(t):
    return t.regions.select("region_id", F.inline(registry.parse_aliases("alternative_names")))


@query("j0_build_keys", "SELECT key_type, tier, key, region_id FROM {keys}")
def j0(t):
    return registry.build_keys(t.regions)


def _tier_query(name: str, tiers: tuple[int, ...], sql_tiers: str):
    @query(
        name,
        f"""SELECT r.row_id, count(*) AS n, min(k.region_id) AS first_region FROM {{row_keys}} r
            JOIN {{keys}} k ON k.key = r.key AND k.tier = CASE WHEN r.tier = 11 THEN 10 ELSE r.tier END
            WHERE r.tier IN ({sql_tiers}) GROUP BY r.row_id, r.tier""",
    )
    def tier(t):
        index, small = registry.shared_index(t.regions)
        keyed = match.row_keys(t.messy)
        out = None
        for number in tiers:
            side = index.filter(F.col("tier") == (10 if number == 11 else number)).select(F.col("key").alias(f"k{number}"), "n_candidates", "candidates")
            hit = match.lookup_join(keyed.select("row_id", f"k{number}"), side, [f"k{number}"], "inner", spread=["row_id"], small=small)
            hit = hit.select("row_id", F.col("n_candidates").alias("n"), F.get("candidates", F.lit(0)).alias("first_region"))
            out = hit if out is None else out.unionByName(hit)
        return out


_tier_query("j1_exact_code", (10, 11), "10, 11")
_tier_query("j2_exact_name_province", (20,), "20")
_tier_query("j3_alias_province", (30,), "30")
_tier_query("j4_normalized_name_province", (40,), "40")
_tier_query("j5_name_only", (50,), "50")


@query("j6_match_cascade", "SELECT row_id, tier_status AS status, found AS region_id, CAST(CASE WHEN tier_status = 'ambiguous' THEN n ELSE 0 END AS BIGINT) AS n_candidates FROM {tiered}")
def j6(t):
    rows = t.messy.drop("true_region", "amount")
    out = match.match_rows(rows, t.regions, on_duplicate="aggregate")
    return out.select("row_id", "status", "region_id", F.col("n_candidates").cast("bigint"))


@query("j7_resolution_overlay", "SELECT row_id, s0 AS status, region AS region_id FROM {decided}")
def j7(t):
    return _matched(t, on_duplicate="aggregate").select("row_id", "status", "region_id")


@query("j6_match_cascade_shuffled", "SELECT row_id, tier_status AS status, found AS region_id, CAST(CASE WHEN tier_status = 'ambiguous' THEN n ELSE 0 END AS BIGINT) AS n_candidates FROM {tiered}")
def j6_shuffled(t):
    out = match.match_rows(t.messy.drop("true_region", "amount"), t.regions, on_duplicate="aggregate", small=False)
    return out.select("row_id", "status", "region_id", F.col("n_candidates").cast("bigint"))


@query("j7_resolution_overlay_shuffled", "SELECT row_id, s0 AS status, region AS region_id FROM {decided}")
def j7_shuffled(t):
    return _matched(t, on_duplicate="aggregate", small=False).select("row_id", "status", "region_id")


@query("j8_duplicate_target", "SELECT row_id, status, region AS region_id FROM {matched}")
def j8(t):
    return _matched(t).select("row_id", "status", "region_id")


@query("j8_duplicate_target_shuffled", "SELECT row_id, status, region AS region_id FROM {matched}")
def j8_shuffled(t):
    """The same result by the plan for registries too large to broadcast."""
    return _matched(t, small=False).select("row_id", "status", "region_id")


_PERMISSIVE = f"""
WITH c AS (SELECT {sql_code_import('official_code')} AS k, max(region_id) AS id FROM {{regions}} WHERE official_code <> '' GROUP BY 1),
p AS (SELECT concat({sql_text('province_name', 'import')}, '|', {sql_text('region_name', 'import')}) AS k, count(*) AS n, max(region_id) AS id FROM {{regions}} WHERE province_name <> '' GROUP BY 1),
o AS (SELECT {sql_text('region_name', 'import')} AS k, count(*) AS n, max(region_id) AS id FROM {{regions}} GROUP BY 1),
f AS (SELECT m.row_id, m.row_number, m.source_id, m.region_code, m.region_name,
        CASE WHEN c.id IS NOT NULL THEN c.id WHEN coalesce(p.n, o.n) = 1 THEN coalesce(p.id, o.id) END AS region_id, coalesce(p.n, o.n, 0) AS n, c.id AS code_id
      FROM {{messy}} m LEFT JOIN c ON c.k = {sql_code_import('m.region_code')}
      LEFT JOIN p ON m.province <> '' AND m.region_name <> '' AND p.k = concat({sql_text('m.province', 'import')}, '|', {sql_text('m.region_name', 'import')})
      LEFT JOIN o ON m.province = '' AND m.region_name <> '' AND o.k = {sql_text('m.region_name', 'import')})
SELECT row_id, region_id, CASE WHEN region_id IS NOT NULL THEN CASE WHEN row_number() OVER (PARTITION BY source_id, region_id ORDER BY row_number, row_id) > 1 THEN 'duplicate-target' ELSE 'exact-code' END
    WHEN n > 1 THEN 'ambiguous' WHEN region_code = '' AND region_name = '' THEN 'invalid' ELSE 'unmatched' END AS status FROM f"""


@query("j9_permissive_match", _PERMISSIVE)
def j9(t):
    out = match.match_rows(t.messy.drop("true_region", "amount"), t.regions, mode="permissive")
    return out.select("row_id", "region_id", "status")


@query(
    "j10_candidates",
    """SELECT m.row_id, c.region_id AS candidate_id, concat('idn-adm2-gb-', lower(c.geometry_source_id)) AS canonical_region_id, c.display_name, c.region_type, c.official_code
       FROM (SELECT row_id, unnest(string_split(candidates, ',')) AS id FROM {matched} WHERE s0 = 'ambiguous') m JOIN {regions} c ON c.region_id = m.id""",
)
def j10(t):
    rows = match.candidate_rows(_matched(t), t.regions)
    return rows.select("row_id", "candidate_id", "canonical_region_id", "display_name", "region_type", "official_code")


@query(
    "j10_all_candidates",
    """SELECT DISTINCT m.row_id, k.region_id AS candidate_id FROM {matched} m
       JOIN {keys} k ON k.key = m.key AND k.tier = CASE WHEN m.tier = 11 THEN 10 ELSE m.tier END WHERE m.s0 = 'ambiguous'""",
)
def j10_all(t):
    """Every candidate, where the list of a row is cut."""
    return match.all_candidates(_matched(t), t.regions).select("row_id", "candidate_id")


@query(
    "j17_feature_by_id",
    "SELECT region_id, display_name FROM {regions} WHERE region_id = 'gb-B7'",
)
def j17(t):
    return registry.by_stable_id(t.regions, "gb-B7").select("region_id", "display_name")


_VALID = """
SELECT *, (region_code = '' AND region_name = '') AS e_missing, (color <> '' AND NOT regexp_full_match(color, '#[0-9a-fA-F]{6}')) AS e_color,
       kind = 'invalid' AS e_number, kind = 'ambiguous' AS w_number
FROM (SELECT m.*, n.kind FROM {matched} m JOIN {numbers} n ON n.row_id = m.row_id)"""


def _register_numbers():
    from areal.catalog.scalars import _number_sql

    inputs.DERIVED["numbers"] = _number_sql("auto")
    inputs.DERIVED["validated"] = f"""
SELECT *, e_missing OR e_color OR e_number OR status IN ('ambiguous', 'unmatched', 'invalid', 'duplicate-target') AS bad,
       w_number OR status = 'ignored' AS warned FROM ({_VALID})"""


_register_numbers()


@query(
    "h7_row_status_split",
    """SELECT row_id, region IS NOT NULL AND NOT bad AS valid, bad AS invalid, warned AND NOT bad AS warning,
       CAST(e_missing AS INTEGER) + CAST(e_color AS INTEGER) + CAST(e_number AS INTEGER) + CAST(status IN ('ambiguous', 'unmatched', 'invalid', 'duplicate-target') AS INTEGER) AS n_errors
       FROM {validated}""",
)
def h7(t):
    return match.validate(_matched(t)).select("row_id", "valid", "invalid", "warning", F.size("errors").alias("n_errors"))


@query(
    "p7_row_checks",
    "SELECT row_id, concat_ws(',', CASE WHEN e_missing THEN 'region-missing' END, CASE WHEN e_color THEN 'color-invalid' END, CASE WHEN e_number THEN 'number-invalid' END) AS issues FROM {validated}",
)
def p7(t):
    found = match.validate(_matched(t)).select("row_id", F.filter("errors", lambda e: ~e.startswith("match-")).alias("e"))
    return found.select("row_id", F.array_join("e", ",").alias("issues"))


@query(
    "a1_import_summary",
    """SELECT count(*) AS rows, count_if(region IS NOT NULL AND NOT bad) AS valid, count_if(warned AND NOT bad) AS warning,
       count_if(bad) AS invalid, count_if(status IN ('ambiguous', 'unmatched', 'duplicate-target', 'invalid')) AS unresolved FROM {validated}""".replace("count_if(", "count(*) FILTER (WHERE "),
)
def a1(t):
    return match.summary(match.validate(_matched(t)))


@query("a2_status_counts", "SELECT status, count(*) AS rows FROM {matched} GROUP BY status")
def a2(t):
    return match.status_counts(_matched(t))


@query(
    "p1_usable_rows",
    "SELECT row_id, region AS region_id FROM {matched} WHERE region IS NOT NULL AND status NOT IN ('ignored', 'unmatched', 'ambiguous', 'duplicate-target', 'invalid')",
)
def p1(t):
    return match.usable(_matched(t)).select("row_id", "region_id")


@query(
    "f19_status_labels",
    """SELECT row_id, CASE WHEN status IN ('exact-code', 'exact-name-province', 'exact-alias-province', 'normalized-name-province') THEN 'Matched'
       WHEN status = 'user-resolved' THEN 'Matched by you' WHEN status = 'ambiguous' THEN 'Choose a match' WHEN status = 'unmatched' THEN 'Unmatched'
       WHEN status = 'duplicate-target' THEN 'Duplicate region' WHEN status = 'invalid' THEN 'Check this row' ELSE 'Ignored' END AS label,
       CASE WHEN bad OR status IN ('ambiguous', 'duplicate-target', 'invalid') THEN 'needs-review' WHEN status = 'unmatched' THEN 'unmatched'
            WHEN region IS NOT NULL THEN 'matched' ELSE 'needs-review' END AS state FROM {validated}""",
)
def f19(t):
    rows = match.validate(_matched(t))
    return rows.select("row_id", text.status_label("status").alias("label"), text.status_state("status", "invalid", "region_id").alias("state"))


def _safe(c: str) -> str:
    return rf"CASE WHEN regexp_matches({c}, '^[=+\-@\t\r]') THEN concat('''', {c}) ELSE {c} END"


_ERRORS = """concat_ws('; ', CASE WHEN e_missing THEN 'Add a region code or a region name.' END, CASE WHEN e_color THEN 'Use a six-digit hex colour.' END,
    CASE WHEN e_number THEN 'The number cannot be read.' END, CASE status WHEN 'ambiguous' THEN 'More than one region fits.' WHEN 'unmatched' THEN 'No region fits.'
    WHEN 'invalid' THEN 'The row is not valid.' WHEN 'duplicate-target' THEN 'Another row has the same region.' END)"""
_WARNS = """concat_ws('; ', CASE WHEN w_number THEN 'The separators of the number can be read in two ways.' END, CASE WHEN status = 'ignored' THEN 'The row was ignored.' END)"""


@query(
    "k1_issue_report",
    f"""SELECT row_number AS "Row", {_safe('region_code')} AS "Region_Code", {_safe('province')} AS "Province", {_safe('region_name')} AS "Region_Name",
        {_safe('trim(numeric_value)')} AS "Value", {_ERRORS} AS "Errors", {_WARNS} AS "Warnings" FROM {{validated}} WHERE bad""",
)
def k1(t):
    return match.issue_report(match.validate(_matched(t)))


def _mapping(t: Tables, compat: bool):
    rows = _matched(t)
    totals = rows.groupBy("region_id").agg(F.count("*").alias("n")).filter("region_id IS NOT NULL")
    assigned = totals.select("region_id", (F.col("n") % 3).cast("string").alias("class_key"), F.when(F.col("n") % 2 == 0, "#C6DBEF").otherwise("#08306B").alias("color"))
    return match.in_report_order(match.mapping_report(rows, assigned, t.regions, "areal-local", compat))


def _mapping_sql(cell) -> str:
    return f"""SELECT {cell('m.row_id')} AS "Source_Row_ID", m.row_number AS "Source_Row_Number", {cell('m.region_name')} AS "Original_Region", {cell('m.province')} AS "Original_Province",
        {cell('m.region_code')} AS "Original_Code", coalesce(m.region, '') AS "Canonical_Region_ID",
        CASE WHEN r.region_id IS NULL THEN '' ELSE concat(r.display_name, ' - ', CASE WHEN r.province_name = '' THEN 'Province not linked' ELSE r.province_name END) END AS "Matched_Display_Name",
        m.status AS "Match_Status", CASE WHEN m.status = 'user-resolved' THEN 'yes' ELSE 'no' END AS "Correction", {cell('trim(m.numeric_value)')} AS "Value", {cell('trim(m.category)')} AS "Category",
        coalesce(CAST(a.n % 3 AS VARCHAR), '') AS "Visualization_Class", CASE WHEN a.n IS NULL THEN '' WHEN a.n % 2 = 0 THEN '#C6DBEF' ELSE '#08306B' END AS "Visualization_Color",
        'areal-local' AS "Boundary_Provider_ID", 'IDN-ADM2-2020-geoboundaries-22746128' AS "Boundary_Version", 'IDN-ADM-REGISTRY-v1-2025-06-23' AS "Registry_Version"
        FROM {{matched}} m LEFT JOIN {{regions}} r ON r.region_id = m.region
        LEFT JOIN (SELECT region, count(*) AS n FROM {{matched}} WHERE region IS NOT NULL GROUP BY region) a ON a.region = m.region"""


@query("k2_mapping_report", _mapping_sql(_safe))
def k2(t):
    return _mapping(t, compat=False)


@query("k2_mapping_report_compat", _mapping_sql(lambda c: f"regexp_replace({c}, '^[=+@-]', '''')"))
def k2_compat(t):
    return _mapping(t, compat=True)


def _review(t: Tables):
    described = t.regions.select("region_id", text.place_text("display_name", "province_name").alias("matched_name"))
    return match.lookup_join(_matched(t), described, ["region_id"], "left", spread=["row_id"])


_REVIEW_SQL = """(SELECT m.*, concat(r.display_name, ' - ', CASE WHEN r.province_name = '' THEN 'Province not linked' ELSE r.province_name END) AS matched_name
    FROM {matched} m LEFT JOIN {regions} r ON r.region_id = m.region)"""


@query(
    "p2_table_filter",
    f"SELECT row_id FROM {_REVIEW_SQL} WHERE contains(upper(concat_ws(' ', region_name, province, region_code, trim(category), trim(numeric_value), coalesce(matched_name, ''))), 'NÁTION 1')",
)
def p2(t):
    return match.data_table(_review(t), "nátion 1").select("row_id")


@query(
    "o1_data_table_order",
    f"""SELECT row_id, row_number() OVER (ORDER BY TRY_CAST(nullif(regexp_extract(numeric_value, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE) ASC NULLS LAST, row_number) AS position
        FROM {_REVIEW_SQL} ORDER BY position LIMIT 200""",
)
def o1(t):
    """First 200 rows by leading number (the size of the review table is part of the feature)."""
    top = match.first_rows(match.data_table(_review(t), sort="value"), 200)
    value = F.regexp_extract("numeric_value", r"\A\s*([+-]?(\d+\.?\d*|\.\d+))", 1).try_cast("double")
    from pyspark.sql import Window

    position = F.row_number().over(Window.orderBy(value.asc_nulls_last(), "row_number"))
    return top.select("row_id", position.cast("bigint").alias("position"))


@query("o5_report_order", "SELECT row_id, row_number FROM {matched}")
def o5(t):
    return _matched(t).select("row_id", "row_number").orderBy("row_number", "row_id")


@query(
    "p3_registry_search",
    f"SELECT region_id FROM {{regions}} WHERE contains({sql_text("concat_ws(' ', display_name, province_name, official_code, geometry_source_name)", 'import')}, 'NATION 1') ORDER BY region_id LIMIT 20",
)
def p3(t):
    return registry.search(t.regions, "kota nátion 1").select("region_id")


@query("p4_province_filter", "SELECT region_id, 'one' AS choice FROM {regions} WHERE province_name = 'ASIA' UNION ALL SELECT region_id, 'unresolved' FROM {regions} WHERE province_name = '' UNION ALL SELECT region_id, 'all' FROM {regions}")
def p4(t):
    def choose(choice: str, label: str):
        return registry.in_province(t.regions, choice).select("region_id", F.lit(label).alias("choice"))

    return choose("ASIA", "one").unionByName(choose("__unresolved", "unresolved")).unionByName(choose("__all", "all"))


_Q0 = """WITH totals AS (SELECT found AS region_id, round(sum(amount), 2) AS total, count(*) AS rows FROM {tiered} WHERE found IS NOT NULL GROUP BY found),
pos AS (SELECT total, row_number() OVER (ORDER BY total) AS p, count(*) OVER () AS n FROM totals),
cuts AS (SELECT DISTINCT total AS cut FROM pos WHERE p IN (CAST(least(n, ceil(n / 5)) AS BIGINT), CAST(least(n, ceil(2 * n / 5)) AS BIGINT), CAST(least(n, ceil(3 * n / 5)) AS BIGINT), CAST(least(n, ceil(4 * n / 5)) AS BIGINT)))
SELECT region_id, CAST(c AS VARCHAR) AS class_key, ['#F0F7FF', '#C6DBEF', '#9ECAE1', '#6BAED6', '#3182BD'][c + 1] AS color, total, rows
FROM (SELECT t.*, (SELECT count(*) FROM cuts WHERE cut < t.total) AS c FROM totals t)"""


@query("q0_match_and_classify", _Q0)
def q0(t):
    """Match messy rows, sum their amount per region, classify the sums into five quantile classes."""
    matched = match.match_rows(t.messy.drop("true_region"), t.regions, on_duplicate="aggregate")
    totals = (
        match.usable(matched)
        .groupBy("region_id")
        .agg(F.round(F.sum("amount"), 2).alias("total"), F.count("*").alias("rows"))
    )
    totals = checkpoint(totals)  # one row per region; the class breaks read it several times
    ready = totals.select(
        "region_id", F.col("region_id").alias("row_id"), F.lit(0).alias("row_number"), F.lit("exact-code").alias("status"),
        F.col("total").cast("string").alias("numeric_value"), F.lit("").alias("category"), "total", "rows",
    )
    classes = classify.classify(ready, "quantile", classes=5)
    return classes.assignments.select("region_id", "class_key", "color").join(totals, "region_id")
