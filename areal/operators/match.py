"""Deterministic matching of rows to regions.

Rows carry text columns (row_id, row_number, region_code, region_name, province
and others, see ROLE_COLUMNS); an optional source_id keeps several inputs apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.functions import number, text
from areal.operators import registry
from areal.operators.registry import INDEX_VERSION, REGISTRY_VERSION, TIERS
from areal.plans.sizing import is_small, lookup_join

ROLE_COLUMNS = ["region_code", "region_name", "province", "numeric_value", "category", "source", "period", "color"]

# Rows with these statuses carry no usable region.
UNUSABLE = ["ignored", "unmatched", "ambiguous", "duplicate-target", "invalid"]
UNRESOLVED = ["ambiguous", "unmatched", "duplicate-target", "invalid"]

DEFAULT_COLOR = "#4472C4"  # fixed value

# Row issues: code -> (is an error, message).
ISSUES = {
    "region-missing": (True, "Add a region code or a region name."),
    "color-invalid": (True, "Use a six-digit hex colour."),
    "number-invalid": (True, "The number cannot be read."),
    "number-ambiguous": (False, "The separators of the number can be read in two ways."),
    "match-ambiguous": (True, "More than one region fits."),
    "match-unmatched": (True, "No region fits."),
    "match-invalid": (True, "The row is not valid."),
    "match-duplicate-target": (True, "Another row has the same region."),
    "match-ignored": (False, "The row was ignored."),
}


def _with_roles(rows: DataFrame) -> DataFrame:
    missing = {c: F.lit("") for c in ROLE_COLUMNS if c not in rows.columns}
    present = {c: text.trim(c) for c in ROLE_COLUMNS if c in rows.columns}
    extra = {} if "row_errors" in rows.columns else {"row_errors": F.lit(0)}
    return rows.withColumns({**missing, **present, **extra})


def row_keys(rows: DataFrame) -> DataFrame:
    """Add the lookup key of every tier as columns k10..k50, NULL where it does not apply."""
    # In steps, so each text is folded and normalised once per row.
    folded = rows.withColumns({"_place": text.ascii_fold("province"), "_name": text.ascii_fold("region_name")})
    named = folded.withColumns(
        {
            "_code": text.normalize_code("region_code"),
            "_exact": F.concat(text.exact_key("_place"), F.lit("|"), text.exact_key("_name")),
            "_place": text.text_key("_place"),
            "_name": text.text_key("_name"),
        }
    )
    both = (F.col("province") != "") & (F.col("region_name") != "")
    return named.withColumns(
        {
            "k10": F.nullif("_code", F.lit("")),
            "k11": F.nullif(F.replace("_code", F.lit("."), F.lit("")), F.lit("")),
            "k20": F.when(both, F.col("_exact")),
            "k30": F.when(both, F.col("_exact")),
            "k40": F.when(both, F.concat("_place", F.lit("|"), "_name")),
            "k50": F.when(F.col("region_name") != "", F.nullif("_name", F.lit(""))),
        }
    ).drop("_code", "_exact", "_place", "_name")


def _best_by_broadcast(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """Index small: one broadcast join per tier, each with the tier's own part; the rows never shuffle."""
    found = keyed
    for tier in TIERS:
        own = index.filter(F.col("tier") == tier).select(
            F.col("key").alias(f"_l{tier}"), F.struct("n_candidates", "candidates").alias(f"_h{tier}")
        )
        found = found.join(F.broadcast(own), F.col(f"k{tier}") == F.col(f"_l{tier}"), "left").drop(f"_l{tier}")
    best = F.coalesce(
        *[
            F.when(
                F.col(f"_h{tier}").isNotNull(),
                F.struct(
                    F.lit(tier).alias("tier"),
                    F.col(f"k{tier}").alias("key"),
                    F.col(f"_h{tier}.n_candidates").alias("n_candidates"),
                    F.col(f"_h{tier}.candidates").alias("candidates"),
                ),
            )
            for tier in TIERS
        ]
    )
    return found.withColumn("best", best).drop(*[f"_h{t}" for t in TIERS], *[f"k{t}" for t in TIERS])


def _best_by_shuffle(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """Index large: the distinct key sets of the rows are joined, the strongest tier of each set goes back to its rows.

    The keys alone decide, so rows that share an id cannot mix.
    """
    names = [f"k{t}" for t in TIERS]
    sets = keyed.select(*names).distinct()
    candidates = F.filter(
        F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"k{t}").alias("key")) for t in TIERS]),
        lambda k: k["key"].isNotNull(),
    )
    exploded = sets.select(*names, F.inline(candidates))
    hits = lookup_join(exploded, index, ["tier", "key"], "inner")
    best = hits.groupBy(*names).agg(F.min(F.struct("tier", "key", "n_candidates", "candidates")).alias("best"))
    best = best.select(*[F.col(n).alias(f"_{n}") for n in names], "best")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return keyed.join(best, same, "left").drop(*names, *[f"_{n}" for n in names])


def _id_columns(df: DataFrame) -> list[str]:
    """What identifies a row: its source, where there are several, and its id."""
    return [c for c in ("source_id",) if c in df.columns] + ["row_id"]


def _decisions(
    resolutions: DataFrame | None, regions: DataFrame, registry_version: str, small: bool
) -> DataFrame | None:
    """User decisions with their target looked up by region id or canonical id."""
    if resolutions is None:
        return None
    targets = regions.select("region_id", "canonical_region_id")
    names = targets.select(F.col("region_id").alias("target_id"), F.col("region_id").alias("_by_id"))
    canon = targets.groupBy(F.col("canonical_region_id").alias("target_id")).agg(F.max("region_id").alias("_by_canonical"))
    found = lookup_join(resolutions, names, ["target_id"], "left", small=small)
    found = lookup_join(found, canon, ["target_id"], "left", small=small)
    return found.select(
        *_id_columns(resolutions),
        F.col("action").alias("_action"),
        F.when(
            (F.col("action") == "resolve") & (F.col("registry_version") == registry_version),
            F.coalesce("_by_id", "_by_canonical"),
        ).alias("_decided"),
    )


def match_rows(
    rows: DataFrame,
    regions: DataFrame,
    resolutions: DataFrame | None = None,
    mode: str = "strict",
    on_duplicate: str = "flag",
    registry_version: str = REGISTRY_VERSION,
    small: bool | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Match every row to at most one region.

    strict: code, name+province, alias+province, normalised name+province; the
    first tier with candidates decides, several candidates are ambiguous, and a
    name alone is always ambiguous. permissive: code, else name+province, else a
    unique name; the first row of a region wins.

    on_duplicate='flag' turns every row of a region that several rows share into
    duplicate-target; 'aggregate' leaves them matched, for metrics that are
    rolled up later. small overrides the measured choice of join strategy. index is a
    lookup index prepared from the same regions (registry.lookup_index of build_keys);
    without one it is written here. With index and small no job runs while this plans.
    """
    described = registry.records(regions)
    prepared = _with_roles(rows)
    if mode == "permissive":
        return _permissive(prepared, regions, on_duplicate)
    if index is None:
        index, measured = registry.shared_index(regions)
        small = measured if small is None else small
    elif small is None:
        small = is_small(index)
    keyed = row_keys(prepared)
    best = _best_by_broadcast(keyed, index) if small else _best_by_shuffle(keyed, index)
    decisions = _decisions(resolutions, described, registry_version, small)
    if decisions is None:
        best = best.withColumns({"_action": F.lit(None).cast("string"), "_decided": F.lit(None).cast("string")})
    else:
        shared = [c for c in _id_columns(best) if c in _id_columns(decisions)]
        best = lookup_join(best, decisions, shared, "left")

    one, tier = F.col("best.n_candidates") == 1, F.col("best.tier")
    by_tier = F.when(~one | (tier == 50), "ambiguous")
    for number_, (_, status) in TIERS.items():
        by_tier = by_tier.when(tier == number_, status)
    status = (
        F.when(F.col("_action") == "ignore", "ignored")
        .when(F.col("_decided").isNotNull(), "user-resolved")
        .when(F.col("row_errors") > 0, "invalid")
        .when((F.col("region_code") == "") & (F.col("region_name") == ""), "invalid")
        .when(F.col("best").isNull(), "unmatched")
        .otherwise(by_tier)
    )
    region = F.when(status == "user-resolved", F.col("_decided")).when(
        status.isin(text.MATCHED_STATUSES), F.get(F.col("best.candidates"), F.lit(0))
    )
    listed = (F.col("_status") == "ambiguous") | F.col("_status").isin(text.MATCHED_STATUSES)
    key_type = F.when(tier < 20, TIERS[10][0])
    for number_, (name, _) in TIERS.items():
        key_type = key_type.when(tier == number_, name)
    tagged = best.withColumns({"_status": status, "region_id": region})
    tagged = tagged.withColumns(
        {
            "status": F.col("_status"),
            "key_type": F.when(listed, key_type),
            "match_key": F.when(listed, F.col("best.key")),
            "n_candidates": F.when(F.col("_status") == "ambiguous", F.col("best.n_candidates")).otherwise(0),
            "candidates": F.when(F.col("_status") == "ambiguous", F.col("best.candidates")).otherwise(
                F.array().cast("array<string>")
            ),
        }
    ).drop("best", "_status", "_action", "_decided")
    flagged = _flag_duplicates(tagged, small) if on_duplicate == "flag" else tagged
    return flagged.withColumns(
        {
            "registry_version": F.lit(registry_version),
            "index_version": F.lit(INDEX_VERSION if registry_version == REGISTRY_VERSION else f"{registry_version}:matching-v2"),
        }
    )


def _group_columns(df: DataFrame) -> list[str]:
    return [c for c in ("source_id",) if c in df.columns] + ["region_id"]


def _flag_duplicates(tagged: DataFrame, regions_small: bool) -> DataFrame:
    """Every row of a region named by several rows becomes duplicate-target."""
    group = _group_columns(tagged)
    shared = (
        tagged.filter("region_id IS NOT NULL").groupBy(*group).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    ).select(*group, F.lit(True).alias("_shared"))
    # One source: no more groups than regions, which were measured.
    bounded = regions_small and "source_id" not in tagged.columns
    joined = lookup_join(tagged, shared, group, "left", small=bounded)
    return joined.withColumn("status", F.when(F.col("_shared"), "duplicate-target").otherwise(F.col("status"))).drop("_shared")


def _permissive(rows: DataFrame, regions: DataFrame, on_duplicate: str) -> DataFrame:
    base = regions.select(
        "region_id",
        registry.optional(regions, "official_code").alias("_code"),
        registry.optional(regions, "region_name").alias("_name"),
        registry.optional(regions, "province_name").alias("_place"),
    )
    def normalized(c):
        return text.normalize_text(c, "import")

    codes = base.filter("_code <> ''").select(text.normalize_code("_code", "import").alias("_k"), "region_id")
    by_code = codes.groupBy("_k").agg(F.max("region_id").alias("_code_id"))
    names = base.filter("_name <> ''").select(normalized("_name").alias("_name"), normalized("_place").alias("_place"), (F.col("_place") != "").alias("_placed"), "region_id")

    def unique(key: Column, df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy(key.alias("_k")).agg(
            F.count("*").alias(f"{prefix}_n"), F.max("region_id").alias(f"{prefix}_id")
        )

    by_place = unique(F.concat("_place", F.lit("|"), "_name"), names.filter("_placed"), "_pair")
    by_name = unique(F.col("_name"), names, "_only")
    named = (F.col("province") != "") & (F.col("region_name") != "")
    found = lookup_join(rows.withColumn("_k", text.normalize_code("region_code", "import")), by_code, ["_k"]).drop("_k")
    pair = F.when(named, F.concat(normalized("province"), F.lit("|"), normalized("region_name")))
    found = lookup_join(found.withColumn("_k", pair), by_place, ["_k"]).drop("_k")
    only = F.when((F.col("region_name") != "") & (F.col("province") == ""), normalized("region_name"))
    found = lookup_join(found.withColumn("_k", only), by_name, ["_k"]).drop("_k")
    count = F.coalesce("_pair_n", "_only_n", F.lit(0))
    region = F.when(F.col("_code_id").isNotNull(), F.col("_code_id")).when(count == 1, F.coalesce("_pair_id", "_only_id"))
    missing = (F.col("region_code") == "") & (F.col("region_name") == "")
    status = (
        F.when(region.isNotNull(), "exact-code")
        .when(count > 1, "ambiguous")
        .when((F.col("row_errors") > 0) | missing, "invalid")
        .otherwise("unmatched")
    )
    tagged = found.withColumns({"status": status, "region_id": region}).drop(
        "_code_id", "_pair_n", "_pair_id", "_only_n", "_only_id"
    )
    if on_duplicate != "flag":
        return tagged
    group = _group_columns(tagged)
    first = (
        tagged.filter("region_id IS NOT NULL")
        .groupBy(*group)
        .agg(F.min(F.struct("row_number", "row_id")).alias("_first"))
    )
    joined = lookup_join(tagged, first, group, "left")
    later = F.col("_first").isNotNull() & (F.struct("row_number", "row_id") != F.col("_first"))
    return joined.withColumn("status", F.when(later, "duplicate-target").otherwise(F.col("status"))).drop("_first")


def candidate_rows(matched: DataFrame, regions: DataFrame) -> DataFrame:
    """Listed candidates with their descriptive fields, one row each."""
    described = registry.records(regions).select(
        F.col("region_id").alias("candidate_id"), "canonical_region_id", "display_name", F.col("province").alias("candidate_province"), "region_type", "official_code"
    )
    listed = matched.select(*_id_columns(matched), F.posexplode("candidates").alias("position", "candidate_id"))
    return lookup_join(listed, described, ["candidate_id"], "inner")


def all_candidates(matched: DataFrame, regions: DataFrame) -> DataFrame:
    """Every candidate of the ambiguous rows, beyond the listed first twenty as well."""
    keys = registry.build_keys(regions).select("key_type", F.col("key").alias("match_key"), F.col("region_id").alias("candidate_id"))
    unsure = matched.filter("status = 'ambiguous'").select(*_id_columns(matched), "key_type", "match_key")
    return lookup_join(unsure, keys, ["key_type", "match_key"], "inner")


def validate(matched: DataFrame, locale: str = "auto") -> DataFrame:
    """Add number result, issue codes and the three flags valid, invalid and warning.

    Ignored rows without errors are in neither valid nor invalid.
    """
    parsed = matched.withColumn("number_result", number.parse_number("numeric_value", locale))
    kind = F.col("number_result.kind")
    conditions = {
        "region-missing": (F.col("region_code") == "") & (F.col("region_name") == ""),
        "color-invalid": (F.col("color") != "") & ~text.is_color("color"),
        "number-invalid": kind == "invalid",
        "number-ambiguous": kind == "ambiguous",
        **{f"match-{s}": F.col("status") == s for s in ("ambiguous", "unmatched", "invalid", "duplicate-target", "ignored")},
    }

    def codes(errors: bool) -> Column:
        return F.array_compact(
            F.array(*[F.when(conditions[code], code) for code, (is_error, _) in ISSUES.items() if is_error == errors])
        )

    flagged = parsed.withColumns({"errors": codes(True), "warnings": codes(False)})
    failed = (F.size("errors") > 0) | (F.col("row_errors") > 0)
    return flagged.withColumns(
        {
            "valid": F.col("region_id").isNotNull() & ~failed,
            "invalid": failed,
            "warning": (F.size("warnings") > 0) & ~failed,
            "color": F.when(F.col("color") == "", DEFAULT_COLOR).otherwise(F.col("color")),
        }
    )


def messages(codes) -> Column:
    """Issue codes as reader text, joined with '; '."""
    known = F.create_map(*[F.lit(x) for code, (_, message) in ISSUES.items() for x in (code, message)])
    return F.array_join(F.transform(codes, lambda code: known[code]), "; ")


def summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count("*").alias("rows"),
        F.count_if("valid").alias("valid"),
        F.count_if("warning").alias("warning"),
        F.count_if("invalid").alias("invalid"),
        F.count_if(F.col("status").isin(UNRESOLVED)).alias("unresolved"),
    )


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def usable(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("region_id").isNotNull() & ~F.col("status").isin(UNUSABLE))


def issue_report(validated: DataFrame) -> DataFrame:
    """Invalid rows with their messages; text cells are safe to open in a spreadsheet."""
    safe = text.escape_formula
    return validated.filter("invalid").select(
        F.col("row_number").alias("Row"),
        safe("region_code").alias("Region_Code"),
        safe("province").alias("Province"),
        safe("region_name").alias("Region_Name"),
        safe("numeric_value").alias("Value"),
        messages(F.col("errors")).alias("Errors"),
        messages(F.col("warnings")).alias("Warnings"),
    )


def mapping_report(
    matched: DataFrame, assignments: DataFrame, regions: DataFrame, provider_id: str, compat: bool = False
) -> DataFrame:
    """Every row with its region, class and colour, and the versions that produced them.

    compat=True replaces a leading formula character by an apostrophe, as the
    reference does; the default keeps it behind the apostrophe.
    """
    described = registry.records(regions).select(
        "region_id", text.place_text("display_name", "province").alias("_shown")
    )
    classes = assignments.select("region_id", F.col("class_key").alias("_class"), F.col("color").alias("_class_color"))
    joined = lookup_join(matched, described, ["region_id"], "left")
    joined = lookup_join(joined, classes, ["region_id"], "left")

    def cell(value) -> Column:
        value = text.text_of(value)
        return F.regexp_replace(value, r"\A[=+@-]", "'") if compat else text.escape_formula(value)

    return joined.select(
        cell("row_id").alias("Source_Row_ID"),
        F.col("row_number").alias("Source_Row_Number"),
        cell("region_name").alias("Original_Region"),
        cell("province").alias("Original_Province"),
        cell("region_code").alias("Original_Code"),
        cell("region_id").alias("Canonical_Region_ID"),
        cell("_shown").alias("Matched_Display_Name"),
        F.col("status").alias("Match_Status"),
        F.when(F.col("status") == "user-resolved", "yes").otherwise("no").alias("Correction"),
        cell("numeric_value").alias("Value"),
        cell("category").alias("Category"),
        cell("_class").alias("Visualization_Class"),
        cell("_class_color").alias("Visualization_Color"),
        F.lit(provider_id).alias("Boundary_Provider_ID"),
        F.lit(registry.BOUNDARY_VERSION).alias("Boundary_Version"),
        F.lit(REGISTRY_VERSION).alias("Registry_Version"),
    )


def in_report_order(report: DataFrame) -> DataFrame:
    return report.orderBy("Source_Row_Number", "Source_Row_ID")


SORTS = {
    "row": ["row_number"],
    "region": ["_shown", "row_number"],
    "status": ["status", "row_number"],
    "value": ["_value", "row_number"],
}


def data_table(rows: DataFrame, query: str = "", sort: str = "row") -> DataFrame:
    """Review table: free-text filter over six fields, then one of four orders."""
    fields = ["region_name", "province", "region_code", "category", "numeric_value", "matched_name"]
    needle = F.upper(text.trim(F.lit(query)))
    hits = rows.filter(F.upper(F.concat_ws(" ", *[text.text_of(c) for c in fields])).contains(needle))
    shown = F.coalesce(F.nullif(text.text_of("matched_name"), F.lit("")), F.col("region_name"))
    leading = F.regexp_extract("numeric_value", r"\A\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")
    keyed = hits.withColumns({"_shown": F.collate(shown, "id"), "_value": leading})
    return keyed.orderBy(*[F.col(c).asc_nulls_last() for c in SORTS[sort]]).drop("_shown", "_value")


def first_rows(table: DataFrame, limit: int = 200) -> DataFrame:
    """The visible part of a review table; count the table itself for the total."""
    return table.limit(limit)
