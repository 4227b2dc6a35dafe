"""Data-quality rules as data, and set comparisons between tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.plans.sizing import literal_table


@dataclass(frozen=True)
class RowRule:
    """A row fails where the condition holds; key identifies it in the sample."""

    name: str
    table: str
    failing: Column
    key: str


@dataclass(frozen=True)
class UniqueRule:
    name: str
    table: str
    key: str


@dataclass(frozen=True)
class CoverRule:
    """Every non-blank value of one column has to occur in another table's column."""

    name: str
    table: str
    column: str
    other: str
    other_column: str


def _row_rules(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """All row rules of a table in one pass."""
    measures = []
    for i, rule in enumerate(rules):
        failing = F.coalesce(rule.failing, F.lit(False))
        measures += [F.count_if(failing).alias(f"n{i}"), F.min(F.when(failing, F.col(rule.key).cast("string"))).alias(f"s{i}")]
    results = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), F.col(f"n{i}").alias("failures"), F.col(f"s{i}").alias("sample")) for i, r in enumerate(rules)]
    )
    return df.agg(*measures).select(F.inline(results))


def _key_rules(tables: dict[str, DataFrame], rules: list[UniqueRule | CoverRule]) -> DataFrame:
    """All rules about keys: every table is read once, and all keys are counted in one grouping."""
    marks: dict[str, list[Column]] = {}

    def mark(table: str, rule: str, column: str, used: bool) -> None:
        value = F.coalesce(F.col(column).cast("string"), F.lit(""))
        marks.setdefault(table, []).append(F.struct(F.lit(rule).alias("rule"), value.alias("value"), F.lit(used).alias("used")))

    for rule in rules:
        if isinstance(rule, UniqueRule):
            mark(rule.table, rule.name, rule.key, used=True)
        else:
            mark(rule.table, rule.name, rule.column, used=True)
            mark(rule.other, rule.name, rule.other_column, used=False)
    marked = reduce(DataFrame.unionByName, [tables[t].select(F.inline(F.array(*m))) for t, m in marks.items()])
    values = (
        marked.filter("value <> ''")
        .groupBy("rule", "value")
        .agg(F.count_if("used").alias("times"), F.bool_or(~F.col("used")).alias("held"))
    )
    unique = F.col("rule").isin([r.name for r in rules if isinstance(r, UniqueRule)])
    failing = F.when(unique, F.col("times") > 1).otherwise((F.col("times") > 0) & ~F.col("held"))
    measured = values.groupBy("rule").agg(
        F.count_if(failing).alias("failures"), F.min(F.when(failing, F.col("value"))).alias("sample")
    )
    names = literal_table(next(iter(tables.values())).sparkSession, ["rule"], [(r.name,) for r in rules])
    return names.join(measured, "rule", "left").select("rule", F.coalesce("failures", F.lit(0)).alias("failures"), "sample")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Non-blank values that occur more than once."""
    filled = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return filled.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Distinct non-blank values of a column that the other table lacks."""
    used = df.filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").select(column).distinct()
    return used.join(other.select(F.col(other_column).alias(column)).distinct(), column, "left_anti")


def run_rules(tables: dict[str, DataFrame], rules: list) -> DataFrame:
    """(rule, failures, sample): one row per rule, sample is the smallest failing key."""
    parts = []
    for name in dict.fromkeys(r.table for r in rules if isinstance(r, RowRule)):
        parts.append(_row_rules(tables[name], [r for r in rules if isinstance(r, RowRule) and r.table == name]))
    keys = [r for r in rules if not isinstance(r, RowRule)]
    if keys:
        parts.append(_key_rules(tables, keys))
    return reduce(DataFrame.unionByName, parts)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one set only, with the side they are on; empty where the sets are equal."""
    left = a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("first"))
    return left.unionByName(b.distinct().exceptAll(a.distinct()).withColumn("side", F.lit("second")))


def union_of(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def missing_values(required: list[str], present: Column) -> Column:
    """Required values that an array lacks."""
    return F.array_except(F.lit(required), present)


def size_profile(sizes: DataFrame, size: str) -> DataFrame:
    """(parts, largest, largest_three, total) of a table of part sizes."""
    top = sizes.select(F.col(size)).orderBy(F.desc(size)).limit(3).agg(F.max(size).alias("largest"), F.sum(size).alias("largest_three"))
    total = sizes.agg(F.count("*").alias("parts"), F.sum(size).alias("total"))
    # Two one-row results, laid over each other.
    both = total.unionByName(top, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("parts", "largest", "largest_three", "total")])


def region_rules() -> list:
    """The registry rule suite: tables regions, canonical, crosswalk, provinces."""
    blank = F.lit("")

    def empty(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), blank) == ""

    unsure = F.col("match_status") == "ambiguous_name"
    verified = ["official_current_name_verified", "current_province_id_verified", "kemendagri_code_verified"]
    filled = reduce(lambda a, b: a | b, [~empty(c) for c in verified])
    required = ["region_id", "display_name", "geometry_source_name", "geometry_source_id", "match_status"]
    rules: list = [RowRule(f"region.missing.{c}", "regions", empty(c), "region_id") for c in required]
    rules += [
        RowRule("canonical.hidden-assignment", "canonical", unsure & filled, "legacy_region_id"),
        RowRule("canonical.reason-missing", "canonical", unsure & empty("ambiguity_reason"), "legacy_region_id"),
        RowRule("canonical.code-without-evidence", "canonical", unsure & ~empty("kemendagri_code_verified"), "legacy_region_id"),
        RowRule("canonical.unsure-type", "canonical", unsure & (F.col("region_type") != "unresolved"), "legacy_region_id"),
        RowRule("canonical.unsure-validity", "canonical", unsure & ~empty("valid_from"), "legacy_region_id"),
        RowRule("crosswalk.review-flag", "crosswalk", (F.col("mapping_status") == "ambiguous_metadata") != (F.col("requires_user_review") == "yes"), "legacy_region_id"),
        RowRule("province.not-current", "provinces", F.col("status") != "current", "canonical_province_id"),
        RowRule("province.code-filled", "provinces", ~empty("official_code_verified"), "canonical_province_id"),
        UniqueRule("region.duplicate-id", "regions", "region_id"),
        UniqueRule("region.duplicate-code", "regions", "official_code"),
        UniqueRule("canonical.duplicate-id", "canonical", "canonical_region_id"),
        UniqueRule("province.duplicate-id", "provinces", "canonical_province_id"),
        CoverRule("canonical.lost-legacy-id", "regions", "region_id", "canonical", "legacy_region_id"),
        CoverRule("crosswalk.not-covering", "regions", "region_id", "crosswalk", "legacy_region_id"),
        CoverRule("crosswalk.unknown-legacy-id", "crosswalk", "legacy_region_id", "regions", "region_id"),
        CoverRule("crosswalk.unknown-canonical-id", "crosswalk", "canonical_region_id", "canonical", "canonical_region_id"),
        CoverRule("canonical.orphan-province", "canonical", "current_province_id_verified", "provinces", "canonical_province_id"),
    ]
    return rules
