"""Territories, scenarios and coverage, built from the written contract.

nodes: id, level, display_name, parent_id, status, scenario_id. assignments:
scenario_id, canonical_region_id, leaf_territory_id, ring, status, provenance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.functions import text
from areal.plans.sizing import checkpoint, is_small, lookup_join

LEVELS = ["salesRegion", "area", "branch", "territory"]  # fixed values, top first
RINGS = ["core", "greater", "unassigned"]  # fixed values
PATH_COLUMNS = ["sales_region_id", "area_id", "branch_id", "territory_id"]
COVERAGE_MODES = ["binary", "coverage-percentage", "outlet-count", "active-customer-count", "sku-distribution"]  # fixed values


def _rank(level) -> Column:
    return F.array_position(F.lit(LEVELS), level) - 1


def validate(nodes: DataFrame, small: bool | None = None) -> DataFrame:
    """(scenario_id, id, issue): duplicate-id, orphan, illegal-parent, cycle, too-deep, name-collision.

    Levels have a fixed depth of four. A chain that has not ended after as many steps
    is a cycle if it never ends, and too deep otherwise.
    """
    keys = ["scenario_id", "id"]
    repeated = nodes.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys, F.lit("duplicate-id").alias("issue"))
    parents = nodes.select("scenario_id", F.col("id").alias("parent_id"), F.col("level").alias("_parent_level"), F.col("parent_id").alias("_next")).dropDuplicates(
        ["scenario_id", "parent_id"]
    )
    small = is_small(parents) if small is None else small  # measured once: all lookups here are parts of it
    linked = lookup_join(nodes, parents, ["scenario_id", "parent_id"], "left", spread=["id"], small=small)
    has_parent = text.text_of("parent_id") != ""
    orphan = linked.filter(has_parent & F.col("_parent_level").isNull()).select(*keys, F.lit("orphan").alias("issue"))
    wrong = (has_parent & F.col("_parent_level").isNotNull() & (_rank(F.col("_parent_level")) != _rank(F.col("level")) - 1)) | (
        (_rank(F.col("level")) == 0) == has_parent
    )
    illegal = linked.filter(wrong).select(*keys, F.lit("illegal-parent").alias("issue"))
    climbing = linked.select(*keys, F.col("_next").alias("_at"))
    step = parents.select("scenario_id", F.col("parent_id").alias("_at"), F.col("_next").alias("_up"))
    for _ in LEVELS:
        climbing = lookup_join(climbing, step, ["scenario_id", "_at"], "inner", spread=["id"], small=small).select(*keys, F.col("_up").alias("_at"))
    long = checkpoint(climbing.filter(text.text_of("_at") != "").select(*keys).distinct())
    endless = _endless(step.withColumnsRenamed({"_at": "id", "_up": "_at"}), long)
    cycle = long.join(endless, keys, "left_semi").select(*keys, F.lit("cycle").alias("issue"))
    deep = long.join(endless, keys, "left_anti").select(*keys, F.lit("too-deep").alias("issue"))
    active = nodes.filter("status = 'active'").withColumn("_name", text.normalize_category("display_name"))
    siblings = ["scenario_id", "parent_id", "_name"]
    named = active.withColumn("parent_id", text.text_of("parent_id"))
    crowded = named.groupBy(*siblings).agg(F.count("*").alias("_n")).filter("_n > 1").select(*siblings)
    collision = lookup_join(named, crowded, siblings, "left_semi", spread=["id"], small=small).select(*keys, F.lit("name-collision").alias("issue"))
    every = repeated.unionByName(orphan).unionByName(illegal).unionByName(cycle).unionByName(deep).unionByName(collision)
    return every.distinct()


def _endless(step: DataFrame, long: DataFrame) -> DataFrame:
    """(scenario_id, id) of the nodes whose chain of parents never ends; step: (scenario_id, id, _at), _at the parent.

    Each round doubles the steps of a jump; only nodes with chains that long stay. Once
    none goes, all that are left go round: the ancestors of a node with a finite chain
    have every shorter one.
    """
    keys = ["scenario_id", "id"]
    if long.isEmpty():
        return long
    jumps, left = checkpoint(step.filter(text.text_of("_at") != "")), None
    while True:
        ahead = jumps.select("scenario_id", F.col("id").alias("_at"), F.col("_at").alias("_next"))
        jumps = checkpoint(lookup_join(jumps, ahead, ["scenario_id", "_at"], "inner").select(*keys, F.col("_next").alias("_at")))
        before, left = left, jumps.count()
        if left in (0, before):
            return jumps.select(*keys)


def paths(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments with branch, area and sales region of their leaf: three lookups."""
    up = nodes.select("scenario_id", F.col("id"), F.col("parent_id")).dropDuplicates(["scenario_id", "id"])
    small = is_small(up)
    found = assignments.withColumn("territory_id", F.col("leaf_territory_id"))
    for child, parent in (("territory_id", "branch_id"), ("branch_id", "area_id"), ("area_id", "sales_region_id")):
        step = up.select("scenario_id", F.col("id").alias(child), F.col("parent_id").alias(parent))
        found = lookup_join(found, step, ["scenario_id", child], "left", spread=["canonical_region_id"], small=small)
    return found


def conflicts(assignments: DataFrame) -> DataFrame:
    """Regions that several active leaves of a scenario claim."""
    claimed = assignments.filter("status = 'active' AND leaf_territory_id IS NOT NULL")
    return (
        claimed.select("scenario_id", "canonical_region_id", "leaf_territory_id")
        .distinct()
        .groupBy("scenario_id", "canonical_region_id")
        .agg(F.count("*").alias("leaves"))
        .filter("leaves > 1")
    )


def unassigned(scope: DataFrame, assignments: DataFrame) -> DataFrame:
    """Regions of a scope (scenario_id, canonical_region_id) without an active leaf."""
    keys = ["scenario_id", "canonical_region_id"]
    assigned = assignments.filter("status = 'active' AND leaf_territory_id IS NOT NULL").select(*keys).distinct()
    return scope.select(*keys).distinct().join(assigned, keys, "left_anti")


def exclusions(assignments: DataFrame, nodes: DataFrame, regions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Assignments with exclusion: the reason they stay out of totals, NULL where accepted."""
    small = is_small(nodes)
    issues = validate(nodes, small).filter("issue = 'name-collision'").select("scenario_id", F.col("id").alias("leaf_territory_id"), F.lit(True).alias("_collision")).distinct()
    leaves = nodes.filter("level = 'territory'").select("scenario_id", F.col("id").alias("leaf_territory_id"), F.lit(True).alias("_leaf")).distinct()
    known = regions.select("canonical_region_id", F.lit(True).alias("_region")).distinct()
    plans = scenarios.select(F.col("id").alias("scenario_id"), F.lit(True).alias("_scenario")).distinct()
    spread = ["canonical_region_id"]
    found = lookup_join(assignments, plans, ["scenario_id"], "left", spread=spread)
    found = lookup_join(found, known, ["canonical_region_id"], "left", spread=["leaf_territory_id", "scenario_id"])
    found = lookup_join(found, leaves, ["scenario_id", "leaf_territory_id"], "left", spread=spread, small=small)
    found = lookup_join(found, issues, ["scenario_id", "leaf_territory_id"], "left", spread=spread, small=small)
    reason = (
        F.when(F.col("_scenario").isNull(), "invalid-scenario")
        .when(F.col("_region").isNull(), "unresolved")
        .when(~F.coalesce(F.col("ring").isin(RINGS), F.lit(False)), "invalid-ring")
        .when(F.col("leaf_territory_id").isNotNull() & F.col("_leaf").isNull(), "orphan-assignment")
        .when(F.col("_collision"), "hierarchy-name-collision")
    )
    return found.withColumn("exclusion", reason).drop("_scenario", "_region", "_leaf", "_collision")


def rollup(metrics: DataFrame) -> DataFrame:
    """Sum, count and weighted average per territory, branch, area, sales region and nation.

    metrics: source_row_id, the four path columns, value, weight, state. A source
    row counts once. Only rows with state 'value' reach the totals; the others
    are counted, so every row is accounted for on each level.
    """
    once = metrics.groupBy("source_row_id").agg(
        F.min(F.struct(*PATH_COLUMNS, "value", "weight", "state")).alias("_m"), F.count("*").alias("_copies")
    ).select("_copies", "_m.*")
    accepted = F.col("state") == "value"
    weighed = accepted & (F.col("weight") > 0)
    level = F.element_at(F.lit(["territory", "branch", "area", "salesRegion", "national"]), F.bit_count(F.grouping_id()) + 1)
    return once.rollup(*PATH_COLUMNS).agg(
        level.alias("level"),
        F.sum(F.when(accepted, F.col("value"))).alias("total"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(F.col("state") == "excluded").alias("excluded"),
        F.count_if(F.col("state") == "unresolved").alias("unresolved"),
        F.sum(F.col("_copies") - 1).alias("duplicates"),
        weighted_average(F.when(weighed, F.col("value")), F.when(weighed, F.col("weight"))).alias("weighted_average"),
        F.when(F.count_if(weighed) > 0, "value").otherwise("not-computable").alias("average_state"),
    )


def weighted_average(value: Column, weight: Column) -> Column:
    """Percentages are averaged by weight, never summed; NULL without a denominator."""
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def fork(assignments: DataFrame, source: str, target: str) -> DataFrame:
    """Valid assignments of a scenario, copied under a new scenario id."""
    valid = assignments.filter((F.col("scenario_id") == source) & (F.col("status") == "active") & F.col("ring").isin(RINGS))
    return valid.withColumns(
        {"scenario_id": F.lit(target), "base_scenario_id": F.lit(source), "provenance": F.lit("copied-from-scenario")}
    )


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """(canonical_region_id, change) between two scenarios with paths.

    Columns: canonical_region_id, territory_id, branch_id, area_id,
    sales_region_id, ring, resolved; one row per region.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        higher = F.concat_ws("/", *[F.coalesce(c, F.lit("-")) for c in PATH_COLUMNS[:3]])
        return df.select("canonical_region_id", F.struct("territory_id", higher.alias("higher"), "ring", "resolved").alias(name))

    joined = side(first, "a").join(side(second, "b"), "canonical_region_id", "full_outer")
    a, b = F.col("a"), F.col("b")
    held, holds = a["territory_id"].isNotNull(), b["territory_id"].isNotNull()
    change = (
        F.when(~F.coalesce(b["resolved"], a["resolved"], F.lit(False)), "unresolved")
        .when(~held & holds, "newly-assigned")
        .when(held & ~holds, "removed")
        .when(held & holds & (a["territory_id"] != b["territory_id"]), "reassigned")
        .when(held & holds & ~a["higher"].eqNullSafe(b["higher"]), "hierarchy-changed")
        .when(~a["ring"].eqNullSafe(b["ring"]), "ring-changed")
        .otherwise("unchanged")
    )
    return joined.select("canonical_region_id", change.alias("change"))


def gap(current, target) -> Column:
    """Target minus current; negative means above target and stays visible."""
    return F.col(target) - F.col(current)


def gap_label(value: Column) -> Column:
    return F.when(value < 0, "above-target").when(value == 0, "on-target").when(value > 0, "below-target")


def state(current, target, denominator, low: float | None = None, high: float | None = None) -> Column:
    """Why a coverage figure can or cannot be read; values out of bounds are invalid, not clamped."""
    now, goal, base = F.col(current), F.col(target), F.col(denominator)
    outside = F.lit(False)
    if low is not None:
        outside = outside | (now < low) | (goal < low)
    if high is not None:
        outside = outside | (now > high) | (goal > high)
    return (
        F.when(now.isNull() & goal.isNull(), "no-data")
        .when(now.isNull(), "current-missing")
        .when(goal.isNull(), "target-missing")
        .when((now < 0) | (goal < 0), "negative")
        .when(F.coalesce(outside, F.lit(False)), "invalid")
        .when(base.isNull(), "denominator-missing")
        .when(base == 0, "denominator-zero")
        .otherwise("value")
    )


def coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Coverage per group and mode from numerators and denominators, divided at the end.

    rows: mode, numerator, denominator, state and the group columns.
    """
    usable = F.col("state") == "value"
    summed = rows.groupBy(*by, "mode").agg(
        F.sum(F.when(usable, F.col("numerator"))).alias("numerator"),
        F.sum(F.when(usable, F.col("denominator"))).alias("denominator"),
        F.count_if(usable).alias("rows"),
        F.count_if(~usable).alias("left_out"),
    )
    share = F.col("numerator") / F.nullif("denominator", F.lit(0.0))
    shown = F.when(F.col("mode") == "binary", F.when(F.col("numerator") > 0, 1.0).otherwise(0.0)).when(
        F.col("mode").isin("coverage-percentage", "sku-distribution"), share
    ).otherwise(F.col("numerator"))
    return summed.withColumn("coverage", F.when(F.col("rows") > 0, shown)).withColumn(
        "covered", F.when(F.col("rows") == 0, "no-data").when(F.col("numerator") > 0, "covered").otherwise("not-covered")
    )
