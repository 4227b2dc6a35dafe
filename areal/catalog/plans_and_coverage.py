"""Territories, scenarios and coverage over regions, nations, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from areal.catalog.registered import query
from areal.operators import territory
from areal.plans import inputs

# Sales region = region, area = nation, branch = nation and size class, territory = supplier; some nodes are faulty.
inputs.DERIVED["nodes"] = """
SELECT 'current' AS scenario_id, concat('S', CAST(r_regionkey AS STRING)) AS id, 'salesRegion' AS level, r_name AS display_name, CASE WHEN r_regionkey = 4 THEN 'A1' ELSE '' END AS parent_id, 'active' AS status FROM {region}
UNION ALL SELECT 'current', concat('A', CAST(n_nationkey AS STRING)), 'area', CASE WHEN n_nationkey IN (5, 10) THEN ' Same  näme' ELSE n_name END, concat('S', CAST(n_regionkey AS STRING)), 'active' FROM {nation}
UNION ALL SELECT 'current', concat('B', CAST(n_nationkey AS STRING), '-x'), 'branch', concat(n_name, 'x'), CASE WHEN n_nationkey = 7 THEN 'S1' ELSE concat('A', CAST(n_nationkey AS STRING)) END, 'active' FROM {nation}
UNION ALL SELECT 'current', concat('B', CAST(n_nationkey AS STRING), '-y'), 'branch', concat(n_name, 'y'), CASE WHEN n_nationkey = 7 THEN 'S1' ELSE concat('A', CAST(n_nationkey AS STRING)) END, 'active' FROM {nation}
UNION ALL SELECT 'current', concat('T', CAST(s_suppkey AS STRING)), 'territory', s_name, CASE WHEN s_acctbal < -500 THEN 'B99-x' ELSE concat('B', CAST(s_nationkey AS STRING), '-', CASE WHEN s_acctbal > 4000 THEN 'x' ELSE 'y' END) END, CASE WHEN s_acctbal > 9000 THEN 'archived' ELSE 'active' END FROM {supplier}
UNION ALL SELECT 'current', concat('T', CAST(s_suppkey AS STRING)), 'territory', concat(s_name, ' twin'), concat('B', CAST(s_nationkey AS STRING), '-x'), 'active' FROM {supplier} WHERE s_acctbal > 9500
UNION ALL SELECT 'loop', concat('L', CAST(r_regionkey AS STRING)), 'area', concat('left ', r_name), concat('M', CAST(r_regionkey AS STRING)), 'active' FROM {region}
UNION ALL SELECT 'loop', concat('M', CAST(r_regionkey AS STRING)), 'branch', concat('right ', r_name), concat('L', CAST(r_regionkey AS STRING)), 'active' FROM {region}
UNION ALL SELECT 'deep', concat('D', CAST(n_nationkey AS STRING)), 'territory', concat('deep ', n_name), CASE WHEN n_nationkey = 0 THEN '' ELSE concat('D', CAST(n_nationkey - 1 AS STRING)) END, 'active' FROM {nation}"""

# A customer is a region; its leaf is a supplier of the same number range.
inputs.DERIVED["placements"] = """
SELECT 'current' AS scenario_id, concat('r', CAST(c_custkey AS STRING)) AS canonical_region_id,
       CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'FURNITURE' AND c_acctbal > 9000 THEN 'T-none' ELSE concat('T', CAST(s_suppkey AS STRING)) END AS leaf_territory_id,
       CASE WHEN c_acctbal < 0 THEN 'unassigned' WHEN c_acctbal > 9500 THEN 'outer' WHEN c_acctbal > 5000 THEN 'core' ELSE 'greater' END AS ring,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000 THEN 'archived' ELSE 'active' END AS status, 'imported' AS provenance
FROM {customer} JOIN {supplier} ON s_suppkey = c_custkey % 10
UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'gone' ELSE 'current' END, concat('r', CAST(o_custkey AS STRING)), concat('T', CAST(o_orderkey % 10 AS STRING)), 'core', 'active', 'manually-assigned'
FROM {orders} WHERE o_totalprice > 400000"""


@query(
    "t1_hierarchy_validation",
    """WITH RECURSIVE n AS (SELECT * FROM {nodes}), p AS (SELECT scenario_id, id, any_value(level) AS level, any_value(parent_id) AS parent_id FROM n GROUP BY 1, 2),
    r AS (SELECT 'salesRegion' AS level, 0 AS k UNION ALL SELECT 'area', 1 UNION ALL SELECT 'branch', 2 UNION ALL SELECT 'territory', 3),
    j AS (SELECT n.*, p.level AS pl, r.k, q.k AS pk FROM n JOIN r ON r.level = n.level LEFT JOIN p ON p.scenario_id = n.scenario_id AND p.id = n.parent_id LEFT JOIN r q ON q.level = p.level),
    up AS (SELECT scenario_id, id, parent_id AS a, 1 AS k FROM n UNION ALL SELECT u.scenario_id, u.id, p.parent_id, k + 1 FROM up u JOIN p ON p.scenario_id = u.scenario_id AND p.id = u.a WHERE k < 60),
    chain AS (SELECT scenario_id, id, max(k) AS k FROM up WHERE a <> '' GROUP BY 1, 2),
    s AS (SELECT scenario_id, id, parent_id, upper(trim(regexp_replace(strip_accents(display_name), '\\s+', ' ', 'g'))) AS nm FROM n WHERE status = 'active')
    SELECT DISTINCT * FROM (SELECT scenario_id, id, 'duplicate-id' AS issue FROM n GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT scenario_id, id, 'orphan' FROM j WHERE parent_id <> '' AND pl IS NULL
    UNION ALL SELECT scenario_id, id, 'illegal-parent' FROM j WHERE (parent_id <> '' AND pk IS NOT NULL AND pk <> k - 1) OR ((k = 0) = (parent_id <> ''))
    UNION ALL SELECT scenario_id, id, CASE WHEN k = 60 THEN 'cycle' ELSE 'too-deep' END FROM chain WHERE k > 5
    UNION ALL SELECT s.scenario_id, s.id, 'name-collision' FROM s JOIN (SELECT scenario_id, parent_id, nm FROM s GROUP BY ALL HAVING count(*) > 1) d USING (scenario_id, parent_id, nm))""",
)
def t1(t):
    return territory.validate(t.nodes)


_PATH = """(SELECT a.*, a.leaf_territory_id AS territory_id, t.parent_id AS branch_id, b.parent_id AS area_id, r.parent_id AS sales_region_id FROM {placements} a
    LEFT JOIN up t ON t.scenario_id = a.scenario_id AND t.id = a.leaf_territory_id LEFT JOIN up b ON b.scenario_id = a.scenario_id AND b.id = t.parent_id LEFT JOIN up r ON r.scenario_id = a.scenario_id AND r.id = b.parent_id)"""
inputs.DERIVED["clean_nodes"] = "SELECT scenario_id, id, level, display_name, parent_id, status FROM {nodes} WHERE display_name NOT LIKE '% twin'"


@query("t2_assignment_paths", f"WITH up AS (SELECT scenario_id, id, parent_id FROM {{clean_nodes}}) SELECT scenario_id, canonical_region_id, territory_id, branch_id, area_id, sales_region_id FROM {_PATH}")
def t2(t):
    return territory.paths(t.clean_nodes, t.placements).select("scenario_id", "canonical_region_id", "territory_id", "branch_id", "area_id", "sales_region_id")


@query("t3_overlaps", "SELECT scenario_id, canonical_region_id, count(DISTINCT leaf_territory_id) AS leaves FROM {placements} WHERE status = 'active' GROUP BY ALL HAVING count(DISTINCT leaf_territory_id) > 1")
def t3(t):
    return territory.conflicts(t.placements)


@query(
    "t4_unassigned_in_scope",
    "SELECT DISTINCT 'current' AS scenario_id, concat('r', CAST(c_custkey AS VARCHAR)) AS canonical_region_id FROM {customer} WHERE concat('r', CAST(c_custkey AS VARCHAR)) NOT IN (SELECT canonical_region_id FROM {placements} WHERE scenario_id = 'current' AND status = 'active' AND leaf_territory_id IS NOT NULL)",
)
def t4(t):
    scope = t.customer.select(F.lit("current").alias("scenario_id"), F.concat(F.lit("r"), "c_custkey").alias("canonical_region_id"))
    return territory.unassigned(scope, t.placements)


@query(
    "t5_exclusion_classes",
    """WITH leaf AS (SELECT DISTINCT scenario_id, id FROM {nodes} WHERE level = 'territory'),
    s AS (SELECT scenario_id, id, parent_id, upper(trim(display_name)) AS nm FROM {nodes} WHERE status = 'active'),
    bad AS (SELECT DISTINCT s.scenario_id, s.id FROM s JOIN (SELECT scenario_id, parent_id, nm FROM s GROUP BY ALL HAVING count(*) > 1) d USING (scenario_id, parent_id, nm))
    SELECT a.canonical_region_id, a.leaf_territory_id, a.ring, CASE WHEN a.scenario_id <> 'current' THEN 'invalid-scenario' WHEN c.c_custkey IS NULL THEN 'unresolved' WHEN a.ring NOT IN ('core', 'greater', 'unassigned') THEN 'invalid-ring'
      WHEN a.leaf_territory_id IS NOT NULL AND l.id IS NULL THEN 'orphan-assignment' WHEN b.id IS NOT NULL THEN 'hierarchy-name-collision' END AS exclusion
    FROM {placements} a LEFT JOIN (SELECT * FROM {customer} WHERE c_mktsegment <> 'MACHINERY' OR c_acctbal < 9000) c ON concat('r', CAST(c.c_custkey AS VARCHAR)) = a.canonical_region_id
    LEFT JOIN leaf l ON l.scenario_id = a.scenario_id AND l.id = a.leaf_territory_id LEFT JOIN bad b ON b.scenario_id = a.scenario_id AND b.id = a.leaf_territory_id""",
)
def t5(t):
    regions = t.customer.filter("c_mktsegment <> 'MACHINERY' OR c_acctbal < 9000").select(F.concat(F.lit("r"), "c_custkey").alias("canonical_region_id"))
    scenarios = t.nodes.select(F.col("scenario_id").alias("id")).distinct()
    out = territory.exclusions(t.placements, t.nodes, regions, scenarios)
    return out.select("canonical_region_id", "leaf_territory_id", "ring", "exclusion")


# One metric row per line item; lines of a returned order come twice.
inputs.DERIVED["line_metrics"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(l_quantity AS INT) AS STRING), '-', CAST(CAST(l_extendedprice * 100 AS BIGINT) AS STRING)) AS source_row_id,
       CAST(s_nationkey % 5 AS STRING) AS sales_region_id, CAST(s_nationkey AS STRING) AS area_id, CASE WHEN s_acctbal > 4000 THEN 'x' ELSE 'y' END AS branch_id, CAST(s_suppkey AS STRING) AS territory_id,
       l_quantity AS value, CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_discount * 100 END AS weight,
       CASE WHEN l_linestatus = 'O' AND l_tax > 0.07 THEN 'unresolved' WHEN l_tax = 0 THEN 'excluded' ELSE 'value' END AS state
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey"""
inputs.DERIVED["metrics"] = "SELECT * FROM {line_metrics} UNION ALL SELECT * FROM {line_metrics} WHERE value > 45"


@query(
    "t6_metric_rollup",
    """WITH once AS (SELECT source_row_id, sales_region_id, area_id, branch_id, territory_id, value, weight, state, count(*) AS copies FROM {metrics} GROUP BY ALL)
    SELECT sales_region_id, area_id, branch_id, territory_id, CASE bit_count(grouping(sales_region_id, area_id, branch_id, territory_id)) WHEN 0 THEN 'territory' WHEN 1 THEN 'branch' WHEN 2 THEN 'area' WHEN 3 THEN 'salesRegion' ELSE 'national' END AS level,
      sum(value) FILTER (WHERE state = 'value') AS total, count(*) FILTER (WHERE state = 'value') AS accepted, count(*) FILTER (WHERE state = 'excluded') AS excluded, count(*) FILTER (WHERE state = 'unresolved') AS unresolved,
      CAST(sum(copies - 1) AS BIGINT) AS duplicates, round(sum(value * weight) FILTER (WHERE state = 'value' AND weight > 0) / nullif(sum(weight) FILTER (WHERE state = 'value' AND weight > 0), 0), 6) AS weighted_average,
      CASE WHEN count(*) FILTER (WHERE state = 'value' AND weight > 0) > 0 THEN 'value' ELSE 'not-computable' END AS average_state
    FROM once GROUP BY ROLLUP (sales_region_id, area_id, branch_id, territory_id)""",
)
def t6(t):
    rolled = territory.rollup(t.metrics)
    return rolled.withColumn("weighted_average", F.round("weighted_average", 6))


@query(
    "t7_weighted_average",
    "SELECT l_suppkey, round(sum(l_tax * w) / nullif(sum(w), 0), 8) AS average FROM (SELECT l_suppkey, l_tax, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS w FROM {lineitem}) GROUP BY 1",
)
def t7(t):
    weight = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))
    return t.lineitem.groupBy("l_suppkey").agg(F.round(territory.weighted_average(F.col("l_tax"), weight), 8).alias("average"))


@query(
    "t8_scenario_fork",
    "SELECT 'proposed' AS scenario_id, canonical_region_id, leaf_territory_id, ring, 'current' AS base_scenario_id, 'copied-from-scenario' AS provenance FROM {placements} WHERE scenario_id = 'current' AND status = 'active' AND ring IN ('core', 'greater', 'unassigned')",
)
def t8(t):
    forked = territory.fork(t.placements, "current", "proposed")
    return forked.select("scenario_id", "canonical_region_id", "leaf_territory_id", "ring", "base_scenario_id", "provenance")


inputs.DERIVED["plan_a"] = """SELECT concat('r', CAST(c_custkey AS STRING)) AS canonical_region_id, CASE WHEN c_acctbal > 1000 THEN concat('T', CAST(c_custkey % 10 AS STRING)) END AS territory_id,
    CAST(c_nationkey AS STRING) AS branch_id, CAST(c_nationkey % 5 AS STRING) AS area_id, 'S' AS sales_region_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'core' ELSE 'greater' END AS ring, c_acctbal > -800 AS resolved FROM {customer}"""
inputs.DERIVED["plan_b"] = """SELECT concat('r', CAST(c_custkey AS STRING)) AS canonical_region_id, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN concat('T', CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN (c_custkey + 1) % 10 ELSE c_custkey % 10 END AS STRING)) END AS territory_id,
    CAST(c_nationkey AS STRING) AS branch_id, CAST(CASE WHEN c_nationkey = 3 THEN 9 ELSE c_nationkey % 5 END AS STRING) AS area_id, 'S' AS sales_region_id, CASE WHEN c_acctbal > 6000 THEN 'core' ELSE 'greater' END AS ring, true AS resolved FROM {customer} WHERE c_acctbal < 9500"""


@query(
    "t9_scenario_comparison",
    """SELECT canonical_region_id, CASE WHEN NOT coalesce(br, ar, false) THEN 'unresolved' WHEN ta IS NULL AND tb IS NOT NULL THEN 'newly-assigned' WHEN ta IS NOT NULL AND tb IS NULL THEN 'removed'
        WHEN ta <> tb THEN 'reassigned' WHEN ta IS NOT NULL AND tb IS NOT NULL AND ah IS DISTINCT FROM bh THEN 'hierarchy-changed' WHEN ag IS DISTINCT FROM bg THEN 'ring-changed' ELSE 'unchanged' END AS change
       FROM (SELECT coalesce(a.canonical_region_id, b.canonical_region_id) AS canonical_region_id, a.territory_id AS ta, b.territory_id AS tb, concat(a.sales_region_id, '/', a.area_id, '/', a.branch_id) AS ah, concat(b.sales_region_id, '/', b.area_id, '/', b.branch_id) AS bh,
             a.ring AS ag, b.ring AS bg, a.resolved AS ar, b.resolved AS br FROM {plan_a} a FULL OUTER JOIN {plan_b} b ON b.canonical_region_id = a.canonical_region_id)""",
)
def t9(t):
    return territory.compare(t.plan_a, t.plan_b)


# Coverage figures per nation and segment.
inputs.DERIVED["figures"] = """SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'binary' WHEN 'MACHINERY' THEN 'coverage-percentage' WHEN 'FURNITURE' THEN 'outlet-count' WHEN 'HOUSEHOLD' THEN 'sku-distribution' ELSE 'active-customer-count' END AS mode,
    CASE WHEN c_acctbal BETWEEN 100 AND 400 THEN NULL ELSE floor(c_acctbal / 100) END AS current_value, CASE WHEN c_acctbal > 9600 THEN NULL ELSE CAST(c_nationkey * 4 AS DOUBLE) END AS target_value,
    CAST(CASE WHEN c_nationkey = 2 THEN 0 WHEN c_nationkey = 3 AND c_acctbal > 5000 THEN NULL ELSE 100 END AS DOUBLE) AS denominator FROM {customer}"""
_STATE = """CASE WHEN current_value IS NULL AND target_value IS NULL THEN 'no-data' WHEN current_value IS NULL THEN 'current-missing' WHEN target_value IS NULL THEN 'target-missing' WHEN current_value < 0 OR target_value < 0 THEN 'negative'
    WHEN current_value > 90 OR target_value > 90 THEN 'invalid' WHEN denominator IS NULL THEN 'denominator-missing' WHEN denominator = 0 THEN 'denominator-zero' ELSE 'value' END"""


@query(
    "t10_coverage_gap",
    "SELECT c_custkey, target_value - current_value AS gap, CASE WHEN target_value < current_value THEN 'above-target' WHEN target_value = current_value THEN 'on-target' WHEN target_value > current_value THEN 'below-target' END AS label FROM {figures}",
)
def t10(t):
    gap = territory.gap("current_value", "target_value")
    return t.figures.select("c_custkey", gap.alias("gap"), territory.gap_label(gap).alias("label"))


@query("t11_metric_state", f"SELECT c_custkey, {_STATE} AS state FROM {{figures}}")
def t11(t):
    return t.figures.select("c_custkey", territory.state("current_value", "target_value", "denominator", 0, 90).alias("state"))


@query(
    "t12_coverage_aggregation",
    f"""SELECT c_nationkey, mode, numerator, denominator, rows, left_out, round(CASE WHEN rows = 0 THEN NULL WHEN mode = 'binary' THEN CASE WHEN numerator > 0 THEN 1 ELSE 0 END WHEN mode IN ('coverage-percentage', 'sku-distribution') THEN numerator / nullif(denominator, 0) ELSE numerator END, 8) AS coverage,
        CASE WHEN rows = 0 THEN 'no-data' WHEN numerator > 0 THEN 'covered' ELSE 'not-covered' END AS covered
        FROM (SELECT c_nationkey, mode, sum(current_value) FILTER (WHERE state = 'value') AS numerator, sum(denominator) FILTER (WHERE state = 'value') AS denominator, count(*) FILTER (WHERE state = 'value') AS rows, count(*) FILTER (WHERE state <> 'value') AS left_out
              FROM (SELECT *, {_STATE} AS state FROM {{figures}}) GROUP BY ALL)""",
)
def t12(t):
    rows = t.figures.withColumns({"state": territory.state("current_value", "target_value", "denominator", 0, 90), "numerator": F.col("current_value").cast("double")})
    out = territory.coverage(rows, ["c_nationkey"])
    return out.withColumn("coverage", F.round("coverage", 8))
