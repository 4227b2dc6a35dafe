"""Classification, legends, colour groups and window idioms."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from areal.catalog.registered import query
from areal.catalog.scalars import sql_coerce, sql_format
from areal.functions import number
from areal.operators import classify, legend, sketches
from areal.plans import inputs
from areal.plans.sizing import literal_table, lookup_join, shared_folder, values_at

inputs.DERIVED["usable"] = f"""SELECT *, {sql_coerce('numeric_value')} AS value,
  CASE WHEN trim(category) = '' THEN 'TANPA KATEGORI' ELSE upper(trim(category)) END AS cat
  FROM {{valued}} WHERE status NOT IN ('ignored', 'unmatched', 'ambiguous', 'duplicate-target', 'invalid')"""
inputs.DERIVED["numeric"] = "SELECT region_id, row_id, row_number, value FROM {usable} WHERE value IS NOT NULL"

_BLUE = "['#F0F7FF', '#C6DBEF', '#9ECAE1', '#6BAED6', '#3182BD', '#08519C', '#08306B']"
_AMBER_REVERSED = "['#8A5409', '#B97612', '#D99525', '#EAB348', '#F5CF75', '#FDE7B1', '#FFF7E6']"
_NO_DATA_ROW = "SELECT 'no-data' AS key, 'No data' AS label, '#D9E0E6' AS color FROM (SELECT count(*) AS n FROM {valued} WHERE region_id NOT IN (SELECT region_id FROM {numeric})) WHERE n > 0"


def _assigned(result: classify.Classified):
    return result.assignments.select("region_id", "class_key", "color")


def _legend(result: classify.Classified):
    return result.legend.select("key", "label", "color")


_CATS = "SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS i FROM (SELECT DISTINCT cat FROM {usable})"
_QUAL = "['#0072B2', '#E69F00', '#009E73', '#CC79A7', '#56B4E9', '#D55E00', '#F0E442', '#332288', '#88CCEE', '#44AA99', '#DDCC77', '#AA4499']"


@query("c1_categorical", f"SELECT region_id, u.cat AS class_key, {_QUAL}[CAST(i AS INTEGER) + 1] AS color FROM {{usable}} u JOIN ({_CATS}) c ON c.cat = u.cat")
def c1(t):
    return _assigned(classify.classify(t.valued))


@query(
    "c1_many_categories",
    """SELECT p_partkey, cat AS class_key, CASE WHEN i < 12 THEN ['#174A5B', '#2B7A78', '#4CA6A8', '#8BC6C5', '#E1B44B', '#D97A43', '#35627A', '#6D9F9C', '#B5D8D1', '#F0D58A', '#A8533D', '#6C7C86'][i + 1]
       ELSE 'derived' END AS color FROM (SELECT p_partkey, upper(p_brand) AS cat FROM {part}) JOIN
       (SELECT cat AS c2, CAST(row_number() OVER (ORDER BY cat) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT upper(p_brand) AS cat FROM {part})) ON c2 = cat""",
)
def c1_many(t):
    rows = t.part.select(
        F.col("p_partkey").cast("string").alias("row_id"), F.col("p_partkey").alias("row_number"), F.col("p_partkey").cast("string").alias("region_id"),
        F.lit("exact-code").alias("status"), F.lit("").alias("numeric_value"), F.col("p_brand").alias("category"),
    )
    out = classify.classify(rows, palette_name="coastal").assignments
    color = F.when(F.col("color").startswith("hsl("), "derived").otherwise(F.col("color"))
    return out.select(F.col("region_id").cast("bigint").alias("p_partkey"), "class_key", color.alias("color"))


@query("c2_numeric_gate", "SELECT row_id, round(value, 4) AS value FROM {numeric}")
def c2(t):
    gated = classify.usable(t.valued).select("row_id", number.coerce_value("numeric_value").alias("value")).filter("value IS NOT NULL")
    return gated.select("row_id", F.round("value", 4).alias("value"))


inputs.DERIVED["range5"] = "SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 5 AS step FROM {numeric}"


@query(
    "c3_equal_interval",
    f"""SELECT region_id, CAST(c AS VARCHAR) AS class_key, {_BLUE}[c + 1] AS color FROM (SELECT region_id,
        CASE WHEN value <= lo + step THEN 0 WHEN value <= lo + step * 2 THEN 1 WHEN value <= lo + step * 3 THEN 2 WHEN value <= lo + step * 4 THEN 3 ELSE 4 END AS c FROM {{numeric}}, {{range5}})""",
)
def c3(t):
    return _assigned(classify.classify(t.valued, "equal-interval"))


def _cuts(k: int) -> str:
    positions = ", ".join(f"CAST(least(n, ceil({i} * n / {k})) AS BIGINT)" for i in range(1, k))
    return f"""SELECT DISTINCT value AS cut FROM (SELECT value, row_number() OVER (ORDER BY value, region_id, row_id) AS p, count(*) OVER () AS n FROM {{numeric}}) WHERE p IN ({positions})"""


@query(
    "c4_quantile",
    f"""WITH cuts AS ({_cuts(7)}) SELECT region_id, CAST(c AS VARCHAR) AS class_key, {_AMBER_REVERSED}[c + 1] AS color
        FROM (SELECT region_id, (SELECT count(*) FROM cuts WHERE cut < value) AS c FROM {{numeric}})""",
)
def c4(t):
    return _assigned(classify.classify(t.valued, "quantile", classes=7, palette_name="amber", reverse=True))


# One sketch per month is stored; breaks over all months come from the merged ones.
@query(
    "c4_quantile_sketch",
    """WITH s AS (SELECT list(o_totalprice ORDER BY o_totalprice) AS v, count(*) AS n FROM {orders}) SELECT CAST(i AS INTEGER) AS break, v[CAST(least(n, ceil(i * n / 7)) AS BIGINT)] AS exact, TRUE AS within_error FROM s, (SELECT unnest(range(1, 7)) AS i)""",
)
def c4_sketch(t):
    by_month = sketches.build(t.orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["month"], "o_totalprice")
    folder = f"{shared_folder(t.spark)}/sketches-{zlib.crc32(t.sf_dir.encode())}"
    by_month.write.mode("overwrite").parquet(folder)
    stored = t.spark.read.parquet(folder)
    near, exact = sketches.breaks(stored, 7), sketches.exact_breaks(t.orders, "o_totalprice", stored, 7)
    # the ranks that the approximate breaks really have
    rows = literal_table(t.spark, ["break", "near", "exact"], [(i, a, e) for i, (a, e) in enumerate(zip(near, exact, strict=True), start=1)])
    ranks = t.orders.agg(F.count("*").alias("n"), *[F.count_if(F.col("o_totalprice") <= a).alias(f"r{i}") for i, a in enumerate(near, start=1)])
    ranks = ranks.select("n", F.posexplode(F.array(*[f"r{i}" for i in range(1, len(near) + 1)])).alias("i", "rank"))
    off = F.abs(F.col("rank") / F.col("n") - F.col("break") / 7)
    joined = rows.join(ranks, F.col("break") == F.col("i") + 1)
    return joined.select("break", "exact", (off <= 2 * sketches.rank_error() + 1 / F.col("n")).alias("within_error"))


@query(
    "c5_manual_breaks",
    f"""SELECT region_id, CAST(c AS VARCHAR) AS class_key, {_BLUE}[c + 1] AS color FROM (SELECT region_id,
        CASE WHEN value <= 0 THEN 0 WHEN value <= 1000 THEN 1 WHEN value <= 2500.5 THEN 2 WHEN value <= 9000 THEN 3 ELSE 4 END AS c FROM {{numeric}})""",
)
def c5(t):
    return _assigned(classify.classify(t.valued, "manual", breaks="0; 1000, 2500.5 9000"))


_DIV = """SELECT region_id, value, CASE WHEN value = 4000 THEN 0 WHEN value < 4000 THEN -1 - CAST(least(1, floor((4000 - value) / b * 2)) AS INTEGER)
    ELSE 1 + CAST(least(1, floor((value - 4000) / a * 2)) AS INTEGER) END AS s
    FROM {numeric}, (SELECT max(4000 - value) AS b, max(value - 4000) AS a FROM {numeric})"""


@query(
    "c6_diverging",
    f"""SELECT region_id, CASE WHEN s = 0 THEN 'center' WHEN s = -2 THEN 'below-0' WHEN s = -1 THEN 'below-1' WHEN s = 1 THEN 'above-0' ELSE 'above-1' END AS class_key,
        ['#2166AC', '#67A9CF', '#F7F7F7', '#EF8A62', '#B2182B'][s + 3] AS color FROM ({_DIV})""",
)
def c6(t):
    return _assigned(classify.classify(t.valued, "diverging", classes=4, center=4000))


@query(
    "c6_diverging_compat",
    f"""SELECT region_id, CASE WHEN s = 0 THEN 'center' WHEN s = -2 THEN 'below-1' WHEN s = -1 THEN 'below-0' WHEN s = 1 THEN 'above-0' ELSE 'above-1' END AS class_key,
        CASE s WHEN -1 THEN '#2166AC' WHEN -2 THEN '#67A9CF' WHEN 0 THEN '#D1E5F0' WHEN 1 THEN '#F7F7F7' ELSE '#FDDBC7' END AS color FROM ({_DIV})""",
)
def c6_compat(t):
    return _assigned(classify.classify(t.valued, "diverging", classes=4, center=4000, compat=True))


@query("c7_no_data", "SELECT row_id FROM {valued} WHERE region_id NOT IN (SELECT region_id FROM {numeric})")
def c7(t):
    return classify.classify(t.valued, "quantile").no_data.select("row_id")


@query(
    "c8_palette_lookup",
    f"SELECT o_orderkey, {_BLUE}[CAST(o_custkey % 7 AS INTEGER) + 1] AS color FROM {{orders}}",
)
def c8(t):
    blue = classify.palette_table(t.spark).filter("family = 'sequential' AND palette = 'blue'").select("position", "color")
    keyed = t.orders.select("o_orderkey", (F.col("o_custkey") % 7).cast("int").alias("position"))
    return keyed.join(F.broadcast(blue), "position").select("o_orderkey", "color")


@query(
    "c9_legend_quantile",
    f"""WITH cuts AS ({_cuts(5)}), l AS (SELECT cut, lag(cut) OVER (ORDER BY cut) AS low, row_number() OVER (ORDER BY cut) - 1 AS i, count(*) OVER () AS n FROM cuts)
        SELECT CAST(i AS VARCHAR) AS key, CASE WHEN i = 0 THEN concat('≤ ', {sql_format('cut', 'id-ID')}) ELSE concat({sql_format('low', 'id-ID')}, '–', {sql_format('cut', 'id-ID')}) END AS label, {_BLUE}[CAST(i AS INTEGER) + 1] AS color FROM l
        UNION ALL SELECT CAST(max(i) + 1 AS VARCHAR), concat('> ', {sql_format('max(cut)', 'id-ID')}), {_BLUE}[CAST(max(i) AS INTEGER) + 2] FROM l
        UNION ALL {_NO_DATA_ROW}""".replace("{:", "{{:").replace("f}'", "f}}'").replace("{{", "{").replace("}}", "}"),
)
def c9(t):
    return _legend(classify.classify(t.valued, "quantile"))


@query(
    "c9_legend_equal_interval",
    f"""SELECT CAST(i AS VARCHAR) AS key, concat({sql_format('lo + step * i', 'integer')}, '–', CASE WHEN i = 4 THEN {sql_format('hi', 'integer')} ELSE {sql_format('lo + step * (i + 1)', 'integer')} END) AS label, {_BLUE}[i + 1] AS color
        FROM {{range5}}, (SELECT CAST(unnest(range(5)) AS INTEGER) AS i) UNION ALL {_NO_DATA_ROW}""".replace("{:", "{{:").replace("f}'", "f}}'").replace("{{", "{").replace("}}", "}"),
)
def c9_equal(t):
    return _legend(classify.classify(t.valued, "equal-interval", number_format="integer"))




@query(
    "c10_last_row_wins",
    "SELECT region_id, row_id, CAST(CASE WHEN value <= 0 THEN 0 WHEN value <= 5000 THEN 1 ELSE 2 END AS VARCHAR) AS class_key FROM (SELECT region_id, row_id, value, row_number() OVER (PARTITION BY region_id ORDER BY value DESC, row_id DESC) AS n FROM (SELECT concat('r', CAST(c_nationkey AS VARCHAR)) AS region_id, concat('row-', CAST(c_custkey AS VARCHAR)) AS row_id, CAST(CAST(c_acctbal AS DECIMAL(12,1)) AS DOUBLE) AS value FROM {customer})) WHERE n = 1",
)
def c10(t):
    rows = t.customer.select(
        F.concat(F.lit("row-"), "c_custkey").alias("row_id"), F.col("c_custkey").alias("row_number"), F.concat(F.lit("r"), "c_nationkey").alias("region_id"),
        F.lit("exact-code").alias("status"), F.col("c_acctbal").cast("decimal(12,1)").cast("string").alias("numeric_value"), F.lit("").alias("category"),
    )
    return classify.classify(rows, "manual", breaks=[0.0, 5000.0]).assignments.select("region_id", "row_id", "class_key")


# Manual colours: one per customer with a balance above 5000, by segment.
inputs.DERIVED["manual"] = """
SELECT concat('r', CAST(c_custkey AS STRING)) AS region_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN '#4472c4' WHEN 'MACHINERY' THEN '#E74C3C' WHEN 'FURNITURE' THEN '#123456' ELSE '#087F73' END AS color,
       'manual' AS category, CAST(c_custkey AS STRING) AS value
FROM {customer} WHERE c_acctbal > 5000"""


@query(
    "j13_assignment_overlay",
    f"""SELECT coalesce(m.region_id, a.region_id) AS region_id, coalesce(a.color, m.color) AS color,
        CASE WHEN a.region_id IS NULL THEN m.category ELSE a.category END AS category, CASE WHEN a.region_id IS NULL THEN m.value ELSE a.numeric_value END AS value
        FROM {{manual}} m FULL OUTER JOIN (SELECT n.region_id, v.category, v.numeric_value, {_BLUE}[CASE WHEN n.value <= 3000 THEN 1 ELSE 2 END] AS color FROM {{numeric}} n JOIN {{valued}} v ON v.region_id = n.region_id) a ON a.region_id = m.region_id""",
)
def j13(t):
    assigned = classify.classify(t.valued, "manual", breaks="3000").assignments
    return classify.overlay(t.manual, assigned, t.valued).select("region_id", "color", "category", "value")


inputs.DERIVED["group_names"] = """
SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN '#4472C4' ELSE '#123456' END AS color, CASE WHEN c_mktsegment = 'BUILDING' THEN ' Built ' ELSE '' END AS name,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'core' ELSE '' END AS category, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '9' END AS value
FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')"""


@query(
    "a3_color_groups",
    """SELECT upper(color) AS color, count(DISTINCT region_id) AS regions, CASE upper(color) WHEN '#4472C4' THEN 'Built - core' WHEN '#E74C3C' THEN 'Red group' WHEN '#123456' THEN 'Color group #123456 - 9' ELSE 'Teal group' END AS label
       FROM {manual} GROUP BY upper(color)""",
)
def a3(t):
    return legend.in_label_order(legend.color_groups(t.manual, t.group_names)).select("color", "regions", "label")


@query("o2_locale_order", "SELECT label, CAST(row_number() OVER (ORDER BY label) AS BIGINT) AS position FROM (SELECT DISTINCT upper(c_mktsegment) AS label FROM {customer})")
def o2(t):
    from areal.plans.sizing import ranked

    labels = t.customer.select(F.upper("c_mktsegment").alias("label")).distinct()
    return ranked(labels, "label", "n", "id").select("label", (F.col("n") + 1).cast("bigint").alias("position"))


@query("o4_value_order", "SELECT row_id, value FROM {numeric}")
def o4(t):
    valued = classify.usable(t.valued).select("row_id", "region_id", number.coerce_value("numeric_value").alias("value"))
    return valued.filter("value IS NOT NULL").orderBy("value", "region_id", "row_id").select("row_id", "value")


@query("o3_top_three_provinces", "SELECT n_regionkey, rows FROM (SELECT n_regionkey, count(*) AS rows FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1) ORDER BY rows DESC, n_regionkey LIMIT 3")
def o3(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_regionkey").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n_regionkey").limit(3)


@query(
    "w4_values_at_positions",
    "SELECT o_orderpriority, CAST(p AS BIGINT) AS position, v AS value FROM (SELECT 'all' AS o_orderpriority, o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS p, count(*) OVER () AS n FROM {orders}) WHERE p IN (1, CAST(ceil(n / 3) AS BIGINT), CAST(ceil(2 * n / 3) AS BIGINT), n)",
)
def w4(t):
    prices = t.orders.select("o_totalprice")
    found: list[int] = []

    def positions(n: int) -> list[int]:
        found[:] = [1, -(-n // 3), -(-2 * n // 3), n]
        return found

    values = values_at(prices, "o_totalprice", positions)
    return classify.literal_table(t.spark, ["o_orderpriority", "position", "value"], [("all", p, v) for p, v in zip(found, values, strict=True)]).withColumn(
        "position", F.col("position").cast("bigint")
    )


@query(
    "w1_partition_count",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}",
)
def w1(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return lookup_join(t.orders.select("o_orderkey", "o_custkey"), counts, ["o_custkey"], "inner").select("o_orderkey", "n")


inputs.DERIVED["legend_classes"] = "SELECT CAST(c_custkey AS STRING) AS map_id, 0 AS position, concat('class ', c_mktsegment) AS label, '#08306B' AS color FROM {customer} WHERE c_mktsegment = 'BUILDING'"
inputs.DERIVED["legend_groups"] = "SELECT CAST(c_custkey AS STRING) AS map_id, 1 AS position, c_name AS label, '#123456' AS color FROM {customer} WHERE c_acctbal > 2000"
inputs.DERIVED["legend_manual"] = "SELECT CAST(c_custkey AS STRING) AS map_id, 2 AS position, 'manual' AS label, '#4472C4' AS color FROM {customer}"


@query(
    "l6_legend_resolution",
    """SELECT * FROM {legend_classes} UNION ALL SELECT * FROM {legend_groups} WHERE map_id NOT IN (SELECT map_id FROM {legend_classes})
       UNION ALL SELECT * FROM {legend_manual} WHERE map_id NOT IN (SELECT map_id FROM {legend_classes}) AND map_id NOT IN (SELECT map_id FROM {legend_groups})""",
)
def l6(t):
    return legend.resolve(t.legend_classes, t.legend_groups, t.legend_manual).select("map_id", "position", "label", "color")


inputs.DERIVED["maps"] = """
SELECT concat('m', CAST(c_custkey AS STRING)) AS map_id, concat('  ', c_name, ' map ') AS title, CAST(NULL AS STRING) AS subtitle, c_mktsegment AS source,
       'Q1' AS period, '' AS footnote, CAST(NULL AS STRING) AS legend_title, CASE WHEN c_acctbal > 0 THEN 'slug' END AS filename_slug,
       CASE WHEN c_nationkey > 12 THEN 'national' ELSE 'view' END AS extent,
       CASE c_nationkey % 6 WHEN 0 THEN '4:3' WHEN 1 THEN 'a4' WHEN 2 THEN 'a3' WHEN 3 THEN '1:1' ELSE '16:9' END AS ratio,
       CASE WHEN c_nationkey % 6 = 5 THEN '3840x2160' ELSE '' END AS png_size, c_acctbal > 0 AS labels, CAST(NULL AS BOOLEAN) AS transparent,
       CASE WHEN c_acctbal > 5000 THEN 'detailed' END AS geometry_detail
FROM {customer}"""
inputs.DERIVED["map_bounds"] = "SELECT concat('m', CAST(c_custkey AS STRING)) AS map_id, 1.0 * c_nationkey AS min_x, 2.0 * c_nationkey AS min_y, 30.0 AS max_x, 60.0 AS max_y FROM {customer} WHERE c_acctbal > 1000"


@query(
    "l9_export_spec",
    """SELECT m.map_id, trim(title) AS title, '' AS subtitle, source, period, footnote, 'Legend' AS legend_title, coalesce(filename_slug, 'map') AS filename_slug,
       CASE WHEN extent = 'national' THEN 'national' ELSE 'current-view' END AS extent, CAST(coalesce(min_x, 94) AS DOUBLE) AS min_x, CAST(coalesce(min_y, -12) AS DOUBLE) AS min_y, CAST(coalesce(max_x, 142) AS DOUBLE) AS max_x, CAST(coalesce(max_y, 8) AS DOUBLE) AS max_y,
       CASE WHEN png_size <> '' THEN 3840 WHEN ratio = '4:3' THEN 1600 WHEN ratio = 'a4' THEN 1754 WHEN ratio = 'a3' THEN 2480 WHEN ratio = '1:1' THEN 1400 ELSE 1600 END AS width,
       CASE WHEN png_size <> '' THEN 2160 WHEN ratio = '4:3' THEN 1200 WHEN ratio = 'a4' THEN 1240 WHEN ratio = 'a3' THEN 1754 WHEN ratio = '1:1' THEN 1400 ELSE 900 END AS height,
       labels, false AS transparent, coalesce(geometry_detail, 'lite') AS geometry_detail, 'areal-local' AS boundary_provider_id, 'IDN-ADM2-2020-geoboundaries-22746128' AS boundary_version, 'IDN-ADM-REGISTRY-v1-2025-06-23' AS registry_version
       FROM {maps} m LEFT JOIN {map_bounds} b ON b.map_id = m.map_id""",
)
def l9(t):
    bounds = t.map_bounds.select("map_id", *[F.col(c).cast("double") for c in ("min_x", "min_y", "max_x", "max_y")])
    return legend.export_spec(t.maps, bounds, "areal-local", "Region map", "map")


