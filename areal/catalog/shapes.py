"""Geometry over grid cells (one cell per order), labels over anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from areal.catalog.registered import Tables, query
from areal.operators import geometry, labels
from areal.plans import inputs

_W = "PARTITION BY region_id, polygon, ring ORDER BY pos"
inputs.DERIVED["edges"] = f"SELECT *, lag(x) OVER ({_W}) AS px, lag(y) OVER ({_W}) AS py FROM {{vertices}}"
inputs.DERIVED["segs"] = """SELECT region_id, least(px * 100000 + py, x * 100000 + y) AS k1, greatest(px * 100000 + py, x * 100000 + y) AS k2 FROM {edges} WHERE px IS NOT NULL AND (px <> x OR py <> y)"""
inputs.DERIVED["loops"] = f"""SELECT *, coalesce(lead(x) OVER ({_W}), first_value(x) OVER ({_W})) AS nx, coalesce(lead(y) OVER ({_W}), first_value(y) OVER ({_W})) AS ny FROM {{vertices}}"""
inputs.DERIVED["ring_areas"] = "SELECT region_id, polygon, ring, sum(x * ny - nx * y) / 2 AS area, sum((x + nx) * (x * ny - nx * y)) AS mx, sum((y + ny) * (x * ny - nx * y)) AS my FROM {loops} GROUP BY ALL"
inputs.DERIVED["largest"] = "SELECT region_id, area, round(mx / (6 * area), 6) AS lng, round(my / (6 * area), 6) AS lat, polygon FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY abs(area) DESC, polygon) AS n FROM {ring_areas}) WHERE n = 1"


def shaped(t: Tables):
    """Cells with nested geometry; every third one has a second, unclosed polygon."""

    def point(dx, dy):
        return F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))

    first = F.array(F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1), point(0, 0)))
    second = F.array(F.array(point(1000, 0), point(1000.5, 0), point(1000.5, 1), point(1000, 0)))
    return t.cells.withColumn("polygons", F.when(F.col("parts") == 2, F.array(first, second)).otherwise(F.array(first)))


@query("g1_vertices", "SELECT region_id, polygon, ring, pos, x, y FROM {vertices}")
def g1(t):
    return geometry.vertices(shaped(t).select("region_id", "polygons"))


@query("g2_bbox", "SELECT region_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM {vertices} GROUP BY region_id")
def g2(t):
    return shaped(t).select("region_id", F.inline(F.array(geometry.bbox())))


@query("g3_vertex_count", "SELECT region_id, CAST(count(*) AS INTEGER) AS vertices FROM {vertices} GROUP BY region_id")
def g3(t):
    return shaped(t).select("region_id", geometry.vertex_count().alias("vertices"))


@query("g4_mean_centroid", "SELECT region_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM {vertices} GROUP BY region_id")
def g4(t):
    center = geometry.mean_centroid()
    return shaped(t).select("region_id", F.round(center["x"], 6).alias("x"), F.round(center["y"], 6).alias("y"))


@query("g5_ring_area", "SELECT region_id, polygon, area FROM {ring_areas}")
def g5(t):
    return geometry.rings(shaped(t).select("region_id", "polygons")).select("region_id", "polygon", geometry.ring_area("points").alias("area"))


@query("g6_boundary_mesh", "SELECT CAST(count(*) AS BIGINT) AS unique_segments, CAST(sum(n) AS BIGINT) AS input_segments, CAST(sum(n - 1) AS BIGINT) AS shared_segments FROM (SELECT count(*) AS n FROM {segs} GROUP BY k1, k2)")
def g6(t):
    return geometry.mesh_stats(geometry.mesh(shaped(t)))


@query("g6_mesh_segments", "SELECT k1, k2, count(*) AS uses FROM {segs} GROUP BY k1, k2")
def g6_segments(t):
    meshed = geometry.mesh(shaped(t))
    return meshed.select((F.col("ax") * 100000 + F.col("ay")).alias("k1"), (F.col("bx") * 100000 + F.col("by")).alias("k2"), "uses")


@query(
    "g7_adjacency",
    """SELECT left_id, right_id, count(*) AS shared_segments FROM (SELECT min(region_id) AS left_id, max(region_id) AS right_id FROM (SELECT DISTINCT k1, k2, region_id FROM {segs}) GROUP BY k1, k2 HAVING count(*) = 2) GROUP BY ALL""",
)
def g7(t):
    return geometry.adjacency(shaped(t))


@query("g8_largest_ring", "SELECT region_id, polygon, abs(area) AS area FROM {largest}")
def g8(t):
    largest = shaped(t).select("region_id", geometry.largest_ring().alias("points"))
    first_x = F.get("points", F.lit(0))["x"]
    return largest.select("region_id", F.when(first_x >= 1000, 1).otherwise(0).alias("polygon"), F.abs(geometry.ring_area("points")).alias("area"))


@query("g9_area_centroid", "SELECT region_id, polygon, round(mx / (6 * area), 6) AS x, round(my / (6 * area), 6) AS y FROM {ring_areas}")
def g9(t):
    ring_rows = geometry.rings(shaped(t).select("region_id", "polygons"))
    return ring_rows.select("region_id", "polygon", F.inline(F.array(geometry.area_centroid("points"))))


inputs.DERIVED["anchored"] = """SELECT c.region_id AS id, display_name AS name, CASE WHEN region_type = '' THEN 'Unresolved' ELSE region_type END AS type, province_name AS province,
    CASE region_type WHEN 'Kota' THEN 3 WHEN 'Kabupaten' THEN CASE WHEN area_sqkm > 0 AND area_sqkm <= 1500 THEN 2 ELSE 1 END ELSE 0 END AS priority, lng, lat FROM {cells} c JOIN {largest} l ON l.region_id = c.region_id"""


@query("g10_label_anchors", "SELECT * FROM {anchored}")
def g10(t):
    return geometry.anchors(shaped(t))


@query(
    "g11_ring_rules",
    """SELECT region_id, false AS no_rings, false AS no_vertices, bool_or(n < 4) AS few_points, bool_or(NOT closed) AS unclosed, NOT bool_or(area <> 0) AS no_area, false AS not_finite, bool_or(outside) AS out_of_range
       FROM (SELECT v.region_id, v.polygon, count(*) AS n, arg_min(x, pos) = arg_max(x, pos) AND arg_min(y, pos) = arg_max(y, pos) AS closed, any_value(area) AS area, bool_or(NOT (x BETWEEN 95 AND 142 AND y BETWEEN -12 AND 7)) AS outside
             FROM {vertices} v JOIN {ring_areas} a ON a.region_id = v.region_id AND a.polygon = v.polygon GROUP BY v.region_id, v.polygon) GROUP BY region_id""",
)
def g11(t):
    return geometry.validate(shaped(t))


def _kept(points: str) -> str:
    """SQL: kept positions of Douglas-Peucker over {points} (line_id, pos, x, y); pos from 0."""
    dist = "CASE WHEN {d} > 0 THEN abs((xs[hi + 1] - xs[lo + 1]) * (ys[i + 1] - ys[lo + 1]) - (ys[hi + 1] - ys[lo + 1]) * (xs[i + 1] - xs[lo + 1])) / {d} ELSE sqrt((xs[i + 1] - xs[lo + 1]) * (xs[i + 1] - xs[lo + 1]) + (ys[i + 1] - ys[lo + 1]) * (ys[i + 1] - ys[lo + 1])) END"
    dist = dist.replace("{d}", "sqrt((xs[hi + 1] - xs[lo + 1]) * (xs[hi + 1] - xs[lo + 1]) + (ys[hi + 1] - ys[lo + 1]) * (ys[hi + 1] - ys[lo + 1]))")
    return f"""WITH RECURSIVE points AS ({points}), lists AS (SELECT line_id, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys, max(pos) AS n FROM points GROUP BY 1),
    far AS (SELECT *, list_transform(range(1, n), lambda i: (xs[i + 1] - xs[1]) * (xs[i + 1] - xs[1]) + (ys[i + 1] - ys[1]) * (ys[i + 1] - ys[1])) AS away FROM lists),
    whole AS (SELECT *, CASE WHEN n > 2 AND xs[1] = xs[n + 1] AND ys[1] = ys[n + 1] THEN list_position(away, list_max(away)) ELSE 0 END AS cut FROM far),
    spans AS (SELECT line_id, CAST(unnest(CASE WHEN cut > 0 THEN [0, cut] ELSE [0] END) AS BIGINT) AS lo, CAST(unnest(CASE WHEN cut > 0 THEN [cut, n] ELSE [n] END) AS BIGINT) AS hi FROM whole
        UNION ALL SELECT line_id, unnest([lo, lo + m]) AS lo, unnest([lo + m, hi]) AS hi FROM (SELECT line_id, lo, hi, list_position(d, list_max(d)) AS m, list_max(d) AS most
            FROM (SELECT s.line_id, s.lo, s.hi, list_transform(range(s.lo + 1, s.hi), lambda i: {dist}) AS d FROM spans s JOIN lists l ON l.line_id = s.line_id WHERE s.hi - s.lo > 1)) WHERE most > 0.018),
    ends AS (SELECT line_id, lo AS pos FROM spans UNION SELECT line_id, hi FROM spans),
    sized AS (SELECT line_id, count(*) AS kept FROM ends GROUP BY 1),
    result AS (SELECT p.* FROM points p JOIN sized z ON z.line_id = p.line_id JOIN lists l ON l.line_id = p.line_id LEFT JOIN ends e ON e.line_id = p.line_id AND e.pos = p.pos WHERE e.pos IS NOT NULL OR kept < least(4, n + 1))"""


_RING = """SELECT line_id, x, y, row_number() OVER (PARTITION BY line_id ORDER BY x, y) - 1 AS pos FROM {ring_points}
    UNION ALL SELECT line_id, min(x), arg_min(y, x), count(*) FROM {ring_points} GROUP BY 1"""
inputs.DERIVED["ring_points"] = "SELECT CAST(CAST(floor(o_orderkey / 200) AS BIGINT) AS STRING) AS line_id, o_orderkey % 1000 / CAST(100 AS DOUBLE) AS x, round(sin(o_orderkey % 1000 / CAST(100 AS DOUBLE)) * 0.02, 9) AS y FROM {orders}"
# Three long lines; each holds a third of all vertices.
inputs.DERIVED["line_points"] = "SELECT o_orderkey % 3 AS line_id, o_orderkey AS place, o_orderkey / CAST(1000 AS DOUBLE) AS x, sqrt(CAST(o_orderkey AS DOUBLE)) / 10 + o_orderkey % 5 / CAST(500 AS DOUBLE) AS y FROM {orders}"


@query("g12_simplify_rings", _kept(_RING) + " SELECT line_id AS region_id, CAST(count(*) AS INTEGER) AS vertices FROM result GROUP BY 1")
def g12(t):
    """Rings with nearly collinear vertices, one per batch of 200 order numbers."""
    ring_rows = t.ring_points.groupBy(F.col("line_id").alias("region_id")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))
    closed = ring_rows.select("region_id", F.lit(0).alias("polygon"), F.lit(0).alias("ring"), F.concat("points", F.slice("points", 1, 1)).alias("points"))
    return geometry.simplify(closed, 0.018).select("region_id", F.size("points").alias("vertices"))


@query(
    "g12_simplify_vertices",
    _kept("SELECT line_id, place, x, y, row_number() OVER (PARTITION BY line_id ORDER BY place) - 1 AS pos FROM {line_points}") + " SELECT line_id, place AS pos FROM result",
)
def g12_vertices(t):
    lines = t.line_points.withColumnRenamed("place", "pos")
    return geometry.simplify_vertices(lines, ["line_id"], 0.018).select("line_id", "pos")


_FIT = """(SELECT c_custkey, lo, hi, 0.5 * lo AS bottom, 2.0 * hi AS top, least((1600 - 116) / greatest(hi - lo, 0.001), (900 - 116 - 142) / greatest(2.0 * hi - 0.5 * lo, 0.001)) AS s
    FROM (SELECT o_custkey AS c_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {orders} GROUP BY 1))"""


@query("g13_fit_to_frame", f"SELECT c_custkey, round(s, 8) AS scale, round((1600 - (hi - lo) * s) / 2, 4) AS offset_x, round(92 + (900 - 88 - 142 - (top - bottom) * s) / 2, 4) AS offset_y FROM {_FIT}")
def g13(t):
    boxes = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_totalprice").alias("min_x"), (F.min("o_totalprice") * 0.5).alias("min_y"), F.max("o_totalprice").alias("max_x"), (F.max("o_totalprice") * 2).alias("max_y")
    )
    fitted = geometry.fit(boxes, 1600, 900)
    return fitted.select("c_custkey", F.round("scale", 8).alias("scale"), F.round("offset_x", 4).alias("offset_x"), F.round("offset_y", 4).alias("offset_y"))


@query(
    "g14_path_text",
    """SELECT region_id, string_agg(p, ' ' ORDER BY polygon) AS path FROM (SELECT region_id, polygon, concat(string_agg(concat(CASE WHEN pos = 0 THEN 'M' ELSE 'L' END, printf('%.2f %.2f', 10 + (x - 90) * 0.5, 20 + (4000 - y) * 0.5)), ' ' ORDER BY pos), ' Z') AS p FROM {vertices} GROUP BY ALL) GROUP BY region_id""",
)
def g14(t):
    page = {"offset_x": F.lit(10.0), "offset_y": F.lit(20.0), "min_x": F.lit(90.0), "max_y": F.lit(4000.0), "scale": F.lit(0.5)}
    return shaped(t).withColumns(page).select("region_id", geometry.path().alias("path"))


def _tenth(v: str) -> str:
    return rf"regexp_replace(CAST(floor(({v}) * 10 + 0.5e0) / 10 AS VARCHAR), '\.0$', '')"


@query(
    "g14_compact_path",
    f"""WITH placed AS (SELECT region_id, polygon, ring, pos,
            concat({_tenth("25 + (x - 94.7e0) / (141.1e0 - 94.7e0) * 800")}, ' ', {_tenth("25 + (6.2e0 - y) / (6.2e0 - -11.2e0) * 340")}) AS p FROM {{vertices}}),
        stepped AS (SELECT *, lag(p) OVER ({_W}) AS q FROM placed)
        SELECT region_id, polygon, CASE WHEN count(*) < 3 THEN '' ELSE concat('M', string_agg(p, 'L' ORDER BY pos), 'Z') END AS path
        FROM stepped WHERE q IS NULL OR p <> q GROUP BY region_id, polygon, ring""",
)
def g14_compact(t):
    ring_rows = geometry.rings(shaped(t).select("region_id", "polygons"))
    return ring_rows.select("region_id", "polygon", geometry.compact_path("points", 25, 25, 800, 340).alias("path"))


@query("g15_longitude_bands", "SELECT region_id, CASE WHEN lon < 105 THEN 0 WHEN lon < 116 THEN 1 WHEN lon < 127 THEN 2 ELSE 3 END AS band FROM (SELECT region_id, avg(x) AS lon FROM {vertices} GROUP BY region_id)")
def g15(t):
    return shaped(t).select("region_id", geometry.longitude_band(geometry.mean_centroid()["x"]).alias("band"))


@query("a5_geometry_summary", "SELECT count(DISTINCT region_id) AS features, count(DISTINCT region_id) AS unique_regions, count(DISTINCT region_id) - count(DISTINCT CASE WHEN polygon = 1 THEN region_id END) AS polygons, count(DISTINCT CASE WHEN polygon = 1 THEN region_id END) AS multi_polygons, count(*) AS vertices FROM {vertices}")
def a5(t):
    return geometry.summary(shaped(t))


@query("p5_viewport_filter", "SELECT id FROM {anchored} WHERE lng BETWEEN 100 AND 110.5 AND lat BETWEEN 0 AND 20")
def p5(t):
    return geometry.inside(geometry.anchors(shaped(t)), 100, 0, 110.5, 20).select("id")


@query(
    "w3_best_label_per_province",
    "SELECT province, id FROM (SELECT *, row_number() OVER (PARTITION BY province ORDER BY priority DESC, lng, lat, id) AS n FROM {anchored}) WHERE n = 1",
)
def w3(t):
    ranked = geometry.anchors(shaped(t)).select("id", "province", F.col("priority").alias("rank"), F.struct("lng", "lat", "id").alias("ordinal"))
    return geometry.best_label_per_province(ranked).select("province", "id")


# A second geometry source: named differently, some by shape id, some by code, some unknown.
inputs.DERIVED["base_regions"] = """SELECT region_id, geometry_source_id, official_code, region_name, province_name, CASE WHEN ordinal % 7 = 0 THEN 'x' ELSE CAST(11 + ordinal % 5 AS STRING) END AS province_code, ordinal FROM {regions}"""
inputs.DERIVED["detail_features"] = """
SELECT CASE WHEN s_suppkey % 4 = 0 THEN concat('GB-B', CAST(s_nationkey AS STRING)) ELSE concat('S', CAST(s_suppkey AS STRING)) END AS shapeID,
       CASE WHEN s_suppkey % 4 = 1 THEN concat('ID', CAST(10 + n_regionkey AS STRING), lpad(CAST(s_nationkey AS STRING), 2, '0')) ELSE '' END AS official_code,
       CASE WHEN s_suppkey % 4 = 2 THEN concat('Kota Nation ', CAST(s_nationkey % 20 AS STRING)) ELSE '' END AS shapeName,
       CASE WHEN s_suppkey % 8 = 2 THEN 'Asia' ELSE '' END AS province,
       CAST(s_suppkey AS DOUBLE) AS size, s_suppkey AS ordinal, '' AS region_id
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


def _detail(t: Tables):
    side = F.col("size")
    ring = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(side.alias("x"), F.lit(0.0).alias("y")), F.struct(side.alias("x"), side.alias("y")))
    return t.detail_features.withColumn("polygons", F.array(F.array(ring)))


@query(
    "j11_detail_merge",
    """WITH d AS (SELECT ordinal, concat('shape:', regexp_replace(shapeID, '^(?i)gb-', '')) AS key FROM {detail_features}
        UNION ALL SELECT ordinal, concat('code:', concat(official_code[3:4], '.', official_code[5:6])) FROM {detail_features} WHERE official_code <> ''
        UNION ALL SELECT ordinal, concat('name:', upper(province), '|', upper(replace(shapeName, 'Kota ', ''))) FROM {detail_features}
        UNION ALL SELECT ordinal, concat('region-name:', upper(replace(shapeName, 'Kota ', ''))) FROM {detail_features} WHERE shapeName <> ''),
    f AS (SELECT key, min(ordinal) AS detail FROM d GROUP BY key),
    b AS (SELECT region_id, 1 AS rank, concat('shape:', geometry_source_id) AS key FROM {base_regions} UNION ALL SELECT region_id, 2, concat('code:', official_code) FROM {base_regions}
        UNION ALL SELECT region_id, 3, concat('name:', province_name, '|', upper(strip_accents(region_name))) FROM {base_regions} UNION ALL SELECT region_id, 4, concat('region-name:', upper(strip_accents(region_name))) FROM {base_regions}),
    m AS (SELECT region_id, arg_min(detail, rank) AS detail FROM b JOIN f ON f.key = b.key GROUP BY region_id)
    SELECT r.region_id, m.detail IS NOT NULL AS detailed, CAST(m.detail AS DOUBLE) AS size FROM {base_regions} r LEFT JOIN m ON m.region_id = r.region_id""",
)
def j11(t):
    base = t.base_regions.withColumn("polygons", F.lit(None).cast(geometry.GEOMETRY_TYPE))
    merged = geometry.merge_detail(base, _detail(t), min_share=0.1)
    corner = F.get(F.get(F.get("polygons", F.lit(0)), F.lit(0)), F.lit(1))["x"]
    return merged.select("region_id", "detailed", corner.alias("size"))


@query(
    "j12_strict_detail_join",
    "SELECT d.shapeID AS shapeid, b.region_id, CASE WHEN b.region_id IS NULL THEN NULL WHEN b.province_code = 'x' THEN '__unresolved' ELSE b.province_code END AS province_code FROM {detail_features} d LEFT JOIN {base_regions} b ON b.geometry_source_id = d.shapeID".replace("d.shapeID AS shapeid", "replace(d.shapeID, 'GB-', '') AS shapeid").replace("= d.shapeID", "= replace(d.shapeID, 'GB-', '')"),
)
def j12(t):
    detail = _detail(t).withColumn("shapeID", F.replace("shapeID", F.lit("GB-"), F.lit("")))
    found, failed = geometry.strict_detail(t.base_regions, detail)
    return found.unionByName(failed).select(F.col("shapeID").alias("shapeid"), "region_id", "province_code")


@query(
    "k5_partition_index",
    "SELECT province_name AS province_code, count(*) AS features FROM {cells} GROUP BY 1",
)
def k5(t):
    return geometry.partition_index(shaped(t).withColumnRenamed("province_name", "province_code")).select("province_code", "features")


@query("k5_partition_fingerprints")
def k5_fingerprints(t):
    return geometry.partition_index(shaped(t).withColumnRenamed("province_name", "province_code"))


# Views over the anchors, one per customer.
inputs.DERIVED["views"] = """
SELECT concat('v', CAST(c_custkey AS STRING)) AS view_id, CAST(95 + c_nationkey AS DOUBLE) AS min_x, CAST(95 + c_nationkey + 1 + c_custkey % 3 AS DOUBLE) AS max_x,
       CAST(c_custkey % 300 AS DOUBLE) AS min_y, CAST(c_custkey % 300 + 2.5 AS DOUBLE) AS max_y,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 5.0 ELSE 8.0 END AS zoom,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'minimal' WHEN c_mktsegment = 'FURNITURE' THEN 'detailed' ELSE 'balanced' END AS density,
       concat('c', CAST((c_custkey % 300) * 40 + c_nationkey AS STRING)) AS selected_id, c_acctbal < 0 AS presentation
FROM {customer}"""
inputs.DERIVED["view_highlights"] = "SELECT view_id, concat('c', CAST(CAST(min_y AS INT) * 40 + CAST(min_x AS INT) - 94 AS STRING)) AS id FROM {views}"

_RANKED = """(SELECT v.view_id, v.zoom, v.density, v.presentation, a.id, a.name, a.type, a.priority, a.province, a.lng, a.lat, v.selected_id = a.id AS sel, h.id IS NOT NULL AS hi,
    CASE WHEN v.selected_id = a.id THEN 100 WHEN h.id IS NOT NULL THEN 90 WHEN a.type = 'Kota' THEN 80 WHEN a.priority > 1 THEN 70 ELSE 10 END AS rank
    FROM {views} v JOIN {anchored} a ON a.lng BETWEEN v.min_x AND v.max_x AND a.lat BETWEEN v.min_y AND v.max_y
    LEFT JOIN {view_highlights} h ON h.view_id = v.view_id AND h.id = a.id)"""


_CANDIDATES = f"""SELECT view_id, id, rank, text, lng, lat FROM (SELECT view_id, id, rank, lng, lat, CASE WHEN province = '' THEN name ELSE province END AS text, row_number() OVER (PARTITION BY view_id, province ORDER BY rank DESC, id) AS n FROM {_RANKED} WHERE zoom < 5.75) WHERE n = 1
        UNION ALL SELECT view_id, id, rank, name, lng, lat FROM {_RANKED} WHERE zoom >= 5.75 AND (sel OR hi OR (NOT presentation AND (density = 'detailed' OR (density = 'balanced' AND (type = 'Kota' OR priority > 1)))))"""


@query("l1_label_candidates", f"SELECT view_id, id, rank, text FROM ({_CANDIDATES})")
def l1(t):
    out = labels.candidates(geometry.anchors(shaped(t)), t.views, t.view_highlights)
    return out.select("view_id", "id", "rank", "text")


@query(
    "l2_label_priority",
    f"SELECT view_id, id, CASE WHEN sel THEN 3 WHEN hi THEN 2 WHEN NOT presentation AND type = 'Kota' THEN 1 ELSE 0 END AS level FROM {_RANKED}",
)
def l2(t):
    seen = labels.visible(geometry.anchors(shaped(t)), t.views, t.view_highlights)
    return seen.select("view_id", "id", labels.level("selected", "highlighted", F.col("type") == "Kota", "presentation").alias("level"))


# Greedy placement one by one, the boxes placed so far in a list.
_THIN = f"""WITH RECURSIVE boxes AS (SELECT view_id, id, (lng - 95) * 60 AS x, (lat % 20) * 8 AS y, greatest(CAST(36 AS DOUBLE), length(text) * CAST(12 AS DOUBLE) * CAST(0.56 AS DOUBLE)) AS w,
        row_number() OVER (PARTITION BY view_id ORDER BY rank DESC, text, id) AS n FROM ({_CANDIDATES})),
    ordered AS (SELECT view_id, id, n, struct_pack(l := x - w / 2 - 3, r := x + w / 2 + 3, t := y - CAST(7.5 AS DOUBLE) - 3, b := y + CAST(7.5 AS DOUBLE) + 3) AS box FROM boxes),
    step AS (SELECT DISTINCT view_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(l DOUBLE, r DOUBLE, t DOUBLE, b DOUBLE)[]) AS placed, CAST(NULL AS VARCHAR) AS id FROM ordered
        UNION ALL SELECT view_id, n, CASE WHEN free THEN list_append(placed, box) ELSE placed END, CASE WHEN free THEN id END
        FROM (SELECT o.view_id, o.n, o.id, o.box, s.placed, len(list_filter(s.placed, lambda q: NOT (o.box.r < q.l OR o.box.l > q.r OR o.box.b < q.t OR o.box.t > q.b))) = 0 AS free
            FROM step s JOIN ordered o ON o.view_id = s.view_id AND o.n = s.n + 1))
    SELECT view_id, id FROM step WHERE id IS NOT NULL"""


@query("l3_thin_labels", _THIN)
def l3(t):
    out = labels.candidates(geometry.anchors(shaped(t)), t.views, t.view_highlights)
    placed = out.select("view_id", "id", "text", "rank", ((F.col("lng") - 95) * 60).alias("x"), (F.col("lat") % 20 * 8).alias("y"), F.lit(12.0).alias("font_size"))
    return labels.thin(placed).select("view_id", "id")
