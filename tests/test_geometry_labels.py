"""Closed forms on grids and brute force for simplification and label thinning."""

import random

import numpy as np
from pyspark.sql import functions as F

from areal.operators import geometry, labels
from areal.operators.geometry import GEOMETRY_TYPE


def grid(spark, rows, columns):
    def square(x, y):
        return [[[(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0), (x, y)]]]

    data = [(f"c{r}-{c}", square(float(c), float(r))) for r in range(rows) for c in range(columns)]
    return spark.createDataFrame(data, f"region_id string, polygons {GEOMETRY_TYPE}")


def test_mesh_of_a_grid(spark):
    stats = geometry.mesh_stats(geometry.mesh(grid(spark, 7, 11))).first()
    assert (stats.input_segments, stats.unique_segments, stats.shared_segments) == (308, 172, 136)
    assert geometry.adjacency(grid(spark, 7, 11)).count() == 7 * 10 + 6 * 11
    two = geometry.mesh_stats(geometry.mesh(grid(spark, 1, 2))).first()
    assert (two.input_segments, two.unique_segments) == (8, 7)


def test_copies_of_one_region_build_no_pairs(spark):
    copies = grid(spark, 1, 1).withColumn("region_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: i.cast("string"))))
    assert geometry.adjacency(copies).count() == 0
    assert {r.regions for r in geometry.crowded_segments(copies).collect()} == {500}


def test_measures(spark):
    row = grid(spark, 1, 1).select(
        geometry.bbox().alias("box"), geometry.vertex_count().alias("n"), geometry.mean_centroid().alias("mean"),
        geometry.ring_area(geometry.largest_ring()).alias("area"), geometry.area_centroid(geometry.largest_ring()).alias("center"),
    ).first()
    assert tuple(row.box) == (0, 0, 1, 1) and row.n == 5 and row.area == 1
    assert tuple(row.mean) == (0.4, 0.4) and tuple(row.center) == (0.5, 0.5)
    empty = spark.createDataFrame([("e", [])], f"region_id string, polygons {GEOMETRY_TYPE}")
    assert tuple(empty.select(geometry.bbox().alias("b")).first().b) == (94, -12, 142, 8)


def test_simplify_keeps_within_tolerance(spark):
    rng = random.Random(5)
    angles = np.linspace(0, 2 * np.pi, 400)
    ring = [(float(np.cos(a) + rng.uniform(-0.004, 0.004)), float(np.sin(a) + rng.uniform(-0.004, 0.004))) for a in angles[:-1]]
    ring.append(ring[0])
    rows = spark.createDataFrame([("r", 0, 0, ring)], "region_id string, polygon int, ring int, points array<struct<x:double,y:double>>")
    out = [(p.x, p.y) for p in geometry.simplify(rows, 0.018).first().points]
    assert out[0] == out[-1] == ring[0] and 4 <= len(out) < 60
    kept = [ring.index(p) for p in out[:-1]] + [len(ring) - 1]
    for a, b in zip(kept, kept[1:], strict=False):
        (x1, y1), (x2, y2) = ring[a], ring[b]
        for x, y in ring[a + 1 : b]:
            assert abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / np.hypot(x2 - x1, y2 - y1) <= 0.018 + 1e-12


def test_candidates_by_density(spark):
    anchors = spark.createDataFrame(
        [
            ("selected", "Selected", "Kabupaten", "Jawa Barat", 1, 107.0, -6.0),
            ("highlighted", "Highlighted", "Kabupaten", "Jawa Barat", 1, 107.01, -6.0),
            ("city", "Kota Bandung", "Kota", "Jawa Barat", 3, 107.02, -6.0),
            ("regency", "Kabupaten Bandung", "Kabupaten", "Jawa Barat", 2, 107.03, -6.0),
        ],
        "id string, name string, type string, province string, priority int, lng double, lat double",
    )
    views = spark.createDataFrame(
        [
            ("minimal", 106.0, 108.0, -7.0, -5.0, 8.0, "minimal", "selected", False),
            ("balanced", 106.0, 108.0, -7.0, -5.0, 8.0, "balanced", None, False),
            ("detailed", 106.0, 108.0, -7.0, -5.0, 8.0, "detailed", None, False),
            ("overview", 106.0, 108.0, -7.0, -5.0, 5.0, "detailed", None, False),
        ],
        "view_id string, min_x double, max_x double, min_y double, max_y double, zoom double, density string, selected_id string, presentation boolean",
    )
    marked = spark.createDataFrame([("minimal", "highlighted")], "view_id string, id string")
    found = labels.candidates(anchors, views, marked).collect()
    by_view = {v: sorted(r.id for r in found if r.view_id == v) for v in ("minimal", "balanced", "detailed")}
    assert by_view == {"minimal": ["highlighted", "selected"], "balanced": ["city", "regency"], "detailed": ["city", "highlighted", "regency", "selected"]}
    assert [r.text for r in found if r.view_id == "overview"] == ["Jawa Barat"]


def _greedy(rows):
    placed = []
    for r in sorted(rows, key=lambda r: (-r[6], r[2], r[1])):
        width = max(r[5] * 3, len(r[2]) * r[5] * 0.56)
        height = r[5] * 1.25
        box = (r[3] - width / 2 - 3, r[3] + width / 2 + 3, r[4] - height / 2 - 3, r[4] + height / 2 + 3)
        if all(box[1] < o[0] or box[0] > o[1] or box[3] < o[2] or box[2] > o[3] for _, o in placed):
            placed.append((r[1], box))
    return {i for i, _ in placed}


def test_thinning_equals_greedy_placement(spark):
    rng = random.Random(11)
    # One view holds most labels.
    rows = [
        ("hot" if i % 4 else f"v{i % 5}", f"id{i}", f"Label {rng.randint(0, 99)}", rng.uniform(0, 900), rng.uniform(0, 600), 12.0, rng.choice([10, 70, 80, 90]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "view_id string, id string, text string, x double, y double, font_size double, rank int")
    got = labels.thin(df).collect()
    for view in {r[0] for r in rows}:
        assert {r.id for r in got if r.view_id == view} == _greedy([r for r in rows if r[0] == view])
    assert labels.thin(df.limit(0)).collect() == []
    # All on one spot: one is placed, whatever the number.
    spot = labels.thin(df.withColumns({"view_id": F.lit("v"), "x": F.lit(5.0), "y": F.lit(5.0)})).collect()
    assert {r.id for r in spot} == _greedy([("v", r[1], r[2], 5.0, 5.0, r[5], r[6]) for r in rows])


def _kept(points, tolerance):
    """Positions that Douglas-Peucker keeps, span by span."""
    n = len(points)
    dist = lambda a, b, p: (
        abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5
        if a != b else ((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2) ** 0.5
    )
    keep, spans = {0, n - 1}, [(0, n - 1)]
    if n > 3 and points[0] == points[-1]:
        far = max(range(1, n - 1), key=lambda i: ((points[i][0] - points[0][0]) ** 2 + (points[i][1] - points[0][1]) ** 2, -i))
        keep.add(far)
        spans = [(0, far), (far, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        most, at = max((dist(points[a], points[b], points[i]), -i) for i in range(a + 1, b))
        if most > tolerance:
            keep.add(-at)
            spans += [(a, -at), (-at, b)]
    return sorted(keep) if len(keep) >= min(4, n) else list(range(n))


def test_simplify_equals_spans_one_by_one(spark):
    rng = random.Random(12)
    rings = []
    for i in range(40):
        n = rng.choice([1, 2, 3, 4, 5, 30, 200])
        ring = [(rng.randint(0, 40) / 8, rng.randint(0, 8) / 64) for _ in range(n)]
        if rng.random() < 0.6:
            ring.append(ring[0])
        rings.append((f"r{i // 2}", i % 2, 0, ring, "x"))  # some ids twice
    rings += [("same", 0, 0, rings[5][3], "y")] * 2 + [("empty", 0, 0, [], "z"), ("null", 0, 0, None, "z")]
    schema = "region_id string, polygon int, ring int, points array<struct<x:double,y:double>>, _lo string"
    got = geometry.simplify(spark.createDataFrame(rings, schema), 0.03).collect()
    plain = lambda points: points and [tuple(p) for p in points]
    wanted = [(r[0], r[1], r[4], [r[3][i] for i in _kept(r[3], 0.03)] if r[3] else r[3]) for r in rings]
    key = lambda r: (r[0], r[1], str(r[3]))
    assert sorted(((r.region_id, r.polygon, r._lo, plain(r.points)) for r in got), key=key) == sorted(wanted, key=key)


def test_one_long_line_is_simplified_by_many_tasks(spark):
    spots = spark.range(40_000).select(F.lit("line").alias("id"), (F.col("id") * 3).alias("pos"), (F.col("id") / 100).alias("x"), F.expr("sqrt(id) + id % 3 / 300D").alias("y"))
    got = [r.pos for r in geometry.simplify_vertices(spots, ["id"], 0.018).orderBy("pos").collect()]
    points = [(i / 100, i**0.5 + i % 3 / 300) for i in range(40_000)]
    assert got == [3 * i for i in _kept(points, 0.018)]


def test_views_find_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(labels, "LEAF", 20)
    rng = random.Random(6)
    spots = [(107.3, -6.2) if i % 5 < 2 else (rng.uniform(-180, 180), rng.uniform(-90, 90)) if i % 5 == 2 else (rng.gauss(107, 0.5), rng.gauss(-6, 0.5)) for i in range(1500)]
    anchors = [(f"a{i}", "n", "Kota", "p", 1, x, y) for i, (x, y) in enumerate(spots)] + [("lost", "n", "Kota", "p", 1, None, 1.0)]
    boxes = []
    for i in range(40):
        x, y, w = rng.uniform(100, 110), rng.uniform(-10, 0), rng.choice([0.0, 1e-4, 0.3, 4.0, 30.0, 300.0])
        boxes.append((f"v{i}", x - w / 2, x + w / 2, y - w / 2, y + w / 2, 8.0, "detailed", None, False))
    boxes += [("spot", 107.3, 107.3, -6.2, -6.2, 8.0, "detailed", "a0", False), ("world", -200.0, 200.0, -100.0, 100.0, 8.0, "detailed", None, False)]
    schema = "view_id string, min_x double, max_x double, min_y double, max_y double, zoom double, density string, selected_id string, presentation boolean"
    a = spark.createDataFrame(anchors, "id string, name string, type string, province string, priority int, lng double, lat double")
    found = labels.visible(a, spark.createDataFrame(boxes, schema), spark.createDataFrame([("spot", "a1")], "view_id string, id string")).collect()
    wanted = sorted((v[0], f"a{i}") for v in boxes for i, (x, y) in enumerate(spots) if v[1] <= x <= v[2] and v[3] <= y <= v[4])
    assert sorted((r.view_id, r.id) for r in found) == wanted
    assert {(r.id, r.rank) for r in found if r.view_id == "spot" and r.rank > 80} == {("a0", 100), ("a1", 90)}
