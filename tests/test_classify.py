"""Class cases of the reference and exact positions against sorting in Python."""

import math
import random

import pytest

from areal.operators import classify
from areal.plans import sizing

SCHEMA = "row_id string, row_number int, region_id string, status string, numeric_value string, category string"


def rows(spark, values, categories=None):
    categories = categories or [""] * len(values)
    return spark.createDataFrame(
        [(f"row{i}", i, f"r{i}", "exact-code", str(v), c) for i, (v, c) in enumerate(zip(values, categories, strict=True))], SCHEMA
    )


def keys(result):
    return {r.region_id: r.class_key for r in result.assignments.collect()}


def codes(result):
    return {r.code for r in result.warnings.collect()}


def test_categorical_is_order_free(spark):
    a = classify.classify(rows(spark, [""] * 3, [" zeta ", "Alpha", "alpha"]))
    b = classify.classify(rows(spark, [""] * 3, ["alpha", "Alpha", " zeta "]))
    assert [r.label for r in a.legend.orderBy("position").collect()] == ["ALPHA", "ZETA"]
    assert {(r.key, r.color) for r in a.legend.collect()} == {(r.key, r.color) for r in b.legend.collect()}


def test_equal_interval_keeps_no_data_apart(spark):
    out = classify.classify(rows(spark, ["0", "10", "", "invalid", "20"]), "equal-interval", classes=3)
    assert out.no_data.count() == 2
    assert keys(out)["r0"] == "0"
    assert [r.label for r in out.legend.orderBy("position").collect()][-1] == "No data"


def test_one_value_gives_one_class(spark):
    out = classify.classify(rows(spark, [5, 5, 5]), "equal-interval")
    assert out.legend.count() == 1 and "one-value" in codes(out)


def test_quantile_keeps_ties_together(spark):
    a = classify.classify(rows(spark, [1, 1, 1, 2, 2, 2]), "quantile", classes=4)
    b = classify.classify(rows(spark, [2, 1, 2, 1, 2, 1]), "quantile", classes=4)
    assert "fewer-classes" in codes(a)
    assert a.legend.count() == b.legend.count() == 3


def test_manual_breaks(spark):
    with pytest.raises(ValueError):
        classify.classify(rows(spark, [1]), "manual", breaks="10,10")
    out = keys(classify.classify(rows(spark, [-1, 0, 10, 11]), "manual", breaks="0,10"))
    assert (out["r1"], out["r2"], out["r3"]) == ("0", "1", "2")


def test_diverging(spark):
    out = classify.classify(rows(spark, [-2, 0, 5]), "diverging", classes=4)
    assert keys(out)["r1"] == "center"
    assert {r.key: r.color for r in out.legend.collect()}["center"] == "#F7F7F7"
    assert "one-sided" in codes(classify.classify(rows(spark, [1, 2]), "diverging"))


def test_nothing_to_classify(spark):
    assert "no-values" in codes(classify.classify(rows(spark, ["", "x"]), "quantile"))


@pytest.mark.parametrize("bucket_rows", [10, 1_000_000])
def test_values_at_positions(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sizing, "RANK_BUCKET_ROWS", bucket_rows)
    rng = random.Random(3)
    # One value holds a third of all rows.
    data = [7.0] * 400 + [rng.uniform(-5, 50) for _ in range(800)]
    rng.shuffle(data)
    df = spark.createDataFrame([(v,) for v in data], "v double").repartition(5)
    wanted = [1, 2, 399, 400, 700, 1199, 1200]
    assert sizing.values_at(df, "v", lambda n: wanted) == [sorted(data)[p - 1] for p in wanted]


@pytest.mark.parametrize("bucket_rows", [10, 1_000_000])
def test_ranked(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sizing, "RANK_BUCKET_ROWS", bucket_rows)
    names = [f"NAME {i:04d}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names[::-1]], "name string")
    got = {r.name: r.pos for r in sizing.ranked(df, "name", "pos").collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_lookup_join_plans_agree(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        small = sorted(map(tuple, sizing.lookup_join(left, right, ["k"], how, small=True).collect()), key=str)
        large = sorted(map(tuple, sizing.lookup_join(left, right, ["k"], how, small=False).collect()), key=str)
        assert small == large and math.isfinite(len(small))


def test_sketches_bracket_exact_breaks(spark):
    from areal.operators import sketches

    rng = random.Random(3)
    numbers = [rng.choice([5.0, 5.0, rng.gauss(0, 1), rng.uniform(-1e6, 1e6)]) for _ in range(20_000)]
    rows = [(f"d{i % 7}", v) for i, v in enumerate(numbers)] + [("d0", None), ("d1", float("nan")), ("none", None)]
    values = spark.createDataFrame(rows, "day string, v double")
    for k in (8, 200):  # a coarse sketch takes wider brackets, not other breaks
        stored = sketches.build(values, ["day"], "v", k)
        assert stored.count() == 7
        ordered = sorted(numbers)
        for classes in (2, 7):
            wanted = [ordered[min(len(ordered), math.ceil(i * len(ordered) / classes)) - 1] for i in range(1, classes)]
            assert sketches.exact_breaks(values, "v", stored, classes, k) == wanted
            near = sketches.breaks(stored, classes)
            for i, v in enumerate(near, start=1):
                low, high = sum(x < v for x in ordered), sum(x <= v for x in ordered)
                slack = 3 * sketches.rank_error(k) * len(ordered)
                assert low - slack <= i * len(ordered) / classes <= high + slack
    merged_days = sketches.merge(stored, [])
    assert merged_days.count() == 1
    nothing = values.filter("v IS NULL")
    empty = sketches.build(nothing, ["day"], "v")
    assert sketches.breaks(empty, 5) == [] and sketches.exact_breaks(nothing, "v", empty, 5) == []
