"""Matching cases: one region per row, nothing decided silently."""

import pytest
from pyspark.sql import functions as F

from areal.operators import match
from areal.operators.registry import REGISTRY_VERSION

REGIONS = [
    ("r-sby", "Bsby", "35.78", "Surabaya", "Kota", "Jawa Timur", "Kota Surabaya", "Surabaya", "", "matched"),
    ("r-bdg", "Bbdg", "51.03", "Badung", "Kabupaten", "Bali", "Kabupaten Badung", "Badung", "Mengwi Lama | Bali | 51.99", "matched"),
    ("r-kp1", "Bkp1", "53.01", "Kupang", "Kabupaten", "Nusa Tenggara Timur", "Kabupaten Kupang", "Kupang", "", "ambiguous_name"),
    ("r-kp2", "Bkp2", "53.71", "Kupang", "Kota", "Nusa Tenggara Timur", "Kota Kupang", "Kota Kupang", "", "ambiguous_name"),
]
COLUMNS = "region_id, geometry_source_id, official_code, region_name, region_type, province_name, display_name, geometry_source_name, alternative_names, match_status"


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame(REGIONS, ", ".join(f"{c} string" for c in COLUMNS.split(", "))).cache()


def run(spark, regions, rows, **options):
    df = spark.createDataFrame(
        [(f"row{i}", i, *r) for i, r in enumerate(rows)], "row_id string, row_number int, region_code string, region_name string, province string"
    )
    return {r.row_id: r for r in match.match_rows(df, regions, **options).collect()}


@pytest.mark.parametrize("small", [True, False])
def test_cascade(spark, regions, small):
    out = run(
        spark, regions,
        [("35.78", "wrong", ""), ("", "Badung", "Bali"), ("", "Kupang", ""), ("", "", ""), ("", "Atlantis", "Bali"), ("5199", "", "")],
        small=small, on_duplicate="aggregate",
    )
    assert [out[f"row{i}"].status for i in range(6)] == ["exact-code", "exact-name-province", "ambiguous", "invalid", "unmatched", "exact-code"]
    assert out["row2"].n_candidates == 2 and out["row2"].candidates == ["r-kp1", "r-kp2"]
    assert out["row5"].region_id == "r-bdg"


def test_alias(spark, regions):
    assert run(spark, regions, [("", "Mengwi Lama", "Bali")])["row0"].status == "exact-alias-province"


@pytest.mark.parametrize("small", [True, False])
def test_duplicates_flag_every_row(spark, regions, small):
    out = run(spark, regions, [("", "Kota Surabaya", "Jawa Timur"), ("", "Surabaya", "Jawa Timur"), ("", "Badung", "Bali")], small=small)
    assert [out[f"row{i}"].status for i in range(3)] == ["duplicate-target", "duplicate-target", "exact-name-province"]


@pytest.mark.parametrize(("version", "status"), [(REGISTRY_VERSION, "user-resolved"), ("old", "ambiguous")])
def test_resolutions(spark, regions, version, status):
    decisions = spark.createDataFrame([("row0", "resolve", "idn-adm2-gb-bkp2", version)], "row_id string, action string, target_id string, registry_version string")
    out = run(spark, regions, [("", "Kupang", "")], resolutions=decisions)["row0"]
    assert out.status == status
    assert out.region_id == ("r-kp2" if status == "user-resolved" else None)


def test_permissive_first_row_wins(spark, regions):
    out = run(spark, regions, [("", "Surabaya", ""), ("3578", "", ""), ("", "Kupang", "")], mode="permissive")
    assert [out[f"row{i}"].status for i in range(3)] == ["exact-code", "duplicate-target", "ambiguous"]


def test_order_and_partitions_do_not_matter(spark, regions):
    rows = [("", n, p) for n in ("Badung", "Kupang", "Surabaya", "x") for p in ("Bali", "Jawa Timur", "")]
    df = spark.createDataFrame([(f"r{i}", i, *r) for i, r in enumerate(rows)], "row_id string, row_number int, region_code string, region_name string, province string")
    pick = ["row_id", "status", "region_id"]
    one = sorted(map(tuple, match.match_rows(df.coalesce(1), regions).select(*pick).collect()), key=str)
    many = sorted(map(tuple, match.match_rows(df.orderBy(F.desc("row_id")).repartition(7), regions).select(*pick).collect()), key=str)
    assert one == many


def test_valid_invalid_ignored_cover_all_rows(spark, regions):
    decisions = spark.createDataFrame([("row0", "ignore", "", REGISTRY_VERSION)], "row_id string, action string, target_id string, registry_version string")
    df = spark.createDataFrame(
        [("row0", 1, "", "Badung", "Bali", "5"), ("row1", 2, "", "Badung", "Bali", "abc"), ("row2", 3, "35.78", "", "", "1,234")],
        "row_id string, row_number int, region_code string, region_name string, province string, numeric_value string",
    )
    out = {r.row_id: r for r in match.validate(match.match_rows(df, regions, decisions)).collect()}
    assert (out["row0"].valid, out["row0"].invalid, out["row0"].warning) == (False, False, True)
    assert out["row1"].invalid and out["row1"].errors == ["number-invalid"]
    assert out["row2"].valid and out["row2"].warnings == ["number-ambiguous"]
