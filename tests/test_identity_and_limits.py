"""Row identity, limits that tell what they refuse, heavy keys, the entry point without its optional part."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from areal.operators import audit, headers, match
from areal.plans import sizing
from areal.sources import delimited, workbook

REGIONS = [("r1", "B1", "11.01", "Alpha", "Kota", "P", "Kota Alpha", "Alpha", "", "matched"), ("r2", "B2", "11.02", "Beta", "Kota", "P", "Kota Beta", "Beta", "", "matched")]
COLUMNS = ["region_id", "geometry_source_id", "official_code", "region_name", "region_type", "province_name", "display_name", "geometry_source_name", "alternative_names", "match_status"]


@pytest.mark.parametrize("small", [True, False])
def test_sources_may_share_row_ids(spark, small):
    regions = spark.createDataFrame(REGIONS, ", ".join(f"{c} string" for c in COLUMNS))
    rows = [("s1", "row", "Alpha"), ("s2", "row", "Beta"), ("s3", "row", "Alpha"), ("s3", "row", "nothing")]
    table = spark.createDataFrame([(*r, "P") for r in rows], "source_id string, row_id string, region_name string, province string")
    out = match.match_rows(table, regions, on_duplicate="aggregate", small=small).collect()
    assert sorted((r.source_id, r.region_name, r.region_id) for r in out) == [
        ("s1", "Alpha", "r1"), ("s2", "Beta", "r2"), ("s3", "Alpha", "r1"), ("s3", "nothing", None)
    ]
    decisions = spark.createDataFrame([("s1", "row", "ignore", "", "")], "source_id string, row_id string, action string, target_id string, registry_version string")
    out = match.match_rows(table, regions, decisions, on_duplicate="aggregate", small=small).collect()
    assert {r.source_id for r in out if r.status == "ignored"} == {"s1"}


def test_ids_are_wide(spark):
    body = "x" * 5000
    sources = spark.createDataFrame([("a", "csv", f"n\n{body}1"), ("b", "csv", f"n\n{body}2"), ("c", "csv", f"n\n{body}2")], "source_key string, source_type string, text string")
    summary, rows = delimited.parse(sources, "comma")
    assert summary.select("source_id").distinct().count() == 2
    many = spark.createDataFrame([("m", "csv", "n,v\n" + "\n".join(f"{i},{i % 7}" for i in range(60_000)))], "source_key string, source_type string, text string")
    _, rows = delimited.parse(many, "comma")
    assert rows.agg(F.count_distinct("row_id"), F.count("*")).first() == (60_000, 60_000)


def test_refused_files_are_told(spark, tmp_path):
    (tmp_path / "small.csv").write_text("a,b\n1,2\n")
    (tmp_path / "large.csv").write_text("a,b\n" + "1,2\n" * 100)
    summary, rows = delimited.read_files(spark, str(tmp_path), "comma", max_bytes=100)
    assert {Path(r["source_key"]).name: r["status"] for r in summary.collect()} == {"small.csv": "ok", "large.csv": "too-many-bytes"}
    assert rows.count() == 1
    assert delimited.read_files(spark, str(tmp_path), "comma")[1].count() == 101


def test_every_workbook_has_a_verdict(spark, tmp_path):
    (tmp_path / "large.xlsx").write_bytes(b"PK\x03\x04" + b"0" * 2000)
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    budget = {**workbook.BUDGET, "compressed": 1000}
    rows, verdicts = workbook.read(spark, str(tmp_path), budget=budget)
    assert {Path(r["path"]).name: r["verdict"] for r in verdicts.collect()} == {"large.xlsx": "too-large", "broken.xlsx": "damaged"}
    assert rows.count() == 0
    assert workbook.inspect(spark, str(tmp_path), budget).count() == 2


def test_repeated_names_of_workbook_columns_keep_the_job_alive(spark):
    cells = [("f", 0, "s", 0, c, v) for c, v in enumerate(["a", "a", "a__2"])] + [("f", 0, "s", 1, c, str(c)) for c in range(3)]
    table = spark.createDataFrame([(*c, None) for c in cells], workbook.CELL_SCHEMA)
    assert len(workbook.rows_of(table).collect()) == 1


def test_secrets_over_the_limit_are_told(spark):
    docs = spark.createDataFrame([(1, "sk-" + "a" * 30), (2, "sk-" + "a" * 300)], "id long, body string")
    assert audit.secrets(docs, "id", "body", []).count() == 2
    assert {tuple(r) for r in audit.secrets(docs, "id", "body", [], max_bytes=100).collect()} == {(1, "api-key"), (2, "not-scanned")}


def test_tokens_with_control_characters(spark):
    docs = spark.createDataFrame([(1, "\x01ab\x02 x12\ny 7"), (2, "")], "id long, body string")
    found = audit.tokens(docs, "id", "body", {"digits": r"\d+", "words": "(?i)[a-z]b"})
    assert {tuple(r) for r in found.collect()} == {(1, 1, 7, "digits", "12"), (1, 2, 3, "digits", "7"), (1, 1, 2, "words", "ab")}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_with_a_heavy_key(spark, how):
    """One key holds 40 % of the rows; neither side is multiplied or run to be measured."""
    left = spark.range(50_000).select(F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 40_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = sizing.lookup_join(left, right, ["k"], how)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Broadcast" not in plan
        kept = joined.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    matched = sum(1 for i in range(50_000) if i % 5 < 2 or (i % 2 == 0 and i < 40_000))
    assert kept == {"left": 50_000, "inner": matched, "left_semi": matched, "left_anti": 50_000 - matched}[how]


def test_entry_point_without_its_optional_part(tmp_path):
    """As after the subpackage and its pipeline are deleted; other import errors are not swallowed."""
    root = Path(__file__).resolve().parent.parent
    program = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name in ("corpus_pipeline", "areal.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = entry.queries()
assert names and not [n for n in names if n.startswith("op") or n == "pipeline"], "left over"
assert set(entry.oracle_sql()) <= set(names)
"""
    done = subprocess.run([sys.executable, "-c", program], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_long_alias_tables_stay_tables(spark, monkeypatch):
    spelled = ["wilayah", "Kode-BPS", "total penjualan", "produk 17", "###", "tahun", "x", None]
    rows = [(source, place, spelled[(source + place) % len(spelled)]) for source in range(9) for place in range(1, 5)]
    named = headers.unique(spark.createDataFrame(rows, "source_id long, position int, header string")).cache()
    held = [("category", f"produk {i}") for i in range(300)] + [("category", "produk"), ("period", "tahun"), ("period", "tahun")]
    held += [("odd", ""), ("regionName", "nama wilayah"), ("regionCode", "bps"), ("regionCode", "kode"), ("numericValue", None)]
    table = spark.createDataFrame(held, "role string, alias string")
    frame, sizes = type(named), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    found = headers.infer_roles(named, table)
    assert max(sizes, default=0) <= 1  # counts only, no table of aliases
    monkeypatch.undo()
    best = {}
    for row in named.withColumn("h", headers.text.normalize_header("name")).collect():
        for role, alias in held:
            if alias is not None and (alias in row["h"] or row["h"] in alias):
                tier = (0 if alias == row["h"] else 1, row["position"], row["name"])
                best[row["source_id"], role] = min(tier, best.get((row["source_id"], role), tier))
    wanted = {(*key, name, "medium" if tier else "high") for key, (tier, _, name) in best.items()}
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) == found.count() > 20
