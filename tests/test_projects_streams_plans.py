"""Saved projects, document checks, streaming use and plan shapes."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from areal.functions import number, text
from areal.operators import audit, project
from areal.operators.registry import BOUNDARY_VERSION
from conftest import SF_DIR


def documents(spark, *docs):
    return spark.createDataFrame([(f"p{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "project_id string, document string")


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame([("gb-1", "1", "matched"), ("gb-2", "2", "ambiguous_name")], "region_id string, geometry_source_id string, match_status string")


STYLE = {"color": "#4472C4", "category": "a", "value": "1"}


def outcomes(spark, regions, doc):
    out = project.reconcile(project.parse(documents(spark, doc)), regions, "here").collect()
    return {r.region_id: r.outcome for r in out}


def test_pinned_project_is_unchanged(spark, regions):
    doc = {"schemaVersion": "1.1", "boundaryVersion": BOUNDARY_VERSION, "highlights": {"gb-1": STYLE}, "regionRefs": {"gb-1": {"canonicalRegionId": "idn-adm2-gb-1"}}}
    parsed = project.compatibility(project.parse(documents(spark, doc)), "here")
    assert parsed.first().provider_status == "legacy-compatible"
    assert outcomes(spark, regions, doc) == {"gb-1": "unchanged"}


def test_retired_ids_are_kept_as_missing(spark, regions):
    doc = {"schemaVersion": "1.0", "boundaryVersion": BOUNDARY_VERSION, "highlights": {"gb-1": STYLE, "gone": STYLE, "gb-2": STYLE}, "manualHighlights": {"lost": STYLE}}
    assert outcomes(spark, regions, doc) == {"gb-1": "mapped", "gone": "missing", "gb-2": "ambiguous", "lost": "missing"}


def test_other_boundary_freezes_everything(spark, regions):
    doc = {"schemaVersion": "1.1", "boundaryProviderId": "there", "boundaryVersion": "x", "highlights": {"gb-1": STYLE}}
    assert outcomes(spark, regions, doc) == {"gb-1": "missing"}


def test_reconciliation_is_idempotent(spark, regions):
    doc = {"schemaVersion": "1.0", "boundaryVersion": BOUNDARY_VERSION, "highlights": {"gb-1": STYLE}}
    first = project.reconcile(project.parse(documents(spark, doc)), regions, "here").first()
    again = dict(doc, schemaVersion="1.1", regionRefs={"gb-1": {"canonicalRegionId": first.canonical_region_id}})
    assert outcomes(spark, regions, again) == {"gb-1": "unchanged"}


def test_document_checks(spark):
    deep = "1.1"
    for _ in range(30):
        deep = [deep]
    docs = documents(
        spark,
        {"schemaVersion": "1.1"},
        {"schemaVersion": "9.9"},
        {"schemaVersion": "1.1", "highlights": {"a": {"color": "blue"}}},
        {"schemaVersion": "1.1", "x": {"__proto__": 1}},
        {"schemaVersion": "1.1", "x": deep},
        {"schemaVersion": "1.1", "legend": [{}] * 201},
        "no json",
    )
    issues = {r.project_id: set(r.issues) for r in project.document_checks(docs).collect()}
    assert issues["p0"] == set() and issues["p1"] == {"schema-version"} and issues["p2"] == {"color"}
    assert issues["p3"] == {"forbidden-key"} and issues["p4"] == {"too-deep"} and issues["p5"] == {"too-many-legend"}
    assert "not-json" in issues["p6"]


def test_token_positions(spark):
    docs = spark.createDataFrame([(1, "ab foo\nfoofoo x foo")], "d int, t string")
    found = sorted((r.line, r.column, r.match) for r in audit.tokens(docs, "d", "t", {"c": "foo"}).collect())
    assert found == [(1, 4, "foo"), (2, 1, "foo"), (2, 4, "foo"), (2, 10, "foo")]


def test_token_positions_of_a_line_with_many_hits(spark):
    rng = random.Random(5)
    words = [rng.choice(["foo", "a", "éé", "foofoo", ""]) for _ in range(3000)]
    line = " ".join(words)
    docs = spark.createDataFrame([(1, line), (2, None), (3, "")], "d int, t string")
    found = sorted((r.column, r.match) for r in audit.tokens(docs, "d", "t", {"c": "foo"}).collect())
    assert found == [(m.start() + 1, "foo") for m in re.finditer("foo", line)]


def test_a_prepared_index_needs_no_job(spark):
    from areal.operators import match, registry

    tables = contract.catalog.registered.Tables(spark, SF_DIR)
    rows, regions = tables.messy, tables.regions
    index, _ = registry.shared_index(regions)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    prepared = match.match_rows(rows, regions, small=True, index=index)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    key = lambda df: sorted(map(tuple, df.select("row_id", "status", "region_id", "match_key").fillna("").collect()))
    assert key(prepared) == key(match.match_rows(rows, regions))


def test_chains_of_parents(spark):
    from areal.operators import territory

    rows = [("s", f"d{i}", "territory", f"n{i}", f"d{i - 1}" if i else "", "active") for i in range(40)]
    rows += [("s", f"c{i}", "territory", f"m{i}", f"c{(i + 1) % 7}", "active") for i in range(7)]
    rows += [("s", "tail", "territory", "t", "c0", "active"), ("s", "own", "territory", "o", "own", "active"), ("t", "d9", "area", "x", None, "active")]
    nodes = spark.createDataFrame(rows, "scenario_id string, id string, level string, display_name string, parent_id string, status string")
    issues = {(r.issue, r.scenario_id, r.id) for r in territory.validate(nodes).collect()}
    assert {i[2] for i in issues if i[0] == "cycle"} == {*(f"c{i}" for i in range(7)), "tail", "own"}
    assert {i[1:] for i in issues if i[0] == "too-deep"} == {("s", f"d{i}") for i in range(6, 40)}


def test_row_functions_run_on_streams(spark):
    customers = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    stream = spark.readStream.schema(customers.schema).parquet(f"{SF_DIR}/customer.parque[t]")
    out = stream.select("c_custkey", text.normalize_text("c_name").alias("k"), number.parse_number(F.col("c_acctbal").cast("string"))["kind"].alias("kind"))
    job = out.writeStream.format("memory").queryName("streamed").outputMode("append").start()
    job.processAllAvailable()
    job.stop()
    assert spark.table("streamed").count() == customers.count()


def test_scan_reads_only_what_it_needs(spark):
    plan = contract.queries()["p6_export_subset"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.0)" in plan


def test_broadcast_cascade_moves_no_rows(spark):
    tables = contract.catalog.registered.Tables(spark, SF_DIR)
    from areal.operators import match, registry

    index, small = registry.shared_index(tables.regions)
    assert small
    best = match._best_by_broadcast(match.row_keys(match._with_roles(tables.messy.drop("true_region"))), index)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
