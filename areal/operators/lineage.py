"""Fingerprints, drift, reproducibility, licence and threshold gates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.functions import text
from areal.plans.sizing import lookup_join


def digest(c) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def _row_digest(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def _sum_of(part: Column) -> Column:
    return F.sum(F.conv(part, 16, 10).cast("decimal(38,0)"))


def fingerprint_of(row_digest: Column) -> Column:
    """Order-free digest of a set of rows: sums over two pieces of the row digests."""
    return F.sha2(
        F.concat_ws(
            "|",
            F.count("*").cast("string"),
            F.coalesce(_sum_of(F.substring(row_digest, 1, 12)), F.lit(0)).cast("string"),
            F.coalesce(_sum_of(F.substring(row_digest, 13, 12)), F.lit(0)).cast("string"),
        ),
        256,
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint) of a table, independent of row order and partitioning."""
    hashed = df.select(_row_digest(df, df.columns).alias("_d"))
    return hashed.agg(F.count("*").alias("rows"), fingerprint_of(F.col("_d")).alias("fingerprint"))


def group_fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    hashed = df.select(*by, _row_digest(df, df.columns).alias("_d"))
    return hashed.groupBy(*by).agg(F.count("*").alias("rows"), fingerprint_of(F.col("_d")).alias("fingerprint"))


def same_run(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose hash differs between two runs (path, sha256), missing ones included."""
    left, right = a.select("path", F.col("sha256").alias("first")), b.select("path", F.col("sha256").alias("second"))
    return left.join(right, "path", "full_outer").filter(~F.col("first").eqNullSafe(F.col("second")))


def drift(pinned: DataFrame, actual: DataFrame) -> DataFrame:
    """Hash and count changes against a pinned manifest (path, sha256, features, vertices)."""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("path", *[F.col(c).alias(f"{prefix}_{c}") for c in ("sha256", "features", "vertices")])

    joined = side(pinned, "pinned").join(side(actual, "actual"), "path", "full_outer")
    changed = {c: ~F.col(f"pinned_{c}").eqNullSafe(F.col(f"actual_{c}")) for c in ("sha256", "features", "vertices")}
    kinds = F.array_compact(
        F.array(
            F.when(F.col("pinned_sha256").isNull(), "added"),
            F.when(F.col("actual_sha256").isNull(), "removed"),
            F.when(changed["sha256"], "checksum"),
            F.when(changed["features"], "feature_count"),
            F.when(changed["vertices"], "vertex_count"),
        )
    )
    return joined.select("path", F.array_join(kinds, ",").alias("changes"), F.when(F.size(kinds) > 0, "review_required").otherwise("no_drift").alias("status"))


def drift_status(drifted: DataFrame) -> DataFrame:
    return drifted.agg(
        F.count_if(F.col("status") == "review_required").alias("changed"),
        F.when(F.count_if(F.col("status") == "review_required") > 0, "review_required").otherwise("no_drift").alias("status"),
    )


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Contents (path, content) against a manifest (path, sha256)."""
    hashed = files.select("path", digest("content").alias("actual"))
    joined = lookup_join(hashed, manifest.select("path", F.col("sha256").alias("expected")), ["path"], "left")
    verdict = F.when(F.col("expected").isNull(), "unlisted").when(F.col("actual") == F.col("expected"), "ok").otherwise("changed")
    return joined.select("path", verdict.alias("status"))


def simplification_gate(measured: DataFrame, pinned: DataFrame) -> DataFrame:
    """Counts and tolerance label of each layer against the pinned ones."""
    joined = measured.alias("m").join(pinned.alias("p"), "layer", "full_outer")
    same = F.lit(True)
    for name in ("features", "vertices", "algorithm", "tolerance"):
        same = same & F.col(f"m.{name}").eqNullSafe(F.col(f"p.{name}"))
    return joined.select("layer", F.when(same, "passed").otherwise("failed").alias("status"))


# Fields a source record must fill.
SOURCE_FIELDS = [
    "datasetId", "title", "publisherOwner", "sourceUrl", "retrievedAccessDate", "effectivePeriodVersion",
    "sha256", "mediaType", "licenseId", "commercialUseStatus", "modificationStatus", "redistributionStatus",
    "attributionRequirementText", "transformationList", "reviewerStatusDate", "productionApprovalStatus",
]
UNCLEAR = "(?i)unknown|unclear|pending"  # fixed value


def source_issues(inventory: DataFrame, snapshots: DataFrame, required: list[str] = SOURCE_FIELDS) -> DataFrame:
    """(id, issue) of source records: missing fields, repeated ids, missing or changed snapshots."""
    repeated = inventory.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1")
    seen = lookup_join(inventory, repeated, ["id"], "left")
    found = lookup_join(seen, snapshots.select(F.col("path").alias("localSnapshotPath"), F.col("sha256").alias("_actual")), ["localSnapshotPath"], "left")
    has_path = text.text_of("localSnapshotPath") != ""
    checks = [F.when(text.text_of(f) == "", F.concat(F.lit("missing:"), F.lit(f))) for f in required]
    checks += [
        F.when(F.col("_n") > 1, "duplicate-id"),
        F.when(has_path & F.col("_actual").isNull(), "snapshot-missing"),
        F.when(has_path & (F.col("_actual") != F.col("sha256")), "checksum-changed"),
    ]
    return found.select("id", F.explode(F.array_compact(F.array(*checks))).alias("issue")).distinct()


def license_gate(assets: DataFrame, files: DataFrame, lock: DataFrame, required_paths: DataFrame) -> DataFrame:
    """(id, issue) of licence records; required paths without a record come last."""
    repeated = assets.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1")
    joined = lookup_join(assets, repeated, ["id"], "left")
    joined = lookup_join(joined, files.select("path", F.col("sha256").alias("_actual")), ["path"], "left")
    joined = lookup_join(joined, lock.select(F.col("package").alias("lockfilePackage"), F.col("license").alias("_locked")), ["lockfilePackage"], "left")

    def blank(name: str) -> Column:
        return text.text_of(name) == ""

    filed, locked = ~blank("path"), ~blank("lockfilePackage")
    checks = {
        "duplicate-id": F.col("_n") > 1,
        "license-missing": blank("licenseId"),
        "source-missing": blank("exactSource"),
        "commercial-use-unclear": blank("commercialUseStatus") | F.col("commercialUseStatus").rlike(UNCLEAR),
        "redistribution-unclear": blank("redistributionStatus") | F.col("redistributionStatus").rlike(UNCLEAR),
        "attribution-missing": F.col("attributionRequired") & (text.trim("attributionText") == ""),
        "file-missing": filed & F.col("_actual").isNull(),
        "sha256-missing": filed & F.col("_actual").isNotNull() & blank("sha256"),
        "checksum-changed": filed & ~blank("sha256") & (F.col("_actual") != F.col("sha256")),
        "not-approved": filed & F.col("category").startswith("production") & ~F.coalesce("productionApproved", F.lit(False)),
        "package-missing": locked & F.col("_locked").isNull(),
        "package-license-changed": locked & (F.col("_locked") != F.col("licenseId")),
    }
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))
    found = joined.select("id", F.explode(issues).alias("issue")).distinct()
    uncovered = required_paths.join(assets.select("path").distinct(), "path", "left_anti")
    return found.unionByName(uncovered.select(F.col("path").alias("id"), F.lit("path-not-covered").alias("issue")))


def threshold_gate(log: DataFrame, size_col: str, limits: DataFrame, group_col: str) -> DataFrame:
    """Per group: request count and size sum of a log against limits (group, max_count, max_size)."""
    measured = log.groupBy(group_col).agg(F.count("*").alias("requests"), F.round(F.sum(size_col), 2).alias("size"))
    joined = measured.join(limits, group_col, "left")
    over = F.when(F.col("requests") > F.col("max_count"), "count").when(F.col("size") > F.col("max_size"), "size").otherwise("ok")
    return joined.select(group_col, "requests", "size", over.alias("verdict"))


def forbidden(log: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Log rows whose text holds a forbidden fragment, any case."""
    lowered, hit = F.lower(column), F.lit(False)
    for pattern in patterns:
        hit = hit | lowered.contains(pattern.lower())
    return log.filter(hit)


def canonical_text(c) -> Column:
    """Line feeds only, no trailing white space, one line end."""
    unix = F.regexp_replace(F.regexp_replace(text.text_of(c), "\r\n?", "\n"), f"[{text.SPACE}]+$", "")
    return F.concat(unix, F.lit("\n"))


def _sorted_json(values: pd.Series) -> pd.Series:
    def one(value):
        try:
            return None if value is None else json.dumps(json.loads(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return values.map(one)


def stable_json(c) -> Column:
    """JSON with keys sorted at every level; NULL where the text is no JSON."""
    return F.pandas_udf(_sorted_json, "string")(c)


def report(df: DataFrame, name: str, errors: DataFrame) -> DataFrame:
    """One-row run report as JSON and Markdown: status, row count, error count."""
    marks = df.select(F.lit(1).alias("row"), F.lit(0).alias("error")).unionByName(errors.select(F.lit(0).alias("row"), F.lit(1).alias("error")))
    counts = marks.agg(F.coalesce(F.sum("row"), F.lit(0)).alias("rows"), F.coalesce(F.sum("error"), F.lit(0)).alias("errors"))
    status = F.when(F.col("errors") > 0, "failed").otherwise("passed")
    described = counts.select(F.lit(name).alias("name"), status.alias("status"), "rows", "errors")
    lines = [
        F.concat(F.lit("# "), F.col("name")),
        F.lit(""),
        F.concat(F.lit("Status: "), F.col("status")),
        F.concat(F.lit("Rows: "), F.col("rows").cast("string")),
        F.concat(F.lit("Errors: "), F.col("errors").cast("string")),
    ]
    return described.select("name", F.to_json(F.struct("name", "status", "rows", "errors")).alias("json"), F.concat_ws("\n", *lines).alias("markdown"))
