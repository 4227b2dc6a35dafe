"""Joins, ranks and positions whose plan depends on a measured size."""

from __future__ import annotations

import math
import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
RANK_BUCKET_ROWS = 1_000_000


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table as a literal: no job, no Python worker."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(columns, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table: true only if its rows and their text size stay within bounds.

    Reads at most max_rows + 1 rows.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size_sum = (
        df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    )
    return rows <= max_rows and size_sum <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join a large left side to a lookup table.

    small tells that the caller has measured the lookup: it is broadcast, and the
    left side does not move. Else no side is run twice to measure it: Spark
    broadcasts what its statistics, or those of a finished shuffle, show to be
    small, and splits the partitions of keys that turn out heavy over as many
    tasks as their size needs. how is inner, left, left_semi or left_anti. spread
    names columns that tell rows apart; the plan does not need it any more.
    """
    return left.join(F.broadcast(right) if small else right, on, how)


def _cuts(distinct: DataFrame, order: str, count: int) -> list:
    """Bounds that split an ordered set of distinct values into ranges of bounded size."""
    wanted = math.ceil(count / RANK_BUCKET_ROWS)
    if wanted <= 1:
        return []
    fractions = [i / wanted for i in range(1, wanted)]
    return sorted(set(distinct.agg(F.percentile_approx(order, fractions, 10 * wanted)).first()[0]))


def values_at(values: DataFrame, value: str, positions: Callable[[int], list[int]]) -> list[float]:
    """Values at 1-based positions of the ascending order, exactly.

    positions gives the wanted positions for a row count. Equal values are
    counted before any ordering, the ordering runs in ranges of bounded size,
    and only the ranges holding a wanted position are ordered at all.
    """
    counted = values.groupBy(value).agg(F.count("*").alias("_n"))
    distinct, total = counted.agg(F.count("*"), F.sum("_n")).first()
    if not distinct:
        return []
    wanted = positions(total)
    cuts = _cuts(counted, value, distinct)
    if cuts:
        ranged = counted.withColumn("_bucket", F.size(F.filter(F.lit(cuts), lambda cut: cut < F.col(value))))
        sizes = ranged.groupBy("_bucket").agg(F.sum("_n").alias("_rows")).orderBy("_bucket").collect()
    else:
        ranged, sizes = counted.withColumn("_bucket", F.lit(0)), [{"_bucket": 0, "_rows": total}]
    before, starts = 0, {}
    for row in sizes:
        if any(before < p <= before + row["_rows"] for p in wanted):
            starts[row["_bucket"]] = before
        before += row["_rows"]
    start = F.create_map(*[F.lit(x) for bucket, rows in starts.items() for x in (bucket, rows)])
    running = F.sum("_n").over(
        Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = ranged.filter(F.col("_bucket").isin(list(starts))).select(
        value, (start[F.col("_bucket")] + running).alias("_last"), F.col("_n")
    )
    hits = last.filter(F.exists(F.lit(wanted), lambda p: (p <= F.col("_last")) & (p > F.col("_last") - F.col("_n"))))
    ends = {r["_last"]: (r["_n"], r[value]) for r in hits.collect()}
    return [next(v for end, (n, v) in ends.items() if end - n < p <= end) for p in wanted]


def ranked(distinct: DataFrame, order: str, rank: str, collation: str | None = None) -> DataFrame:
    """Add the 0-based position of each distinct text in ascending order.

    Up to RANK_BUCKET_ROWS texts are ordered in one window; more are split into
    ranges first, so no task orders all of them.
    """
    key = F.collate(order, collation) if collation else F.col(order)
    count = distinct.count()
    if count <= RANK_BUCKET_ROWS:
        return distinct.withColumn(rank, F.row_number().over(Window.orderBy(key, order)) - 1)
    checkpointed = checkpoint(
        distinct.repartitionByRange(math.ceil(count / RANK_BUCKET_ROWS) + 1, key, F.col(order)).withColumn("_part", F.spark_partition_id())
    )
    counts = checkpointed.groupBy("_part").count()
    offsets = counts.withColumn(
        "_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key, order)) - 1
    return (
        checkpointed.join(F.broadcast(offsets), "_part")
        .withColumn(rank, (within + F.col("_before")).cast("int"))
        .drop("_part", "_before")
    )


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows to all cores by columns that tell them apart, before work that is long for their size: a small file
    would else be one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster.

    It comes from spark.checkpoint.dir; a temporary one is used only where none is
    set on a local master.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder is None:
            if not re.match(r"local(\[.*\])?\Z", context.master):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = os.path.join(tempfile.mkdtemp(prefix="areal-"), "checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the checkpoint folder of the cluster."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
