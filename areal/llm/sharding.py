"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in memory, by a
seeded hash; Spark's shuffle files are the external storage. Pass two takes one
bucket at a time, puts it in Fisher-Yates order and deals it out. The position in
the whole order (rows of all earlier buckets plus the place in the bucket) gives
the shard, so the shards' row counts are at most one apart.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from areal.llm.common import free_name

SHARDS = 16
SEED = 20240229
#: Text held at once by a task of the second pass, and the least number of buckets, for even work on small tables.
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS = 256


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform order of 0..n-1: the place of each item drawn from those not yet settled."""
    order = list(range(n))
    draw = random.Random(seed)
    for i in range(n - 1, 0, -1):
        j = draw.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    record: tuple[str, ...] = ("doc_id", "text"),
    text: str = "text",
) -> DataFrame:
    """All columns and rows of docs with shard and slot, in a random order that the seed fixes.

    record names the columns that tell records apart; the order depends on their
    values alone, not on files or tasks, so a lost task is made again alike. Rows
    equal in all of them are interchangeable and share a bucket. Null texts count
    as empty, null ids are one more value. Columns named shard or slot are
    replaced. An empty table gives no rows. The driver holds one count for each
    bucket (100 TB in buckets of 64 MB: 1.6 million numbers).
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 64
    total = kept.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / bucket_bytes))
    hash_name, bucket_name = free_name("_hash", kept.columns), free_name("_bucket", kept.columns)
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in record])
    scattered = kept.withColumn(hash_name, hashed).withColumn(bucket_name, F.pmod(hash_name, F.lit(buckets)).cast("int"))

    counts = scattered.groupBy(bucket_name).count().toArrow()
    before = np.zeros(buckets + 1, dtype=np.int64)
    before[np.asarray(counts[bucket_name]) + 1] = np.asarray(counts["count"])
    shared = docs.sparkSession.sparkContext.broadcast(np.cumsum(before))
    names = kept.columns

    def deal(key: tuple, bucket: pa.Table) -> pa.Table:
        number = key[0].as_py()
        # the order in which a shuffle hands over rows is not fixed: begin with that of the hashes
        settled = np.argsort(np.asarray(bucket[hash_name]), kind="stable")
        order = settled[fisher_yates(bucket.num_rows, seed * 1_000_003 + number)]
        place = np.arange(bucket.num_rows, dtype=np.int64) + shared.value[number]
        dealt = bucket.select(names).take(pa.array(order))
        return dealt.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column(
            "slot", pa.array(place // shards)
        )

    schema = StructType(list(kept.schema.fields)).add("shard", IntegerType(), False).add("slot", LongType(), False)
    return scattered.groupBy(bucket_name).applyInArrow(deal, schema)


def write_shards(dealt: DataFrame, path: str) -> None:
    """Write the shards as folders; slot is the place of a row in its shard."""
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
