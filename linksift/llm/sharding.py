"""Two-pass external shuffle of a table into shards.

First pass: a seeded hash scatters the records over buckets small enough for a task's memory.
Second pass: each bucket is put in a fixed order and shuffled by Fisher-Yates with the bucket's
own seed. A bucket starts where those before it end, so every record has its place in one uniform
order of the whole table; the place gives shard (place mod shards) and slot (place div shards).
Counts of shards are at most one apart, and slots have no gaps.

Equal rows share a bucket; where that fills it far over its size, its rows are counted and each copy
is dealt by itself (there -0.0 in other columns becomes 0.0).

The result depends on seed, size of buckets and rows only, not on partitions or retries. Null
texts have no bytes. Rows that repeat an id are records of their own, ordered by text; equal rows
are told apart by nothing, so their order does not matter. An empty table gives empty shards.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut_lineage

#: Bytes of text in a bucket, about; more only where the table would need over MOST_BUCKETS of them.
BUCKET_BYTES = 4 << 20
#: Bound of the list of buckets, which every task gets: 2**20 numbers. 100 TB make buckets of 100 MB.
MOST_BUCKETS = 1 << 20
#: A bucket of more than so many times its size is dealt anew.
FULL = 4
#: Copies of a row that one row stands for while they are dealt out over tasks.
COPIES = 1024
LAW = "rows"


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1, each as likely."""
    order, random = np.arange(n), np.random.default_rng(seed)
    for i, j in zip(range(n - 1, 0, -1), random.integers(0, np.arange(n, 1, -1))):
        order[i], order[j] = order[j], order[i]
    return order


def scattered(df: DataFrame, id_col: str, text_col: str, seed: int, bucket_bytes: int) -> DataFrame:
    """``df`` with the bucket of each row, ``_bucket``."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(64)
    total = df.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    buckets = min(MOST_BUCKETS, max(1, math.ceil(total / bucket_bytes)))
    # The text's hash spreads rows that repeat an id or have none.
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(buckets)))
    most = FULL * max(bucket_bytes, math.ceil(total / buckets))
    full = dealt.groupBy("_bucket").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > most).select("_bucket").collect()
    if not full:
        return dealt
    marked = F.broadcast(df.sparkSession.createDataFrame(full, "_bucket long"))  # MOST_BUCKETS / FULL rows at most
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = dealt.join(marked, "_bucket", "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    zero, step = F.lit(0).cast("long"), F.lit(COPIES).cast("long")
    parts = counted.withColumn("_from", F.explode(F.sequence(zero, F.col("_rows") - 1, step))).repartition(F.col(id_col), F.col("_from"))
    copies = parts.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + step, F.col("_rows")) - 1)))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.to_json(F.struct(*columns)), F.col("_copy")), F.lit(buckets)).alias("_bucket")
    return dealt.join(marked, "_bucket", "left_anti").select(*columns, "_bucket").unionByName(copies.select(*columns, bucket))


def shuffled(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with shard and slot (columns of those names are replaced), written once in its new order."""
    df = df.drop("shard", "slot", "_bucket")
    kept = StructType([*df.schema.fields, StructField("_bucket", LongType()), StructField("_place", LongType())])

    def mix(batch: pa.Table) -> pa.Table:
        number = batch.column("_bucket")[0].as_py()
        ordered = batch.sort_by([(id_col, "ascending"), (text_col, "ascending")])
        order = fisher_yates(len(ordered), seed * 1_000_003 + number)
        return ordered.take(pa.array(order)).append_column("_place", pa.array(np.arange(len(ordered)), pa.int64()))

    mixed = cut_lineage(scattered(df, id_col, text_col, seed, bucket_bytes).groupBy("_bucket").applyInArrow(mix, kept))
    counts = dict(map(tuple, mixed.groupBy("_bucket").count().collect()))  # MOST_BUCKETS rows at most
    starts = dict(zip(sorted(counts), accumulate([0] + [counts[b] for b in sorted(counts)])))
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(starts.items()), "_bucket long, _start long"))
    place = F.col("_start") + F.col("_place")
    placed = mixed.join(offsets, "_bucket").withColumns({"shard": F.pmod(place, F.lit(shards)).cast("int"), "slot": F.floor(place / F.lit(shards)).cast("long")})
    return placed.drop("_bucket", "_place", "_start")


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """The shuffled records as Parquet under ``path``/shard=N, with their slots."""
    shuffled(df, shards, **options).write.partitionBy("shard").parquet(path)
