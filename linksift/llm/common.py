"""What the operators of this package share: tables, Arrow batches, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path

__all__ = ["WHITE", "arrow_map", "cut_lineage", "documents", "free_name", "learned_share", "raw_texts", "scratch_path", "table"]

#: White space of the contracts, as a character class.
WHITE = r"[\x20\x09-\x0D]"
#: Rows of an Arrow batch: long texts must not add up to more than a worker's memory.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of few rows, so that a batch of very long texts stays small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def learned_share(key: Column, share: Column, seed: int) -> Column:
    """True for a seeded, hash-chosen ``share`` (0 to 1) of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < share * F.lit(float(1 << 30))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
