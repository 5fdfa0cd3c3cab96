"""One-document snapshots: eight arrays in, eight tables out, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FEEDBACK, LINKS, MISSES, PICKS, RECORD_SOURCES, RECORDS, RUN_LOG, SCORES

SNAPSHOT_TABLES = {
    "runs": RUN_LOG, "candidates": LINKS, "events": RECORDS, "eventSources": RECORD_SOURCES, "scores": SCORES, "recommendations": PICKS,
    "feedback": FEEDBACK, "missedEvents": MISSES,
}
_SCHEMA = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in SNAPSHOT_TABLES.items()] + [T.StructField("_corrupt_record", T.StringType())])


def read_snapshot(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, rejects): a missing array is an empty table; an unreadable document goes to rejects."""
    docs = spark.read.schema(_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    tables = {
        name: docs.select(F.inline(F.coalesce(F.col(name), F.array().cast(T.ArrayType(schema))))) for name, schema in SNAPSHOT_TABLES.items()
    }
    # Reading the corrupt column alone is refused for files, so the filter mentions a data column.
    any_size = F.coalesce(F.size("runs"), F.lit(-1)) >= F.lit(-1)
    rejects = docs.filter(F.col("_corrupt_record").isNotNull() & any_size).select("_corrupt_record", F.input_file_name().alias("file"))
    return tables, rejects


def write_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Write every table under a new version folder.

    All tables share one version number and the caller publishes it last, so a reader sees
    the whole snapshot or none of it. Rows stay distributed: one folder per table instead of
    one document.
    """
    target = f"{root.rstrip('/')}/v={version}"
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{target}/{name}")
    return target


def read_snapshot_tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{target}/{name}") for name, schema in SNAPSHOT_TABLES.items()}
