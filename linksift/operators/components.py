"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, delete_path, scratch_path


def _with_minimum(directed: DataFrame) -> DataFrame:
    """Each edge (u, v) with ``m``, the smallest of u and its neighbours.

    The minimum is merged before the shuffle; the join back to a hub's edges is one that adaptive
    execution splits when it is skewed.
    """
    near = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return directed.join(by_shuffle(near), "u")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for undirected ``edges(a, b)``; component = smallest vertex id.

    Large-star / small-star contraction: O(log n) rounds in practice, and only the current edge
    list is kept. Each step is written out, and the one before it is deleted. Vertices without an
    edge to another vertex are not listed.
    """
    spark = edges.sparkSession
    written: list[str] = []

    def step(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "components")
        df.filter("u <> v").distinct().write.parquet(path)
        if written:
            delete_path(spark, written.pop())
        written.append(path)
        return spark.read.schema(df.schema).parquet(path)

    current = step(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    signature = _signature(current)
    while signature[0]:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = step(_with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        current = step(_with_minimum(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                     F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v"))
        found = _signature(current)
        if found == signature:
            break
        signature = found
    roots = current.select(F.col("v").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
