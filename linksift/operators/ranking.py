"""Latest/best row per key, top-k, and full ranks that stay distributed under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_POSITION_BITS = 33


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key in ``order``.

    Spark plans this as a group limit before the shuffle, so a key that holds a third of the
    table still ships at most ``n`` rows per map task.
    """
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, seq: str) -> DataFrame:
    """Newest row per key; the later ``seq`` wins a tie."""
    return first_per_key(df, keys, [F.desc(ts), F.desc(seq)])


def last_value_first_position(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last row per key, with ``position`` = where the key was first seen."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_last"), F.min(seq).alias("position"))
    return best.select(*keys, *[F.col("_last")[c].alias(c) for c in others], "position")


def exact_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based row number within ``keys`` by ``order`` without one task per key.

    A plain ranking window sends a whole key to one task. Here rows are range-partitioned and
    sorted on (keys, order), so a hot key spans many tasks; each row's place inside its task
    is known from the sort, and only per-task counts (one row per key and task) are summed
    across tasks. The sorted rows are written out once so that both reads see one placement.
    ``order`` must be total, or ties fall in an arbitrary but fixed order.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id())
    placed = cut_lineage(placed).withColumns({
        "_task": F.shiftright("_mid", _POSITION_BITS), "_at": F.col("_mid").bitwiseAND((1 << _POSITION_BITS) - 1),
    })
    per_task = placed.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_task").alias("_t"), "_from", "_before")
    same_key = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = placed.join(starts, [F.col("_task") == F.col("_t"), *same_key])
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_from") + 1).alias(rank))


def exact_global_rank(df: DataFrame, order: list[Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position over the whole table, distributed the same way as ``exact_rank``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    placed = cut_lineage(placed).withColumns({
        "_task": F.shiftright("_mid", _POSITION_BITS), "_at": F.col("_mid").bitwiseAND((1 << _POSITION_BITS) - 1),
    })
    # One row per task: the number of shuffle partitions bounds it.
    per_task = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(starts), "_task")
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(rank))


def ranked_top(df: DataFrame, order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """Top ``limit`` rows with their 1-based rank; the window runs only over the kept rows."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def round_robin(df: DataFrame, group: list[str], priority: str, seq: str, position: str = "position") -> DataFrame:
    """Interleave groups: best row of every group, then every second-best, and so on.

    Groups are ordered by their best row (higher ``priority``, then earlier ``seq``). Adds
    ``round``, ``group_priority``, ``group_seq`` and the global ``position``.
    """
    ranked = exact_rank(df, group, [F.desc(priority), F.col(seq)], "round")
    best = ranked.filter("round = 1").select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col(priority).alias("group_priority"), F.col(seq).alias("group_seq"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    joined = ranked.join(best, on).drop(*[f"_g{i}" for i in range(len(group))])
    return exact_global_rank(joined, [F.col("round"), F.desc("group_priority"), F.col("group_seq"), F.col(seq)], position)


def budget_limit(n: Column, budget: int, percent: float, hard_cap: int = 48, floor_count: int = 24) -> Column:
    """k = min(n, budget, hard cap, max(ceil(n * percent), min(floor, n)))."""
    share = F.ceil(n * F.lit(percent / 100.0))
    return F.greatest(F.lit(0), F.least(n, F.lit(budget), F.lit(hard_cap), F.greatest(share, F.least(F.lit(floor_count), n))))


def budgeted_top(df: DataFrame, order: list[Column], budget: int, percent: float, hard_cap: int = 48,
                 floor_count: int = 24, rank: str = "rank") -> DataFrame:
    """Top-k where k depends on the row count; the cap bounds k, so the ranked side is tiny."""
    counted = df.agg(F.count(F.lit(1)).alias("_n")).select(
        budget_limit(F.col("_n"), budget, percent, hard_cap, floor_count).alias("_k"))
    top = ranked_top(df, order, min(budget, hard_cap), rank)
    return top.join(F.broadcast(counted), F.col(rank) <= F.col("_k")).drop("_k")


def seen_last(df: DataFrame, seen: str, rank: str, position: str = "position") -> DataFrame:
    """Move rows flagged ``seen`` to the end, order otherwise kept."""
    return exact_global_rank(df, [F.col(seen), F.col(rank)], position)
