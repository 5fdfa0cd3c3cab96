"""Upserts and run-log merges expressed as union + one row per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .ranking import first_per_key


def by_values(rows: DataFrame, order: Callable[[str], Column] = F.asc) -> list[Column]:
    """All comparable values of a row, as the last tie-break; null is the smallest.

    Column by column: one struct of all would be made before the shuffle and double each row there.
    """
    return [order(f.name) for f in rows.schema if not isinstance(f.dataType, MapType)]


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], seq: str,
           update_cols: list[str] | None = None, keep_min: list[str] = (), keep_max: list[str] = ()) -> DataFrame:
    """``current`` with ``incoming`` applied: last incoming row per key wins.

    ``update_cols`` limits which columns an existing row takes from the new one; ``keep_min``
    and ``keep_max`` columns take the smaller or larger of both (first and last seen). Of rows
    alike in ``seq``, the one whose values sort last wins, so a rerun gives the same table. If
    ``current`` holds ``seq`` too, a late row that is older than the stored one changes nothing
    but those two kinds of column. A row without ``seq`` counts as older than any.
    """
    newest = first_per_key(incoming, keys, [F.desc(seq), *by_values(incoming, F.desc)])
    cols = current.columns
    left = current.select(*keys, F.struct(*cols).alias("_old"))
    right = newest.select(*keys, F.struct(*[F.col(c) if c in newest.columns else F.lit(None).cast(current.schema[c].dataType).alias(c)
                                            for c in cols]).alias("_new"))
    return _applied(left.join(right, keys, "full_outer"), cols, keys, seq, update_cols, keep_min, keep_max)


def _applied(pairs: DataFrame, cols: list[str], keys: list[str], seq: str, update_cols: list[str] | None,
             keep_min: list[str], keep_max: list[str], also: list[str] = ()) -> DataFrame:
    """``cols`` of rows with their keys, ``_old`` and ``_new`` by the conflict rule of ``upsert``; ``also`` are kept as they are."""
    late = F.coalesce(F.col("_new")[seq] < F.col("_old")[seq], F.col("_old")[seq].isNotNull()) if seq in cols else F.lit(False)
    taken = F.col("_new").isNotNull() & ~late

    def merged(c: str) -> Column:
        old, new = F.col("_old")[c], F.col("_new")[c]
        if c in keys:
            return F.col(c)
        if c in keep_min:
            return F.least(old, new)
        if c in keep_max:
            return F.greatest(old, new)
        if update_cols is not None and c not in update_cols and c != seq:
            return F.when(F.col("_old").isNotNull(), old).otherwise(new)
        return F.when(taken, new).otherwise(old)

    return pairs.select(*[merged(c).alias(c) for c in cols], *also)


def upsert_dealt(dealt: DataFrame, is_stored: str, places: list[str], keys: list[str], seq: str,
                 update_cols: list[str] | None = None, keep_min: list[str] = (), keep_max: list[str] = ()) -> DataFrame:
    """``upsert`` of stored and incoming rows that lie in one frame, told apart by ``is_stored`` and already dealt by ``places``.

    ``places`` follow from the keys, so all rows of a key are in one task: nothing is shuffled here, and the result stays
    dealt by ``places``, which it keeps. As in ``upsert``, a key with a null in it equals no stored one.
    """
    rows, stored = dealt.drop(is_stored, *places), F.col(is_stored)
    in_key = Window.partitionBy(*keys, *places).orderBy(F.desc(is_stored), F.desc(seq), *by_values(rows, F.desc))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    # A key's rows: its stored one, then the incoming ones, of which the first wins. Columns are looked at one by one, as a struct would be sorted too.
    needed = [c for c in rows.columns if update_cols is None or c in (*update_cols, *keep_min, *keep_max, seq)]
    marked = dealt.withColumns({"_before": F.lag(is_stored).over(in_key), "_after": F.lead(is_stored).over(in_key),
                                **{f"_after_{c}": F.lead(c).over(in_key) for c in needed}})
    after = F.struct(*[F.col(f"_after_{c}" if c in needed else c).alias(c) for c in rows.columns])
    row = F.struct(*rows.columns)
    pairs = marked.filter(stored | F.col("_before").isNull() | (F.col("_before") & ~known)).select(
        *places, *keys, F.when(stored, row).alias("_old"), F.when(~stored, row).when(known & ~F.col("_after"), after).alias("_new"))
    return _applied(pairs, rows.columns, keys, seq, update_cols, keep_min, keep_max, places)


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str], also_unique: list[str] | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet (conflict: do nothing)."""
    by_value = by_values(incoming)
    fresh = first_per_key(incoming, keys, by_value).join(current.select(*keys), keys, "left_anti")
    if also_unique:
        fresh = first_per_key(fresh, also_unique, by_value).join(current.select(*also_unique), also_unique, "left_anti")
    return fresh


def union_latest(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key where ``left`` wins over ``right``."""
    both = right.withColumn("_side", F.lit(0)).unionByName(left.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, keys, [F.desc("_side")]).drop("_side")


def run_state(log: DataFrame, counters: list[str], key: str = "run_id", seq: str = "seq") -> DataFrame:
    """Final run rows from an append-only run log.

    Each counter is the last non-null value logged, as a JSON object merge would leave it; a
    key's log is folded by partial aggregation, never collected.
    """
    others = [c for c in log.columns if c not in (*counters, key, seq)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in [*others, *counters]]
    return log.groupBy(key).agg(*last)
