"""Source graph and running source reputation."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import stable_id
from ..session import cut_lineage
from .ranking import first_per_key


def _segment_maps(batch: pa.RecordBatch, keys: list[str], values: list[str]) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """First rows of the stretches of equal keys, and each value's map over each stretch: (first value or NaN, factor, offset)."""
    fresh = np.ones(batch.num_rows, bool)
    fresh[1:] = False
    for key in keys:
        now, before = batch.column(key).slice(1), batch.column(key).slice(0, batch.num_rows - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before)))
        fresh[1:] |= differ.to_numpy(zero_copy_only=False)
    starts, stretch = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    maps = {}
    for value in values:
        known = pc.is_valid(batch.column(value)).to_numpy(zero_copy_only=False)
        own, x = stretch[known], batch.column(value).to_numpy(zero_copy_only=False).astype(float)[known]
        count = np.bincount(own, minlength=len(starts))
        ends = np.cumsum(count)
        # The last of n values weighs 1/2, the one before it 1/4, and so on; what was before weighs 2**-n.
        weight = np.ldexp(1.0, -np.minimum(ends[own] - np.arange(len(own)), 1100))
        first = np.full(len(starts), np.nan)
        first[count > 0] = x[(ends - count)[count > 0]]
        maps[value] = first, np.ldexp(1.0, -np.minimum(count, 1100)), np.bincount(own, weights=x * weight, minlength=len(starts))
    return starts, maps


def half_mean_maps(df: DataFrame, keys: list[str], seq: str, values: list[str], partitions: int | None = None) -> DataFrame:
    """(keys, a struct for each value): what folding (acc + x) / 2 over a key's rows in ``seq`` order does to acc.

    The fold of a run of rows is an affine map, acc -> factor * acc + offset, and maps compose. Rows are
    range-partitioned and sorted by (keys, seq), so a hot key spans many tasks; each task folds its
    stretch of a key in one pass, and one row per key and task is composed in order. ``first`` is the first
    value, from which a fold without a past starts; it is null if all are. Null values are left out.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*keys, seq, *[F.col(v).cast("double").alias(v) for v in values]).repartitionByRange(n, *keys, seq).sortWithinPartitions(*keys, seq).select(*keys, *values)
    parts = ["first", "factor", "offset"]
    names = [*keys, "_task", *[f"{v}__{p}" for v in values for p in parts]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None  # the last stretch, which the next batch may go on with

        def sent(rows: pa.RecordBatch, maps: dict) -> pa.RecordBatch:
            columns = [*(rows.column(k) for k in keys), pa.array(np.full(rows.num_rows, task, np.int32))]
            for v in values:
                first, factor, offset = maps[v]
                columns += [pa.array(first, mask=np.isnan(first)), pa.array(factor), pa.array(offset)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts, maps = _segment_maps(batch, keys, values)
            heads = batch.select(keys).take(pa.array(starts))
            if held is not None:
                if held[0].equals(heads.slice(0, 1)):
                    for v in values:
                        (f0, k0, o0), (f1, k1, o1) = held[1][v], maps[v]
                        f1[0] = f1[0] if np.isnan(f0[0]) else f0[0]
                        o1[0] += k1[0] * o0[0]
                        k1[0] *= k0[0]
                else:
                    yield sent(*held)
            if len(starts) > 1:
                yield sent(heads.slice(0, len(starts) - 1), {v: tuple(x[:-1] for x in m) for v, m in maps.items()})
            held = heads.take(pa.array([len(starts) - 1])), {v: tuple(x[-1:].copy() for x in m) for v, m in maps.items()}
        if held is not None:
            yield sent(*held)

    key_types = ", ".join(f"`{k}` {ordered.schema[k].dataType.simpleString()}" for k in keys)
    folded = ordered.mapInArrow(fold, key_types + ", _task int, " + ", ".join(f"`{v}__{p}` double" for v in values for p in parts))
    told = F.struct("_task", *[F.struct(*[F.col(f"{v}__{p}").alias(p) for p in parts]).alias(v) for v in values])

    def composed(v: str) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("offset"))
        return F.aggregate(F.transform("_maps", lambda m: m[v]), start, lambda done, m: F.struct(
            F.coalesce(done["first"], m["first"]).alias("first"), (done["factor"] * m["factor"]).alias("factor"), (m["factor"] * done["offset"] + m["offset"]).alias("offset")))

    # One entry for each task that a key spans.
    return folded.groupBy(*keys).agg(F.sort_array(F.collect_list(told)).alias("_maps")).select(*keys, *[composed(v).alias(v) for v in values])


def half_mean(over: Column, before: Column | None = None) -> Column:
    """The folded value of a map of ``half_mean_maps``, from ``before`` on or else from its first value."""
    start = over["first"] if before is None else F.coalesce(before, over["first"])
    return F.when(over["first"].isNull(), F.lit(None).cast("double") if before is None else before).otherwise(over["factor"] * start + over["offset"])


def running_half_mean(df: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """Fold (acc + x) / 2 over each key's rows in ``seq`` order; the first row starts the fold.

    Null values are left out; a key with none at all is not returned.
    """
    maps = half_mean_maps(df, keys, seq, values)
    return maps.filter(F.coalesce(*[F.col(v)["first"] for v in values]).isNotNull()).select(*keys, *[half_mean(F.col(v)).alias(v) for v in values])


def reputation(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """In-batch fold of source rows: half-mean quality and noise, counts, newest sighting."""
    folded = running_half_mean(df, keys, seq, ["quality_score", "noise_rate"])
    totals = df.groupBy(*keys).agg(F.max("freshness_score").alias("freshness_score"), F.sum("events_found").alias("events_found"),
                                   F.sum("recommended_events").alias("recommended_events"), F.max("last_seen").alias("last_seen"))
    return totals.join(folded, keys, "left")


def merge_reputation(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored source rows with one batch merged in (both one row per id)."""
    cols = [c for c in current.columns if c != "id"]
    joined = current.select("id", F.struct(*cols).alias("_o")).join(batch.select("id", F.struct(*cols).alias("_n")), "id", "full_outer")

    def both(c: str, merged: Column) -> Column:
        return F.when(F.col("_o").isNull(), F.col("_n")[c]).when(F.col("_n").isNull(), F.col("_o")[c]).otherwise(merged).alias(c)

    def rule(c: str) -> Column:
        old, new = F.col("_o")[c], F.col("_n")[c]
        return {
            "quality_score": (old + new) / 2, "noise_rate": (old + new) / 2, "freshness_score": F.greatest(old, new),
            "events_found": old + new, "recommended_events": old + new, "last_seen": F.greatest(old, new),
        }.get(c, old)

    return joined.select("id", *[both(c, rule(c)) for c in cols])


def fold_into(current: DataFrame, batch: DataFrame, seq: str, mark: int) -> DataFrame:
    """Stored source rows with one batch of source rows folded in, row by row in ``seq`` order.

    The batch goes on from the stored half-means, so folding batches one after another equals folding
    all rows at once. A row touched by the batch keeps ``mark`` in ``_seq``; a row whose ``_seq`` is ``mark``
    or later has the batch already and stays, so folding a batch again changes nothing.
    """
    labels, means = ["source_type", "name", "url", "handle"], ["quality_score", "noise_rate"]
    known = batch.filter("id is not null")
    maps = half_mean_maps(known, ["id"], seq, means)
    totals = known.groupBy("id").agg(F.max("freshness_score").alias("freshness_score"), F.sum("events_found").alias("events_found"), F.sum("recommended_events").alias("recommended_events"),
                                     F.max("last_seen").alias("last_seen"), F.min_by(F.struct(*labels), F.col(seq)).alias("_labels"))
    fresh = maps.join(totals, "id").select("id", F.struct(*means, "freshness_score", "events_found", "recommended_events", "last_seen", "_labels").alias("_n"))
    stored = [c for c in current.columns if c != "id"]
    joined = current.select("id", F.struct(*stored).alias("_o")).join(fresh, "id", "full_outer")
    kept = F.col("_n").isNull() | F.coalesce(F.col("_o")["_seq"] >= mark, F.lit(False))

    def merged(c: str) -> Column:
        old, new = F.col("_o")[c], F.col("_n")[c] if c not in (*labels, "_seq") else None
        if c in means:
            after = half_mean(new, old)
        elif c in labels:
            after = F.when(F.col("_o").isNull(), F.col("_n._labels")[c]).otherwise(old)
        elif c == "_seq":
            after = F.lit(mark).cast("long")
        elif c in ("events_found", "recommended_events"):
            after = F.when(old.isNull() & new.isNull(), None).otherwise(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)))
        else:
            after = F.greatest(old, new)
        return F.when(kept, old).otherwise(after).cast(current.schema[c].dataType).alias(c)

    return joined.select("id", *[merged(c) for c in stored])


def with_source(links: DataFrame, default_quality: float = 50.0) -> DataFrame:
    """Links plus the source node they came from: ``from_id`` and source columns."""
    url = U.link_url(F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.col("canonical_url")))
    staged = links.withColumn("_src_url", url).withColumns({"_src_host": U.host_of(F.col("_src_url")), "_src_path": U.path_of(F.col("_src_url"))})
    kind = F.coalesce("source_type", U.source_type(F.col("_src_host"), F.col("_src_path")))
    staged = staged.withColumn("_kind", kind)
    handle = F.coalesce("source_handle", F.when(F.col("_kind") == "x_account", F.get(U.path_segments(F.col("_src_path")), F.lit(0))))
    staged = staged.withColumn("_handle", handle)
    return staged.withColumns({
        "from_id": stable_id(F.col("_kind"), F.col("_handle"), F.col("_src_url")),
        "to_id": stable_id(F.lit("candidate"), F.col("canonical_url")),
        "_name": F.coalesce("source_name", "_handle", "_src_host"),
        "_quality": F.coalesce("source_score", F.lit(default_quality)),
    })


def source_nodes(links: DataFrame, seq: str = "seq") -> DataFrame:
    """Graph nodes: one per source (folded over its links) and one per link target."""
    used = ["from_id", "to_id", "_kind", "_name", "_src_url", "_handle", "_quality", "rejection_reason", "discovered_at", "title", "canonical_url", "source_score"]
    staged = cut_lineage(with_source(links).select(*used, F.col(seq).alias(seq)))  # read four times below
    rejected = F.col("rejection_reason").isNotNull()
    rows = staged.select(
        F.col("from_id").alias("id"), F.col("_kind").alias("source_type"), F.col("_name").alias("name"), F.col("_src_url").alias("url"),
        F.col("_handle").alias("handle"), F.col("_quality").alias("quality_score"), F.when(rejected, 0.35).otherwise(0.1).alias("noise_rate"),
        F.lit(75.0).alias("freshness_score"), F.lit(1).cast("long").alias("events_found"), F.lit(0).cast("long").alias("recommended_events"),
        F.col("discovered_at").alias("last_seen"), F.col(seq).alias("seq"))
    labels = first_per_key(rows.select("id", "source_type", "name", "url", "handle", "seq"), ["id"], [F.col("seq")]).drop("seq")
    sources = reputation(rows, ["id"], "seq").join(labels, "id")
    targets = first_per_key(staged.select(
        F.col("to_id").alias("id"), F.lit("organizer_site").alias("source_type"), F.coalesce("title", "canonical_url").alias("name"),
        F.col("canonical_url").alias("url"), F.lit(None).cast("string").alias("handle"), F.coalesce("source_score", F.lit(50.0)).alias("quality_score"),
        F.when(rejected, 0.4).otherwise(0.1).alias("noise_rate"), F.lit(80.0).alias("freshness_score"), F.lit(1).cast("long").alias("events_found"),
        F.lit(0).cast("long").alias("recommended_events"), F.col("discovered_at").alias("last_seen"), F.col(seq).alias("_seq")),
        ["id"], [F.col("_seq")]).drop("_seq")
    return sources.unionByName(targets)


def source_edges(links: DataFrame, run_id: str, as_of: datetime, seq: str = "seq") -> DataFrame:
    """Typed weighted edges source -> link; the last link with the same edge id wins."""
    staged = with_source(links)
    kind = F.when(F.col("platform") == "x", "mentions").otherwise("discovered")
    weight = F.when(F.col("rejection_reason").isNotNull(), F.lit(0.25)).otherwise(
        F.greatest(F.lit(0.4), F.least(F.lit(1.0), F.coalesce("source_score", F.lit(50.0)) / 100)))
    rows = staged.select(
        stable_id(F.lit(run_id), F.col("from_id"), F.col("to_id"), kind, F.col("canonical_url")).alias("id"), F.lit(run_id).alias("run_id"),
        "from_id", "to_id", kind.alias("edge_type"), weight.alias("weight"), F.col("source_url").alias("evidence_url"),
        F.lit(as_of).cast("timestamp").alias("first_seen"), F.lit(as_of).cast("timestamp").alias("last_seen"), F.col(seq).alias("_seq"))
    return first_per_key(rows, ["id"], [F.desc("_seq")]).drop("_seq")
