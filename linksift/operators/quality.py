"""Run quality: coverage rates, flags, and link quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import round_half_up
from .rollups import score_summary


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percent_text(rate: Column) -> Column:
    return F.concat(round_half_up(rate * 100).cast("long").cast("string"), F.lit("%"))


def quality_summary(links: DataFrame, extractable: DataFrame, records: DataFrame, picks: DataFrame) -> DataFrame:
    """One row of counts and rates. ``extractable`` holds the links kept before per-url dedupe."""
    l = links.agg(F.count(F.lit(1)).alias("candidates_found"), F.countDistinct("canonical_url").alias("unique_urls"),
                  F.count_if(F.col("status") == "rejected").alias("rejected"), F.countDistinct(F.nullif(F.col("source_query"), F.lit(""))).alias("unique_queries"))
    e = extractable.agg(F.count(F.lit(1)).alias("extractable"), F.countDistinct("canonical_url").alias("extractable_unique"))
    r = records.agg(F.count(F.lit(1)).alias("records"))
    p = picks.agg(F.count(F.lit(1)).alias("picks"))
    one = l.crossJoin(e).crossJoin(r).crossJoin(p)  # four one-row tables
    return one.withColumns({
        "unique_url_rate": ratio(F.col("unique_urls"), F.col("candidates_found")),
        "rejection_rate": ratio(F.col("rejected"), F.col("candidates_found")),
        "duplicate_rate": ratio(F.col("extractable") - F.col("extractable_unique"), F.col("extractable")),
        "extraction_yield": ratio(F.col("records"), F.col("extractable_unique")),
        "recommendation_rate": ratio(F.col("picks"), F.greatest(F.lit(1), F.col("records"))),
    })


def quality_flags(summary: DataFrame, agent_percent: Column, agent_links: Column) -> DataFrame:
    """Flags of a quality summary row, one per row, in the reference's order."""
    tests = [
        (F.col("candidates_found") < 20, "low_candidate_volume"), (F.col("rejection_rate") > 0.5, "high_candidate_rejection_rate"),
        (F.col("unique_url_rate") < 0.55, "high_duplicate_url_rate"), (F.col("duplicate_rate") > 0.5, "high_pre_extraction_duplicate_rate"),
        (F.col("extraction_yield") < 0.35, "low_extraction_yield"), (F.col("recommendation_rate") < 0.1, "low_recommendation_yield"),
        (agent_percent < 40, "agent_exploration_under_target"), ((agent_links == 0) & (agent_percent > 0), "agent_queries_returned_no_candidates"),
    ]
    return summary.select(F.posexplode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))).alias("position", "flag"))


def link_quality(links: DataFrame) -> DataFrame:
    """Score distribution of links, and their intent mix in long form: (measure, key, value)."""
    scored = links.withColumn("_s", F.coalesce("source_score", F.lit(0.0)))
    summary = score_summary(scored, "_s").select(F.expr(
        "stack(4, 'count', cast(count as double), 'top', max, 'median', p50, 'bottom', min) as (key, value)")).withColumn("measure", F.lit("score"))
    mix = links.groupBy(F.col("intent").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("measure", F.lit("intent"))
    return summary.unionByName(mix).select("measure", "key", "value")


def counts_long(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(dimension, key, count) for several count-by reports over different tables."""
    out = None
    for name, (df, key) in parts.items():
        part = df.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("count")).withColumn("dimension", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("dimension", "key", "count")


def query_group_counts(links: DataFrame, queries: DataFrame) -> DataFrame:
    """Links per query group; links of an unknown query count under their platform."""
    groups = queries.groupBy(F.col("query_text").alias("source_query")).agg(F.max("query_group").alias("query_group"))
    joined = links.select("source_query", "platform").groupBy("source_query", "platform").agg(F.count(F.lit(1)).alias("n")).join(groups, "source_query", "left")
    return joined.groupBy(F.coalesce("query_group", "platform", F.lit("unknown")).alias("query_group")).agg(F.sum("n").alias("count"))
