"""The source registry: built-in rows minus disabled ones, plus the rules document's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..functions.text import match_text
from ..functions.urls import host_of, path_of
from ..schemas import REGISTRY


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).json(path)


def custom_sources(spark: SparkSession, rules: Rules) -> DataFrame:
    """Sources added in the rules document, with derived id, query text and domains."""
    raw = spark.createDataFrame([
        (s["name"], s["kind"], s.get("priority", "high"), s.get("url"), s.get("feed"), s.get("handle"), s.get("query"))
        for s in rules.added_sources
    ], "name string, kind string, priority string, url string, feed_url string, handle string, query string")
    slug = F.coalesce(F.nullif(F.regexp_replace(match_text(F.col("name")), "[^a-z0-9]+", "-"), F.lit("")), F.lit("source"))
    host = F.regexp_replace(host_of(F.col("url")), "^www\\.", "")
    site = F.concat(host, F.regexp_replace(path_of(F.col("url")), "/+$", ""))
    phrases = " OR ".join(f'"{p}"' for p in rules.phrases[:3])
    handle = F.regexp_replace("handle", "^@", "")
    query = F.coalesce(
        F.col("query"),
        F.when((F.col("kind") == "x_account") & handle.isNotNull(),
               F.concat(F.lit("from:"), handle, F.lit(' (url:lu.ma OR url:luma.com OR "RSVP" OR "event") -is:retweet'))),
        F.when(host.isNotNull(), F.concat(F.lit("site:"), site, F.lit(f' ({phrases} OR "event" OR "RSVP")'))))
    return raw.select(
        F.concat(F.lit("custom-"), slug).alias("id"), "name", "kind", "priority", "url", "feed_url", handle.alias("handle"), query.alias("query_text"),
        F.when(host.isNotNull(), F.array(host)).alias("include_domains"), F.lit(None).cast("double").alias("source_score"),
        F.lit(None).cast("int").alias("max_candidate_links"), F.array(F.lit("custom")).alias("tags"), F.lit("Added in the rules document.").alias("notes"))


def registry_for(built_in: DataFrame, rules: Rules) -> DataFrame:
    """Built-in sources not disabled by id or tag, then the added ones."""
    disabled = [d.lower() for d in rules.disabled_sources]
    kept = built_in
    if disabled:
        off = F.array(*[F.lit(d) for d in disabled])
        kept = built_in.filter(~F.lower("id").isin(disabled) & ~F.coalesce(F.arrays_overlap(F.transform("tags", F.lower), off), F.lit(False)))
    if not rules.added_sources:
        return kept
    return kept.unionByName(custom_sources(built_in.sparkSession, rules), allowMissingColumns=True)


def registry_source_type(kind: Column) -> Column:
    return F.when(kind == "luma_calendar", "luma_calendar").when(kind == "rss_feed", "newsletter").when(kind == "x_account", "x_account") \
        .otherwise("organizer_site")
