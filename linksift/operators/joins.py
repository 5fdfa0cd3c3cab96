"""Enrichment, lateral, attribution and containment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import history_text, plain_title
from ..functions.urls import shared_url
from .containment import MIN_TITLE, contained_titles
from .ranking import first_per_key, latest_per_key

GENERIC_TITLE = "(?i)^(public source link from|public source retained|public source fetch failed|luma public surface)"


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_per_key(scores, ["record_id"], "created_at", "seq")


def enriched_picks(picks: DataFrame, records: DataFrame, scores: DataFrame) -> DataFrame:
    """Picks with their record and newest score; picks without either are kept."""
    latest = latest_scores(scores)
    latest = latest.select("record_id", *[F.col(c).alias(f"latest_{c}") for c in latest.columns if c != "record_id"])
    taken = set(picks.columns)
    named = records.select(F.col("id").alias("record_id"), *[
        F.col(c).alias(f"record_{c}" if c in taken else c) for c in records.columns if c != "id"])
    return picks.join(named, "record_id", "left").join(latest, "record_id", "left")


def previous_pick(records: DataFrame, picks: DataFrame, run_id: Column, url: str = "canonical_url", title: str = "title",
                  picked: DataFrame | None = None) -> DataFrame:
    """Per record, the newest pick of another run whose record shares the url or the lower-case title.

    ``picked`` holds the records behind the picks when they are not ``records`` themselves.

    The OR is split into two equi joins. Each side first keeps the newest two picks per key
    and run-distinctness, so a title shared by a third of all picks joins to two rows, not
    to every pick.
    """
    source = records if picked is None else picked
    keyed = source.select(F.col("id"), F.lower(title).alias("_title"), F.col(url).alias("_url"))
    chosen = picks.select("pick_id", "run_id", "record_id", "score", "reason", "created_at").join(
        keyed.withColumnRenamed("id", "record_id"), "record_id")
    wanted = records.select(F.col("id"), F.col(url).alias("_url"), F.lower(title).alias("_title"), run_id.alias("_run"))

    def newest_two_runs(key: str) -> DataFrame:
        order = [F.desc("created_at"), F.desc("pick_id")]
        per_run = first_per_key(chosen.filter(F.col(key).isNotNull()), [key, "run_id"], order)
        return first_per_key(per_run, [key], order, n=2).select(
            key, F.struct("created_at", "pick_id", "run_id", "record_id", "score", "reason").alias("_p"))

    hits = None
    for key in ("_url", "_title"):
        part = wanted.join(newest_two_runs(key), key).filter(F.col("_p.run_id") != F.col("_run")).select("id", "_p")
        hits = part if hits is None else hits.unionByName(part)
    best = hits.groupBy("id").agg(F.max("_p").alias("_p"))
    return best.select("id", F.col("_p.pick_id").alias("previous_pick_id"), F.col("_p.run_id").alias("previous_run_id"),
                       F.col("_p.record_id").alias("previous_record_id"), F.col("_p.score").alias("previous_score"),
                       F.col("_p.created_at").alias("previous_created_at"))


def attribution(records: DataFrame, links: DataFrame, more_urls: DataFrame | None = None) -> DataFrame:
    """(record_id, link_id, platform): every link whose url equals one of the record's urls (form B).

    ``more_urls`` adds (id, url) rows for records whose urls are kept in long form.
    """
    def named(url: Column) -> Column:
        return F.coalesce(url != "", F.lit(False))

    def urls(df: DataFrame, id_col: str, forms: Column, *keep: str) -> DataFrame:
        return df.select(F.col("id").alias(id_col), *keep, F.explode(F.array_distinct(forms)).alias("_url"))

    def own_forms(*columns: str) -> Column:
        """Forms of some columns, written out one by one: Spark compiles them, a lambda over an array it interprets."""
        return F.array_compact(F.array(*[F.when(named(F.col(c)), shared_url(F.col(c))) for c in columns]))

    listed = F.transform(F.filter(F.coalesce("source_urls", F.array().cast("array<string>")), named), shared_url)
    rec = urls(records, "record_id", F.concat(own_forms("canonical_url"), listed))
    if more_urls is not None:
        rec = rec.unionByName(more_urls.select(F.col("id").alias("record_id"), shared_url(F.col("url")).alias("_url")))
    lnk = urls(links, "link_id", own_forms("canonical_url", "url"), "platform")
    return rec.join(lnk, "_url").groupBy("record_id", "link_id").agg(F.min("platform").alias("platform"))


def links_seen_before(links: DataFrame, picked: DataFrame) -> DataFrame:
    """Ids of links that match a picked record: same url, same specific title, or title inside the snippet.

    Containment runs without a cross join, see ``contained_titles``.
    """
    lnk = links.select(
        "id", F.array_distinct(F.transform(F.filter(F.array("canonical_url", "url", "source_url"),
                                                    lambda u: F.coalesce(u != "", F.lit(False))), shared_url)).alias("_urls"),
        history_text(F.col("title")).alias("_title"), history_text(F.col("snippet")).alias("_snippet"),
        F.coalesce(F.col("title").rlike(GENERIC_TITLE), F.lit(False)).alias("_generic"))
    rec_urls = picked.select(F.explode(F.transform(
        F.filter(F.concat(F.array("canonical_url"), F.coalesce("source_urls", F.array().cast("array<string>"))),
                 lambda u: F.coalesce(u != "", F.lit(False))), shared_url)).alias("_url")).distinct()
    by_url = lnk.select("id", F.explode("_urls").alias("_url")).join(rec_urls, "_url", "left_semi").select("id")
    titles = picked.select(history_text(F.col("title")).alias("_picked")).filter(F.length("_picked") >= MIN_TITLE).distinct()
    by_title = (lnk.filter((F.length("_title") >= MIN_TITLE) & ~F.col("_generic"))
                .join(titles, F.col("_title") == F.col("_picked"), "left_semi").select("id"))
    return by_url.unionByName(by_title).unionByName(
        contained_titles(lnk, "id", "_snippet", titles, "_picked").select("id")).distinct()


def title_name(title: Column) -> Column:
    """A 128-bit name of a plain title: what joins and shuffles carry in place of the text."""
    return F.unhex(F.md5(plain_title(title).cast("binary")))


def unknown_titles(found: DataFrame, known: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose plain title is not among the known titles; they are compared by ``title_name``. A null title is unknown."""
    name = "_title_name"
    return found.withColumn(name, title_name(F.col(title))).join(known.select(title_name(F.col(title)).alias(name)).distinct(), name, "left_anti").drop(name)
