"""The end-to-end batch: links -> ranked links -> records -> merged -> scored -> picks -> digest."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.coerce import coerce_records
from ..functions.dates import window_reason
from ..functions.rules import Rules
from ..functions.text import stable_id
from ..operators.dedupe import duplicate_groups, group_urls, merge_groups
from ..operators.joins import attribution, links_seen_before
from ..schemas import ALWAYS_SET, RUN_COUNTERS, RUN_LOG
from ..session import cut_lineage
from .digest import render_digests
from .history import for_digest, split_by_history
from .links import extractable, rank_for_extraction
from .scoring import adjust_scores, output_rows, picks, rubric_scores, score_budget


@dataclass
class BatchResult:
    ranked_links: DataFrame
    merged: DataFrame
    window_rejects: DataFrame
    scored: DataFrame
    skipped: DataFrame
    picks: DataFrame
    attribution: DataFrame
    digest: DataFrame
    counters: dict[str, int]


def run_batch(links: DataFrame, raw_records: DataFrame, old_picks: DataFrame, history: DataFrame, rules: Rules, as_of: datetime, run_id: str,
              extract_limit: int | None = None, score_budget_rows: int | None = None, score_percent: float = 100.0, max_picks: int | None = None) -> BatchResult:
    """One batch over landed links and landed raw records.

    ``raw_records`` holds record JSON with the ``link_id`` it was extracted from; extraction
    itself happened upstream. Nothing is left out unless the caller sets a budget: for links
    to extract, for records to score, for picks. Stage counters ride along as observations, so they cost
    no extra pass.
    """
    seen_links = Observation("links")
    watched = links.observe(seen_links, F.count(F.lit(1)).alias("candidates_found"), F.count_if(F.col("status") == "rejected").alias("rejected_candidates"))
    usable = watched.filter(extractable(F.col("status")))
    picked = history.join(old_picks.select(F.col("record_id").alias("id")).distinct(), "id", "left_semi")
    ranked = cut_lineage(rank_for_extraction(usable, links_seen_before(usable, picked)))
    within = F.lit(True) if extract_limit is None else F.col("position") <= extract_limit
    taken = ranked.filter(within).select(F.col("id").alias("link_id"), F.col("position").alias("seq"))

    coerced = coerce_records(raw_records.join(taken, "link_id"))
    seen_records = Observation("records")
    accepted = coerced.filter(F.size("problems") == 0).drop("problems").observe(seen_records, F.count(F.lit(1)).alias("raw_events_extracted"))
    grouped = cut_lineage(duplicate_groups(cut_lineage(accepted)))
    merged = cut_lineage(merge_groups(grouped))
    urls = group_urls(grouped).join(merged.select("group_id", "id"), "group_id").select("id", "url")
    reason = window_reason(F.col("start_at"), as_of)
    windowed = merged.withColumn("window_reason", reason)
    inside = windowed.filter("window_reason is null").drop("window_reason")
    scored = cut_lineage(output_rows(adjust_scores(rubric_scores(inside if score_budget_rows is None else score_budget(inside, score_budget_rows, score_percent), rules), rules)).withColumn("source_urls", F.array("canonical_url")))
    eligible, skipped = split_by_history(scored, old_picks, history, urls)
    best = picks(eligible, rules, as_of, max_picks)
    chosen = best.select(stable_id(F.lit(run_id), F.col("id")).alias("pick_id"), F.lit(run_id).alias("run_id"), F.col("id").alias("record_id"),
                         F.col("score").cast("double").alias("score"), F.coalesce("rationale", F.lit("Picked on its score alone.")).alias("reason"),
                         F.lit(as_of).cast("timestamp").alias("created_at"))
    chosen = cut_lineage(chosen)
    shown = for_digest(eligible, chosen, rules.recommend, rules.review).withColumns({"run_id": F.lit(run_id), "reasons": F.array("rationale")})
    sources = attribution(scored, links, urls.join(scored.select("id"), "id", "left_semi"))
    counters = {**seen_links.get, **seen_records.get, **_sizes(deduped_events_extracted=merged, future_window_events=inside, scoring_attempted=scored,
                                                               recommendations_created=chosen)}
    return BatchResult(ranked, merged, windowed.filter("window_reason is not null"), scored, skipped, chosen, sources,
                       render_digests(shown, rules.recommend, rules.review, as_of), counters)


def _sizes(**frames: DataFrame) -> dict[str, int]:
    """Row counts of already materialised stage tables, in one job."""
    united = None
    for name, df in frames.items():
        part = df.select(F.lit(name).alias("n"))
        united = part if united is None else united.unionByName(part)
    counts = {r["n"]: r["count"] for r in united.groupBy("n").count().collect()}  # one row per stage
    return {name: counts.get(name, 0) for name in frames}


def run_row(spark, run_id: str, started: datetime, finished: datetime, counters: dict[str, int], status: str = "succeeded", error: str | None = None,
            run_type: str = "daily", scan_mode: str = "full", seq: int = 1) -> DataFrame:
    """The run-log row that ends a run; counters that were not set count as zero or stay null if optional."""
    always = {name: 0 for name in RUN_COUNTERS[:ALWAYS_SET]}
    values = {"run_id": run_id, "seq": seq, "run_type": run_type, "started_at": started, "finished_at": finished, "status": status, "error": error,
              "scan_mode": scan_mode, **always, **{k: v for k, v in counters.items() if k in RUN_COUNTERS}}
    return spark.createDataFrame([tuple(values.get(f.name) for f in RUN_LOG)], RUN_LOG)
