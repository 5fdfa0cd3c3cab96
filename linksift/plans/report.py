"""Report bundle: one DataFrame per section, written as report tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import duration_seconds
from ..functions.presentation import action_from_score, score_label, score_tone
from ..functions.rules import Rules
from ..operators import quality, rollups
from ..operators.dedupe import dedupe_sections
from ..operators.joins import enriched_picks
from .history import near_misses, pick_history, suppressed
from .misses import recent_misses

GAPS = {
    "misses": "No missed records are stored, so misses cannot be shown.",
    "links": "No links are stored, so sources and queries cannot be compared.",
    "records": "No records are stored, so organizers cannot be compared.",
    "feedback": "No feedback is stored, so there are no preferences to show.",
}


def build_report(tables: dict[str, DataFrame], rules: Rules, as_of: datetime, daily_cap: int = 150) -> dict[str, DataFrame]:
    """All report sections from the job tables.

    The display run's id is one value, read once; every other step stays a DataFrame.
    """
    runs, links, records, scores, picks = (tables[n] for n in ("runs", "links", "records", "scores", "picks"))
    recent = rollups.newest(rollups.run_counters(runs, links, tables["record_sources"], scores, picks), 20, "started_at", "run_id")
    shown = rollups.display_run(recent)
    row = shown.select("run_id").first()
    run_id = row[0] if row else None
    run_links = links.filter(F.col("run_id") == run_id) if run_id is not None else links.limit(0)
    recommended = enriched_picks(picks.filter(F.col("run_id") == run_id).orderBy(F.desc("score"), "pick_id").limit(25), records, scores)
    review = near_misses(scores, records, rules.review, rules.recommend, run_id)
    hidden = suppressed(scores, records, picks, rules.recommend, run_id if run_id is not None else "")
    skips = shown.filter(~F.coalesce(F.col("x_enabled"), F.lit(False)) | (F.coalesce("x_budget_remaining", F.lit(0)) <= 0))
    summary = rollups.feedback_summary(tables["feedback"])
    sections = {
        "runs": recent.withColumns({"seconds": duration_seconds(F.col("started_at"), F.col("finished_at"), F.col("status")),
                                    "is_stuck": rollups.stuck(F.col("status"), F.col("started_at"), as_of)}),
        "today": shown, "health": rollups.health(recent, as_of), "funnel": rollups.funnel(recent),
        "budget": rollups.budget_by_day(runs, daily_cap),
        "picks": dress(recommended, rules), "history": pick_history(picks, records, scores), "suppressed": hidden, "review": review,
        "link_counts": rollups.count_by(run_links, "status"),
        "rejections": rollups.rejection_summary(run_links.withColumn("seq", F.col("id")), "seq", review, skips),
        "sources": rollups.source_performance(links, tables["record_sources"], picks).withColumn("action", rollups.source_action()),
        "organizers": rollups.organizer_performance(records, scores, picks), "feedback": summary,
        "taste": rollups.taste_signals(tables["feedback"], records), "misses": recent_misses(tables["misses"]),
        "gaps": rollups.data_gaps({n: tables[n] for n in GAPS}, GAPS),
    }
    return sections


def dress(picks: DataFrame, rules: Rules) -> DataFrame:
    """Add the badge tone, label and action of a score."""
    return picks.withColumns({
        "tone": score_tone(F.col("score"), rules.recommend, rules.review), "label": score_label(F.col("score"), rules.recommend, rules.review),
        "suggested_action": action_from_score(F.col("score"), rules.recommend)})


def across_sections(picked: DataFrame, review: DataFrame, hidden: DataFrame) -> DataFrame:
    """Picks, then near misses, then suppressed rows, one row per real-world record."""
    tagged = [df.withColumns({"section": F.lit(n), "section_rank": F.lit(i)}) for i, (n, df) in enumerate((("picks", picked), ("review", review), ("suppressed", hidden)))]
    return dedupe_sections(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]))


def write_report(sections: dict[str, DataFrame], root: str) -> None:
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


__all__ = ["build_report", "across_sections", "write_report", "quality"]
