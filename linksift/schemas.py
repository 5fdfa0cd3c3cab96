"""Fixed schemas; nothing is inferred."""

from pyspark.sql import types as T

_S, _D, _L, _I, _B, _TS = (T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType())
_LIST = T.ArrayType(_S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LINKS = _struct(
    id=_S, run_id=_S, platform=_S, source_url=_S, url=_S, canonical_url=_S, source_query=_S, source_id=_S, title=_S, snippet=_S,
    discovered_at=_TS, evidence=_LIST, status=_S, rejection_reason=_S, source_handle=_S, source_name=_S, source_type=_S, source_score=_D,
)
RECORDS = _struct(
    id=_S, run_id=_S, canonical_url=_S, source_urls=_LIST, title=_S, description=_S, start_raw=_S, start_at=_TS, end_at=_TS, timezone=_S,
    city=_S, venue_text=_S, location_precision=_S, hosts=_LIST, organizers=_LIST, platforms=_LIST, visibility_flags=_LIST,
    registration_status=_S, event_type=_S, confidence=_D, first_seen=_TS, last_seen=_TS,
)
RECORD_SOURCES = _struct(record_id=_S, link_id=_S, platform=_S)
SCORES = _struct(
    record_id=_S, run_id=_S, total=_D, user_fit=_I, room_quality=_I, networking_value=_I, timeliness=_I, location_actionability=_I,
    novelty=_I, evidence_confidence=_I, penalties=_LIST, should_recommend=_B, rationale=_S, next_action=_S, model=_S, rules_name=_S,
    created_at=_TS, seq=_L,
)
PICKS = _struct(pick_id=_S, run_id=_S, record_id=_S, score=_D, reason=_S, created_at=_TS)
FEEDBACK = _struct(id=_S, record_id=_S, feedback_type=_S, note=_S, created_at=_TS)
MISSES = _struct(id=_S, hunt_id=_S, title=_S, url=_S, happened_at=_S, miss_reason=_S, evidence=_LIST, suggestion=_S, created_at=_TS)
HUNTS = _struct(id=_S, run_id=_S, week_start=T.DateType(), week_end=T.DateType(), status=_S, checked=_L, missed=_L, ignored=_L, queries=_L,
                created_at=_TS)
QUERIES = _struct(id=_S, run_id=_S, query_text=_S, query_type=_S, platform=_S, budget_cost=_L, created_at=_TS)
SOURCES = _struct(
    id=_S, source_type=_S, name=_S, url=_S, handle=_S, quality_score=_D, noise_rate=_D, freshness_score=_D, events_found=_L,
    recommended_events=_L, last_seen=_TS,
)
SOURCE_EDGES = _struct(id=_S, run_id=_S, from_id=_S, to_id=_S, edge_type=_S, weight=_D, evidence_url=_S, first_seen=_TS, last_seen=_TS)
# Run counters, always set first, then optional.
RUN_COUNTERS = [
    "candidates_found", "pages_inspected", "events_extracted", "scores_created", "recommendations_created",
    "rejected_candidates", "x_posts_read", "x_budget_remaining",
    "extraction_attempted", "extraction_limit", "raw_events_extracted", "deduped_events_extracted", "future_window_events",
    "scoring_attempted", "scoring_limit",
]
ALWAYS_SET = 8  # the leading counters default to zero
RUN_LOG = T.StructType(
    [T.StructField(n, k) for n, k in (
        ("run_id", _S), ("seq", _L), ("run_type", _S), ("started_at", _TS), ("finished_at", _TS), ("status", _S), ("error", _S),
        ("scan_mode", _S), ("x_enabled", _B))]
    + [T.StructField(n, _L) for n in RUN_COUNTERS]
)
REGISTRY = _struct(
    id=_S, name=_S, kind=_S, priority=_S, url=_S, feed_url=_S, handle=_S, query_text=_S, include_domains=_LIST, source_score=_D,
    max_candidate_links=_I, tags=_LIST, notes=_S,
)
SEARCH_RESPONSE = T.StructType([T.StructField("results", T.ArrayType(_struct(
    id=_S, title=_S, url=_S, publishedDate=_S, author=_S, highlights=_LIST, summary=_S, text=_S)))])
POST_RESPONSE = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("id", _S), T.StructField("text", _S), T.StructField("author_id", _S), T.StructField("created_at", _S),
        T.StructField("entities", T.StructType([T.StructField("urls", T.ArrayType(_struct(expanded_url=_S, unwound_url=_S, url=_S)))])),
    ]))),
    T.StructField("includes", T.StructType([T.StructField("users", T.ArrayType(_struct(id=_S, name=_S, username=_S)))])),
])
TABLES = {
    "links": LINKS, "records": RECORDS, "record_sources": RECORD_SOURCES, "scores": SCORES, "picks": PICKS, "feedback": FEEDBACK,
    "misses": MISSES, "hunts": HUNTS, "queries": QUERIES, "sources": SOURCES, "source_edges": SOURCE_EDGES, "run_log": RUN_LOG,
}
KEYS = {
    "links": ["id"], "records": ["id"], "record_sources": ["record_id", "link_id"], "picks": ["pick_id"], "queries": ["id"],
    "sources": ["id"], "source_edges": ["id"],
}
