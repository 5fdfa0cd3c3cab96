"""Report rollups, run health, quality and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, quality, ranking, rollups, sketches
from ..session import scratch_path
from ..sources.tables import list_rows
from . import query
from . import views as V

C = F.col

_PERF = """c AS (SELECT coalesce(nullif(source_query, ''), platform) AS label, platform, count(*) AS candidate_count, count(*) FILTER (status IN ('rejected', 'error')) AS noise_count FROM v_lines GROUP BY 1, 2),
  e AS (SELECT coalesce(nullif(source_query, ''), l.platform) AS label, l.platform, count(DISTINCT l.record_id) AS event_count, count(DISTINCT p.pick_id) AS recommendation_count FROM v_lines l LEFT JOIN v_picks p ON p.record_id = l.record_id GROUP BY 1, 2),
  perf AS (SELECT label, platform, candidate_count, coalesce(event_count, 0) AS event_count, coalesce(recommendation_count, 0) AS recommendation_count, noise_count FROM c LEFT JOIN e USING (label, platform))"""
_PERF_CTES = (V.V_RECORDS, V.V_PICKS, V.V_LINES, _PERF)


def _performance(spark, sf, limit):
    return rollups.source_performance(V.v_lines(spark, sf), V.v_record_sources(spark, sf), V.v_picks(spark, sf), limit)


@query("source_performance", V.with_ctes(*_PERF_CTES, select="SELECT * FROM perf ORDER BY candidate_count DESC, label, platform LIMIT 12"))
def source_performance(spark, sf):
    return _performance(spark, sf, 12)


@query("source_performance_all", V.with_ctes(*_PERF_CTES, select="SELECT * FROM perf"))
def source_performance_all(spark, sf):
    return _performance(spark, sf, None)


@query("source_actions", V.with_ctes(*_PERF_CTES, select="""SELECT label, CASE WHEN recommendation_count >= 2 OR recommendation_count / candidate_count >= 0.15 THEN 'Keep or promote' WHEN noise_count / candidate_count >= 0.5 AND candidate_count >= 5 THEN 'Demote or rewrite'
  WHEN event_count = 0 AND candidate_count >= 5 THEN 'Inspect examples' ELSE 'Monitor' END AS action FROM (SELECT label, candidate_count, event_count, CASE WHEN length(label) % 2 = 0 THEN recommendation_count ELSE 0 END AS recommendation_count, noise_count FROM perf)"""))
def source_actions(spark, sf):
    perf = _performance(spark, sf, None).withColumn("recommendation_count", F.when(F.length("label") % 2 == 0, C("recommendation_count")).otherwise(0))
    return perf.select("label", rollups.source_action().alias("action"))


_ORG = """o AS (SELECT DISTINCT id, unnest([host, organizer]) AS organizer FROM v_records), s AS (SELECT record_id, total FROM v_scores QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY created_at DESC, seq DESC) = 1),
  org AS (SELECT organizer, count(*) AS event_count, CAST(sum(coalesce(n, 0)) AS BIGINT) AS recommendation_count, max(coalesce(total, 0)) AS max_score, floor(avg(coalesce(total, 0)) * 10 + 0.5) / 10 AS avg_score FROM o LEFT JOIN s ON s.record_id = o.id LEFT JOIN (SELECT record_id, count(*) AS n FROM v_picks GROUP BY 1) p ON p.record_id = o.id GROUP BY organizer)"""


@query("organizer_performance", V.with_ctes(V.V_RECORDS, V.V_PICKS, V.V_SCORES, _ORG, select="SELECT * FROM org ORDER BY max_score DESC, event_count DESC, organizer LIMIT 15"))
def organizer_performance(spark, sf):
    return rollups.organizer_performance(V.v_records(spark, sf), V.v_scores(spark, sf), V.v_picks(spark, sf))


@query("organizer_performance_all", V.with_ctes(V.V_RECORDS, V.V_PICKS, V.V_SCORES, _ORG, select="SELECT organizer, event_count, recommendation_count, max_score FROM org"))
def organizer_performance_all(spark, sf):
    return rollups.organizer_performance(V.v_records(spark, sf), V.v_scores(spark, sf), V.v_picks(spark, sf), None).select("organizer", "event_count", "recommendation_count", "max_score")


@query("feedback_summary", V.with_ctes(V.V_FEEDBACK, select="SELECT feedback_type, count(*) AS count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest_at FROM v_feedback GROUP BY 1 ORDER BY 2 DESC, max(created_at) DESC LIMIT 12"))
def feedback_summary(spark, sf):
    return rollups.feedback_summary(V.v_feedback(spark, sf)).withColumn("latest_at", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss"))


_FJ = "SELECT f.feedback_type, r.host, r.organizer, r.event_type FROM v_feedback f JOIN v_records r ON r.id = f.record_id"


@query("taste_signals", V.with_ctes(V.V_RECORDS, V.V_FEEDBACK, f"fj AS ({_FJ})", select="""SELECT * FROM (SELECT 'liked_organizer' AS signal, name, count(*) AS count FROM (SELECT unnest([host, organizer]) AS name FROM fj WHERE feedback_type IN ('good','very_my_type','want_intro')) GROUP BY name ORDER BY count DESC, name LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'disliked_type', event_type, count(*) AS c FROM fj WHERE feedback_type IN ('bad','too_generic','too_far','not_relevant') GROUP BY event_type ORDER BY c DESC, event_type LIMIT 1) UNION ALL SELECT 'captured', NULL, count(*) FROM v_feedback"""))
def taste_signals(spark, sf):
    return rollups.taste_signals(V.v_feedback(spark, sf), V.v_records(spark, sf)).select("signal", "name", "count")


@query("taste_from_summary", V.with_ctes(V.V_FEEDBACK, select="SELECT count(*) || ' feedback items captured.' AS text FROM v_feedback UNION ALL (SELECT 'Most common signal: ' || replace(feedback_type, '_', ' ') || ' (' || count(*) || ').' FROM v_feedback GROUP BY feedback_type ORDER BY count(*) DESC, max(created_at) DESC LIMIT 1)"))
def taste_from_summary(spark, sf):
    return rollups.taste_from_summary(rollups.feedback_summary(V.v_feedback(spark, sf))).select("text")


def month_runs(spark, sf):
    """Order months as runs with stored counters."""
    return V.v_records(spark, sf).groupBy("run_id").agg(F.min("start_at").alias("started_at"), (F.count(F.lit(1)) * 2).alias("candidates_found"), (F.count(F.lit(1)) / 3).cast("long").alias("events_extracted"),
                                                        F.lit(0).cast("long").alias("scores_created"), F.lit(7).cast("long").alias("recommendations_created"), F.lit(100).cast("long").alias("rejected_candidates"))


@query("run_counters", V.with_ctes(V.V_RECORDS, V.V_PICKS, V.V_LINES, """mr AS (SELECT run_id, count(*) * 2 AS cf, CAST(floor(count(*) / 3) AS BIGINT) AS ee, 0 AS sc, 7 AS rc, 100 AS rj FROM v_records GROUP BY run_id)""", select="""SELECT run_id, greatest(cf, coalesce(l.n, 0)) AS candidates_found,
  greatest(ee, coalesce(l.recs, 0), coalesce(s.n, 0)) AS events_extracted, greatest(sc, coalesce(s.n, 0)) AS scores_created, greatest(rc, coalesce(p.n, 0)) AS recommendations_created, greatest(rj, coalesce(l.rej, 0)) AS rejected_candidates
  FROM mr LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'rejected') AS rej, count(DISTINCT record_id) AS recs FROM v_lines GROUP BY 1) l USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS n FROM v_records GROUP BY 1) s USING (run_id)
  LEFT JOIN (SELECT run_id, count(*) AS n FROM v_picks GROUP BY 1) p USING (run_id)"""))
def run_counters(spark, sf):
    out = rollups.run_counters(month_runs(spark, sf), V.v_lines(spark, sf), V.v_record_sources(spark, sf), V.v_records(spark, sf).select("run_id"), V.v_picks(spark, sf))
    return out.drop("started_at")


def _sql_category(v: str) -> str:
    n, t = f"lower({v})", f"regexp_replace(lower({v}), '[^a-z0-9]+', '_', 'g')"

    def has(*parts):
        return "(" + " OR ".join(f"contains({n}, '{p}')" for p in parts) + ")"

    return (f"CASE WHEN contains({t}, 'past_event') OR {has('past event')} THEN 'past_event' WHEN contains({t}, 'time_sink') OR {has('hackathon', 'buildathon', 'hack night', 'low networking')} THEN 'time_sink' "
            f"WHEN {has('online', 'webinar', 'virtual')} THEN 'online_only' WHEN starts_with({t}, 'excluded_') OR starts_with({t}, 'eligibility_gate') OR starts_with({t}, 'user_mismatch') THEN 'profile_mismatch' "
            f"WHEN contains({t}, 'junk') THEN 'generic_networking' WHEN contains({t}, 'missing_date') OR contains({t}, 'invalid_date') OR {has('date missing', 'no date', 'date not confirmed', 'unclear date')} THEN 'missing_date' "
            f"WHEN {has('outside', 'not bay', 'remote')} THEN 'outside_bay' WHEN {has('sold out', 'closed', 'waitlist')} THEN 'sold_out_closed' WHEN {has('generic', 'networking', 'vendor')} THEN 'generic_networking' "
            f"WHEN {has('score', 'low')} THEN 'low_score' WHEN {has('budget', 'schedule', 'skip')} THEN 'schedule_budget' ELSE 'other' END")


_ORDER = "[" + ", ".join(f"'{k}'" for k, _ in rollups.REJECTION_ORDER) + "]"


@query("rejection_summary", V.with_ctes(V.V_RECORDS, V.V_LINES, f"cat AS (SELECT *, {_sql_category('rejection_reason')} AS key FROM v_lines WHERE status IN ('rejected', 'error'))", select=f"""SELECT CAST(list_position({_ORDER}, key) - 1 AS INT) AS display_order, key, CAST(sum(n) AS BIGINT) AS count, max(ex) AS examples
  FROM (SELECT key, count(*) AS n, array_to_string(list(id ORDER BY discovered_at DESC, id)[1:8], ' ') AS ex FROM cat GROUP BY key UNION ALL SELECT 'low_score', count(*), NULL FROM v_records WHERE score >= 65 AND score < 80) GROUP BY key"""))
def rejection_summary(spark, sf):
    near = V.v_records(spark, sf).filter("score >= 65 and score < 80")
    lines = V.v_lines(spark, sf).withColumn("seq", F.struct((-F.unix_date(C("discovered_at").cast("date"))).alias("d"), C("id").alias("i")))
    return rollups.rejection_summary(lines, "seq", near).select("display_order", "key", "count", F.array_join("examples", " ").alias("examples"))


@query("status_counts", V.with_ctes(V.V_LINES, select="SELECT status, count(*) AS count FROM v_lines GROUP BY 1"))
def status_counts(spark, sf):
    return rollups.count_by(V.v_lines(spark, sf), "status")


@query("top_rejection_reasons", V.with_ctes(V.V_LINES, select="SELECT rejection_reason, count(*) AS count FROM v_lines WHERE rejection_reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"))
def top_rejection_reasons(spark, sf):
    return rollups.top_counts(V.v_lines(spark, sf).filter("rejection_reason is not null"), "rejection_reason", 8)


@query("counts_long", V.with_ctes(V.V_RECORDS, V.V_LINES, select="SELECT 'city' AS dimension, city AS key, count(*) AS count FROM v_records GROUP BY 2 UNION ALL SELECT 'registration', registration_status, count(*) FROM v_records GROUP BY 2 UNION ALL SELECT 'platform', platform, count(*) FROM v_lines GROUP BY 2 UNION ALL SELECT 'reason', coalesce(rejection_reason, 'unknown'), count(*) FROM v_lines GROUP BY 2"))
def counts_long(spark, sf):
    r, lines = V.v_records(spark, sf), V.v_lines(spark, sf)
    return quality.counts_long({"city": (r, C("city")), "registration": (r, C("registration_status")), "platform": (lines, C("platform")), "reason": (lines, C("rejection_reason"))})


_QUAL = """q AS (SELECT *, unique_urls / candidates_found AS unique_url_rate, rejected / candidates_found AS rejection_rate, (extractable - extractable_unique) / extractable AS duplicate_rate, records / extractable_unique AS extraction_yield, picks / greatest(1, records) AS recommendation_rate FROM
  (SELECT count(*) AS candidates_found, count(DISTINCT canonical_url) AS unique_urls, count(*) FILTER (status = 'rejected') AS rejected, count(DISTINCT source_query) AS unique_queries, count(*) FILTER (status = 'new') AS extractable, count(DISTINCT canonical_url) FILTER (status = 'new') AS extractable_unique FROM v_lines),
  (SELECT count(*) AS records FROM v_records), (SELECT count(*) AS picks FROM v_picks))"""


def _quality(spark, sf):
    lines = V.v_lines(spark, sf)
    return quality.quality_summary(lines, lines.filter("status = 'new'"), V.v_records(spark, sf), V.v_picks(spark, sf))


@query("quality_summary", V.with_ctes(V.V_RECORDS, V.V_PICKS, V.V_LINES, _QUAL, select="SELECT * FROM q"))
def quality_summary(spark, sf):
    return _quality(spark, sf)


@query("quality_flags", V.with_ctes(V.V_RECORDS, V.V_PICKS, V.V_LINES, _QUAL, select="""SELECT flag FROM (SELECT unnest([CASE WHEN candidates_found < 20 THEN 'low_candidate_volume' END, CASE WHEN rejection_rate > 0.5 THEN 'high_candidate_rejection_rate' END, CASE WHEN unique_url_rate < 0.55 THEN 'high_duplicate_url_rate' END,
  CASE WHEN duplicate_rate > 0.5 THEN 'high_pre_extraction_duplicate_rate' END, CASE WHEN extraction_yield < 0.35 THEN 'low_extraction_yield' END, CASE WHEN recommendation_rate < 0.1 THEN 'low_recommendation_yield' END, 'agent_exploration_under_target', 'agent_queries_returned_no_candidates']) AS flag FROM q) WHERE flag IS NOT NULL"""))
def quality_flags(spark, sf):
    return quality.quality_flags(_quality(spark, sf), F.lit(30), F.lit(0)).select("flag")


@query("score_summary", V.with_ctes(V.V_RECORDS, select="SELECT city, count(*) AS count, min(score) AS min, list_sort(list(score))[CAST(floor(count(*) / 2) AS INT) + 1] AS p50, max(score) AS max, floor(avg(score) * 10 + 0.5) / 10 AS avg FROM v_records GROUP BY city"))
def score_summary(spark, sf):
    return rollups.score_summary(V.v_records(spark, sf), "score", "city")


@query("score_summary_all", V.with_ctes(V.V_SCORES, select="SELECT count(*) AS count, min(total) AS min, list_sort(list(total))[CAST(floor(count(*) / 2) AS INT) + 1] AS p50, max(total) AS max FROM v_scores"))
def score_summary_all(spark, sf):
    return rollups.score_summary(V.v_scores(spark, sf), "total").drop("avg")


@query("daily_budget", V.with_ctes(V.V_RUNS, select="SELECT strftime((started_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS local_day, CAST(sum(x_posts_read) AS BIGINT) AS used, CAST(greatest(0, 150 - sum(x_posts_read)) AS BIGINT) AS remaining FROM v_runs GROUP BY 1"))
def daily_budget(spark, sf):
    return rollups.budget_by_day(V.v_runs(spark, sf), 150).withColumn("local_day", F.date_format("local_day", "yyyy-MM-dd"))


@query("organizer_signals", V.with_ctes(V.V_RECORDS, V.V_PICKS, select="""SELECT lower(name) AS organizer_key, count(DISTINCT r) AS event_count, count(*) AS recommendation_count, max(score) AS max_score FROM (SELECT p.score, r.id AS r, unnest([host, organizer]) AS name FROM v_picks p JOIN v_records r ON r.id = p.record_id) WHERE length(name) BETWEEN 4 AND 80 GROUP BY 1"""))
def organizer_signals(spark, sf):
    return rollups.organizer_signals(V.v_picks(spark, sf), V.v_records(spark, sf), None).drop("organizer")


@query("useful_organizers", """SELECT n, n NOT IN ('luma', 'abc') AND NOT regexp_matches(n, '^[0-9]+$') AND (contains(n, ' ') OR regexp_matches(n, '(?i)\\b(ai|vc|labs?|club|community|founders?|ventures?|capital|studio|commons|robotics|mechanics|cloud|school|cafe|tower|fund|alliance|tinkerers)\\b')) AS useful FROM (
  SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'luma' WHEN 1 THEN c_name || ' Labs' WHEN 2 THEN c_name WHEN 3 THEN CAST(c_custkey + 10000 AS VARCHAR) ELSE lower(c_mktsegment) || '-club' END AS n FROM customer)""")
def useful_organizers(spark, sf):
    k = C("c_custkey") % 5
    n = F.when(k == 0, "luma").when(k == 1, F.concat("c_name", F.lit(" Labs"))).when(k == 2, C("c_name")).when(k == 3, (C("c_custkey") + 10000).cast("string")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("-club")))
    return V.table(spark, sf, "customer").select(n.alias("n")).distinct().select("n", rollups.useful_organizer(C("n")).alias("useful"))


def event_queries(spark, sf):
    """Events as an executed-query log."""
    connector = F.when(C("event_type").isin("view", "click"), "exa").when(C("event_type") == "error", "x").when(C("event_type") == "signup", "rss").otherwise("public_source")
    return V.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), connector.alias("connector"), connector.alias("platform"), F.when(C("event_type") == "click", "agent_exploration").otherwise("static").alias("query_group"),
                                               F.when(C("event_type") == "click", "agent_exploration").otherwise("static").alias("query_type"))


@query("query_mix", """SELECT *, CAST(floor(agent_exa_queries / exa_queries * 100 + 0.5) AS BIGINT) AS agent_exa_percent FROM (SELECT count(*) AS total_queries, count(*) FILTER (event_type IN ('view','click')) AS exa_queries, count(*) FILTER (event_type = 'click') AS agent_exa_queries, count(*) FILTER (event_type = 'error') AS x_queries,
  count(*) FILTER (event_type = 'purchase') AS public_source_queries, count(*) FILTER (event_type = 'signup') AS rss_queries FROM events)""")
def query_mix(spark, sf):
    return rollups.query_mix(event_queries(spark, sf))


@query("query_log_counts", "SELECT strftime(ts, '%Y-%m-%d') AS run_id, CASE WHEN event_type = 'click' THEN 'agent_exploration' ELSE 'static' END AS query_type, CASE WHEN event_type IN ('view','click') THEN 'exa' WHEN event_type = 'error' THEN 'x' WHEN event_type = 'signup' THEN 'rss' ELSE 'public_source' END AS platform, count(*) AS count FROM events GROUP BY 1, 2, 3")
def query_log_counts(spark, sf):
    return rollups.query_log_counts(event_queries(spark, sf))


@query("planner_history", V.with_ctes(V.V_RECORDS, V.V_PICKS, V.V_LINES, select="SELECT * FROM (SELECT count(*) AS recent_candidates, count(DISTINCT source_query) AS recent_candidate_queries, count(*) FILTER (status = 'rejected') AS recent_rejected_candidates FROM v_lines), (SELECT count(*) AS recent_events FROM v_records), (SELECT count(*) AS recent_recommendations FROM v_picks)"))
def planner_history(spark, sf):
    return rollups.planner_history(V.v_lines(spark, sf), V.v_records(spark, sf), V.v_picks(spark, sf))


@query("ordered_lines", "SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ' ') AS parts FROM lineitem GROUP BY l_orderkey")
def ordered_lines(spark, sf):
    rows = rollups.ordered_values(V.table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber"], "l_partkey", "parts")
    return rows.select("l_orderkey", F.array_join(F.transform("parts", lambda p: p.cast("string")), " ").alias("parts"))


@query("distinct_counts", V.with_ctes(V.V_LINES, select="SELECT platform, count(DISTINCT canonical_url) AS urls, count(DISTINCT source_query) AS queries, count(DISTINCT lower(title)) AS titles FROM v_lines GROUP BY platform"))
def distinct_counts(spark, sf):
    return rollups.distinct_counts(V.v_lines(spark, sf), ["platform"], {"urls": C("canonical_url"), "queries": C("source_query"), "titles": F.lower("title")})


@query("sketched_events", "SELECT event_type, count(*) AS n, true AS users_near, true AS median_near FROM events GROUP BY event_type")
def sketched_events(spark, sf):
    """Users and median value of each kind of event, from sketches stored by day and merged over days, held against the exact ones: users within 5 %, the median within 3 % of the ranks."""
    events = V.table(spark, sf, "events").select("event_type", "user_id", C("value").cast("double").alias("value"), F.to_date("ts").alias("day"))
    path = scratch_path(spark, "sketches")
    sketches.store_days(sketches.sketched(events, ["day", "event_type"], ["user_id"], ["value"]), path)
    told = sketches.estimated(sketches.merged(sketches.read_days(spark, path), ["event_type"])).select("event_type", "n", "user_id_distinct", C("value_quantiles")[0].alias("median"))
    users = rollups.distinct_counts(events, ["event_type"], {"users": C("user_id")})
    ranks = events.join(F.broadcast(told.select("event_type", "median")), "event_type").groupBy("event_type").agg(  # a row for each kind
        (F.count_if(C("value") < C("median")) / F.count("value")).alias("below"), (F.count_if(C("value") <= C("median")) / F.count("value")).alias("upto"))
    near = F.abs(C("user_id_distinct") - C("users")) <= C("users") * 0.05
    return told.join(users, "event_type").join(ranks, "event_type").select("event_type", "n", near.alias("users_near"), ((C("below") <= 0.53) & (C("upto") >= 0.47)).alias("median_near"))


@query("latest_score", V.with_ctes(V.V_SCORES, select="SELECT record_id, total, seq FROM v_scores QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY created_at DESC, seq DESC) = 1"))
def latest_score(spark, sf):
    return joins.latest_scores(V.v_scores(spark, sf)).select("record_id", "total", "seq")


@query("latest_score_by_ids", V.with_ctes(V.V_RECORDS, V.V_PICKS, V.V_SCORES, select="SELECT record_id, total FROM v_scores WHERE record_id IN (SELECT record_id FROM v_picks) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY created_at DESC, seq DESC) = 1"))
def latest_score_by_ids(spark, sf):
    return joins.latest_scores(joins.by_ids(V.v_scores(spark, sf), V.v_picks(spark, sf), "record_id")).select("record_id", "total")


@query("last_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS position FROM events GROUP BY user_id")
def last_per_key(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return ranking.last_value_first_position(e, ["user_id"], "event_id").select("user_id", "event_type", "position")


@query("display_run", V.with_ctes(V.V_RUNS, select="SELECT run_id, status FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS rn FROM v_runs) ORDER BY CASE WHEN rn = 1 AND status <> 'running' THEN 0 WHEN status <> 'running' THEN 1 WHEN rn = 1 THEN 2 ELSE 3 END, started_at DESC LIMIT 1"))
def display_run(spark, sf):
    return rollups.display_run(V.v_runs(spark, sf)).select("run_id", "status")


_KEPT = "k AS (SELECT run_id FROM v_runs ORDER BY started_at DESC, run_id DESC LIMIT 30)"


@query("retention", V.with_ctes(V.V_RUNS, _KEPT, select="SELECT event_id, user_id || ':' || strftime(ts, '%Y-%m-%d') AS run_id FROM events WHERE user_id || ':' || strftime(ts, '%Y-%m-%d') IN (SELECT run_id FROM k)"))
def retention(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("run_id"))
    return rollups.retention(V.v_runs(spark, sf), 30, {"events": e})[1]["events"].select("event_id", "run_id")


@query("newest_feedback", V.with_ctes(V.V_FEEDBACK, select="SELECT id FROM v_feedback ORDER BY created_at DESC, id DESC LIMIT 1000"))
def newest_feedback(spark, sf):
    return rollups.newest(V.v_feedback(spark, sf), 1000, "created_at", "id").select("id")


@query("stuck_runs", V.with_ctes(V.V_RUNS, select="SELECT run_id FROM v_runs WHERE status = 'running' AND started_at < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 2 HOUR"))
def stuck_runs(spark, sf):
    import datetime

    r = V.v_runs(spark, sf)
    return r.filter(rollups.stuck(C("status"), C("started_at"), datetime.datetime(2024, 1, 15, 12))).select("run_id")


@query("health_status", V.with_ctes(V.V_RUNS, "l AS (SELECT * FROM v_runs ORDER BY started_at DESC, run_id DESC LIMIT 1)", select="""SELECT run_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-31' - INTERVAL 2 HOUR THEN 'failing' WHEN status = 'failed' THEN 'failing'
  WHEN coalesce((SELECT max(started_at) FROM v_runs WHERE status = 'succeeded'), TIMESTAMP '1900-01-01') < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR THEN 'warning' ELSE 'healthy' END AS status FROM l"""))
def health_status(spark, sf):
    import datetime

    return rollups.health(V.v_runs(spark, sf), datetime.datetime(2024, 1, 31)).select("run_id", "status")


@query("run_funnel", V.with_ctes(V.V_RUNS, select="""SELECT run_id, candidates_found AS links, events_extracted AS records, recommendations_created AS picks, candidates_found - events_extracted AS dropped_before_records, events_extracted - recommendations_created AS dropped_before_picks,
  candidates_found || ' candidate' || CASE WHEN candidates_found = 1 THEN '' ELSE 's' END || ' -> ' || events_extracted || ' event' || CASE WHEN events_extracted = 1 THEN '' ELSE 's' END || ' -> ' || recommendations_created || ' recommendation' || CASE WHEN recommendations_created = 1 THEN '' ELSE 's' END AS text FROM v_runs"""))
def run_funnel(spark, sf):
    return rollups.funnel(V.v_runs(spark, sf))


@query("data_gaps", "SELECT 'none' AS \"table\", '' AS message FROM events WHERE event_type = 'missing' UNION ALL SELECT 'misses', 'no misses' WHERE (SELECT count(*) FROM events WHERE event_type = 'missing') = 0")
def data_gaps(spark, sf):
    e = V.table(spark, sf, "events")
    return rollups.data_gaps({"events": e, "misses": e.filter("event_type = 'missing'")}, {"misses": "no misses", "events": "no events"})


@query("list_rows", V.with_ctes(V.V_LINES, select="SELECT id, status FROM v_lines WHERE run_id = '1998-03' AND status = 'rejected' ORDER BY discovered_at DESC, id LIMIT 100"))
def list_rows_query(spark, sf):
    return list_rows(V.v_lines(spark, sf), "discovered_at", "id", 100, "1998-03", "rejected").select("id", "status")


@query("recent_misses", V.with_ctes(V.V_FEEDBACK, select="SELECT id, record_id FROM v_feedback WHERE feedback_type = 'bad' ORDER BY created_at DESC, id LIMIT 10"))
def recent_misses(spark, sf):
    from ..plans.misses import recent_misses as newest_misses

    return newest_misses(V.v_feedback(spark, sf).filter("feedback_type = 'bad'")).select("id", "record_id")


@query("feedback_rejects", "SELECT event_id, event_type NOT IN ('purchase', 'signup', 'click', 'view') AS rejected FROM events")
def feedback_rejects(spark, sf):
    from ..functions.coerce import FEEDBACK_LABELS

    label = F.create_map(*[F.lit(x) for pair in list(V.LABELS.items())[:4] for x in pair])[C("event_type")]
    return V.table(spark, sf, "events").select("event_id", (~F.coalesce(label.isin(FEEDBACK_LABELS), F.lit(False))).alias("rejected"))
