"""Records: scoring, dedupe, history, window, digest, misses, rotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as Rl
from ..functions.dates import window_reason
from ..functions.text import DEDUPE_STOP_WORDS, REPORT_STOP_WORDS, html_title, jaccard, overlap
from ..operators import dedupe, joins, ranking, similarity
from ..operators import upsert as ups
from ..plans import digest, history, misses, rotation, scoring
from . import query
from . import views as V

C = F.col
R = V.ORDER_RULES

_TEXT = "t || ' ' || event_type || ' ' || city || ' ' || registration_status || ' ' || host || ' ' || organizer"


@query("record_text", V.with_ctes(V.V_RECORDS, select=f"SELECT id, {_TEXT.replace('t ||', 'title ||', 1)} AS text FROM v_records"))
def record_text(spark, sf):
    r = V.v_records(spark, sf)
    return r.select("id", scoring.record_text(r).alias("text"))


@query("score_components", V.with_ctes(V.V_RECORDS, select="""SELECT id AS record_id, score AS total, least(25, CAST(floor(score * 0.25 + 0.5) AS INT)) AS user_fit, least(20, CAST(floor(score * 0.2 + 0.5) AS INT)) AS room_quality,
  least(15, CAST(floor(score * 0.15 + 0.5) AS INT)) AS networking_value, least(10, CAST(floor(score * 0.1 + 0.5) AS INT)) AS novelty, score >= 60 AS should_recommend, CASE WHEN score >= 60 THEN 'apply' ELSE 'monitor' END AS next_action FROM v_records"""))
def score_components(spark, sf):
    return scoring.score_rows(V.v_records(spark, sf), R).select("record_id", "total", "user_fit", "room_quality", "networking_value", "novelty", "should_recommend", "next_action")



_M = "m"
_FMT, _TOP, _GATE = (V.sql_hit(_M, *k) for k in (R.exclude_formats, R.exclude_topics, R.exclude_eligibility))
_ON = V.sql_hit(_M, *[k for t in R.topics if t.weight >= 0 for k in t.keywords])
_AUD, _LOCAL, _GEN = V.sql_hit(_M, *R.audience), V.sql_hit(_M, *R.local_terms()), V.sql_hit(_M, *R.avoid_formats)
_CUR, _HUB = V.sql_hit(_M, *Rl.CURATION_TERMS, *R.prefer_formats), V.sql_hit(_M, *R.hubs)
_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {V.sql_hit(_M, *t.keywords)} THEN '{t.name}' END" for t in R.topics if t.weight >= 0) + "], lambda x: x IS NOT NULL), ', ')"
V_SCORED = f"""hay AS (SELECT *, {V.sql_match_text(_TEXT.replace('t ||', 'title ||', 1))} AS m FROM v_records),
  flags AS (SELECT *, {_FMT} AS fmt, {_TOP} AS top, {_GATE} AS gate, {_ON} AS on_topic, {_AUD} AS aud, {_CUR} AS cur, {_HUB} AS hub, {_LOCAL} AS loc, {_GEN} AS gen, registration_status = 'closed' AS shut FROM hay),
  f2 AS (SELECT *, (top OR gate) AS mismatch, (top OR gate OR fmt) AS blocked, (on_topic OR aud) AS rel, hub AND (on_topic OR aud) AS hubroom FROM flags),
  comp AS (SELECT *, CASE WHEN mismatch THEN 5 WHEN on_topic THEN 23 WHEN aud THEN 16 ELSE 10 END AS user_fit, CASE WHEN blocked THEN 6 WHEN cur THEN 18 WHEN hubroom THEN 17 ELSE 10 END AS room_quality,
    CASE WHEN blocked THEN 3 WHEN cur AND rel THEN 14 WHEN hubroom THEN 13 WHEN aud THEN 9 ELSE 8 END AS networking_value, 8 AS timeliness, CASE WHEN loc THEN 9 ELSE 5 END AS location_actionability,
    CASE WHEN blocked THEN 3 WHEN cur THEN 8 WHEN hubroom THEN 7 ELSE 4 END AS novelty, CAST(floor(confidence * 10 + 0.5) AS INT) AS evidence_confidence,
    CASE WHEN gen THEN 10 ELSE 0 END + CASE WHEN fmt THEN 30 ELSE 0 END + CASE WHEN top THEN 32 ELSE 0 END + CASE WHEN gate THEN 35 ELSE 0 END + CASE WHEN shut THEN 12 ELSE 0 END AS pts FROM f2),
  tot AS (SELECT *, greatest(0, least(100, user_fit + room_quality + networking_value + timeliness + location_actionability + novelty + evidence_confidence - pts)) AS total FROM comp),
  scored AS (SELECT *, total >= {R.recommend} AND NOT shut AND NOT blocked AS should_recommend,
    CASE WHEN shut THEN 'monitor' WHEN blocked THEN 'skip' WHEN cur THEN 'apply' WHEN total >= {R.recommend} THEN 'rsvp' ELSE 'skip' END AS next_action,
    list_concat(CASE WHEN gen THEN ['generic_large_or_online_format'] ELSE [] END, list_transform({V.sql_hits(_M, R.exclude_formats)}[1:3], lambda k: 'excluded_format:' || k), list_transform({V.sql_hits(_M, R.exclude_topics)}[1:3], lambda k: 'excluded_topic:' || k),
      list_transform({V.sql_hits(_M, R.exclude_eligibility)}[1:3], lambda k: 'eligibility_gate:' || k), CASE WHEN shut THEN ['registration_unavailable'] ELSE [] END) AS penalties,
    CASE WHEN top THEN 'Excluded topic: ' || {V.sql_first_hit(_M, R.exclude_topics)} WHEN gate THEN 'Eligibility gate likely excludes you: ' || {V.sql_first_hit(_M, R.exclude_eligibility)} WHEN fmt THEN 'Excluded format: ' || {V.sql_first_hit(_M, R.exclude_formats)}
      WHEN on_topic THEN 'Matches your topics: ' || {_NAMES} WHEN aud THEN 'Right audience, topic unclear' ELSE 'Weak profile fit' END || '; ' ||
    CASE WHEN cur THEN 'Curated room signal' WHEN hub THEN 'Ecosystem hub signal (' || {V.sql_first_hit(_M, R.hubs)} || ')' ELSE 'Limited curation evidence' END || '; ' || CASE WHEN loc THEN '{R.region} location evidence' ELSE 'Location needs verification' END AS rationale FROM tot)"""
_COMPS = "user_fit, room_quality, networking_value, timeliness, location_actionability, novelty, evidence_confidence"


@query("rubric_score", V.with_ctes(V.V_RECORDS, V_SCORED, select=f"SELECT id, {_COMPS}, total, should_recommend, next_action, rationale, array_to_string(penalties, '|') AS penalties FROM scored"))
def rubric_score(spark, sf):
    return scoring.rubric_scores(V.v_records(spark, sf), R).select("id", *_COMPS.split(", "), "total", "should_recommend", "next_action", "rationale", F.array_join("penalties", "|").alias("penalties"))


_UP, _DOWN = [t for t in R.topics if t.weight > 0], [t for t in R.topics if t.weight < 0]
V_ADJUSTED = f"""adj AS (SELECT *, {' + '.join(f"CASE WHEN {V.sql_hit(_M, *t.keywords)} THEN {t.weight} ELSE 0 END" for t in _UP)} AS raw_up, {' + '.join(f"CASE WHEN {V.sql_hit(_M, *t.keywords)} THEN {-t.weight} ELSE 0 END" for t in _DOWN)} AS raw_down FROM scored),
  bp AS (SELECT *, least(15, floor(CASE WHEN raw_up > 0 AND gen THEN raw_up / 2.0 ELSE raw_up END + 0.5)) AS b, least(25, raw_down) AS p, user_fit + room_quality + networking_value + timeliness + location_actionability + novelty + evidence_confidence AS parts FROM adj),
  cut AS (SELECT *, least(user_fit, ceil(p * 0.45)) AS fc, least(networking_value, ceil(p * 0.3)) AS nc, CASE WHEN abs(parts - total) > 3 THEN greatest(0, least(100, parts - len(penalties) * 3)) ELSE total END AS rec FROM bp),
  adjusted AS (SELECT *, CAST(least(25, user_fit - fc + ceil(b * 0.5)) AS INT) AS fit2, CAST(least(15, networking_value - nc + floor(b * 0.25)) AS INT) AS net2,
    CAST(least(10, novelty - least(novelty, greatest(0, p - fc - nc)) + greatest(0, b - ceil(b * 0.5) - floor(b * 0.25))) AS INT) AS nov2, CAST(greatest(0, least(100, rec - p + b)) AS INT) AS total2 FROM cut)"""


@query("topic_adjusted_score", V.with_ctes(V.V_RECORDS, V_SCORED, V_ADJUSTED, select=f"""SELECT id, fit2 AS user_fit, net2 AS networking_value, nov2 AS novelty, total2 AS total, CAST(b AS INT) AS boost, CAST(p AS INT) AS penalty, should_recommend AND total2 >= {R.recommend} AS should_recommend,
  CASE WHEN total2 >= {R.recommend} THEN CASE WHEN next_action = 'skip' THEN 'rsvp' ELSE next_action END WHEN total2 >= {R.review} THEN 'monitor' ELSE 'skip' END AS next_action FROM adjusted"""))
def topic_adjusted_score(spark, sf):
    scored = scoring.rubric_scores(V.v_records(spark, sf), R)
    return scoring.adjust_scores(scored, R).select("id", "user_fit", "networking_value", "novelty", "total", "boost", "penalty", "should_recommend", "next_action")


@query("output_rows", V.with_ctes(V.V_RECORDS, V_SCORED, select="SELECT id, city, host AS hosts, '' AS description, CAST(total AS BIGINT) AS score FROM scored"))
def output_rows(spark, sf):
    out = scoring.output_rows(scoring.rubric_scores(V.v_records(spark, sf), R))
    return out.select("id", "city", F.array_join("hosts", "|").alias("hosts"), "description", C("score").cast("long").alias("score"))


@query("ranked_scores", V.with_ctes(V.V_RECORDS, V_SCORED, select="SELECT id, total, row_number() OVER (ORDER BY total DESC, confidence DESC, start_at, id) AS rank FROM scored WHERE should_recommend QUALIFY rank <= 40"))
def ranked_scores(spark, sf):
    return scoring.rank_scored(scoring.rubric_scores(V.v_records(spark, sf), R), 40).select("id", "total", C("rank").cast("long").alias("rank"))


_REASON = "CASE WHEN start_at IS NULL THEN 'missing_date' WHEN start_at <= TIMESTAMP '1998-06-15 12:00:00' THEN 'past_event' WHEN start_at > TIMESTAMP '1998-06-15 12:00:00' + INTERVAL 1 MONTH THEN 'too_far_future' END"


@query("date_window", V.with_ctes(V.V_RECORDS, select=f"SELECT id, {_REASON} AS reason FROM v_records"))
def date_window(spark, sf):
    return V.v_records(spark, sf).select("id", window_reason(C("start_at"), V.AS_OF).alias("reason"))


@query("date_window_counts", V.with_ctes(V.V_RECORDS, select=f"SELECT reason, count(*) AS count FROM (SELECT {_REASON} AS reason FROM v_records) WHERE reason IS NOT NULL GROUP BY reason"))
def date_window_counts(spark, sf):
    return date_window(spark, sf).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


@query("top_picks", V.with_ctes(V.V_RECORDS, select=f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM v_records WHERE ({_REASON}) IS NULL AND score >= 60 QUALIFY rank <= 25"))
def top_picks(spark, sf):
    return scoring.picks(V.v_records(spark, sf), R, V.AS_OF, 25).select("id", "score", C("rank").cast("long").alias("rank"))


@query("budgeted_top_k", V.with_ctes(V.V_RECORDS, select="SELECT id, row_number() OVER (ORDER BY seq) AS rank FROM v_records QUALIFY rank <= least((SELECT count(*) FROM v_records), 30, 48, greatest(ceil((SELECT count(*) FROM v_records) * 0.001), 24))"))
def budgeted_top_k(spark, sf):
    return scoring.score_budget(V.v_records(spark, sf), 30, 0.1).select("id", C("rank").cast("long").alias("rank"))


@query("score_bands", V.with_ctes(V.V_RECORDS, select="SELECT CASE WHEN score >= 80 THEN 'recommended' WHEN score >= 65 THEN 'possible' ELSE 'below' END AS band, count(*) AS count FROM v_records GROUP BY 1"))
def score_bands(spark, sf):
    return V.v_records(spark, sf).groupBy(history.band(C("score"), 80, 65).alias("band")).agg(F.count(F.lit(1)).alias("count"))


@query("digest_rows", V.with_ctes(V.V_RECORDS, V.V_PICKS, select="SELECT id FROM v_records WHERE id IN (SELECT record_id FROM v_picks WHERE score < 95) OR (score >= 65 AND score < 80)"))
def digest_rows(spark, sf):
    picked = V.v_picks(spark, sf).filter("score < 95")
    return history.for_digest(V.v_records(spark, sf), picked, 80, 65).select("id")


# --- Fuzzy dedupe -------------------------------------------------------------------------


def page_records(spark, sf):
    """Pages as records: real titles, sites as hosts, language as city; copies and near copies inside."""
    p = V.texts(spark, sf, "pages")
    site = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    start = F.to_timestamp_ntz(F.lit("2024-03-01 22:00:00")) + F.make_dt_interval(hours=(C("page_id") % 5).cast("int"))
    return p.select(
        C("page_id").cast("string").alias("id"), C("page_id").alias("seq"), C("url").alias("canonical_url"), F.array("url").alias("source_urls"), F.coalesce(html_title(C("html")), F.lit("")).alias("title"),
        F.lit(None).cast("string").alias("description"), start.cast("timestamp").alias("start_at"), F.lit(None).cast("timestamp").alias("end_at"), F.lit("UTC").alias("timezone"),
        F.when(C("page_id") % 6 > 0, lang).alias("city"), F.lit(None).cast("string").alias("venue_text"), F.lit("city_only").alias("location_precision"), F.array(site).alias("hosts"), F.array(site).alias("organizers"),
        F.array(F.lit("web")).alias("platforms"), F.array().cast("array<string>").alias("visibility_flags"), F.lit("open").alias("registration_status"), F.lit("other").alias("event_type"), ((C("page_id") % 10) / 10).alias("confidence"), site.alias("site"))


_C_URL = ("regexp_replace(regexp_extract(url, '^(https?)://', 1) || '://' || regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) || "
          "CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN '?' || regexp_extract(url, '(page=[0-9]+)', 1) ELSE '' END, '/$', '')")
V_PAGE_RECORDS = f"""pr AS MATERIALIZED (SELECT page_id AS seq, CAST(page_id AS VARCHAR) AS id, url, {_C_URL} AS cu, coalesce({V.sql_title()}, '') AS title, TIMESTAMP '2024-03-01 22:00:00' + INTERVAL 1 HOUR * (page_id % 5) AS start_at,
    CASE WHEN page_id % 6 > 0 THEN regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) ELSE '' END AS city, {V.sql_title_text("regexp_extract(url, '^https?://([^/?#]+)', 1)")} AS host FROM pages),
  pt AS MATERIALIZED (SELECT *, {V.sql_tokens('title', DEDUPE_STOP_WORDS)} AS tok, trim(regexp_replace(regexp_replace({V.sql_title_text('title')}, '\\b(sf|san francisco|bay area|event|meetup)\\b', ' ', 'g'), ' +', ' ', 'g')) || '|' || strftime(start_at, '%Y-%m-%d') || '|' || CASE WHEN city = '' THEN 'unknown city' ELSE city END AS k FROM pr)"""


def _sql_similar(a: str, b: str) -> str:
    inter, la, lb = f"len(list_intersect({a}.tok, {b}.tok))", f"len({a}.tok)", f"len({b}.tok)"
    jac, sub = f"{inter} / ({la} + {lb} - {inter})", f"{inter} / least({la}, {lb})"
    return (f"({a}.cu = {b}.cu OR (({a}.city = '' OR {b}.city = '' OR {a}.city = {b}.city) AND (abs(epoch({a}.start_at) - epoch({b}.start_at)) <= 10800 OR CAST({a}.start_at AS DATE) = CAST({b}.start_at AS DATE)) "
            f"AND {la} > 0 AND {lb} > 0 AND ({jac} >= 0.72 OR ({sub} >= 0.8 AND {a}.host = {b}.host) OR ({sub} >= 0.9 AND {inter} >= 3))))")


#: Components within a city or without one; then a group without a city joins that of the first content it agrees with.
_COMPONENTS = f"""edges AS MATERIALIZED (SELECT a.seq AS a, b.seq AS b FROM pt a JOIN pt b ON a.seq <> b.seq AND (a.k = b.k OR a.cu = b.cu OR (a.city = b.city AND {_sql_similar('a', 'b')}))),
  reach AS (SELECT seq AS a, seq AS b FROM pt UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a), part AS MATERIALIZED (SELECT a AS seq, min(b) AS part FROM reach GROUP BY a),
  content AS MATERIALIZED (SELECT *, min(seq) OVER (PARTITION BY k, tok, start_at, city) AS first_seq FROM pt JOIN part USING (seq)), cityless AS (SELECT part FROM content GROUP BY part HAVING max(city) = ''),
  choice AS (SELECT a.part, arg_min(b.part, b.first_seq) AS target FROM content a JOIN content b ON a.city = '' AND b.city <> '' AND {_sql_similar('a', 'b')} WHERE a.part IN (SELECT part FROM cityless) GROUP BY a.part),
  comp AS (SELECT seq, min(seq) OVER (PARTITION BY coalesce(target, part)) AS root FROM part LEFT JOIN choice USING (part))"""


@query("fuzzy_dedupe", "WITH RECURSIVE " + V_PAGE_RECORDS + ",\n" + _COMPONENTS + """ SELECT CAST(root AS VARCHAR) AS id, count(*) AS merged_count, arg_max(title, length(title) * 100000 - seq) AS title, arg_min(url, length(url) * 100000 + seq) AS canonical_url,
  max((seq % 10) / 10.0) AS confidence, count(DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1)) AS n_hosts FROM comp JOIN pt USING (seq) GROUP BY root""")
def fuzzy_dedupe(spark, sf):
    out = dedupe.dedupe_records(page_records(spark, sf))
    return out.select("id", "merged_count", "title", "canonical_url", "confidence", F.size("hosts").cast("long").alias("n_hosts"))


@query("merged_ids", "WITH RECURSIVE " + V_PAGE_RECORDS + ",\n" + _COMPONENTS + " SELECT CAST(root AS VARCHAR) AS leader, CAST(seq AS VARCHAR) AS id FROM comp")
def merged_ids(spark, sf):
    grouped = dedupe.duplicate_groups(page_records(spark, sf)).select("group_id", "id", "seq")
    leaders = grouped.groupBy("group_id").agg(F.min_by("id", "seq").alias("leader"))
    return grouped.join(leaders, "group_id").select("leader", "id")


@query("order_dedupe", V.with_ctes(V.V_RECORDS, select="SELECT title, strftime(start_at, '%Y-%m-%d') AS day, city, count(*) AS merged_count, min(seq) AS first_seq, max(confidence) AS confidence FROM v_records GROUP BY title, start_at, city"))
def order_dedupe(spark, sf):
    """Orders merge where title, day and city agree: their titles are too short for partial matches."""
    out = dedupe.dedupe_records(V.v_records(spark, sf).withColumn("start_at", C("start_at").cast("timestamp")))
    return out.select("title", F.date_format("start_at", "yyyy-MM-dd").alias("day"), "city", "merged_count", C("seq").alias("first_seq"), "confidence")


@query("section_dedupe", "WITH RECURSIVE " + V_PAGE_RECORDS + f""", st AS MATERIALIZED (SELECT *, {V.sql_tokens('title', REPORT_STOP_WORDS)} AS rt, strftime((start_at AT TIME ZONE 'UTC') AT TIME ZONE 'UTC', '%Y-%m-%d') || '|' || city AS place,
    array_to_string(list_filter(string_split({V.sql_title_text('title')}, ' '), lambda w: length(w) > 1 AND w NOT IN ({", ".join(f"'{w}'" for w in REPORT_STOP_WORDS)})), ' ') AS rk FROM pt),
  edges AS MATERIALIZED (SELECT a.seq AS a, b.seq AS b FROM st a JOIN st b ON a.seq <> b.seq AND (lower(a.cu) = lower(b.cu) OR (a.place = b.place AND (a.rk = b.rk OR (len(a.rt) > 0 AND len(b.rt) > 0 AND
    (len(list_intersect(a.rt, b.rt)) / least(len(a.rt), len(b.rt)) >= 0.82 OR len(list_intersect(a.rt, b.rt)) / (len(a.rt) + len(b.rt) - len(list_intersect(a.rt, b.rt))) >= 0.72)))))),
  reach AS (SELECT seq AS a, seq AS b FROM st UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a), comp AS (SELECT a AS seq, min(b) AS root FROM reach GROUP BY a)
  SELECT id, CAST(seq % 3 AS INT) AS section_rank, CAST((seq * 37) % 101 AS DOUBLE) AS score FROM st JOIN comp USING (seq) QUALIFY row_number() OVER (PARTITION BY root ORDER BY seq % 3, (seq * 37) % 101 DESC, id) = 1""")
def section_dedupe(spark, sf):
    rows = page_records(spark, sf).withColumns({"section_rank": (C("seq") % 3).cast("int"), "score": ((C("seq") * 37) % 101).cast("double")})
    return dedupe.dedupe_sections(rows).select("id", "section_rank", "score")


@query("title_similarity_pairs", """WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) || ' ' || lower(replace(p_brand, '#', ' brand')) AS t FROM part), k AS (SELECT t, list_sort(list_distinct(string_split(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'), ' '))) AS tok FROM n)
  SELECT a.t AS left_title, b.t AS right_title, len(list_intersect(a.tok, b.tok)) / (len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok))) AS similarity, len(list_intersect(a.tok, b.tok)) / least(len(a.tok), len(b.tok)) AS subset
  FROM k a JOIN k b ON a.t < b.t WHERE len(list_intersect(a.tok, b.tok)) / least(len(a.tok), len(b.tok)) >= 0.8""")
def title_similarity_pairs(spark, sf):
    name = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(" brand"))))
    names = V.table(spark, sf, "part").select(name.alias("node")).distinct()
    nodes = names.select("node", F.array_distinct(F.split(F.regexp_replace("node", "[^a-z0-9]+", " "), " ")).alias("tokens"), F.array(F.lit("all")).alias("blocks"))
    pairs = similarity.similar_pairs(nodes, None, 0.8)
    t = nodes.select("node", "tokens")
    full = pairs.join(t.select(C("node").alias("x"), C("tokens").alias("_x")), "x").join(t.select(C("node").alias("y"), C("tokens").alias("_y")), "y")
    return full.select(F.least("x", "y").alias("left_title"), F.greatest("x", "y").alias("right_title"), jaccard(C("_x"), C("_y")).alias("similarity"), overlap(C("_x"), C("_y")).alias("subset")).filter("subset >= 0.8")


# --- History ------------------------------------------------------------------------------

_HIST = f"""h AS MATERIALIZED (SELECT * FROM pt WHERE seq % 4 = 0), skip AS (SELECT DISTINCT a.id FROM pt a JOIN h b ON a.seq = b.seq OR {_sql_similar('a', 'b')})"""


def _history(spark, sf):
    records = page_records(spark, sf)
    past = records.filter(C("seq") % 4 == 0)
    picks = past.select(C("id").alias("record_id"))
    return history.split_by_history(records, picks, past)


@query("history_eligible", V.with_ctes(V_PAGE_RECORDS, _HIST, select="SELECT id FROM pt WHERE id NOT IN (SELECT id FROM skip)"))
def history_eligible(spark, sf):
    return _history(spark, sf)[0].select("id")


@query("history_skipped", V.with_ctes(V_PAGE_RECORDS, _HIST, select="SELECT id FROM skip"))
def history_skipped(spark, sf):
    return _history(spark, sf)[1].select("id")


def month_scores(spark, sf):
    """Every record scored in its own month and again in the next."""
    r = V.v_records(spark, sf)
    shifted = r.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("_n"), "*")
    at = F.add_months(C("start_at").cast("date"), C("_n"))
    return shifted.select(F.date_format(at, "yyyy-MM").alias("run_id"), C("id").alias("record_id"), F.greatest(F.lit(0.0), C("score") - C("_n") * 5).alias("total"), at.cast("timestamp").alias("created_at"),
                          (C("seq") * 2 + C("_n")).alias("seq"), F.lit(None).cast("string").alias("rationale"))


V_MONTH_SCORES = """ms AS (SELECT strftime(start_at + INTERVAL 1 MONTH * n, '%Y-%m') AS run_id, id AS record_id, greatest(0, score - n * 5) AS total, CAST(start_at AS DATE) + INTERVAL 1 MONTH * n AS created_at, seq * 2 + n AS seq FROM v_records CROSS JOIN (SELECT unnest([0, 1]) AS n))"""


@query("suppressed_picks", V.with_ctes(V.V_RECORDS, V.V_PICKS, V_MONTH_SCORES, select="""SELECT s.run_id, s.record_id AS id, s.total, p.pick_id AS previous_pick_id, CASE WHEN p.pick_id IS NOT NULL THEN 'Previously recommended; hidden from the latest digest to avoid repeats.' ELSE 'Scored above the recommendation threshold but did not enter the latest recommendation set.' END AS reason
  FROM (SELECT * FROM ms WHERE total >= 80 QUALIFY row_number() OVER (PARTITION BY run_id, record_id ORDER BY created_at DESC, seq DESC) = 1) s JOIN v_records r ON r.id = s.record_id
  LEFT JOIN LATERAL (SELECT q.pick_id FROM v_picks q JOIN v_records qr ON qr.id = q.record_id WHERE q.run_id <> s.run_id AND (qr.canonical_url = r.canonical_url OR lower(qr.title) = lower(r.title)) ORDER BY q.created_at DESC, q.pick_id DESC LIMIT 1) p ON true
  WHERE NOT EXISTS (SELECT 1 FROM v_picks c WHERE c.run_id = s.run_id AND c.record_id = s.record_id)"""))
def suppressed_picks(spark, sf):
    out = history.suppressed(month_scores(spark, sf), V.v_records(spark, sf), V.v_picks(spark, sf), 80)
    return out.select("run_id", "id", "total", "previous_pick_id", "reason")


@query("suppressed_top", V.with_ctes(V.V_RECORDS, V.V_PICKS, V_MONTH_SCORES, select="""SELECT record_id AS id, total FROM (SELECT * FROM ms WHERE total >= 80 AND run_id = '1998-03' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY created_at DESC, seq DESC) = 1) s
  WHERE NOT EXISTS (SELECT 1 FROM v_picks c WHERE c.run_id = s.run_id AND c.record_id = s.record_id) ORDER BY total DESC, record_id LIMIT 25"""))
def suppressed_top(spark, sf):
    return history.suppressed(month_scores(spark, sf), V.v_records(spark, sf), V.v_picks(spark, sf), 80, "1998-03").select("id", "total")


@query("near_misses", V.with_ctes(V.V_RECORDS, V_MONTH_SCORES, select="""SELECT record_id, total, title, city FROM (SELECT * FROM ms WHERE total >= 65 AND total < 80 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY created_at DESC, seq DESC) = 1) JOIN v_records r ON r.id = record_id ORDER BY total DESC, record_id LIMIT 25"""))
def near_misses(spark, sf):
    return history.near_misses(month_scores(spark, sf), V.v_records(spark, sf), 65, 80).select("record_id", "total", "title", "city")


@query("pick_history", V.with_ctes(V.V_RECORDS, V.V_PICKS, V_MONTH_SCORES, select="""SELECT p.pick_id, p.score, r.title, s.total AS latest_total FROM (SELECT * FROM v_picks ORDER BY created_at DESC, pick_id DESC LIMIT 50) p LEFT JOIN v_records r ON r.id = p.record_id
  LEFT JOIN (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY created_at DESC, seq DESC) = 1) s ON s.record_id = p.record_id"""))
def pick_history(spark, sf):
    return history.pick_history(V.v_picks(spark, sf), V.v_records(spark, sf).select("id", "title"), month_scores(spark, sf)).select("pick_id", "score", "title", "latest_total")


@query("enriched_picks", V.with_ctes(V.V_RECORDS, V.V_PICKS, V_MONTH_SCORES, select="""SELECT p.pick_id, r.title, r.city, s.total AS latest_total FROM v_picks p LEFT JOIN v_records r ON r.id = p.record_id LEFT JOIN LATERAL (SELECT total FROM ms WHERE ms.record_id = p.record_id ORDER BY created_at DESC, seq DESC LIMIT 1) s ON true"""))
def enriched_picks(spark, sf):
    return joins.enriched_picks(V.v_picks(spark, sf), V.v_records(spark, sf).select("id", "title", "city"), month_scores(spark, sf)).select("pick_id", "title", "city", "latest_total")


@query("picks_by_day", V.with_ctes(V.V_RECORDS, V.V_PICKS, select="SELECT strftime((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS local_day, count(*) AS picks FROM v_picks GROUP BY 1"))
def picks_by_day(spark, sf):
    return history.picks_by_day(V.v_picks(spark, sf)).groupBy(F.date_format("local_day", "yyyy-MM-dd").alias("local_day")).agg(F.count(F.lit(1)).alias("picks"))


# --- Digest, misses, rotation ---------------------------------------------------------------

_BLOCK = "rk || '. ' || title || ' (' || CAST(score AS INT) || ')' || chr(10) || strftime(start_at, '%b %-d, %-I:%M %p') || ' - ' || city || chr(10) || 'Why: Picked for ' || city || '.' || chr(10) || 'Link: ' || canonical_url"


@query("digest_text", V.with_ctes(V.V_RECORDS, select=f"""SELECT run_id, n1 AS n_recommended, n2 AS n_possible, CASE WHEN length(full_text) <= 100000 THEN full_text END AS text FROM (
  SELECT run_id, count(*) FILTER (score >= 98) AS n1, count(*) FILTER (score < 98) AS n2,
    'Link digest: ' || count(*) || ' event' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || chr(10) || count(*) FILTER (score >= 98) || ' recommended, ' || count(*) FILTER (score < 98) || ' review-worthy'
    || coalesce(chr(10) || chr(10) || 'Recommended (98+)' || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY rk) FILTER (score >= 98), '') || coalesce(chr(10) || chr(10) || 'Possible (95-97)' || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY rk) FILTER (score < 98), '') AS full_text
  FROM (SELECT *, {_BLOCK} AS b FROM (SELECT *, row_number() OVER (PARTITION BY run_id, score >= 98 ORDER BY score DESC, id) AS rk FROM v_records WHERE score >= 95)) GROUP BY run_id)"""))
def digest_text(spark, sf):
    rows = V.v_records(spark, sf).withColumn("reasons", F.array(F.concat(F.lit("Picked for "), "city", F.lit(". More."))))
    return digest.render_digests(rows, 98, 95, max_length=100_000)


@query("digest_capped", V.with_ctes(V.V_RECORDS, select="SELECT run_id, count(*) FILTER (score >= 80) AS n_recommended, count(*) FILTER (score < 80) AS n_possible FROM v_records WHERE score >= 65 GROUP BY run_id"))
def digest_capped(spark, sf):
    rows = V.v_records(spark, sf).withColumn("reasons", F.array(F.lit("Strong fit.")))
    return digest.render_digests(rows, 80, 65).filter(F.length("text") <= digest.MAX_LENGTH).select("run_id", "n_recommended", "n_possible")


_FOUND = f"f AS (SELECT item_id, text AS title, 'https://b.example.com/' || item_id AS url, {V.sql_match_text('text')} AS m FROM benchmark)"
_RELEVANT = V.sql_hit("m", *V.TEXT_RULES.relevant_keywords(), *V.TEXT_RULES.audience, *V.TEXT_RULES.prefer_formats)


def _classified(spark, sf):
    b = V.table(spark, sf, "benchmark")
    found = b.select("item_id", C("text").alias("title"), F.concat(F.lit("https://b.example.com/"), "item_id").alias("url"), F.lit("").alias("snippet"), F.lit("").alias("source_query"), C("item_id").alias("seq"))
    known = V.texts(spark, sf, "documents").select(C("text").alias("title")).unionByName(b.filter(C("item_id") % 5 == 0).select(C("text").alias("title")))
    return misses.classify(found, known, V.TEXT_RULES, F.concat_ws("\n", "title", "url"))


_MISSED = f"SELECT item_id, {_RELEVANT} AND item_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM documents d WHERE trim(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(f.title), '[^a-z0-9]+', ' ', 'g'))) AS was_missed, CASE WHEN {_RELEVANT} THEN 0.76 ELSE 0.55 END AS confidence FROM f"


@query("missed_records", V.with_ctes(_FOUND, select=f"SELECT item_id, was_missed, CASE WHEN was_missed THEN 'source_gap' ELSE 'not_relevant' END AS miss_reason, CAST(confidence AS DOUBLE) AS confidence FROM ({_MISSED})"))
def missed_records(spark, sf):
    return _classified(spark, sf).select("item_id", "was_missed", "miss_reason", C("confidence").cast("double").alias("confidence"))


@query("hunt_summary", V.with_ctes(_FOUND, select=f"SELECT count(*) AS checked, count(*) FILTER (was_missed) AS missed, count(*) FILTER (NOT was_missed) AS ignored, '1998-06-08' AS week_start, '1998-06-15' AS week_end FROM ({_MISSED})"))
def hunt_summary(spark, sf):
    s = misses.hunt_summary(_classified(spark, sf), V.AS_OF, 3)
    return s.select("checked", "missed", "ignored", F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), F.date_format("week_end", "yyyy-MM-dd").alias("week_end"))


@query("unknown_titles", "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE trim(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g')))")
def unknown_titles(spark, sf):
    return joins.unknown_titles(V.table(spark, sf, "benchmark"), V.texts(spark, sf, "documents"), "text").select("item_id")


_PRI = "(['must_scan','high','medium','paused'])[CAST(s_suppkey % 4 + 1 AS INT)]"
_KIND = "(['luma_calendar','rss_feed','event_digest','organizer_site','indexed_source','x_account'])[CAST(s_suppkey % 6 + 1 AS INT)]"


def supplier_registry(spark, sf):
    k = C("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("luma_calendar", "rss_feed", "event_digest", "organizer_site", "indexed_source", "x_account")]), (k % 6 + 1).cast("int"))
    pri = F.element_at(F.array(*[F.lit(x) for x in ("must_scan", "high", "medium", "paused")]), (k % 4 + 1).cast("int"))
    return V.table(spark, sf, "supplier").select(
        C("s_name").alias("id"), C("s_name").alias("name"), kind.alias("kind"), pri.alias("priority"), F.when(k % 6 != 5, F.concat(F.lit("https://s.example.com/"), k)).alias("url"),
        F.when(k % 6 == 1, F.concat(F.lit("https://s.example.com/feed/"), k)).alias("feed_url"), F.lit(None).cast("string").alias("handle"), F.when(k % 3 != 0, F.concat(F.lit("query "), k)).alias("query_text"),
        F.array(F.lit("s.example.com")).alias("include_domains"), C("s_acctbal").alias("source_score"), F.lit(20).alias("max_candidate_links"), F.array(F.concat(F.lit("nation-"), "s_nationkey")).alias("tags"), F.lit(None).cast("string").alias("notes"))


V_REG = f"""reg AS (SELECT s_suppkey, s_name AS id, {_PRI} AS priority, {_KIND} AS kind, s_acctbal, s_nationkey, s_suppkey % 6 <> 5 AS has_url, s_suppkey % 6 = 1 AS has_feed, s_suppkey % 3 <> 0 AS has_query FROM supplier)"""
_SLOT = "CAST(list_reduce(list_transform(string_split(id || ':' || (d - DATE '1970-01-01'), ''), lambda c: CAST(ascii(c) AS HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS HUGEINT)) AS BIGINT)"


@query("rotation_plan", V.with_ctes(V_REG, f"""days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), x AS (SELECT reg.*, d, w, wi, c, {_SLOT} AS slot FROM reg CROSS JOIN days CROSS JOIN (SELECT unnest(['morning','midday','evening']) AS w, unnest([0,1,2]) AS wi)
    CROSS JOIN (SELECT unnest(['public_source','rss','exa','x']) AS c) WHERE (c = 'public_source' AND has_url AND kind NOT IN ('rss_feed','x_account')) OR (c = 'rss' AND has_feed) OR (c = 'exa' AND has_query AND kind <> 'x_account') OR (c = 'x' AND has_query AND kind = 'x_account'))""",
    select="""SELECT strftime(d, '%Y-%m-%d') AS day, w AS scan_window, c AS connector, id, slot, CAST(CASE c WHEN 'public_source' THEN CASE WHEN priority = 'must_scan' THEN 3 ELSE 1 END WHEN 'rss' THEN CASE WHEN priority = 'must_scan' THEN 5 ELSE 3 END WHEN 'x' THEN CASE WHEN priority = 'must_scan' THEN 50 ELSE 35 END ELSE 20 END AS BIGINT) AS max_results
  FROM x WHERE priority <> 'paused' AND CASE WHEN c IN ('x','rss') THEN wi = 0 WHEN priority = 'must_scan' THEN wi = 0 OR slot % 2 = wi - 1 WHEN priority = 'high' THEN slot % 3 = wi ELSE slot % 6 = wi END"""))
def rotation_plan(spark, sf):
    days = V.table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    return rotation.rotation_plan(supplier_registry(spark, sf), days).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "scan_window", "connector", "id", "slot", C("max_results").cast("long").alias("max_results"))


@query("registry_order", V.with_ctes(V_REG, select="SELECT id, row_number() OVER (ORDER BY CASE priority WHEN 'must_scan' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, s_acctbal DESC, id) AS position FROM reg"))
def registry_order(spark, sf):
    return ranking.exact_global_rank(supplier_registry(spark, sf), rotation.registry_order(), "position").select("id", "position")


@query("registry_scan", V.with_ctes(V_REG, select="SELECT id, kind, CASE kind WHEN 'luma_calendar' THEN 'luma_calendar' WHEN 'rss_feed' THEN 'newsletter' WHEN 'x_account' THEN 'x_account' ELSE 'organizer_site' END AS source_type FROM reg WHERE s_nationkey <> 3 AND id <> 'Supplier#000000001' UNION ALL SELECT 'custom-my-place', 'organizer_site', 'organizer_site'"))
def registry_scan(spark, sf):
    from ..functions.rules import Rules
    from ..sources.registry import registry_for, registry_source_type

    rules = Rules(disabled_sources=("supplier#000000001", "Nation-3"), phrases=("a",), added_sources=({"name": "My Place!", "kind": "organizer_site", "url": "https://www.my.example.com/x/"},))
    out = registry_for(supplier_registry(spark, sf), rules)
    return out.select("id", "kind", registry_source_type(C("kind")).alias("source_type"))


@query("organizer_follow_ups", V.with_ctes(V.V_RECORDS, V.V_PICKS, select="""SELECT organizer, n AS recommendation_count, mx AS max_score, contains('"' || organizer || '" ("Luma"', organizer) AS names_it FROM (SELECT name AS organizer, count(*) AS n, max(score) AS mx, count(DISTINCT id) AS e FROM (SELECT p.score, r.id, unnest([host, organizer]) AS name FROM v_picks p JOIN v_records r ON r.id = p.record_id) GROUP BY name) ORDER BY n DESC, mx DESC, e DESC, organizer LIMIT 5"""))
def organizer_follow_ups(spark, sf):
    out = rotation.organizer_follow_ups(V.v_picks(spark, sf), V.v_records(spark, sf), R, V.AS_OF)
    return out.select("organizer", "recommendation_count", "max_score", C("query").contains(C("organizer")).alias("names_it"))


@query("merged_plan", """SELECT 'agent_exploration' AS query_group, 'query ' || s_suppkey AS query_text FROM supplier WHERE s_suppkey < 5 UNION ALL (SELECT 'static', 'static ' || p_partkey FROM part WHERE p_partkey % 2 = 0 ORDER BY p_partkey LIMIT 5) UNION ALL SELECT 'static', 'static ' || p_partkey FROM part WHERE p_partkey % 2 = 1""")
def merged_plan(spark, sf):
    planned = V.table(spark, sf, "supplier").select(C("s_suppkey").alias("position"), F.concat(F.lit("query "), "s_suppkey").alias("query"))
    static = V.table(spark, sf, "part").select(C("p_partkey").alias("position"), F.when(C("p_partkey") % 2 == 0, "exa").otherwise("rss").alias("connector"), F.lit("static").alias("query_group"), F.concat(F.lit("static "), "p_partkey").alias("query_text"))
    return rotation.merge_plan(static, planned, 10, rotation.target_queries(10)).select("query_group", "query_text")


# --- Upserts, set operations -----------------------------------------------------------------


@query("upsert_latest", """SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, strftime(min(first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen FROM (
  SELECT user_id, event_type, value, event_id, ts AS first_seen FROM events) GROUP BY user_id""")
def upsert_latest(spark, sf):
    e = V.table(spark, sf, "events").withColumn("first_seen", C("ts"))
    cols = ["user_id", "event_type", "value", "event_id", "first_seen"]
    half = C("event_id") % 2 == 0
    # Two passes: odd events after even ones would lose order, so each half is reduced by key first.
    stored = ups.upsert(e.limit(0).select(cols), e.filter(half).select(cols), ["user_id"], "event_id", keep_min=["first_seen"])
    newest = ranking.latest_per_key(stored.unionByName(e.filter(~half).select(cols)), ["user_id"], "event_id", "event_id")
    seen = e.groupBy("user_id").agg(F.min("first_seen").alias("_f"))
    merged = ups.upsert(stored, newest.join(seen, "user_id").withColumn("first_seen", C("_f")).select(cols), ["user_id"], "event_id", keep_min=["first_seen"])
    return merged.select("user_id", "event_type", "value", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("upsert_columns", """SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'rejected' ELSE 'new' END AS status FROM customer UNION ALL SELECT c_custkey + 1000000, 'fresh ' || c_name, 'new' FROM customer WHERE c_custkey % 5 = 0""")
def upsert_columns(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", C("c_name").alias("title"), F.lit("new").alias("status"))
    incoming = c.filter(C("c_custkey") % 2 == 0).withColumns({"title": F.lit("ignored"), "status": F.lit("rejected")}).unionByName(
        c.filter(C("c_custkey") % 5 == 0).withColumns({"c_custkey": C("c_custkey") + 1000000, "title": F.concat(F.lit("fresh "), "title")}))
    return ups.upsert(c, incoming.withColumn("pass", F.lit(1)), ["c_custkey"], "pass", update_cols=["status"])


@query("insert_new_picks", V.with_ctes(V.V_RECORDS, V.V_PICKS, select="SELECT pick_id, run_id, record_id FROM v_picks WHERE CAST(record_id AS BIGINT) % 3 <> 0"))
def insert_new_picks(spark, sf):
    p = V.v_picks(spark, sf)
    stored = p.filter(C("record_id").cast("long") % 3 == 0)
    return ups.insert_new(stored, p, ["pick_id"], ["run_id", "record_id"]).select("pick_id", "run_id", "record_id")


@query("union_latest", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM customer")
def union_latest(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey")
    left = c.filter(C("c_custkey") % 2 == 0).withColumn("side", F.lit("left"))
    return ups.union_latest(left, c.withColumn("side", F.lit("right")), ["c_custkey"])


@query("run_state", """SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_type = 'view') AS x_posts_read, arg_max(value, event_id) FILTER (event_type = 'click') AS candidates_found FROM events GROUP BY user_id""")
def run_state(spark, sf):
    e = V.table(spark, sf, "events")
    log = e.select(C("user_id").cast("string").alias("run_id"), C("event_id").alias("seq"), C("event_type").alias("status"), F.when(C("event_type") == "view", C("value")).alias("x_posts_read"),
                   F.when(C("event_type") == "click", C("value")).alias("candidates_found"))
    return ups.run_state(log, ["x_posts_read", "candidates_found"]).select("run_id", "status", "x_posts_read", "candidates_found")


_RULE_A = "SELECT 'topic' AS kind, n_name AS name, CAST(s_nationkey AS DOUBLE) AS weight, s_name AS keyword FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0"
_RULE_B = "SELECT 'topic' AS kind, n_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN -1.0 ELSE CAST(s_nationkey AS DOUBLE) END AS weight, s_name AS keyword FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 1"


@query("rules_diff", f"""SELECT coalesce(b.name, a.name) AS name, coalesce(b.keyword, a.keyword) AS keyword, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'weight' END AS change, a.weight AS weight_before, b.weight AS weight_after
  FROM ({_RULE_A}) a FULL OUTER JOIN ({_RULE_B}) b ON lower(a.name) = lower(b.name) AND lower(a.keyword) = lower(b.keyword) WHERE a.name IS NULL OR b.name IS NULL OR a.weight <> b.weight""")
def rules_diff(spark, sf):
    s = V.table(spark, sf, "supplier").join(V.table(spark, sf, "nation"), C("s_nationkey") == C("n_nationkey"))
    base = s.select("s_suppkey", F.lit("topic").alias("kind"), C("n_name").alias("name"), C("s_nationkey").cast("double").alias("weight"), C("s_suppkey").cast("int").alias("ordinal"), C("s_name").alias("keyword"))
    before = base.filter(C("s_suppkey") % 3 != 0).drop("s_suppkey")
    after = base.filter(C("s_suppkey") % 3 != 1).withColumns({"weight": F.when(C("s_suppkey") % 7 == 0, -1.0).otherwise(C("weight")), "name": F.upper("name")}).drop("s_suppkey")
    return Rl.rules_diff(before, after).select(F.upper("name").alias("name"), "keyword", "change", "weight_before", "weight_after")


