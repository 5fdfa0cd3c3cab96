"""Link intelligence: anchors, rejection, intent, signal, ranking, graph, attribution, novelty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import joins, quality, ranking, reputation, similarity
from ..plans import links as L
from ..plans import rotation
from ..sources.landed import anchor_links as anchors_of
from . import query
from . import views as V
from .text_queries import P_URLS, platform_urls

C = F.col
R = V.TEXT_RULES
DAY = V.PAGES_AS_OF.date()


def sql_dates(t: str, as_of: str = "DATE '2024-06-15'") -> str:
    """Every explicit date in lower-case text ``t``, as a list."""
    iso = (f"list_transform(regexp_extract_all({t}, '\\b20[0-9]{{2}}[-/_](?:0?[1-9]|1[0-2])[-/_](?:0?[1-9]|[12][0-9]|3[01])\\b'), "
           "lambda m: try_cast(regexp_replace(m, '[/_]', '-', 'g') AS DATE))")
    named_pattern = ("\\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
                     "\\.?\\s+[0-3]?[0-9](?:st|nd|rd|th)?(?:,?\\s+20[0-9]{2})?\\b")
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    named = (f"list_transform(regexp_extract_all({t}, '{named_pattern}'), lambda m: try_cast(coalesce(nullif(regexp_extract(m, '\\s(20[0-9]{{2}})$', 1), ''), "
             f"CAST(year({as_of}) AS VARCHAR)) || '-' || list_position({months}, substr(m, 1, 3)) || '-' || regexp_extract(m, '^[a-z]+\\.?\\s+([0-9]{{1,2}})', 1) AS DATE))")
    word = "event|meetup|dinner|breakfast|salon|conference|summit|workshop|demo|panel|rsvp|luma|eventbrite"
    bare = (f"CASE WHEN regexp_matches({t}, '\\b20[0-9]{{2}}\\b') AND regexp_matches({t}, '{word}') THEN list_transform(list_filter(range(1, length({t}) + 1), "
            f"lambda i: regexp_matches(substr({t}, i, 4), '^20[0-9]{{2}}$') AND NOT regexp_matches(substr({t}, greatest(i - 1, 1), CASE WHEN i > 1 THEN 1 ELSE 0 END), '[a-z0-9_]') "
            f"AND NOT regexp_matches(substr({t}, i + 4, 1), '[a-z0-9_]') AND try_cast(substr({t}, i, 4) AS INT) < year({as_of}) "
            f"AND regexp_matches(substr({t}, greatest(1, i - 80), CASE WHEN i > 80 THEN 160 ELSE 79 + i END), '{word}')), lambda i: make_date(try_cast(substr({t}, i, 4) AS INT), 1, 1)) ELSE [] END")
    return f"list_filter(list_concat({iso}, {named}, {bare}), lambda d: d IS NOT NULL)"


def sql_reason(rules=R) -> str:
    past = "len(list_filter({0}, lambda d: d < DATE '2024-06-15')) > 0"
    future = "len(list_filter({0}, lambda d: d >= DATE '2024-06-15')) > 0"
    return (f"CASE WHEN {past.format('d_primary')} THEN 'past_event_explicit_date' WHEN {past.format('d_snippet')} AND NOT ({future.format('d_snippet')}) THEN 'past_event_explicit_date' "
            f"WHEN {V.sql_hit('m', *rules.exclude_formats)} THEN 'excluded_format:' || {V.sql_first_hit('m', rules.exclude_formats)} "
            f"WHEN {V.sql_hit('m', *rules.exclude_topics)} THEN 'excluded_topic:' || {V.sql_first_hit('m', rules.exclude_topics)} "
            f"WHEN {V.sql_hit('m', *rules.exclude_eligibility)} THEN 'eligibility_gate:' || {V.sql_first_hit('m', rules.exclude_eligibility)} "
            f"WHEN {V.sql_hit('m', 'coupon', 'discount', 'giveaway', 'sponsorship')} THEN 'obvious_low_signal_or_junk' "
            "WHEN contains(lower(hay), 'linkedin.com') AND NOT contains(lower(hay), 'event') AND NOT contains(lower(hay), 'luma') THEN 'linkedin_indexed_but_event_signal_unclear' END")


def platform_links(spark, sf):
    """Page links with their url moved onto the known platforms."""
    moved = platform_urls(spark, sf).select(C("page_id").alias("seq"), C("url").alias("_u"))
    return V.v_links(spark, sf).join(moved, "seq").withColumns({"url": C("_u"), "source_url": C("_u"), "canonical_url": U.link_url(C("_u"))}).drop("_u")


# Page text is long, so the staged columns are materialised once.
V_PLINKS = f"""v_plinks AS MATERIALIZED (SELECT id, seq, platform, p_urls.url, {V.sql_link_url('p_urls.url')} AS canonical_url, title, snippet FROM v_links JOIN p_urls ON p_urls.page_id = v_links.seq),
  staged AS MATERIALIZED (SELECT *, canonical_url || ' ' || title || ' ' || snippet AS hay, {V.sql_match_text("canonical_url || ' ' || title || ' ' || snippet")} AS m,
    lower(regexp_extract(canonical_url, '^https?://([^/?#]+)', 1)) AS host, lower(regexp_extract(canonical_url, '^https?://[^/?#]+([^?#]*)', 1)) AS path, title || ' ' || snippet AS txt,
    {sql_dates("lower(canonical_url || ' ' || title)")} AS d_primary, {sql_dates("lower(snippet)")} AS d_snippet FROM v_plinks),
  judged AS MATERIALIZED (SELECT *, {sql_reason()} AS reason,
    CASE WHEN CASE WHEN host = 'eventbrite.com' THEN regexp_matches(path, '^/e/[^/]+tickets-[0-9]+') WHEN host = 'meetup.com' THEN regexp_matches(path, '/events/[0-9]+')
        WHEN host = 'partiful.com' THEN path <> '/' AND string_split(path, '/')[2] NOT IN ('events', 'explore')
        WHEN host = 'lu.ma' THEN regexp_matches(path, '^/+[^/]+/*$') AND NOT regexp_matches(path, '^/+(ai|sf|bay-area|san-francisco|calendar|discover)/*$|^/+(user|calendar)|events/*$|calendar')
        WHEN contains(host, 'linkedin.com') THEN contains(path, '/events/') ELSE false END THEN 'concrete_event'
      WHEN regexp_matches(path, '/events?/?$|/calendar/?$|/ai-radar/?$|/cities/|/city/|/tag/|/category/') OR regexp_matches(lower(txt), '\\b(events calendar|event calendar|upcoming events|events this week|week of|roundup|newsletter|digest|radar)\\b') THEN 'listing_source'
      WHEN regexp_matches(path, '/about/?$|/apply/?$|/companies/?$|/community/?$|/members/?$') OR regexp_matches(lower(txt), '\\b(community|coworking space|accelerator|venture fund|portfolio|membership|member owned|event space)\\b') THEN 'organizer_source'
      WHEN {V.sql_hit('m', *R.local_terms())} AND regexp_matches(lower(hay), '\\b(upcoming|this week|next week|rsvp|apply|register|tickets?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|20[0-9]{{2}})\\b') THEN 'concrete_event'
      ELSE 'low_event_confidence' END AS intent FROM staged),
  assessed AS MATERIALIZED (SELECT *, CAST(greatest(0, least(100, 30 + (least(8, len({V.sql_hits('m', R.signal_terms())})) - {' - '.join(f"CASE WHEN {V.sql_hit('m', *t.keywords)} THEN 1 ELSE 0 END" for t in R.negative_topics())}) * 7
      + CASE host WHEN 'lu.ma' THEN 18 WHEN 'meetup.com' THEN 8 WHEN 'eventbrite.com' THEN 6 ELSE 0 END + CASE intent WHEN 'concrete_event' THEN 18 WHEN 'listing_source' THEN -18 WHEN 'organizer_source' THEN -12 ELSE -28 END
      - (len({V.sql_hits('m', ['coupon', 'discount', 'giveaway', 'sponsorship'])}) + len({V.sql_hits('m', R.exclude_formats)})) * 12 - CASE WHEN {V.sql_hit('m', *R.exclude_formats)} THEN 35 ELSE 0 END
      - CASE WHEN host = 'linkedin.com' THEN 8 ELSE 0 END - CASE WHEN reason = 'past_event_explicit_date' THEN 40 ELSE 0 END)) AS DOUBLE) AS source_score FROM judged)"""
_PL = (V.V_LINKS, P_URLS, V_PLINKS)


@query("assessed_links", V.with_ctes(*_PL, select="SELECT id, canonical_url, reason AS rejection_reason, intent, source_score, CASE WHEN reason IS NULL THEN 'new' ELSE 'rejected' END AS status FROM assessed"))
def assessed_links(spark, sf):
    return L.assess_links(platform_links(spark, sf), R, DAY).select("id", "canonical_url", "rejection_reason", "intent", "source_score", "status")


@query("rejection_reason_counts", V.with_ctes(*_PL, select="SELECT reason AS rejection_reason, count(*) AS count FROM judged GROUP BY reason"))
def rejection_reason_counts(spark, sf):
    return L.assess_links(platform_links(spark, sf), R, DAY).groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("count"))


@query("link_quality", V.with_ctes(*_PL, select="""SELECT 'intent' AS measure, intent AS key, CAST(count(*) AS DOUBLE) AS value FROM assessed GROUP BY intent
  UNION ALL SELECT 'score', 'count', count(*) FROM assessed UNION ALL SELECT 'score', 'top', max(source_score) FROM assessed UNION ALL SELECT 'score', 'bottom', min(source_score) FROM assessed
  UNION ALL SELECT 'score', 'median', list_sort(list(source_score))[CAST(floor(count(*) / 2) AS INT) + 1] FROM assessed"""))
def link_quality(spark, sf):
    return quality.link_quality(L.assess_links(platform_links(spark, sf), R, DAY))


@query("host_performance", V.with_ctes(*_PL, select="""SELECT host, count(*) AS links, count(reason) AS noise, count(DISTINCT canonical_url) AS urls FROM judged GROUP BY host ORDER BY links DESC, host LIMIT 12"""))
def host_performance(spark, sf):
    links = L.assess_links(platform_links(spark, sf), R, DAY)
    return (links.groupBy(U.host_of(C("canonical_url")).alias("host"))
            .agg(F.count(F.lit(1)).alias("links"), F.count("rejection_reason").alias("noise"), F.countDistinct("canonical_url").alias("urls"))
            .orderBy(F.desc("links"), "host").limit(12))


@query("extraction_priority", V.with_ctes(*_PL, select="""SELECT id, source_score + CASE intent WHEN 'concrete_event' THEN 40 WHEN 'listing_source' THEN -20 WHEN 'organizer_source' THEN -30 ELSE -45 END
  + CASE WHEN regexp_matches(canonical_url, '^https://lu\\.ma/[^/?#]+') THEN 18 WHEN regexp_matches(canonical_url, 'meetup\\.com/[^/]+/events/[0-9]+') THEN 14 WHEN regexp_matches(canonical_url, 'eventbrite\\.com/e/[^/]+tickets-[0-9]+') THEN 12 ELSE 0 END AS priority FROM assessed"""))
def extraction_priority(spark, sf):
    links = L.assess_links(platform_links(spark, sf), R, DAY)
    return links.select("id", L.extraction_priority(C("intent"), C("canonical_url"), C("source_score")).alias("priority"))


_RANKED = """, best AS (SELECT *, regexp_replace(canonical_url, '/$', '') AS u FROM assessed QUALIFY row_number() OVER (PARTITION BY regexp_replace(canonical_url, '/$', '') ORDER BY source_score DESC, seq) = 1),
  prio AS (SELECT *, source_score + CASE intent WHEN 'concrete_event' THEN 40 WHEN 'listing_source' THEN -20 WHEN 'organizer_source' THEN -30 ELSE -45 END
    + CASE WHEN regexp_matches(canonical_url, '^https://lu\\.ma/[^/?#]+') THEN 18 ELSE 0 END AS priority FROM best),
  rounds AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority DESC, seq) AS round, max(priority) OVER (PARTITION BY host) AS gp,
    first_value(seq) OVER (PARTITION BY host ORDER BY priority DESC, seq) AS gs FROM prio)"""


@query("ranked_links", V.with_ctes(*_PL, select="").rstrip() + _RANKED + " SELECT id, priority, round, row_number() OVER (ORDER BY round, gp DESC, gs, seq) AS position FROM rounds")
def ranked_links(spark, sf):
    links = L.assess_links(platform_links(spark, sf), R, DAY)
    return L.rank_for_extraction(links).select("id", "priority", "round", "position")


@query("ranked_links_seen_last", V.with_ctes(*_PL, select="").rstrip() + _RANKED + """, pos AS (SELECT id, seq, row_number() OVER (ORDER BY round, gp DESC, gs, seq) AS p FROM rounds)
  SELECT id, seq % 7 = 0 AS seen_before, row_number() OVER (ORDER BY seq % 7 = 0, p) AS position FROM pos""")
def ranked_links_seen_last(spark, sf):
    links = L.assess_links(platform_links(spark, sf), R, DAY)
    seen = links.filter(C("seq") % 7 == 0).select("id")
    return L.rank_for_extraction(links, seen).select("id", "seen_before", "position")


def page_anchors(spark, sf):
    return anchors_of(V.texts(spark, sf, "pages"), keep_all=True)


_ENC = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7E]|[\"<>`{{}}]') THEN url_encode(c) ELSE c END), '')"
_RAW_PATH = "regexp_extract(abs, '^https?://[^/?#]+([^?#]*)', 1)"
V_ANCHORS = f"""v_anchors AS MATERIALIZED (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY min(position)) - 1 AS position FROM (SELECT page_id, position, base, 'http' || CASE WHEN starts_with(abs, 'https') THEN 's' ELSE '' END || '://' || regexp_replace(regexp_extract(abs, '^https?://([^/?#]+)', 1), '^www\\.', '')
    || CASE WHEN regexp_replace({_RAW_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_ENC.format(_RAW_PATH)}, '/+$', '') END AS link FROM (
  SELECT page_id, url AS base, generate_subscripts(h, 1) AS position, unnest(h) AS href, CASE WHEN regexp_matches(unnest(h), '^https?://') THEN unnest(h) ELSE regexp_extract(url, '^https?://[^/?#]+', 0) || unnest(h) END AS abs
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref=["'']([^"'']+)["'']', 1) || list_distinct(list_transform(regexp_extract_all(html, '(?i)https?://[^\\s<>"'')\\]]+'), lambda x: regexp_replace(x, '[.,;:!?]+$', ''))) AS h FROM pages))) WHERE link <> {V.sql_link_url('base')} GROUP BY page_id, link)"""


@query("anchor_links", V.with_ctes(V_ANCHORS, select="SELECT page_id, position, link, regexp_matches(lower(link), '^https?://[^/]+[^?]*(event|events|calendar|rsvp|register|tickets|startup-school|after-hours)') AS is_record_like FROM v_anchors"))
def anchor_links(spark, sf):
    return page_anchors(spark, sf).select("page_id", C("position").cast("long").alias("position"), "link", "is_record_like")


@query("best_link_per_url", V.with_ctes(V_ANCHORS, select="""SELECT regexp_replace(link, '/$', '') AS url, page_id, position, CAST(page_id % 101 AS DOUBLE) AS source_score FROM v_anchors
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(link, '/$', '') ORDER BY page_id % 101 DESC, page_id * 1000 + position) = 1"""))
def best_link_per_url(spark, sf):
    rows = page_anchors(spark, sf).select(C("link").alias("canonical_url"), "page_id", "position", (C("page_id") % 101).cast("double").alias("source_score"), (C("page_id") * 1000 + C("position")).alias("seq"))
    return L.best_link_per_url(rows).select(U.shared_url(C("canonical_url")).alias("url"), "page_id", C("position").cast("long").alias("position"), "source_score")


@query("first_link_per_source", V.with_ctes(V_ANCHORS, select="SELECT link, page_id AS first_page, position FROM v_anchors QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, position) = 1"))
def first_link_per_source(spark, sf):
    rows = page_anchors(spark, sf).select(C("link").alias("canonical_url"), F.lit("web").alias("platform"), F.lit(None).cast("string").alias("source_id"), F.lit("pages").alias("source_query"), "page_id", "position",
                                          F.struct("page_id", "position").alias("seq"))
    return L.first_link_per_source(rows).select(C("canonical_url").alias("link"), C("page_id").alias("first_page"), C("position").cast("long").alias("position"))


@query("round_robin_rank", """SELECT doc_id, round, row_number() OVER (ORDER BY round, gp DESC, gs, doc_id) AS position FROM (SELECT doc_id, row_number() OVER w AS round, max(n_chars) OVER (PARTITION BY source) AS gp, first_value(doc_id) OVER w AS gs
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id))""")
def round_robin_rank(spark, sf):
    docs = V.texts(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return ranking.round_robin(docs, ["source"], "n_chars", "doc_id").select("doc_id", "round", "position")


@query("per_source_cap", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def per_source_cap(spark, sf):
    docs = V.texts(spark, sf, "documents").select("source", "doc_id")
    return ranking.first_per_key(docs, ["source"], [C("doc_id")], 5)


@query("exact_rank", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem")
def exact_rank(spark, sf):
    line = V.table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return ranking.exact_rank(line, ["l_suppkey"], [F.desc("l_extendedprice"), C("l_orderkey"), C("l_linenumber"), C("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("normalized_links", f"SELECT id, CASE WHEN page_id % 3 = 0 THEN source_url ELSE url END AS url, CASE WHEN page_id % 2 = 0 THEN 'given' ELSE regexp_replace({V.sql_link_url('source_url')}, '/$', '') END AS canonical_url, CASE WHEN page_id % 5 = 0 THEN 'error' ELSE 'new' END AS status "
       "FROM (SELECT CAST(page_id AS VARCHAR) AS id, page_id, 'https://a.example.com/' || page_id || '/?ref=x#top' AS source_url, 'https://a.example.com/' || page_id || '/?ref=x#top' AS url FROM pages)")
def normalized_links(spark, sf):
    p = V.texts(spark, sf, "pages")
    made = F.concat(F.lit("https://a.example.com/"), "page_id", F.lit("/?ref=x#top"))
    raw = p.select(C("page_id").cast("string").alias("id"), made.alias("source_url"), F.when(C("page_id") % 3 != 0, made).otherwise(F.lit("")).alias("url"),
                   F.when(C("page_id") % 2 == 0, F.lit("given")).alias("canonical_url"), F.when(C("page_id") % 5 == 0, F.lit("error")).alias("status"))
    return L.normalize_links(raw, "run").select("id", "url", "canonical_url", "status")


@query("extractable_links", V.with_ctes(V.V_LINES, select="SELECT platform, count(*) AS count FROM v_lines WHERE status NOT IN ('rejected', 'error') GROUP BY platform"))
def extractable_links(spark, sf):
    return V.v_lines(spark, sf).filter(L.extractable(C("status"))).groupBy("platform").agg(F.count(F.lit(1)).alias("count"))


@query("generic_titles", "SELECT page_id, page_id % 3 = 0 AS generic FROM pages")
def generic_titles(spark, sf):
    title = F.when(C("page_id") % 3 == 0, F.concat(F.lit("Public source link from "), "url")).otherwise(F.concat(F.lit("About public source link from "), "url"))
    return V.texts(spark, sf, "pages").select("page_id", L.generic_title(title).alias("generic"))


# --- Graph and reputation -----------------------------------------------------------------


@query("source_reputation", """SELECT CAST(l_suppkey AS VARCHAR) AS id, round(list_reduce(list(CAST(l_extendedprice % 101 AS DOUBLE) ORDER BY l_orderkey, l_linenumber, l_partkey), lambda a, b: (a + b) / 2), 9) AS quality_score,
  round(list_reduce(list(CAST(l_discount AS DOUBLE) ORDER BY l_orderkey, l_linenumber, l_partkey), lambda a, b: (a + b) / 2), 9) AS noise_rate, count(*) AS events_found, max(l_quantity) AS freshness_score FROM lineitem GROUP BY l_suppkey""")
def source_reputation(spark, sf):
    line = V.table(spark, sf, "lineitem")
    rows = line.select(C("l_suppkey").cast("string").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"), (C("l_extendedprice") % 101).alias("quality_score"), C("l_discount").alias("noise_rate"),
                       C("l_quantity").alias("freshness_score"), F.lit(1).cast("long").alias("events_found"), F.lit(0).cast("long").alias("recommended_events"), C("l_shipdate").alias("last_seen"))
    return reputation.reputation(rows, ["id"], "seq").select("id", F.round("quality_score", 9).alias("quality_score"), F.round("noise_rate", 9).alias("noise_rate"), "events_found", "freshness_score")


def graph_links(spark, sf):
    """Order lines as links of a supplier page."""
    n = C("l_orderkey") * 8 + C("l_linenumber")
    return V.texts(spark, sf, "lineitem").select(
        F.concat(F.lit("https://www.supplier"), "l_suppkey", F.lit(".example.com/?utm_source=x")).alias("source_url"), F.concat(F.lit("https://shop.example.com/p/"), "l_partkey").alias("canonical_url"),
        F.when(C("l_suppkey") % 2 == 0, "x").otherwise("web").alias("platform"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("source_handle"),
        F.lit(None).cast("string").alias("source_name"), (C("l_extendedprice") % 101).alias("source_score"), F.when(C("l_returnflag") == "R", "bad").alias("rejection_reason"),
        F.concat(F.lit("part "), "l_partkey").alias("title"), C("l_shipdate").cast("timestamp").alias("discovered_at"), F.struct(n.alias("n"), "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))


_GRAPH = """g AS (SELECT 'https://supplier' || l_suppkey || '.example.com/' AS src, 'https://shop.example.com/p/' || l_partkey AS dst, l_suppkey, l_partkey, CAST(l_extendedprice % 101 AS DOUBLE) AS score, l_returnflag = 'R' AS bad, l_shipdate,
  row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem),
  ids AS (SELECT *, substr(sha1('organizer_site' || chr(10) || chr(10) || src), 1, 24) AS from_id, substr(sha1('candidate' || chr(10) || dst), 1, 24) AS to_id FROM g)"""


@query("source_graph_nodes", V.with_ctes(_GRAPH, select="""SELECT from_id AS id, min(src) AS url, 'supplier' || min(l_suppkey) || '.example.com' AS name, round(list_reduce(list(score ORDER BY seq), lambda a, b: (a + b) / 2), 9) AS quality_score, count(*) AS events_found, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen FROM ids GROUP BY from_id
  UNION ALL SELECT to_id, min(dst), 'part ' || min(l_partkey), round(arg_min(score, seq), 9), 1, strftime(arg_min(l_shipdate, seq), '%Y-%m-%d') FROM ids GROUP BY to_id"""))
def source_graph_nodes(spark, sf):
    return reputation.source_nodes(graph_links(spark, sf)).select("id", "url", "name", F.round("quality_score", 9).alias("quality_score"), "events_found", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


@query("source_graph_edges", V.with_ctes(_GRAPH, select="""SELECT substr(sha1('run' || chr(10) || from_id || chr(10) || to_id || chr(10) || kind || chr(10) || dst), 1, 24) AS id, from_id, to_id, kind AS edge_type,
  CASE WHEN arg_max(bad, seq) THEN 0.25 ELSE greatest(0.4, least(1.0, arg_max(score, seq) / 100)) END AS weight FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'mentions' ELSE 'discovered' END AS kind FROM ids) GROUP BY from_id, to_id, kind, dst"""))
def source_graph_edges(spark, sf):
    return reputation.source_edges(graph_links(spark, sf), "run", V.PAGES_AS_OF).select("id", "from_id", "to_id", "edge_type", "weight")


# --- Joins over links ---------------------------------------------------------------------


@query("attribution", """SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS record_id, l_orderkey || '-' || l_linenumber AS link_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def attribution(spark, sf):
    line = V.texts(spark, sf, "lineitem")
    link_url = F.concat(F.lit("https://www.shop.example.com/o/"), "l_orderkey", F.lit("/?utm_campaign=a"))
    links = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), link_url.alias("url"), U.shared_url(link_url).alias("canonical_url"), F.lit("web").alias("platform"))
    return joins.attribution(V.v_records(spark, sf), links).select("record_id", "link_id")


@query("links_seen_before", f"""WITH t AS (SELECT page_id, trim(regexp_replace(replace(lower(title), '&amp;', 'and'), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(replace(lower(snippet), '&amp;', 'and'), '[^a-z0-9]+', ' ', 'g')) AS s FROM (SELECT page_id, {V.sql_title()} AS title, {V.sql_text('html')} AS snippet FROM pages)),
  picked AS (SELECT DISTINCT t FROM t WHERE page_id % 5 = 0 AND length(t) >= 12)
  SELECT CAST(page_id AS VARCHAR) AS id FROM t WHERE page_id % 5 = 0 OR (length(t.t) >= 12 AND t.t IN (SELECT t FROM picked)) OR EXISTS (SELECT 1 FROM picked p WHERE contains(t.s, p.t))""")
def links_seen_before(spark, sf):
    links = V.v_links(spark, sf).drop("title")
    titled = links.join(V.texts(spark, sf, "pages").select(C("page_id").alias("seq"), _title().alias("title")), "seq")
    picked = titled.filter(C("seq") % 5 == 0).select("canonical_url", "title", F.array("url").alias("source_urls"))
    return joins.links_seen_before(titled, picked)


def _title():
    from ..functions.text import html_title

    return html_title(C("html"))


@query("contained_passages", f"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents), b AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS p FROM benchmark)
  SELECT doc_id, md5(p) AS passage_md5 FROM d JOIN b ON contains(t, p)""")
def contained_passages(spark, sf):
    from ..functions.text import plain_title

    docs = V.texts(spark, sf, "documents").select("doc_id", plain_title(C("text")).alias("t"))
    passages = V.table(spark, sf, "benchmark").select(plain_title(C("text")).alias("p")).distinct()
    return joins.contained_titles(docs, "doc_id", "t", passages, "p").select("doc_id", F.md5("p").alias("passage_md5"))


@query("query_group_counts", V.with_ctes(V.V_LINES, select="SELECT CASE WHEN s_suppkey IS NOT NULL THEN 'group ' || s_nationkey ELSE platform END AS query_group, count(*) AS count FROM v_lines LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON source_query = 'supplier ' || s_suppkey GROUP BY 1"))
def query_group_counts(spark, sf):
    queries = V.table(spark, sf, "supplier").filter(C("s_suppkey") % 3 != 0).select(F.concat(F.lit("supplier "), "s_suppkey").alias("query_text"), F.concat(F.lit("group "), "s_nationkey").alias("query_group"))
    return quality.query_group_counts(V.v_lines(spark, sf), queries)


_FP = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('the','and','for','with','from','events','event','upcoming'))))"


@query("query_novelty", f"""WITH q AS (SELECT page_id, {_FP.format(V.sql_title())} AS f FROM pages), avoid AS (SELECT DISTINCT f FROM q WHERE page_id % 4 = 0 AND len(f) > 0)
  SELECT page_id FROM q WHERE page_id % 4 <> 0 AND f NOT IN (SELECT f FROM avoid) AND NOT EXISTS (SELECT 1 FROM avoid a WHERE len(list_intersect(a.f, q.f)) >= 5 AND len(list_intersect(a.f, q.f)) / least(len(a.f), len(q.f)) >= 0.82)""")
def query_novelty(spark, sf):
    titles = V.texts(spark, sf, "pages").select("page_id", F.coalesce(_title(), F.lit("")).alias("query"))
    avoid = titles.filter(C("page_id") % 4 == 0).select(C("query").alias("value"))
    return similarity.novel_queries(titles.filter(C("page_id") % 4 != 0), avoid).select("page_id")


@query("sanitized_queries", f"""WITH q AS (SELECT page_id, trim(regexp_replace({V.sql_title()}, '\\s+', ' ', 'g')) AS t FROM pages), u AS (SELECT *, {_FP.format('t')} AS f, {V.sql_match_text('t')} AS m FROM q WHERE t <> ''),
  k AS (SELECT * FROM u WHERE {V.sql_hit('m', 'the', 'of')} AND NOT {V.sql_hit('m', 'thatin', 'ononst')})
  SELECT page_id, CASE WHEN contains(lower(t), '-thatin') THEN t ELSE t || ' -thatin' END || ' -ononst' AS query FROM k QUALIFY row_number() OVER (PARTITION BY f ORDER BY page_id) = 1""")
def sanitized_queries(spark, sf):
    from ..functions.rules import Rules

    rules = Rules(cities=("the",), aliases=("of",), exclude_formats=("thatin", "ononst"))
    proposed = V.texts(spark, sf, "pages").select("page_id", C("page_id").alias("position"), F.coalesce(_title(), F.lit("")).alias("query"), F.lit("topic").alias("novelty_axis"))
    empty = proposed.limit(0).select(C("query").alias("value"))
    return rotation.sanitize_queries(proposed, empty, rules).select("page_id", "query")


