"""Reference-shaped inputs derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rules, Topic
from ..session import spread
from ..functions.text import html_title, html_to_text
from ..functions.urls import link_url

AS_OF = datetime(1998, 6, 15, 12, 0, 0)
PAGES_AS_OF = datetime(2024, 6, 15, 12, 0, 0)

# Rules whose keywords occur in the given texts.
TEXT_RULES = Rules(
    name="catalog", region="Test Region", cities=("thing", "whand"), aliases=("ation",),
    topics=(Topic("Common words", 8, ("ortion", "the thing")), Topic("Plain words", 0, ("ntble", "and the")),
            Topic("Low words", -10, ("esing", "ingor")), Topic("Lower words", -10, ("enein", "ensch"))),
    audience=("therea", "with the"), prefer_formats=("tionen", "edble"), avoid_formats=("ndtion", "thintion"), hubs=("outre", "queque"),
    exclude_formats=("thatin", "ononst", "inoran"), exclude_topics=("hetition", "threen"), exclude_eligibility=("ereden", "achte"),
    phrases=("the thing",),
)
ORDER_RULES = Rules(
    name="orders", region="Order Region", cities=("nation 3", "nation 7"), aliases=("nation 11",),
    topics=(Topic("Home", 8, ("household", "furniture")), Topic("Build", 0, ("building",)), Topic("Machines", -10, ("machinery",)),
            Topic("Slow", -20, ("low",))),
    audience=("automobile",), prefer_formats=("urgent",), avoid_formats=("not specified",), hubs=("customer#000000007",),
    exclude_formats=("nation 1", "nation 2"), exclude_topics=("nation 4",), exclude_eligibility=("nation 5",), phrases=("order",), recommend=60, review=45,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are expensive to process."""
    return spread(table(spark, sf_dir, name))


def v_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records; hosts from customers, cities from nations."""
    joined = (texts(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
              .join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")))  # nation is fixed at 25 rows
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("approval_required")
    return joined.select(
        key.cast("string").alias("id"), key.alias("seq"), F.date_format("o_orderdate", "yyyy-MM").alias("run_id"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"), F.lit(None).cast("string").alias("description"),
        F.concat(F.lit("https://shop.example.com/o/"), key).alias("canonical_url"), F.array(F.concat(F.lit("https://www.shop.example.com/o/"), key, F.lit("?ref=x"))).alias("source_urls"),
        F.col("o_orderdate").alias("start_at"), F.lit(None).cast("timestamp").alias("end_at"), F.lit("UTC").alias("timezone"), F.col("n_name").alias("city"),
        F.lit(None).cast("string").alias("venue_text"), F.lit("city_only").alias("location_precision"),
        F.array(F.concat("c_name", F.lit(" Club"))).alias("hosts"), F.array(F.concat("c_mktsegment", F.lit(" desk"))).alias("organizers"),
        F.array(F.lit("web")).alias("platforms"), F.array().cast("array<string>").alias("visibility_flags"), status.alias("registration_status"),
        F.lower("c_mktsegment").alias("event_type"), ((key % 11) / 10).alias("confidence"), ((key * 37) % 101).cast("double").alias("score"))


V_RECORDS = """v_records AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq, strftime(o_orderdate, '%Y-%m') AS run_id, o_orderpriority || ' ' || c_mktsegment AS title,
    'https://shop.example.com/o/' || o_orderkey AS canonical_url, o_orderdate AS start_at, n_name AS city, c_name || ' Club' AS host,
    c_mktsegment || ' desk' AS organizer, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'approval_required' END AS registration_status,
    lower(c_mktsegment) AS event_type, (o_orderkey % 11) / 10.0 AS confidence, CAST((o_orderkey * 37) % 101 AS DOUBLE) AS score
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def v_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Records scored 80 and over, picked in the month of their date."""
    return v_records(spark, sf).filter("score >= 80").select(
        F.concat(F.lit("p"), "id").alias("pick_id"), "run_id", F.col("id").alias("record_id"), "score", F.lit(None).cast("string").alias("reason"), F.col("start_at").alias("created_at"))


V_PICKS = """v_picks AS (SELECT 'p' || id AS pick_id, run_id, id AS record_id, score, start_at AS created_at FROM v_records WHERE score >= 80)"""


def v_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as links: suppliers are the sources, return flags the status."""
    line = texts(spark, sf, "lineitem")
    platform = F.element_at(F.array(*[F.lit(p) for p in ("luma", "meetup", "eventbrite", "exa", "web")]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("l_linenumber"))
    status = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "error").otherwise("new")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM").alias("run_id"),
        platform.alias("platform"), F.concat(F.lit("supplier "), "l_suppkey").alias("source_query"), F.col("l_suppkey").cast("string").alias("source_id"),
        status.alias("status"), F.when(status != "new", reason).alias("rejection_reason"), F.concat(F.lit("https://shop.example.com/p/"), "l_partkey").alias("canonical_url"),
        F.col("l_orderkey").cast("string").alias("record_id"), F.concat(F.lit("part "), "l_partkey").alias("title"), F.lit("").alias("snippet"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("discovered_at"))


REASONS = ["past_event_explicit_date", "excluded_format:hackathon", "Online webinar only", "missing_date", "venue sold out", "score too low", "x_skipped_due_to_schedule_or_budget"]
V_LINES = f"""v_lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, strftime(l_shipdate, '%Y-%m') AS run_id,
    (['luma','meetup','eventbrite','exa','web'])[CAST(l_suppkey % 5 + 1 AS INT)] AS platform, 'supplier ' || l_suppkey AS source_query,
    CAST(l_suppkey AS VARCHAR) AS source_id, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'error' ELSE 'new' END AS status,
    CASE WHEN l_returnflag IN ('R','A') THEN ({REASONS!r})[l_linenumber] END AS rejection_reason, 'https://shop.example.com/p/' || l_partkey AS canonical_url,
    CAST(l_orderkey AS VARCHAR) AS record_id, 'part ' || l_partkey AS title, l_extendedprice AS price, l_shipdate AS discovered_at FROM lineitem)"""


def v_record_sources(spark: SparkSession, sf: str) -> DataFrame:
    return v_lines(spark, sf).select("record_id", F.col("id").alias("link_id"), "platform")


def v_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events as score rows of a user; several per user."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("record_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.least(F.lit(100.0), "value").alias("total"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), F.col("event_type").alias("rationale"))


V_SCORES = """v_scores AS (SELECT CAST(user_id AS VARCHAR) AS record_id, strftime(ts, '%Y-%m-%d') AS run_id, least(100.0, value) AS total, ts AS created_at, event_id AS seq,
  event_type AS rationale FROM events)"""

LABELS = {"purchase": "good", "signup": "very_my_type", "click": "want_intro", "view": "too_generic", "error": "bad"}


def v_feedback(spark: SparkSession, sf: str) -> DataFrame:
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("event_type")]
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("record_id"),
                                             label.alias("feedback_type"), F.lit(None).cast("string").alias("note"), F.col("ts").alias("created_at"))


V_FEEDBACK = ("v_feedback AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS record_id, CASE event_type "
              + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END AS feedback_type, ts AS created_at FROM events)")


def v_runs(spark: SparkSession, sf: str) -> DataFrame:
    """(user, day) activity as runs."""
    e = table(spark, sf, "events")
    errors = F.count_if(F.col("event_type") == "error")
    return e.groupBy("user_id", F.to_date("ts").alias("_d")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("_end"), F.count_if(F.col("event_type") == "view").alias("x_posts_read"), errors.alias("_errors"),
        F.count(F.lit(1)).alias("candidates_found"), F.count_if(F.col("event_type") == "click").alias("events_extracted"),
        F.count_if(F.col("event_type") == "purchase").alias("recommendations_created")).select(
        F.concat_ws(":", "user_id", F.date_format("_d", "yyyy-MM-dd")).alias("run_id"), "started_at",
        F.when(F.col("_errors") != 1, F.col("_end")).alias("finished_at"),
        F.when(F.col("_errors") == 0, "succeeded").when(F.col("_errors") == 1, "running").otherwise("failed").alias("status"),
        F.when(F.col("_errors") > 1, F.concat(F.col("_errors").cast("string"), F.lit(" errors"))).alias("error"), "x_posts_read", "candidates_found", "events_extracted",
        F.lit(0).cast("long").alias("scores_created"), "recommendations_created", F.col("_errors").alias("rejected_candidates"))


V_RUNS = """v_runs AS (
  SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS run_id, min(ts) AS started_at, CASE WHEN count(*) FILTER (event_type = 'error') <> 1 THEN max(ts) END AS finished_at,
    CASE count(*) FILTER (event_type = 'error') WHEN 0 THEN 'succeeded' WHEN 1 THEN 'running' ELSE 'failed' END AS status,
    CASE WHEN count(*) FILTER (event_type = 'error') > 1 THEN count(*) FILTER (event_type = 'error') || ' errors' END AS error,
    count(*) FILTER (event_type = 'view') AS x_posts_read, count(*) AS candidates_found, count(*) FILTER (event_type = 'click') AS events_extracted, 0 AS scores_created,
    count(*) FILTER (event_type = 'purchase') AS recommendations_created, count(*) FILTER (event_type = 'error') AS rejected_candidates
  FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'))"""


def v_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as links; the whole page text is the snippet. Every fourth title carries a date."""
    p = texts(spark, sf, "pages")
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.col("page_id").cast("int") % 900)
    dated = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" on "), F.date_format(day, "MMMM d, yyyy"))).otherwise(F.lit(""))
    canonical = link_url(F.col("url"))
    return p.select(
        F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("seq"), F.lit("web").alias("platform"), F.col("url").alias("source_url"), "url",
        canonical.alias("canonical_url"), F.lit(None).cast("string").alias("source_query"), F.lit(None).cast("string").alias("source_id"),
        F.concat(F.coalesce(html_title(F.col("html")), F.lit("")), dated).alias("title"), html_to_text(F.col("html")).alias("snippet"),
        F.lit(PAGES_AS_OF).cast("timestamp").alias("discovered_at"))


_SPACE = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def sql_entities(expr: str, nbsp: bool = True) -> str:
    first = f"replace({expr}, '&nbsp;', ' ')" if nbsp else expr
    return f"replace(replace(replace(replace(replace({first}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"


def sql_strip(expr: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({expr}, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), "
            "'<[^>]+>', ' ', 'g')")


def sql_text(expr: str) -> str:
    return f"trim(regexp_replace({sql_entities(sql_strip(expr))}, '{_SPACE}', ' ', 'g'))"


def sql_title(html: str = "html") -> str:
    return f"trim({sql_entities(sql_strip(f'''nullif(regexp_extract({html}, '<title[^>]*>(.*?)</title>', 1, 'is'), '')'''), nbsp=False)})"


_TRACK = ("'fbclid','gclid','igshid','mc_cid','mc_eid','mkt_tok','ref','ref_src','referrer','spm'")


def sql_link_url(url: str) -> str:
    """Form A for http(s) urls whose parameters need no re-encoding."""
    path = f"regexp_replace(regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')"
    params = (f"list_sort(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') "
              f"AND lower(split_part(p, '=', 1)) NOT IN ({_TRACK})))")
    return (f"(regexp_extract({url}, '^(https?)://', 1) || '://' || regexp_replace(lower(regexp_extract({url}, '^https?://([^/?#]+)', 1)), '^www\\.', '') || "
            f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END)")


V_LINKS = f"""v_links AS (
  SELECT CAST(page_id AS VARCHAR) AS id, page_id AS seq, 'web' AS platform, url, {sql_link_url('url')} AS canonical_url,
    coalesce({sql_title()}, '') || CASE WHEN page_id % 4 = 0 THEN ' on ' || strftime(DATE '2023-01-01' + CAST(page_id % 900 AS INT), '%B %-d, %Y') ELSE '' END AS title,
    {sql_text('html')} AS snippet FROM pages)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- SQL forms of the text functions ----------------------------------------------------


def sql_match_text(expr: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({expr})), '[^a-z0-9+&#@]+', ' ', 'g'))"


def sql_title_text(expr: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({expr})), '[^a-z0-9]+', ' ', 'g'))"


def sql_hit(text: str, *keywords: str) -> str:
    """Whole-word, plural-tolerant match of any keyword in normalised text."""
    from ..functions.rules import keyword_body, normal_keyword

    bodies = "|".join(keyword_body(k) for k in keywords if normal_keyword(k))
    return f"regexp_matches({text}, '(^|[^a-z0-9])(?:{bodies})($|[^a-z0-9])')"


def sql_first_hit(text: str, keywords) -> str:
    return "CASE " + " ".join(f"WHEN {sql_hit(text, k)} THEN '{k}'" for k in keywords) + " END"


def sql_hits(text: str, keywords) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_hit(text, k)} THEN '{k}' END" for k in keywords) + "], lambda k: k IS NOT NULL)"


def sql_tokens(expr: str, stop: list[str]) -> str:
    """Distinct title tokens in first-seen order."""
    words = ", ".join(f"'{w}'" for w in stop)
    base = f"list_filter(string_split({sql_title_text(expr)}, ' '), lambda w: length(w) > 1 AND w NOT IN ({words}))"
    return f"list_sort(list_distinct({base}))"
