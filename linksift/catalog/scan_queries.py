"""Scans of landed bodies, job tables, snapshots, report bundle and the whole batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import batch, report
from ..session import cut_lineage, scratch_path
from ..sources import landed, snapshot
from ..sources.tables import Tables
from . import query
from . import views as V
from .rollup_queries import month_runs

C = F.col
R = V.TEXT_RULES


@query("search_results_scan", """SELECT CAST(doc_id AS VARCHAR) AS source_id, substr(sha1('run' || chr(10) || 'q' || chr(10) || u), 1, 24) AS id, u AS canonical_url, CASE WHEN doc_id % 4 = 0 THEN u ELSE 'doc ' || doc_id END AS title,
  md5(CASE doc_id % 3 WHEN 0 THEN text || chr(10) || 'more' WHEN 1 THEN text ELSE substr(text, 1, 500) END) AS snippet_md5, CASE WHEN doc_id % 2 = 0 THEN 'meetup' ELSE 'exa' END AS platform, source AS source_name
  FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'https://meetup.com/g/' ELSE 'https://docs.example.com/' END || doc_id AS u FROM documents)""")
def search_results_scan(spark, sf):
    d = V.texts(spark, sf, "documents")
    k = C("doc_id")
    url = F.concat(F.when(k % 2 == 0, "https://www.meetup.com/g/").otherwise("https://docs.example.com/"), k, F.lit("/?utm_source=feed"))
    result = F.struct(k.cast("string").alias("id"), F.when(k % 4 != 0, F.concat(F.lit("doc "), k)).alias("title"), url.alias("url"), C("source").alias("author"),
                      F.when(k % 3 == 0, F.array("text", F.lit("more"))).alias("highlights"), F.when(k % 3 == 1, C("text")).alias("summary"), C("text").alias("text"))
    no_url = F.struct(F.lit("x").alias("id"), F.lit("no url").alias("title"), F.lit(None).cast("string").alias("url"), C("source").alias("author"), F.array("text").alias("highlights"), C("text").alias("summary"), C("text").alias("text"))
    responses = d.select(F.lit("q").alias("query_id"), F.lit("docs").alias("query_text"), F.to_json(F.struct(F.array(result, no_url).alias("results"))).alias("body"))
    return landed.search_results(responses, R, V.PAGES_AS_OF, "run").select("source_id", "id", "canonical_url", "title", F.md5("snippet").alias("snippet_md5"), "platform", "source_name")


@query("social_posts_scan", """SELECT source_id, url, title, handle AS source_handle, rejected_without_link FROM (SELECT conv_id || '-' || turn AS source_id, unnest(CASE turn % 3 WHEN 0 THEN ['https://x.com/' || role || '/status/' || conv_id || '-' || turn] WHEN 1 THEN ['https://lu.ma/c' || conv_id] ELSE ['https://lu.ma/c' || conv_id, 'https://e.example.com/' || turn] END) AS url,
  'X post from @' || role AS title, role AS handle, turn % 3 = 0 AS rejected_without_link FROM conversations)""")
def social_posts_scan(spark, sf):
    c = V.table(spark, sf, "conversations")
    pid = F.concat_ws("-", "conv_id", "turn")
    k = C("turn") % 3
    entity = F.when(k > 0, F.array(F.struct(F.concat(F.lit("https://lu.ma/c"), "conv_id").alias("expanded_url"), F.lit(None).cast("string").alias("unwound_url"), F.lit("https://t.co/a").alias("url"))))
    body_text = F.when(k == 2, F.concat(C("text"), F.lit(" https://e.example.com/"), C("turn"), F.lit(". https://t.co/b"))).otherwise(F.concat(C("text"), F.lit(" https://t.co/b")))
    post = F.struct(pid.alias("id"), body_text.alias("text"), C("role").alias("author_id"), F.lit("2024-06-01T10:00:00Z").alias("created_at"), F.struct(entity.alias("urls")).alias("entities"))
    user = F.struct(C("role").alias("id"), C("role").alias("username"), F.initcap("role").alias("name"))
    responses = c.select(F.lit("q").alias("query_id"), F.lit("posts").alias("query_text"), F.to_json(F.struct(F.array(post).alias("data"), F.struct(F.array(user).alias("users")).alias("includes"))).alias("body"))
    out = landed.social_posts(responses, R, V.PAGES_AS_OF, "run")
    return out.select("source_id", "url", "title", "source_handle", F.coalesce(C("rejection_reason") == landed.NO_POST_LINK, F.lit(False)).alias("rejected_without_link"))


_BASE = V.sql_link_url("url")


@query("page_links_scan", f"""SELECT page_id, canonical_url, status_kind FROM (SELECT page_id, CASE WHEN page_id % 10 = 9 OR page_id % 3 > 0 THEN {_BASE} ELSE regexp_extract({_BASE}, '^https?://[^/?#]+', 0) || '/events/' || page_id END AS canonical_url,
  CASE WHEN page_id % 10 = 9 THEN 'public_source_fetch_failed' WHEN page_id % 3 > 0 THEN 'public_source_no_event_links' ELSE 'link' END AS status_kind FROM pages) UNION ALL SELECT page_id, 'https://lu.ma/p' || page_id, 'link' FROM pages WHERE page_id % 10 <> 9 AND page_id % 3 = 0""")
def page_links_scan(spark, sf):
    p = V.texts(spark, sf, "pages")
    k = C("page_id")
    extra = F.when(k % 3 == 0, F.concat(F.lit('<a class="x" href="/events/'), k, F.lit('">e</a><a href="https://lu.ma/p'), k, F.lit('?utm_source=a">l</a><a href="mailto:a@b.c">m</a><a href="/static/events.png">i</a>'))).otherwise(F.lit(""))
    landed_pages = p.select(k.cast("string").alias("query_id"), k.cast("string").alias("query_text"), "url", F.concat("html", extra).alias("html"), F.when(k % 10 == 9, F.lit("HTTP 500")).alias("fetch_error"))
    out = landed.page_links(landed_pages, R, V.PAGES_AS_OF, "run")
    kind = F.when(C("rejection_reason").isin(landed.NO_LINKS, landed.FETCH_FAILED), C("rejection_reason")).otherwise("link")
    return out.select(C("source_query").cast("long").alias("page_id"), "canonical_url", kind.alias("status_kind"))


@query("feed_scan", f"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'https://f.example.com/feed/' || doc_id WHEN doc_id % 3 = 0 THEN 'https://lu.ma/d' || doc_id ELSE 'https://f.example.com/' || doc_id END AS canonical_url,
  CASE WHEN doc_id % 5 = 4 THEN 'RSS feed failed: https://f.example.com/feed/' || doc_id ELSE 'Item ' || doc_id END AS title, CASE WHEN doc_id % 5 = 4 THEN 'error' ELSE 'entry' END AS kind FROM documents""")
def feed_scan(spark, sf):
    d = V.texts(spark, sf, "documents")
    k = C("doc_id")
    inner = F.concat(F.lit("<![CDATA["), F.regexp_replace("text", "\\]\\]>|<|>", " "), F.lit("]]>"), F.when(k % 3 == 0, F.concat(F.lit(" https://lu.ma/d"), k, F.lit("?utm_source=nl."))).otherwise(F.lit("")))
    link = F.concat(F.lit("https://f.example.com/"), k)
    rss = F.concat(F.lit("<rss><channel><item><title>Item "), k, F.lit("</title><link>"), link, F.lit("</link><description>"), inner, F.lit("</description><pubDate>Mon, 03 Jun 2024 10:00:00 GMT</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>Item "), k, F.lit('</title><link rel="alternate" href="'), link, F.lit('"/><summary>'), inner, F.lit("</summary><updated>2024-06-03T10:00:00Z</updated></entry></feed>"))
    body = F.when(k % 5 == 4, F.lit("not a feed")).when(k % 4 == 0, atom).otherwise(rss)
    feeds = d.select(k.cast("string").alias("query_id"), k.cast("string").alias("query_text"), F.concat(F.lit("https://f.example.com/feed/"), k).alias("feed_url"), body.alias("body"))
    out = landed.feed_links(feeds, R, V.PAGES_AS_OF, "run")
    return out.select(C("source_query").cast("long").alias("doc_id"), "canonical_url", "title", F.when(C("status") == "error", "error").otherwise("entry").alias("kind"))


@query("seed_scan", "SELECT 'https://lu.ma/s' || s_suppkey AS canonical_url, 'Luma public surface: s' || s_suppkey AS title, 'rejected' AS status, 'luma_calendar_seed_not_event' AS rejection_reason FROM supplier")
def seed_scan(spark, sf):
    seeds = V.table(spark, sf, "supplier").select(F.concat(F.lit("https://lu.ma/s"), "s_suppkey", F.lit("/")).alias("url"), C("s_suppkey").alias("position"))
    return landed.seed_links(seeds, R, V.PAGES_AS_OF, "run").select("canonical_url", "title", "status", "rejection_reason")


@query("united_connectors", "SELECT 'https://lu.ma/s' || s_suppkey AS canonical_url, 'luma' AS platform, 'luma_public_seed' AS source_query FROM supplier UNION ALL SELECT 'https://d.example.com/' || c_custkey, 'exa', 'customers' FROM customer")
def united_connectors(spark, sf):
    seeds = V.table(spark, sf, "supplier").select(F.concat(F.lit("https://lu.ma/s"), "s_suppkey").alias("url"), C("s_suppkey").alias("position"))
    seed_rows = landed.seed_links(seeds, R, V.PAGES_AS_OF, "run")
    result = F.struct(F.lit(None).cast("string").alias("id"), C("c_name").alias("title"), F.concat(F.lit("https://d.example.com/"), "c_custkey").alias("url"), F.array("c_mktsegment").alias("highlights"))
    responses = V.table(spark, sf, "customer").select(F.lit("q").alias("query_id"), F.lit("customers").alias("query_text"), F.to_json(F.struct(F.array(result, result).alias("results"))).alias("body"))
    found = landed.search_results(responses, R, V.PAGES_AS_OF, "run")
    return landed.unite_connectors(found, seed_rows, seed_rows).select("canonical_url", "platform", "source_query")


# --- Job tables -----------------------------------------------------------------------------


@query("stored_links", V.with_ctes(V.V_LINES, select="SELECT canonical_url, CASE WHEN bool_or(status = 'rejected') THEN 'rejected' ELSE 'new' END AS status, min(title) AS title FROM v_lines GROUP BY canonical_url"))
def stored_links(spark, sf):
    """Links saved once as new, then saved again with the rejections of a second pass."""
    tables = Tables(spark, scratch_path(spark, "links"))
    lines = V.v_lines(spark, sf).drop("record_id", "price").withColumn("id", C("canonical_url"))
    first = lines.groupBy("id").agg(F.min("canonical_url").alias("canonical_url"), F.min("title").alias("title"), F.lit("new").alias("status"))
    tables.save_links(first.withColumn("pass", F.lit(1)), "pass")
    tables.save_links(lines.filter("status = 'rejected'").dropDuplicates(["id"]).withColumns({"title": F.lit("not taken"), "pass": F.lit(2)}), "pass")
    return tables.read("links").select("canonical_url", "status", "title")


@query("stored_scores", V.with_ctes(V.V_RECORDS, V.V_PICKS, select="SELECT (SELECT count(*) FROM v_records) * 2 AS scores, (SELECT count(*) FROM v_picks) AS picks"))
def stored_scores(spark, sf):
    """Scores append, picks insert once however often they are saved."""
    tables = Tables(spark, scratch_path(spark, "scores"))
    scores = V.v_records(spark, sf).select(C("id").alias("record_id"), C("score").alias("total"), F.lit("apply").alias("next_action"), F.lit(True).alias("should_recommend"))
    for run in ("a", "b", "a"):  # the last one is a retry
        tables.save_scores(scores, run, "heuristic", "orders", 80)
        tables.save_picks(V.v_picks(spark, sf))
    n = tables.read("scores").agg(F.count(F.lit(1)).alias("scores"))
    return n.crossJoin(tables.read("picks").agg(F.count(F.lit(1)).alias("picks")))  # two one-row tables


@query("stored_sources", """SELECT CAST(l_suppkey AS VARCHAR) AS id, (qa + qb) / 2 AS quality_score, n AS events_found FROM (SELECT l_suppkey, avg(l_quantity) AS qa, max(l_quantity) AS qb, count(*) * 2 AS n FROM lineitem GROUP BY l_suppkey)""")
def stored_sources(spark, sf):
    """Two batches merged into the stored source rows."""
    tables = Tables(spark, scratch_path(spark, "sources"))
    line = V.table(spark, sf, "lineitem")
    for agg in (F.avg, F.max):
        tables.save_sources(line.groupBy(C("l_suppkey").cast("string").alias("id")).agg(agg("l_quantity").alias("quality_score"), F.lit(0.1).alias("noise_rate"), F.lit(75.0).alias("freshness_score"),
                                                                                     F.count(F.lit(1)).alias("events_found"), F.lit(0).alias("recommended_events")))
    return tables.read("sources").select("id", "quality_score", "events_found")


@query("stored_runs", V.with_ctes(V.V_RUNS, select="SELECT run_id, CASE WHEN status = 'running' THEN 'running' ELSE status END AS status, candidates_found, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at FROM v_runs"))
def stored_runs(spark, sf):
    """Run lifecycle from an append-only log: created, then finished or failed."""
    tables = Tables(spark, scratch_path(spark, "runs"))
    runs = V.v_runs(spark, sf)
    tables.log_run(runs.select("run_id", F.lit(0).alias("seq"), "started_at", F.lit("running").alias("status"), "candidates_found"))
    ended = runs.filter("status <> 'running'").select("run_id", F.lit(1).alias("seq"), "finished_at", "status", "error")
    tables.log_run(ended.unionByName(runs.filter("status = 'running' and finished_at is not null").select("run_id", F.lit(1).alias("seq"), "finished_at", "status", "error")))
    return tables.runs().select("run_id", "status", "candidates_found", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


@query("stored_queries", "SELECT 'run:' || s_suppkey AS id, 'second ' || s_name AS query_text, CAST(s_nationkey AS BIGINT) AS budget_cost FROM supplier")
def stored_queries(spark, sf):
    tables = Tables(spark, scratch_path(spark, "queries"))
    s = V.table(spark, sf, "supplier")
    for word, seq in (("second ", 2), ("first ", 1)):  # the older rows come late
        tables.save_queries(s.select(F.lit(seq).alias("seq"), C("s_suppkey").cast("string").alias("id"), F.concat(F.lit(word), "s_name").alias("query_text"), C("s_nationkey").alias("budget_cost")), "run", "seq")
    return tables.read("queries").select("id", "query_text", "budget_cost")


_TIME = "yyyy-MM-dd HH:mm:ss"


@query("stored_records", V.with_ctes(V.V_RECORDS, select="SELECT id, 'again ' || title AS title, strftime(start_at - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(start_at + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS last_seen FROM v_records"))
def stored_records(spark, sf):
    """Records saved, seen again a day later, then an older sighting that comes late."""
    tables = Tables(spark, scratch_path(spark, "records"))
    records = V.v_records(spark, sf)
    for order, days, title in ((2, 0, C("title")), (3, 1, F.concat(F.lit("again "), "title")), (1, -1, F.lit("late"))):
        seen = C("start_at").cast("timestamp") + F.make_dt_interval(days=F.lit(days))
        tables.save_records(records.withColumns({"title": title, "first_seen": seen, "last_seen": seen, "order": F.lit(order)}), "order")
    return tables.read("records").select("id", "title", F.date_format("first_seen", _TIME).alias("first_seen"), F.date_format("last_seen", _TIME).alias("last_seen"))


@query("stored_record_sources", V.with_ctes(V.V_LINES, select="SELECT DISTINCT record_id, id AS link_id, platform FROM v_lines"))
def stored_record_sources(spark, sf):
    """Attribution rows saved under another platform first."""
    tables = Tables(spark, scratch_path(spark, "attribution"))
    rows = V.v_lines(spark, sf).select("record_id", C("id").alias("link_id"), "platform")
    for order, platform in enumerate((F.lit("other"), C("platform"))):
        tables.save_record_sources(rows.withColumns({"platform": platform, "order": F.lit(order)}), "order")
    return tables.read("record_sources").select("record_id", "link_id", "platform")


@query("stored_edges", """SELECT l_suppkey || '-' || l_partkey AS id, CAST(l_suppkey AS VARCHAR) AS from_id, CAST(count(*) * 2 AS DOUBLE) AS weight, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen,
  strftime(max(l_shipdate) + INTERVAL 1 DAY, '%Y-%m-%d') AS last_seen FROM lineitem GROUP BY l_suppkey, l_partkey""")
def stored_edges(spark, sf):
    """Edges from suppliers to parts, saved again with twice the weight; only weight and last sight change."""
    tables = Tables(spark, scratch_path(spark, "edges"))
    shipped = C("l_shipdate").cast("timestamp")
    edges = V.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min(shipped).alias("first_seen"), F.max(shipped).alias("last_seen")).select(
        F.concat_ws("-", "l_suppkey", "l_partkey").alias("id"), C("l_suppkey").cast("string").alias("from_id"), C("n").alias("weight"), "first_seen", "last_seen")
    tables.save_edges(edges.withColumn("order", F.lit(1)), "order")
    tables.save_edges(edges.withColumns({"from_id": F.lit("not taken"), "weight": C("weight") * 2, "first_seen": C("first_seen") + F.expr("interval 1 day"),
                                         "last_seen": C("last_seen") + F.expr("interval 1 day"), "order": F.lit(2)}), "order")
    day = {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")}
    return tables.read("source_edges").withColumns(day).select("id", "from_id", "weight", "first_seen", "last_seen")


@query("stored_feedback", V.with_ctes(V.V_FEEDBACK, select="SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'rejected' ELSE 'stored' END AS state FROM v_feedback"))
def stored_feedback(spark, sf):
    """Feedback with a label nobody knows on every seventh row: stored or handed back."""
    tables = Tables(spark, scratch_path(spark, "feedback"))
    label = F.when(C("id").cast("long") % 7 == 0, "nobody knows").otherwise(C("feedback_type"))
    rejected = tables.save_feedback(V.v_feedback(spark, sf).withColumn("feedback_type", label))
    return tables.read("feedback").select("id", F.lit("stored").alias("state")).unionByName(rejected.select("id", F.lit("rejected").alias("state")))


@query("stored_hunts", V.with_ctes(V.V_RUNS, V.V_FEEDBACK, select="SELECT 'hunt' AS kind, run_id AS id, CAST(candidates_found AS BIGINT) AS n FROM v_runs UNION ALL SELECT 'miss', record_id, count(*) FROM v_feedback WHERE feedback_type = 'bad' GROUP BY record_id"))
def stored_hunts(spark, sf):
    """Runs as hunts, bad feedback as what they missed."""
    tables = Tables(spark, scratch_path(spark, "hunts"))
    hunts = V.v_runs(spark, sf).select(C("run_id").alias("id"), "run_id", C("candidates_found").alias("checked"))
    misses = V.v_feedback(spark, sf).filter("feedback_type = 'bad'").select("id", C("record_id").alias("hunt_id"), C("note").alias("title"))
    tables.save_hunt(hunts, misses)
    missed = tables.read("misses").groupBy(C("hunt_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return tables.read("hunts").select(F.lit("hunt").alias("kind"), "id", C("checked").alias("n")).unionByName(missed.select(F.lit("miss").alias("kind"), "id", "n"))


@query("snapshot_tables", V.with_ctes(V.V_FEEDBACK, V.V_RECORDS, V.V_PICKS, select="SELECT 'feedback' AS name, count(*) AS n FROM v_feedback UNION ALL SELECT 'recommendations', count(*) FROM v_picks UNION ALL SELECT 'runs', 0"))
def snapshot_tables(spark, sf):
    """Tables written as a snapshot version and read back; an absent table is empty."""
    target = snapshot.write_snapshot({"feedback": V.v_feedback(spark, sf), "recommendations": V.v_picks(spark, sf), "runs": spark.createDataFrame([], snapshot.SNAPSHOT_TABLES["runs"])},
                                     scratch_path(spark, "snapshot"), 1)
    back = {n: spark.read.schema(snapshot.SNAPSHOT_TABLES[n]).json(f"{target}/{n}") for n in ("feedback", "recommendations", "runs")}
    out = None
    for name, df in back.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- Report and batch -------------------------------------------------------------------------


def job_tables(spark, sf):
    runs = month_runs(spark, sf).withColumns({"status": F.lit("succeeded"), "error": F.lit(None).cast("string"), "finished_at": C("started_at"), "x_enabled": F.lit(True),
                                              "x_budget_remaining": F.lit(5), "x_posts_read": C("candidates_found")})
    records = V.v_records(spark, sf)
    scores = records.select("run_id", C("id").alias("record_id"), C("score").alias("total"), C("start_at").alias("created_at"), "seq", F.lit(None).cast("string").alias("rationale"))
    misses = V.v_feedback(spark, sf).filter("feedback_type = 'bad'")
    return {"runs": runs, "links": V.v_lines(spark, sf), "records": records, "scores": scores, "picks": V.v_picks(spark, sf), "record_sources": V.v_record_sources(spark, sf),
            "feedback": V.v_feedback(spark, sf), "misses": misses}


@query("report_bundle")
def report_bundle(spark, sf):
    """Row count of every report section."""
    sections = report.build_report(job_tables(spark, sf), V.TEXT_RULES, V.AS_OF)
    out = None
    for name, df in sections.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("section"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("batch_picks")
def batch_picks(spark, sf):
    """The whole batch over pages: assessed links, records coerced from JSON, merge, score, picks."""
    from ..plans.links import assess_links
    from .link_queries import platform_links

    links = cut_lineage(assess_links(platform_links(spark, sf), R, V.PAGES_AS_OF.date()))  # links are saved before they are ranked
    url = F.concat(F.lit("https://r.example.com/"), "id")
    start = F.date_format(F.date_add(F.lit("2024-06-16").cast("date"), (C("seq") % 40).cast("int")), "yyyy-MM-dd'T'12:00:00'Z'")
    record = F.to_json(F.struct("id", url.alias("canonical_url"), F.array(url).alias("source_urls"), "title", C("snippet").alias("description"), start.alias("start_at"), F.lit("city").alias("location_precision"),
                                F.array("platform").alias("platforms"), F.lit("open").alias("registration_status"), F.lit(90).alias("confidence")))
    raw = links.select(C("id").alias("link_id"), record.alias("raw"))
    empty_picks, empty_records = V.v_picks(spark, sf).limit(0), V.v_records(spark, sf).limit(0)
    rules = R.__class__(**{**R.__dict__, "recommend": 60, "review": 40})
    result = batch.run_batch(links, raw, empty_picks, empty_records, rules, V.PAGES_AS_OF, "run")
    return result.picks.select("record_id", "score")
