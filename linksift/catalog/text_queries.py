"""Column jobs: urls, text, dates, ids, coercion, presentation."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions import coerce, dates, presentation, text, urls
from ..functions import rules as R
from ..operators.dedupe import dedupe_key, match_city, report_city, report_keys

from ..plans.rotation import rotation_slot
from . import query
from . import views as V

C = F.col

# Page urls moved onto the known platforms, so that every platform rule is exercised.
_HOSTS = ["lu.ma", "www.meetup.com", "eventbrite.com", "partiful.com", "linkedin.com", "blog.substack.com", "x.com"]


def platform_urls(spark, sf):
    p = V.texts(spark, sf, "pages").select("page_id", "url")
    host = F.element_at(F.array(*[F.lit(h) for h in _HOSTS]), (C("page_id") % 8).cast("int"))
    moved = F.concat(F.lit("https://"), host, F.element_at(F.array(*[F.lit(x) for x in ("", "/events", "/explore")]), (C("page_id") % 3 + 1).cast("int")),
                     F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1))
    return p.select("page_id", F.when(C("page_id") % 8 > 0, moved).otherwise(C("url")).alias("url"))


P_URLS = f"""p_urls AS (SELECT page_id, CASE WHEN page_id % 8 > 0 THEN 'https://' || ({_HOSTS!r})[CAST(page_id % 8 AS INT)] || (['', '/events', '/explore'])[CAST(page_id % 3 + 1 AS INT)]
  || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) ELSE url END AS url FROM pages)"""


def _sql_light(strip_www: bool, tracking: str) -> str:
    parts = "string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')"
    kept = f"list_filter({parts}, lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '{tracking}'))"
    host = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
    host = f"regexp_replace({host}, '^www\\.', '')" if strip_www else host
    path = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
    return (f"regexp_replace(regexp_extract(url, '^(https?)://', 1) || '://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
            f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END, '/$', '')")


_C = _sql_light(True, "(?i)^(utm_|ref$|referrer$|source$|fbclid$|gclid$)")


@query("canonical_links", f"""SELECT page_id, {V.sql_link_url('url')} AS form_a, {_sql_light(False, '^(utm_.*|ref|ref_src|fbclid|gclid)$')} AS form_b,
  {_C} AS form_c, lower({_C}) AS form_d FROM pages""")
def canonical_links(spark, sf):
    return V.texts(spark, sf, "pages").select("page_id", *[urls.canonical_url(C("url"), m).alias(f"form_{m.lower()}") for m in "ABCD"])


@query("url_facts", V.with_ctes(P_URLS, select="""SELECT page_id, host, path,
  CASE WHEN host = 'lu.ma' THEN 'luma' WHEN host LIKE '%meetup.com' THEN 'meetup' WHEN host LIKE '%eventbrite.com' THEN 'eventbrite' ELSE 'web' END AS page_platform,
  CASE WHEN host = 'lu.ma' THEN 'luma' WHEN host LIKE '%meetup.com' THEN 'meetup' WHEN host LIKE '%eventbrite.com' THEN 'eventbrite' WHEN host LIKE '%linkedin.com' THEN 'linkedin_indexed' ELSE 'exa' END AS search_platform,
  host IN ('lu.ma','www.meetup.com','eventbrite.com','partiful.com') AS known_platform,
  regexp_matches(path, '(?i)\\.(ico|png|jpe?g|gif|svg|webp|avif|css|js|mjs|json|xml|txt|woff2?|ttf|otf|map|pdf|mp4|webm|webmanifest)$')
    OR (host IN ('lu.ma','www.meetup.com','eventbrite.com','partiful.com') AND (string_split(path, '/')[2] IN ('explore','blog','home','search') OR path = '/')) AS never_a_record,
  regexp_matches(lower(path), 'event|events|calendar|rsvp|register|tickets|startup-school|after-hours') AS record_path,
  CASE WHEN host = 'lu.ma' THEN 'luma_calendar' WHEN host = 'x.com' THEN 'x_account' WHEN host = 'linkedin.com' THEN 'linkedin_indexed_author' WHEN host LIKE '%meetup%' THEN 'meetup_group'
    WHEN host LIKE '%eventbrite%' THEN 'eventbrite_organizer' WHEN host LIKE '%partiful%' THEN 'organizer_site' WHEN host LIKE '%substack%' THEN 'newsletter'
    WHEN host LIKE '%vc%' OR lower(path) LIKE '%ventures%' THEN 'vc_page' WHEN host LIKE '%founder%' THEN 'founder_house' ELSE 'organizer_site' END AS source_type
  FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
    CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS path FROM p_urls)"""))
def url_facts(spark, sf):
    base = platform_urls(spark, sf).select("page_id", urls.host_of(C("url")).alias("host"), urls.path_of(C("url")).alias("path"))
    return base.select(
        "page_id", "host", "path", urls.page_platform(C("host")).alias("page_platform"), urls.search_platform(C("host")).alias("search_platform"),
        urls.known_platform(C("host")).alias("known_platform"), urls.never_a_record(C("host"), C("path"), C("host").isNotNull()).alias("never_a_record"),
        urls.path_suggests_record(C("path")).alias("record_path"), urls.source_type(C("host"), C("path")).alias("source_type"))


@query("page_text", f"""SELECT page_id, {V.sql_title()} AS title, md5(body) AS body_md5, length(body) AS body_length, md5({V.sql_text('html')}) AS text_md5 FROM (
  SELECT page_id, html, {V.sql_text('''coalesce(nullif(regexp_extract(html, '<main.*?</main>', 0, 'is'), ''), nullif(regexp_extract(html, '<article.*?</article>', 0, 'is'), ''), nullif(regexp_extract(html, '<body.*?</body>', 0, 'is'), ''), html)''')} AS body FROM pages)""")
def page_text(spark, sf):
    p = V.texts(spark, sf, "pages").withColumn("_body", text.readable_text(C("html")))
    return p.select("page_id", text.html_title(C("html")).alias("title"), F.md5("_body").alias("body_md5"), F.length("_body").cast("long").alias("body_length"),
                    F.md5(text.html_to_text(C("html"))).alias("text_md5"))


@query("text_forms", f"SELECT doc_id, md5({V.sql_match_text('text')}) AS match_md5, md5({V.sql_title_text('text')}) AS title_md5, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS plain_md5, md5(trim(regexp_replace(replace(lower(text), '&amp;', 'and'), '[^a-z0-9]+', ' ', 'g'))) AS history_md5 FROM documents")
def text_forms(spark, sf):
    t = C("text")
    return V.texts(spark, sf, "documents").select("doc_id", F.md5(text.match_text(t)).alias("match_md5"), F.md5(text.title_text(t)).alias("title_md5"),
                                                  F.md5(text.plain_title(t)).alias("plain_md5"), F.md5(text.history_text(t)).alias("history_md5"))


@query("urls_in_text", """SELECT page_id, len(u) AS n_urls, array_to_string(list_sort(u), ' ') AS urls FROM (
  SELECT page_id, list_distinct(list_transform(regexp_extract_all(html || ' see ' || url || ', and (' || url || ').', '(?i)https?://[^\\s<>"'')\\]]+'), lambda x: regexp_replace(x, '[.,;:!?]+$', ''))) AS u FROM pages)""")
def urls_in_text(spark, sf):
    body = F.concat(C("html"), F.lit(" see "), C("url"), F.lit(", and ("), C("url"), F.lit(")."))
    return V.texts(spark, sf, "pages").select("page_id", text.urls_in_text(body).alias("u")).select(
        "page_id", F.size("u").cast("long").alias("n_urls"), F.array_join(F.sort_array("u"), " ").alias("urls"))


@query("feed_text", f"SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace('<![CDATA[' || text || ']]> <b>x &amp; y</b>', '<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'gs'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '{V._SPACE}', ' ', 'g'))) AS clean_md5 FROM documents")
def feed_text(spark, sf):
    wrapped = F.concat(F.lit("<![CDATA["), C("text"), F.lit("]]> <b>x &amp; y</b>"))
    return V.texts(spark, sf, "documents").select("doc_id", F.md5(text.feed_text(wrapped)).alias("clean_md5"))


@query("stable_ids", "SELECT c_custkey, substr(sha1(c_name || chr(10) || c_mktsegment || chr(10) || c_nationkey), 1, 24) AS id FROM customer")
def stable_ids(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", text.stable_id(C("c_name"), C("c_mktsegment"), C("c_nationkey")).alias("id"))


SLOT_TEXT = "s_name || ':19723'"


def _sql_hash(expr: str) -> str:
    return f"list_reduce(list_transform(string_split({expr}, ''), lambda c: CAST(ascii(c) AS HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS HUGEINT))"


@query("rotation_slots", f"SELECT s_suppkey, CAST({_sql_hash(SLOT_TEXT)} AS BIGINT) AS slot FROM supplier")
def rotation_slots(spark, sf):
    return V.table(spark, sf, "supplier").select("s_suppkey", rotation_slot(C("s_name"), F.lit("2024-01-01").cast("date")).alias("slot"))


def page_titles(spark, sf):
    return V.texts(spark, sf, "pages").select("page_id", text.html_title(C("html")).alias("title"))


@query("title_tokens", f"SELECT page_id, array_to_string({V.sql_tokens('t', text.DEDUPE_STOP_WORDS)}, ' ') AS dedupe_tokens, array_to_string({V.sql_tokens('t', text.REPORT_STOP_WORDS)}, ' ') AS report_tokens FROM (SELECT page_id, {V.sql_title()} AS t FROM pages)")
def title_tokens(spark, sf):
    return page_titles(spark, sf).select("page_id", *[F.array_join(F.sort_array(text.title_tokens(C("title"), stop)), " ").alias(n)
                                                      for n, stop in (("dedupe_tokens", text.DEDUPE_STOP_WORDS), ("report_tokens", text.REPORT_STOP_WORDS))])


@query("query_fingerprints", """SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(q), '(^|[^a-z0-9_])20[0-9]{2}($|[^a-z0-9_])', '\\1\\2', 'g'), 'site:[^\\s)]+', '', 'g'), '[^a-z0-9]+'),
  lambda w: length(w) > 2 AND w NOT IN ('the','and','for','with','from','events','event','upcoming')))), ' ') AS fingerprint FROM (SELECT page_id, '"' || """ + V.sql_title() + """ || '" (site:lu.ma) events 2024' AS q FROM pages)""")
def query_fingerprints(spark, sf):
    q = F.concat(F.lit('"'), C("title"), F.lit('" (site:lu.ma) events 2024'))
    return page_titles(spark, sf).select("page_id", F.array_join(F.sort_array(F.split(text.query_fingerprint(q), " ")), " ").alias("fingerprint"))


@query("label_slugs", f"SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace({V.sql_match_text('''p_name || ' / ' || p_brand''')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'topic') AS slug FROM part")
def label_slugs(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", text.label_slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("city_forms", """SELECT c_custkey, CASE WHEN c IN ('unknown city', 'unknown') THEN '' WHEN c = 'sf' THEN 'san francisco' ELSE c END AS match_city, CASE WHEN c = 'unknown' THEN '' WHEN c = 'sf' THEN 'san francisco' ELSE c END AS report_city
  FROM (SELECT c_custkey, trim(regexp_replace(lower(coalesce(city, '')), '[^a-z0-9]+', ' ', 'g')) AS c FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'SF' WHEN 1 THEN 'Unknown' WHEN 2 THEN NULL WHEN 3 THEN 'San-Francisco' ELSE c_mktsegment END AS city FROM customer))""")
def city_forms(spark, sf):
    k = C("c_custkey") % 5
    city = F.when(k == 0, "SF").when(k == 1, "Unknown").when(k == 3, "San-Francisco").when(k == 4, C("c_mktsegment"))
    return V.table(spark, sf, "customer").withColumn("city", city).select("c_custkey", match_city(C("city")).alias("match_city"), report_city(C("city")).alias("report_city"))


@query("local_dates", """SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE zone, '%Y-%m-%d') AS local_date FROM (
  SELECT event_id, ts, (['America/Los_Angeles', 'Asia/Tokyo', 'UTC'])[CAST(event_id % 3 + 1 AS INT)] AS zone FROM events)""")
def local_dates(spark, sf):
    zone = F.element_at(F.array(*[F.lit(z) for z in ("America/Los_Angeles", "Asia/Tokyo", "UTC")]), (C("event_id") % 3 + 1).cast("int"))
    return V.table(spark, sf, "events").select("event_id", dates.local_date(C("ts"), zone).alias("local_date"))


_SQL_KEY_TITLE = f"trim(regexp_replace(regexp_replace({V.sql_title_text('title')}, '\\b(sf|san francisco|bay area|event|meetup)\\b', ' ', 'g'), ' +', ' ', 'g'))"


@query("dedupe_keys", V.with_ctes(V.V_RECORDS, select=f"SELECT id, {_SQL_KEY_TITLE} || '|' || strftime(start_at, '%Y-%m-%d') || '|' || {V.sql_title_text('city')} AS dedupe_key FROM (SELECT id, title || ' SF Meetup' AS title, start_at, city FROM v_records)"))
def dedupe_keys(spark, sf):
    r = V.v_records(spark, sf)
    return r.select("id", dedupe_key(F.concat("title", F.lit(" SF Meetup")), C("start_at"), C("timezone"), C("city")).alias("dedupe_key"))


@query("report_keys", V.with_ctes(V.V_RECORDS, select="SELECT id, canonical_url || ' title|' || array_to_string(list_filter(string_split(" + V.sql_title_text("title") + ", ' '), lambda w: length(w) > 1), ' ') || '|' || strftime(start_at, '%Y-%m-%d') || '|' || trim(regexp_replace(lower(city), '[^a-z0-9]+', ' ', 'g')) AS keys FROM v_records"))
def report_key_rows(spark, sf):
    r = V.v_records(spark, sf)
    both = F.concat(F.array("canonical_url"), "source_urls")
    return r.select("id", F.array_join(report_keys(both, C("title"), C("start_at"), C("timezone"), C("city")), " ").alias("keys"))


@query("keyword_hits", f"SELECT doc_id, array_to_string({V.sql_hits('t', ['the thing', 'ortion', 'esing', 'thatin', 'a+', 'estion', 'reresh'])}, '|') AS hits FROM (SELECT doc_id, {V.sql_match_text('text')} AS t FROM documents)")
def keyword_hits(spark, sf):
    docs = V.texts(spark, sf, "documents").select("doc_id", text.match_text(C("text")).alias("t"))
    return docs.select("doc_id", F.array_join(R.keyword_hits(C("t"), ["the thing", "ortion", "esing", "thatin", "a+", "estion", "reresh"]), "|").alias("hits"))


_BENCH_WORDS = "SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark"


@query("keyword_hits_many", f"""WITH words AS (SELECT w FROM ({_BENCH_WORDS}) WHERE length(w) >= 5),
  runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({V.sql_match_text('text')}, '[a-z0-9]+')) AS r FROM documents),
  forms AS (SELECT w, w AS r FROM words UNION ALL SELECT w, w || 's' FROM words WHERE NOT ends_with(w, 's') UNION ALL SELECT w, w || 'es' FROM words WHERE NOT ends_with(w, 's'))
  SELECT doc_id, count(DISTINCT w) AS n_keywords, min(w) AS first_keyword, max(w) AS last_keyword FROM runs JOIN forms USING (r) GROUP BY doc_id""")
def keyword_hits_many(spark, sf):
    bench = V.table(spark, sf, "benchmark")
    keywords = bench.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).filter(F.length("keyword") >= 5).distinct()
    rules = keywords.select(F.xxhash64("keyword").alias("ordinal"), "keyword")
    hits = R.match_many(V.texts(spark, sf, "documents"), "doc_id", "text", rules)
    return hits.groupBy("doc_id").agg(F.countDistinct("keyword").alias("n_keywords"), F.min("keyword").alias("first_keyword"), F.max("keyword").alias("last_keyword"))


_FORMS = {0: "'held on ' || strftime(d, '%Y-%m-%d') || ' at noon'", 1: "strftime(d, '%B') || ' ' || CAST(day(d) AS VARCHAR) || 'th, ' || year(d) || ' dinner'",
          2: "strftime(d, '%b') || '. ' || CAST(day(d) AS VARCHAR) || ' only'", 3: "'event recap ' || year(d)", 4: "'bad 2005-02-30 and ' || strftime(d, '%Y/%m/%d')"}


@query("explicit_dates", f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN coalesce(strftime(try_cast('1998-' || strftime(d, '%m-%d') AS DATE), '%Y-%m-%d'), '')
  WHEN 3 THEN year(d) || '-01-01' WHEN 1 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS dates FROM (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS d FROM orders)""")
def explicit_dates(spark, sf):
    d = C("d")
    k = C("o_orderkey") % 5
    body = (F.when(k == 0, F.concat(F.lit("held on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" at noon")))
            .when(k == 1, F.concat(F.date_format(d, "MMMM d"), F.lit("th, "), F.year(d), F.lit(" supper")))
            .when(k == 2, F.concat(F.date_format(d, "MMM"), F.lit(". "), F.dayofmonth(d), F.lit(" only")))
            .when(k == 3, F.concat(F.lit("event recap "), F.year(d)))
            .otherwise(F.concat(F.lit("bad 2005-02-30 and "), F.date_format(d, "yyyy/MM/dd"))))
    shifted = V.table(spark, sf, "orders").select("o_orderkey", F.to_date(C("o_orderdate") + F.expr("interval 10 years")).alias("d"))
    as_of = V.AS_OF.date()
    found = dates.explicit_dates(C("body"), as_of.replace(year=1998))
    late = dates.explicit_dates(C("body"), as_of.replace(year=2012))
    chosen = F.when(C("o_orderkey") % 5 == 3, late).otherwise(found)
    return shifted.withColumn("body", body).select("o_orderkey", F.array_join(F.transform(chosen, lambda x: F.date_format(x, "yyyy-MM-dd")), " ").alias("dates"))


@query("date_flags", V.with_ctes(V.V_RECORDS, select="SELECT id, coalesce(start_at < TIMESTAMP '1998-06-15', false) AS has_past, coalesce(start_at >= TIMESTAMP '1998-06-15', false) AS has_future FROM (SELECT id, try_cast('1998-' || strftime(start_at, '%m-%d') AS TIMESTAMP) AS start_at FROM v_records)"))
def date_flags(spark, sf):
    r = V.v_records(spark, sf)
    found = dates.explicit_dates(F.concat(F.lit("on "), F.date_format("start_at", "MMMM d"), F.lit(" in town")), V.AS_OF.date())
    r, found = r.select("id", found.alias("_found")), C("_found")
    return r.select("id", dates.has_past_date(found, V.AS_OF.date()).alias("has_past"), dates.has_future_date(found, V.AS_OF.date()).alias("has_future"))


@query("enum_coercion", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'city_only' WHEN 1 THEN 'exact' WHEN 2 THEN 'neighborhood' WHEN 3 THEN 'unknown' WHEN 4 THEN 'exact' END AS precision,
  CASE p_size % 6 WHEN 0 THEN 'approval_required' WHEN 1 THEN 'sold_out' WHEN 3 THEN 'open' ELSE 'unknown' END AS registration,
  CASE p_size % 6 WHEN 0 THEN 'panel' WHEN 1 THEN 'other' WHEN 2 THEN 'salon' WHEN 3 THEN 'happy_hour' ELSE 'other' END AS record_type,
  CASE p_size % 6 WHEN 0 THEN 'rsvp' WHEN 1 THEN 'ask_intro' WHEN 2 THEN 'skip' ELSE 'monitor' END AS next_action,
  CASE p_size % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM part""")
def enum_coercion(spark, sf):
    def pick(*options):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (C("p_size") % 6 + 1).cast("int"))
    return V.table(spark, sf, "part").select(
        "p_partkey", coerce.location_precision(pick("City Level", "exact-address", "Approx", "TBD", "the venue hall", "elsewhere")).alias("precision"),
        coerce.registration_status(pick("Requires Approval", "soldout", "n/a", "OPEN", "maybe", "")).alias("registration"),
        coerce.record_type(pick("Fireside Chat", "mixer", "roundtable", "Happy Hour", "none", "gala")).alias("record_type"),
        coerce.next_action(pick("Attend", "ask intro", "SKIP", "monitor", "whatever", "?")).alias("next_action"),
        coerce.boolean_word(pick("Yes", " no ", "recommend", "perhaps", "1", "")).alias("flag"))


@query("numeric_coercion", """SELECT o_orderkey, CASE WHEN n > 1 AND n <= 100 THEN n / 100 ELSE n END AS confidence,
  CASE WHEN n > 25 AND n <= 100 THEN floor(n / 100 * 25 + 0.5) WHEN n > 100 THEN 25 ELSE n END AS fit FROM (SELECT o_orderkey, CAST(o_orderkey % 130 AS DOUBLE) AS n FROM orders)""")
def numeric_coercion(spark, sf):
    n = (C("o_orderkey") % 130).cast("string")
    return V.table(spark, sf, "orders").select("o_orderkey", coerce.confidence(n).alias("confidence"), coerce.capped_component(n, 25).alias("fit"))


@query("json_coercion", """SELECT event_id, CAST(user_id AS VARCHAR) AS id, CASE WHEN k > 1 THEN k / 100.0 ELSE CAST(k AS DOUBLE) END AS confidence, event_id % 2 = 0 AS accepted
  FROM (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""")
def json_coercion(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    url = F.concat(F.lit("https://e.example.com/"), "event_id")
    body = F.to_json(F.struct(C("user_id").cast("string").alias("id"), url.alias("canonical_url"), F.array(url).alias("source_urls"), F.when(C("event_id") % 2 == 0, C("event_type")).otherwise(F.lit("ab")).alias("title"),
                              F.lit("city").alias("location_precision"), k.alias("confidence")))
    raw = F.when(C("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(C("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done."))).otherwise(body)
    out = coerce.coerce_records(e.select("event_id", raw.alias("raw")))
    return out.select("event_id", "id", "confidence", (F.size("problems") == 0).alias("accepted"))


@query("score_coercion", """SELECT event_id, CAST(user_id AS VARCHAR) AS record_id, total, CASE WHEN total > 25 THEN floor(total / 100 * 25 + 0.5) ELSE total END AS user_fit, event_type = 'purchase' AS should_recommend, 'rsvp' AS next_action, total BETWEEN 0 AND 100 AS accepted
  FROM (SELECT event_id, user_id, event_type, CAST(floor(least(value, 100)) AS DOUBLE) AS total FROM events)""")
def score_coercion(spark, sf):
    e = V.table(spark, sf, "events").withColumn("t", F.floor(F.least("value", F.lit(100))).cast("int"))
    five = F.lit(5)
    body = F.to_json(F.struct(C("user_id").cast("string").alias("event_id"), C("t").alias("totalScore"), C("t").alias("userFit"), five.alias("roomQuality"), five.alias("networkingValue"), five.alias("timeliness"),
                              five.alias("locationActionability"), five.alias("novelty"), five.alias("evidenceConfidence"), F.when(C("event_type") == "purchase", "yes").otherwise("no").alias("should_recommend"),
                              F.lit("why").alias("rationale"), F.lit("Join").alias("next_action")))
    out = coerce.coerce_scores(e.select("event_id", body.alias("raw")))
    return out.select("event_id", "record_id", "total", "user_fit", "should_recommend", "next_action", (F.size("problems") == 0).alias("accepted"))


@query("plan_items", """SELECT o_orderkey, CAST(i AS BIGINT) AS position, CASE i WHEN 0 THEN 'query ' || o_orderkey ELSE c_mktsegment || ' rooms' END AS query, CASE i WHEN 0 THEN greatest(5, least(20, o_orderkey % 40)) ELSE 12 END AS max_results,
  CASE i WHEN 0 THEN 'topic' ELSE 'variety' END AS novelty_axis FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (SELECT unnest([0, 1]) AS i)""")
def plan_items(spark, sf):
    o = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), C("o_custkey") == C("c_custkey"))
    body = F.concat(F.lit('{"items":[{"query":"query '), "o_orderkey", F.lit('","max_results":'), C("o_orderkey") % 40, F.lit(',"novelty_axis":"topic"},{"text":" '), "c_mktsegment", F.lit(' rooms"},{"query":" "}]}'))
    out = coerce.coerce_plan_items(o.select("o_orderkey", body.alias("raw")))
    return out.select("o_orderkey", C("position").cast("long").alias("position"), "query", C("max_results").cast("long").alias("max_results"), "novelty_axis")


@query("digest_lines", """SELECT o_orderkey, CASE WHEN length(t) <= 30 THEN t ELSE rtrim(substr(t, 1, 27)) || '...' END AS short, regexp_extract(t, '^(.+?[.!?])(?:\\s|$)', 1) AS sentence,
  strftime(o_orderdate, '%b %-d, %-I:%M %p') AS shown_at, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html
  FROM (SELECT o_orderkey, o_orderdate + INTERVAL 90 MINUTE * (o_orderkey % 16) AS o_orderdate, o_orderpriority || ' & <' || o_orderstatus || '>. "Second" part ' || o_orderkey AS t FROM orders)""")
def digest_lines(spark, sf):
    t = F.concat("o_orderpriority", F.lit(" & <"), "o_orderstatus", F.lit('>. "Second" part '), "o_orderkey")
    at = C("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(C("o_orderkey") % 16 * 90).cast("int"))
    return V.table(spark, sf, "orders").select("o_orderkey", presentation.truncate(t, 30).alias("short"), presentation.first_sentence(t).alias("sentence"),
                                               presentation.display_time(at, "UTC").alias("shown_at"), presentation.escape_html(t).alias("html"))


@query("score_badges", V.with_ctes(V.V_RECORDS, select="""SELECT id, CASE WHEN score >= 85 THEN 'strong' WHEN score >= 80 THEN 'pass' WHEN score >= 65 THEN 'near' ELSE 'low' END AS tone,
  CASE WHEN score >= 85 THEN 'Strong fit' WHEN score >= 80 THEN 'Above the bar' WHEN score >= 65 THEN 'Just under the bar' ELSE 'Below the bar' END AS label,
  CASE WHEN score >= 88 THEN 'apply' WHEN score >= 80 THEN 'rsvp' ELSE 'monitor' END AS action, CASE WHEN score >= 80 THEN 'go' ELSE 'wait' END AS action_tone FROM v_records"""))
def score_badges(spark, sf):
    s = C("score")
    action = presentation.action_from_score(s, 80)
    return V.v_records(spark, sf).select("id", presentation.score_tone(s, 80, 65).alias("tone"), presentation.score_label(s, 80, 65).alias("label"), action.alias("action"),
                                         presentation.action_tone(action).alias("action_tone"))


@query("run_durations", V.with_ctes(V.V_RUNS, select="SELECT run_id, CASE WHEN finished_at IS NOT NULL AND status <> 'running' THEN CAST(floor((epoch_us(finished_at) - epoch_us(started_at)) / 1e6 + 0.5) AS BIGINT) END AS seconds FROM v_runs"))
def run_durations(spark, sf):
    return V.v_runs(spark, sf).select("run_id", dates.duration_seconds(C("started_at"), C("finished_at"), C("status")).alias("seconds"))


@query("hunt_weeks", "SELECT event_id, strftime(CAST(ts AS DATE) - 7, '%Y-%m-%d') AS week_start, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS week_end FROM events")
def hunt_weeks(spark, sf):
    end = F.date_trunc("day", "ts")
    return V.table(spark, sf, "events").select("event_id", F.date_format(F.date_sub(end, 7), "yyyy-MM-dd").alias("week_start"), F.date_format(end, "yyyy-MM-dd").alias("week_end"))


@query("list_union", "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([trim(o_orderpriority), o_orderstatus, c_mktsegment, trim(c_mktsegment)], lambda v: v <> ''))), '|') AS merged, o_orderstatus IN ('O', c_mktsegment) AS overlaps FROM orders JOIN customer ON o_custkey = c_custkey")
def list_union(spark, sf):
    o = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), C("o_custkey") == C("c_custkey"))
    left = F.array(F.concat(F.lit(" "), "o_orderpriority"), C("o_orderstatus"), F.lit(" "))
    right = F.array(C("c_mktsegment"), F.concat("c_mktsegment", F.lit("  ")))
    return o.select("o_orderkey", F.array_join(F.sort_array(text.union_lists(left, right)), "|").alias("merged"), F.arrays_overlap(F.array("o_orderstatus"), F.array(F.lit("O"), C("c_mktsegment"))).alias("overlaps"))


