import re
import sys
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from linksift.functions import coerce, dates, presentation, text, urls
from linksift.functions import rules as R

AS_OF = date(2026, 8, 23)
C = F.col


@pytest.mark.parametrize("raw, expected", [
    ("https://www.lu.ma/event-slug/?utm_source=x&ref=abc&invite=keep#section", "https://lu.ma/event-slug?invite=keep"),
    ("lu.ma/abc", "https://lu.ma/abc"),
    ("HTTPS://Example.COM:443/A//", "https://example.com/A"),
    ("http://example.com:8080?b=2&a=1&a=0", "http://example.com:8080/?a=1&a=0&b=2"),
    ("https://example.com/x?flag", "https://example.com/x?flag="),
    ("https://example.com/café x", "https://example.com/caf%C3%A9%20x"),
    ("https://", None),
    ("", ""),
])
def test_link_url(one, raw, expected):
    assert one(urls.link_url(C("u")), u=raw) == expected


@pytest.mark.parametrize("raw", ["https://www.lu.ma/a/?b=1&a=2&utm_x=1", "http://m.example.org/p/?page=2&ref=x#top", "x.com"])
def test_link_url_is_idempotent(one, raw):
    once = one(urls.link_url(C("u")), u=raw)
    assert one(urls.link_url(C("u")), u=once) == once


def test_other_canonical_forms(one):
    raw = "https://www.Example.com/Path/?ref=1&source=2&UTM_x=3&keep=4#frag"
    assert one(urls.shared_url(C("u")), u=raw) == "https://www.example.com/Path/?source=2&UTM_x=3&keep=4"
    assert one(urls.dedupe_url(C("u")), u=raw) == "https://example.com/Path/?keep=4"
    assert one(urls.report_url(C("u")), u=raw) == "https://example.com/path/?keep=4"
    assert one(urls.shared_url(C("u")), u=" not a url ") == "not a url"
    assert one(urls.dedupe_url(C("u")), u=" Not A Url ") == "not a url"
    assert one(urls.shared_url(C("u")), u="https://a.com/x?flag") == "https://a.com/x?flag"


@pytest.mark.parametrize("url, expected", [
    ("https://lu.ma/favicon.ico", True), ("https://example.com/images/logo.png", True), ("https://luma.com/signin", True),
    ("https://luma.com/explore", True), ("https://luma.com/", True), ("https://lu.ma/ai-founders-dinner", False),
    ("https://eventbrite.com/e/founder-dinner-tickets-123", False), ("https://example.com/events/founder-breakfast", False),
])
def test_never_a_record(one, url, expected):
    host = urls.host_of(C("u"))
    assert one(urls.never_a_record(host, urls.path_of(C("u")), host.isNotNull()), u=url) is expected


def test_platforms(one):
    assert one(urls.on_domain(urls.host_of(C("u")), "meetup"), u="https://www.meetup.com/sf-ai/events/123") is True
    assert one(urls.on_domain(urls.host_of(C("u")), "meetup"), u="https://example.com/meetup-not-platform") is False
    assert one(urls.source_type(urls.host_of(C("u")), urls.path_of(C("u"))), u="https://x.com/someone") == "x_account"


@pytest.mark.parametrize("value, keyword, hit", [
    ("Founders dinner", "founder", True), ("Consumer-facing AI", "consumer facing", True), ("Tickets on sale now", "sales", False),
    ("Said the agent", "ai", False), ("For Series A+ founders only", "series a+", True),
])
def test_keyword_matching(one, spark, value, keyword, hit):
    assert one(R.keyword_hits(text.match_text(C("t")), [keyword]), t=value) == ([keyword] if hit else [])
    docs = spark.createDataFrame([(1, value)], "k long, t string")
    many = R.match_many(docs, "k", "t", spark.createDataFrame([(0, keyword)], "ordinal int, keyword string"))
    assert many.count() == int(hit)


def _normal(value, kept):
    """The word form of one text by Python's own normalisation."""
    form = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(f"[^{kept}]+", " ", form).strip(" ")


def test_every_letter_folds_to_its_compatibility_form(spark):
    texts = [f"x{chr(code)}1" for code in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(code)) not in ("Cn", "Co", "Cs")]
    texts += ["Café Zürich", "ÀÉÎÕÜ ñç", "naïve façade", "Łódź", "ﬁne ½", "ﬀ ﬃ ŉ ǆ", "５０％ ＯＦＦ", "① ⑽ ㏑ ㎏", "e\u0301 \U0001d400\U0001d41a \U0001f600 \U0001f101", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.match_text(C("t")).alias("m"), text.title_text(C("t")).alias("s"))
    wrong = [(texts[r["i"]], r["m"], r["s"]) for r in df.collect()
             if r["m"] != _normal(texts[r["i"]], "a-z0-9+&#@") or r["s"] != _normal(texts[r["i"]], "a-z0-9")]
    assert not wrong, wrong[:20]


def explicit(one, value):
    return one(dates.explicit_dates(C("t"), AS_OF), t=value)


def test_explicit_dates(one):
    assert explicit(one, "https://example.com/events/2024/09/12/x") == [date(2024, 9, 12), date(2024, 1, 1)]
    assert explicit(one, "Salon September 12, 2024")[0] == date(2024, 9, 12)
    assert explicit(one, "dinner on Sep 3rd") == [date(2026, 9, 3)]
    assert explicit(one, "Feb 30 and 2025-02-30") == []
    assert explicit(one, "Event recap from 2025 with videos") == [date(2025, 1, 1)]
    assert explicit(one, "copyright 2019") == []
    assert explicit(one, "2019 " + "x" * 74 + " event") == []
    assert explicit(one, "2019 " + "x" * 69 + " event") == [date(2019, 1, 1)]
    assert explicit(one, "event" + " " * 75 + "2019") == [date(2019, 1, 1)]
    assert explicit(one, "event" + " " * 76 + "2019") == []


@pytest.mark.parametrize("raw, expected", [
    (None, "missing_date"), ("not-a-date", "invalid_date"), ("2026-08-22T10:00:00Z", "past_event"),
    ("2026-10-01T10:00:00Z", "too_far_future"), ("2026-09-10T10:00:00Z", None),
])
def test_window(one, raw, expected):
    col = dates.window_reason(dates.parse_time(C("t")), datetime(2026, 8, 23, 19), C("t"))
    assert one(col, t=raw) == expected


def test_month_end_clamps(one):
    col = dates.window_reason(dates.parse_time(C("t")), datetime(2026, 1, 31, 12), C("t"))
    assert one(col, t="2026-02-28T12:00:00Z") is None
    assert one(col, t="2026-02-28T12:00:01Z") == "too_far_future"


def test_stable_id_and_hash(one):
    import hashlib
    assert one(text.stable_id(F.lit("a"), F.lit(None), F.lit("b"))) == hashlib.sha1(b"a\n\nb").hexdigest()[:24]
    h = 0
    for ch in "luma-sf:20688":
        h = (h * 31 + ord(ch)) % 2**32
    assert one(text.polynomial_hash(F.lit("luma-sf:20688"))) == h


def test_coercion(one):
    assert one(coerce.location_precision(C("v")), v="Exact-Address") == "exact"
    assert one(coerce.location_precision(C("v")), v="citywide") == "city_only"
    assert one(coerce.registration_status(C("v")), v="Requires approval") == "approval_required"
    assert one(coerce.record_type(C("v")), v="Fireside chat") == "panel"
    assert one(coerce.next_action(C("v")), v="attend") == "rsvp"
    assert [one(coerce.confidence(C("v")), v=v) for v in ("85", "0.4", "", "unknown", None)] == [0.85, 0.4, 0.5, 0.5, 0.5]
    assert [one(coerce.capped_component(C("v"), 25), v=v) for v in ("20", "80", "400")] == [20.0, 20.0, 25.0]
    assert one(coerce.loose_json(C("v")), v='```json\n{"a": 1}\n```') == '{"a": 1}'


def test_record_coercion_rejects_with_reasons(spark):
    good = '{"id":"1","canonical_url":"https://a.com","source_urls":["https://a.com"],"title":"Dinner","location_precision":"city","confidence":85}'
    bad = '{"id":"","canonicalUrl":"nope","title":"ab","confidence":"2000"}'
    rows = coerce.coerce_records(spark.createDataFrame([(good,), (bad,)], "raw string")).collect()
    assert rows[0]["problems"] == [] and rows[0]["confidence"] == 0.85 and rows[0]["location_precision"] == "city_only"
    assert rows[1]["problems"] == ["id", "canonical_url", "source_urls", "title", "location_precision", "confidence"]


def test_html_text(one):
    html = "<body><script>x</script><style>y</style><p>A&amp;B&nbsp; &lt;c&gt;</p></body>"
    assert one(text.html_to_text(C("h")), h=html) == "A&B <c>"
    assert one(text.readable_text(C("h")), h="<nav>n</nav><article>in</article>") == "in"
    assert one(text.cap_page_text(C("h"), 3), h="abcd") == "abc\n[truncated]"


def test_fingerprint_and_similarity(one):
    assert one(text.query_fingerprint(C("q")), q='"AI founders" (site:lu.ma) events in San Francisco 2026 founders') == "founders san francisco"
    assert one(text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(text.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 1.0


def test_presentation(one):
    assert one(presentation.truncate(C("t"), 6), t="abc defgh") == "abc..."
    assert one(presentation.first_sentence(C("t")), t="One. Two.") == "One."
    assert one(presentation.escape_markdown(C("t")), t="a*b https://x.com/a_b") == "a\\*b https://x.com/a_b"
    assert one(presentation.plain_digest(C("t")), t='R&amp;D <a href="https://a.com">see</a>') == "R&D see (https://a.com)"
    assert one(presentation.markdown_digest(C("t")), t="Digest\n\nRecommended (80+)\nx") == "### Digest\n\n#### Recommended (80+)\nx  "


def test_rules_document_is_validated():
    with pytest.raises(ValueError, match="review must be lower"):
        R.Rules(recommend=60, review=60)
    assert R.DEFAULT_RULES.search_exclusions() == ["-hackathon", "-buildathon", "-webinar"]
    assert R.distinct_terms(["SF", "Bay", "sf"]) == ["SF", "Bay"]


@pytest.mark.parametrize("value, keyword, hit", [
    ("salt & pepper", "&", True), ("salt pepper", "&", False), ("learn c#", "c#", True), ("learn c", "c#", False), ("one #founders day", "#founder", False),
    ("rock & founders", "& founder", True), ("agents", "agent", True), ("boxes", "box", True), ("bo", "box", False), ("", "box", False),
    ("a consumer ai agents", "ai agent", True), ("a consumer ai and agents", "ai agent", False), ("#b2b+", "b2b", True), ("xb2b", "b2b", False),
])
def test_keywords_of_signs_and_plurals(one, spark, value, keyword, hit):
    import re

    want = bool(re.search(f"(?<![a-z0-9]){R.keyword_body(keyword)}(?![a-z0-9])", value))
    assert want is hit
    t = text.match_text(C("t"))
    assert one(R.keyword_hits(t, [keyword, "zzz"]), t=value) == ([keyword] if hit else [])
    assert one(R.any_keyword(t, ["zzz", keyword]), t=value) is hit
    assert one(R.first_hit(t, ["zzz", keyword]), t=value) == (keyword if hit else None)
    docs = spark.createDataFrame([(1, value), (None, value), (2, None)], "k long, t string")
    many = R.match_many(docs, "k", "t", spark.createDataFrame([(0, keyword), (1, None)], "ordinal int, keyword string"))
    assert sorted(r["k"] or 0 for r in many.collect()) == ([0, 1] if hit else [])


def test_plain_urls_are_only_cut(spark):
    """A plain url takes its form without the parser that a fragment sends it to, and both agree."""
    plain = ["https://a.com", "https://a.com/", "http://www.a-b.c/x//", "https://www.a.com/x?utm_source=1&ref=b=c", "https://a.com/x/?gclid", "https://www./x?fbclid=", "http://a/@b;c"]
    odd = ["https://a.com/x?keep=1&ref=2", "HTTPS://a.com/?ref=1", "https://a.com:443/x", "https://u@a.com/x", "https://a.com/é?ref", "https://a.com/x?", "https://a.com/x?&ref=1", "https://a.com/x?refx=1", "https://a.com/x?r%65f=1", None, "", " https://a.com/ "]
    df = spark.createDataFrame([(u,) for u in plain + odd], "u string")
    for form, names in ((urls.shared_url, urls._SHARED_NAMES), (urls.dedupe_url, urls._DEDUPE_NAMES)):
        rows = df.select("u", form(C("u")).alias("cut"), form(F.concat(F.trim("u"), F.lit("#f"))).alias("parsed"), C("u").rlike(urls._plain(names)).alias("plain")).collect()
        assert {r["u"] for r in rows if r["plain"]} == set(plain)
        assert all(r["cut"] == r["parsed"] for r in rows if r["u"])
