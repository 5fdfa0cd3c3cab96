"""Keyword rules: the rules document, whole-word matching, derived views and diffs.

A rules document is a small driver-side configuration (tens to hundreds of keywords). Up
to a few hundred keywords become Column tests on the words of a text; larger sets go through
``match_many`` which joins on an anchor word instead.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import match_text


@dataclass(frozen=True)
class Topic:
    name: str
    weight: float
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    """One rules document. Thresholds: ``review`` must stay below ``recommend``."""

    name: str = "custom"
    region: str = "SF Bay Area"
    cities: tuple[str, ...] = ("San Francisco", "Palo Alto", "Menlo Park", "Mountain View", "Berkeley", "Oakland")
    aliases: tuple[str, ...] = ()
    topics: tuple[Topic, ...] = ()
    audience: tuple[str, ...] = ()
    prefer_formats: tuple[str, ...] = ()
    avoid_formats: tuple[str, ...] = ()
    hubs: tuple[str, ...] = ()
    exclude_formats: tuple[str, ...] = ()
    exclude_topics: tuple[str, ...] = ()
    exclude_eligibility: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    rooms: tuple[str, ...] = ("founder dinner", "founder breakfast", "operator roundtable", "founder salon", "happy hour")
    notes: tuple[str, ...] = ()
    recommend: int = 80
    review: int = 65
    disabled_sources: tuple[str, ...] = ()
    added_sources: tuple[dict, ...] = field(default=())

    def __post_init__(self):
        if not 1 <= self.recommend <= 100 or not 0 <= self.review <= 100:
            raise ValueError("thresholds must be between 0 and 100")
        if self.review >= self.recommend:
            raise ValueError("thresholds.review must be lower than thresholds.recommend")
        for topic in self.topics:
            if not topic.keywords:
                raise ValueError(f"topic {topic.name}: list at least one keyword")
            if not -50 <= topic.weight <= 50:
                raise ValueError(f"topic {topic.name}: weight must be between -50 and 50")

    # Derived views -----------------------------------------------------------------
    def local_terms(self) -> list[str]:
        return distinct_terms([*self.cities, *self.aliases])

    def positive_topics(self) -> list[Topic]:
        return sorted((t for t in self.topics if t.weight > 0), key=lambda t: -t.weight)

    def neutral_topics(self) -> list[Topic]:
        return [t for t in self.topics if t.weight == 0]

    def negative_topics(self) -> list[Topic]:
        return sorted((t for t in self.topics if t.weight < 0), key=lambda t: t.weight)

    def relevant_keywords(self) -> list[str]:
        return distinct_terms([k for t in self.topics if t.weight >= 0 for k in t.keywords])

    def signal_terms(self) -> list[str]:
        return [*GENERIC_SIGNAL_TERMS, *self.relevant_keywords(), *self.audience, *self.prefer_formats, *self.hubs,
                *self.local_terms()]

    def search_exclusions(self, limit: int = 3) -> list[str]:
        usable = [t for t in self.exclude_formats if re.fullmatch(r"[a-zA-Z0-9 -]+", t)]
        ordered = sorted(usable, key=lambda t: " " in t)
        return [f'-"{t}"' if " " in t else f"-{t}" for t in ordered[:limit]]

    # Flat table --------------------------------------------------------------------
    def lists(self) -> dict[str, tuple[str, ...]]:
        return {
            "cities": self.cities, "aliases": self.aliases, "audience": self.audience,
            "prefer_formats": self.prefer_formats, "avoid_formats": self.avoid_formats, "hubs": self.hubs,
            "exclude_formats": self.exclude_formats, "exclude_topics": self.exclude_topics,
            "exclude_eligibility": self.exclude_eligibility, "phrases": self.phrases, "rooms": self.rooms,
            "notes": self.notes, "disabled_sources": self.disabled_sources,
        }

    def to_df(self, spark: SparkSession) -> DataFrame:
        """rules(kind, name, weight, ordinal, keyword); thresholds and region are rows too."""
        rows = [(kind, kind, None, i, k) for kind, terms in self.lists().items() for i, k in enumerate(terms)]
        rows += [("topic", t.name, float(t.weight), i, k) for t in self.topics for i, k in enumerate(t.keywords)]
        rows += [("threshold", "recommend", float(self.recommend), 0, None), ("threshold", "review", float(self.review), 0, None),
                 ("region", self.region, None, 0, None)]
        return spark.createDataFrame(rows, "kind string, name string, weight double, ordinal int, keyword string")


# Words that help regardless of the rules document.
GENERIC_SIGNAL_TERMS = [
    "approval", "application", "apply to attend", "curated", "invite", "invite only", "rsvp",
    "demo night", "demo day", "startup", "luma", "meetup",
]
# Promotional noise.
JUNK_TERMS = ["coupon", "discount", "giveaway", "sponsorship"]
# Signs of a curated or small room.
CURATION_TERMS = [
    "approval", "invite", "invite only", "member", "application", "apply to attend", "curated",
    "limited capacity", "closed door",
]

# The default rules document.
DEFAULT_RULES = Rules(
    name="consumer-ai-founder",
    region="SF Bay Area",
    aliases=("SF", "Bay Area", "San Jose", "Stanford", "SoMa", "Hayes Valley", "Mission"),
    topics=(
        Topic("Consumer AI / B2C", 8, (
            "b2c", "consumer", "consumer ai", "consumer-facing", "prosumer", "creator", "social app",
            "social product", "marketplace", "mobile app", "personal ai")),
        Topic("AI agents", 0, ("ai agent", "agent builder", "agent founder", "agentic", "agents")),
        Topic("Product, growth and go-to-market", 0, ("product", "go-to-market", "gtm", "growth", "design partner")),
        Topic("B2B / enterprise SaaS", -10, (
            "b2b", "enterprise", "saas", "procurement", "cio", "ciso", "cxo", "enterprise buyer")),
        Topic("Sales and revenue operations", -10, (
            "sales", "revops", "revenue operations", "revenue leader", "demand gen", "lead gen", "pipeline",
            "sales leader", "marketing leader", "customer acquisition")),
    ),
    audience=("founder", "builder", "operator", "investor", "angel investor", "product leader"),
    prefer_formats=("dinner", "breakfast", "salon", "roundtable", "founder house"),
    avoid_formats=("conference", "expo", "online", "class", "course", "training"),
    hubs=(
        "SHACK15", "SHACK 15", "StartupHQ", "Startup HQ", "90 Gold", "Founders Cafe", "Founders Inc",
        "South Park Commons", "Cerebral Valley", "Frontier Tower", "Entrepreneur First", "Entrepreneurs First",
        "Pear VC", "SignalFire", "a16z", "GitHub for Startups", "Malaika Commons", "Founders Common",
        "Founders You Should Know", "Brex Startup Community", "AI Hustle", "SF AI Agent Meetup", "Sapienne",
        "Founders Brew", "Homebrew Club", "Founders on Tap"),
    exclude_formats=(
        "hackathon", "buildathon", "code sprint", "coding sprint", "hack night", "webinar", "online event",
        "virtual only", "job fair"),
    exclude_topics=(
        "physical ai", "robotics", "hardware ai", "frontier research", "research club", "paper reading",
        "ml research", "research scientist", "postdoc"),
    exclude_eligibility=(
        "phd required", "postdoc required", "faculty only", "researchers only", "frontier lab only",
        "series a founders only", "series a+", "series b+"),
    phrases=("AI founders", "agent builders", "consumer AI founders", "AI product builders", "AI builders"),
    rooms=("founder dinner", "founder salon", "operator roundtable", "founder breakfast", "builder salon", "happy hour"),
)


def distinct_terms(terms: list[str]) -> list[str]:
    """Case-insensitive distinct, first spelling kept."""
    first: dict[str, str] = {}
    for term in terms:
        first.setdefault(term.lower(), term)
    return list(first.values())


def normal_keyword(keyword: str) -> str:
    folded = "".join(c for c in unicodedata.normalize("NFKD", keyword.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub("[^a-z0-9+&#@]+", " ", folded).strip()


def keyword_body(keyword: str) -> str:
    """Regex body of one keyword: plural-tolerant when the last word is alphabetic and not in -s."""
    head, _, last = normal_keyword(keyword).rpartition(" ")
    body = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", f"{head} {last}" if head else last)
    plural = len(last) >= 3 and re.fullmatch("[a-z]+", last) and not last.endswith("s")
    return body + ("(?:s|es)?" if plural else "")


def _pattern(body: str) -> str:
    return f"(?<![a-z0-9]){body}(?![a-z0-9])"


def _anchor(keyword: str) -> tuple[list[str], bool]:
    """The keyword's longest run of letters and digits, in the forms a matching text may hold it; and whether that run alone decides.

    Empty for a keyword of signs only.
    """
    norm = normal_keyword(keyword)
    longest = max(re.findall("[a-z0-9]+", norm), key=len, default="")
    if not longest:
        return [], False
    ends = ["", "s", "es"] if keyword_body(keyword).endswith("(?:s|es)?") and norm.endswith(longest) else [""]
    return [longest + e for e in ends], norm == longest


def keyword_runs(text: Column, keywords) -> Column:
    """Distinct runs of letters and digits of normalised ``text`` that some of ``keywords`` may need: the only pass over the text."""
    forms = sorted({f for k in keywords if normal_keyword(k) for f in _anchor(k)[0]})
    runs = F.split(F.translate(text, "+&#@", "    "), " ")
    return F.array_intersect(runs, F.array(*[F.lit(f) for f in forms])) if forms else F.array().cast("array<string>")


def _occurs(keyword: str, text: Column, runs: Column) -> Column:
    forms, decides = _anchor(keyword)
    exact = text.rlike(_pattern(keyword_body(keyword)))
    if not forms:
        return exact
    seen = reduce(Column.__or__, [F.array_contains(runs, f) for f in forms])
    return seen if decides else seen & exact


def _over_runs(test, text: Column, keywords: list[str], runs: Column | None) -> Column:
    """``test(runs)``; runs made here are bound once, as every test would else cut the text again."""
    return test(runs) if runs is not None else F.get(F.transform(F.array(keyword_runs(text, keywords)), test), F.lit(0))


def any_keyword(text: Column, keywords, runs: Column | None = None) -> Column:
    """True when any keyword occurs in already normalised ``text`` (``match_text``).

    ``runs``, here and below, is a column of ``keyword_runs`` over a superset of the keywords;
    with it no test reads the text, but for keywords of several words whose longest word is there.
    """
    usable = [k for k in keywords if normal_keyword(k)]
    if not usable:
        return F.lit(False)
    single = sorted({f for k in usable for f in _anchor(k)[0] if _anchor(k)[1]})

    def occurs(found: Column) -> Column:
        tests = [F.arrays_overlap(found, F.array(*[F.lit(f) for f in single]))] if single else []
        return reduce(Column.__or__, tests + [_occurs(k, text, found) for k in usable if not _anchor(k)[1]])

    return F.coalesce(_over_runs(occurs, text, usable, runs), F.lit(False))


def keyword_hits(text: Column, keywords, runs: Column | None = None) -> Column:
    """Matched keywords in rule order, over already normalised ``text``."""
    usable = [k for k in keywords if normal_keyword(k)]
    if not usable:
        return F.array().cast("array<string>")

    def hits(found: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_occurs(k, text, found), F.lit(k)) for k in usable]))

    return _over_runs(hits, text, usable, runs)


def first_hit(text: Column, keywords, runs: Column | None = None) -> Column:
    """First matched keyword in rule order; null when none."""
    return F.get(keyword_hits(text, keywords, runs), F.lit(0))


def topic_hits(text: Column, topics: list[Topic], runs: Column | None = None) -> Column:
    """array<struct(name, weight)> of the topics with a keyword in ``text``, in topic order."""
    if not topics:
        return F.array().cast("array<struct<name:string,weight:double>>")
    return F.array_compact(F.array(*[
        F.when(any_keyword(text, t.keywords, runs), F.struct(F.lit(t.name).alias("name"), F.lit(float(t.weight)).alias("weight")))
        for t in topics
    ]))


def match_many(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, ordinal, keyword) for large rule tables with columns ``ordinal`` and ``keyword``.

    A keyword can only match where its longest letter-or-digit run occurs as a run of the text
    (with a plural ending, if it may have one), so keys and rules join on that run alone; a
    keyword of signs joins on its first sign. A run that is the whole keyword decides. Only for
    the others is the text read back, once for each key and candidate. Texts of one key, null
    too, count together.
    """
    norm = match_text(F.col("keyword"))
    esc = F.regexp_replace(norm, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    last = F.element_at(F.split(norm, " "), -1)
    plural = (F.length(last) >= 3) & last.rlike("^[a-z]+$") & ~last.endswith("s")
    by_length = F.transform(F.regexp_extract_all(norm, F.lit("[a-z0-9]+"), F.lit(0)), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    anchor = F.coalesce(F.array_max(by_length)["r"], F.substring(norm, 1, 1))
    forms = F.when(plural & norm.endswith(anchor), F.array(anchor, F.concat(anchor, F.lit("s")), F.concat(anchor, F.lit("es")))).otherwise(F.array(anchor))
    compiled = rules.filter(norm != "").select(
        "ordinal", "keyword", (norm.rlike("^[a-z0-9]+$")).alias("_decides"),
        F.concat(F.lit("(?<![a-z0-9])"), esc, F.when(plural, F.lit("(?:s|es)?")).otherwise(F.lit("")), F.lit("(?![a-z0-9])")).alias("_pattern"),
        F.explode(forms).alias("_run"),
    )
    norm_text = df.select(F.col(key), match_text(F.col(text)).alias("_text"))
    signs = F.filter(F.array(*[F.lit(s) for s in "+&#@"]), lambda s: F.contains("_text", s))
    cut = F.array_distinct(F.split(F.translate("_text", "+&#@", "    "), " "))
    runs = norm_text.select(key, F.explode(F.concat(cut, signs)).alias("_run"))
    met = runs.join(compiled, "_run")
    sure = met.filter("_decides").select(key, "ordinal", "keyword")
    if compiled.filter("not _decides").isEmpty():  # the rules alone are read; without such a keyword no text is needed again
        return sure.distinct()
    open_ = met.filter("not _decides").select(F.col(key).alias("_key"), "ordinal", "keyword", "_pattern").distinct()
    tested = open_.join(norm_text, F.col("_key").eqNullSafe(F.col(key))).filter(F.expr("_text rlike _pattern")).select(key, "ordinal", "keyword")
    return sure.unionByName(tested).distinct()


# Differences between two rules documents -------------------------------------------------


def rules_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, keyword, change, weight_before, weight_after) between two flat rules tables.

    Letter case and list order are ignored; ``change`` is added, removed or weight.
    """
    def keyed(df: DataFrame, side: str) -> DataFrame:
        own = F.when(F.col("kind") == "topic", F.lower(F.trim("name"))).otherwise(
            F.when(F.col("kind").isin("region"), F.lit("region")).otherwise(F.lower(F.trim("name"))))
        word = F.when(F.col("kind") == "region", F.lower(F.col("name"))).otherwise(F.lower(F.trim(F.coalesce("keyword", F.lit("")))))
        return df.groupBy("kind", own.alias("_name"), word.alias("_word")).agg(
            F.min_by("name", "ordinal").alias(f"name_{side}"), F.min_by("keyword", "ordinal").alias(f"keyword_{side}"),
            F.min("weight").alias(f"weight_{side}"), F.lit(True).alias(f"in_{side}"))

    joined = keyed(before, "before").join(keyed(after, "after"), ["kind", "_name", "_word"], "full_outer")
    change = (F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed")
              .when(~F.col("weight_before").eqNullSafe(F.col("weight_after")), "weight"))
    return joined.withColumn("change", change).filter("change is not null").select(
        "kind", F.coalesce("name_after", "name_before").alias("name"), F.coalesce("keyword_after", "keyword_before").alias("keyword"),
        "change", "weight_before", "weight_after")
