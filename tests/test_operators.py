"""Operators against brute force, goldens and metamorphic checks."""

import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linksift.functions import rules as R
from linksift.operators import containment, dedupe, joins, ranking, reputation, rollups, similarity, sketches, upsert
from linksift.plans import batch, history, links, rotation, scoring
from linksift.plans.pick_index import PickIndex
from linksift.session import delete_path
from linksift.sources import landed, snapshot
from linksift.sources.tables import Tables
from linksift.streaming import jobs

C = F.col
RECORD = ("id string, seq long, canonical_url string, source_urls array<string>, title string, description string, start_at timestamp, end_at timestamp, timezone string, city string, venue_text string,"
          " location_precision string, hosts array<string>, organizers array<string>, platforms array<string>, visibility_flags array<string>, registration_status string, event_type string, confidence double")


def record(i, title="AI Builders Dinner SF", url=None, start="2026-08-25 02:00:00", city="San Francisco", hosts=("Host A",), confidence=0.8, **extra):
    url = url or f"https://example.com/{i}"
    row = dict(id=str(i), seq=i, canonical_url=url, source_urls=[url], title=title, description="Small dinner for AI builders.", start_at=datetime.fromisoformat(start) if start else None, end_at=None,
               timezone="America/Los_Angeles", city=city, venue_text=None, location_precision="city_only", hosts=list(hosts), organizers=list(hosts), platforms=["luma"],
               visibility_flags=["approval_required"], registration_status="approval_required", event_type="dinner", confidence=confidence)
    row.update(extra)
    return tuple(row.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def test_golden_merge(spark):
    merged = dedupe.dedupe_records(frame(spark, record(1, url="https://example.com/a"), record(2, title="AI Builders Dinner San Francisco", url="https://lu.ma/a", hosts=("Host B",), confidence=0.95))).collect()
    assert len(merged) == 1
    row = merged[0]
    assert (row["id"], row["merged_count"], row["canonical_url"], row["confidence"]) == ("1", 2, "https://lu.ma/a", 0.95)
    assert row["hosts"] == ["Host A", "Host B"] and row["title"] == "AI Builders Dinner San Francisco"
    assert row["dedupe_key"] == "ai builders dinner|2026-08-24|san francisco"


def test_near_equal_titles_an_hour_apart_merge(spark):
    a = record(1, "Startup Grind San Francisco August Edition", start="2026-08-28 02:00:00", hosts=("x",))
    b = record(2, "Startup Grind SF - August Edition", start="2026-08-28 03:00:00", hosts=("y",))
    assert dedupe.dedupe_records(frame(spark, a, b)).count() == 1


def _duplicates(a, b):
    """The duplicate predicate, pair by pair."""
    import re

    def tokens(t):
        return {w for w in re.sub("[^a-z0-9]+", " ", t.lower()).split() if len(w) > 1 and w not in dedupe.title_tokens.__defaults__[0]}

    def key(r):
        title = re.sub(r"\b(sf|san francisco|bay area|event|meetup)\b", " ", re.sub("[^a-z0-9]+", " ", r["title"].lower()))
        return " ".join(title.split()), r["start_at"].date() if r["start_at"] else None, (r["city"] or "unknown city").lower()

    if key(a) == key(b) or set(a["source_urls"]) & set(b["source_urls"]):
        return True
    ca, cb = (a["city"] or "").lower(), (b["city"] or "").lower()
    if ca and cb and ca != cb or not a["start_at"] or not b["start_at"]:
        return False
    if abs(a["start_at"] - b["start_at"]) > timedelta(hours=3) and a["start_at"].date() != b["start_at"].date():
        return False
    ta, tb = tokens(a["title"]), tokens(b["title"])
    if not ta or not tb:
        return False
    shared = len(ta & tb)
    if shared / len(ta | tb) >= 0.72:
        return True
    subset = shared / min(len(ta), len(tb))
    return subset >= 0.8 and bool(set(a["hosts"]) & set(b["hosts"])) or subset >= 0.9 and shared >= 3


def random_records(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["agent", "builder", "founder", "dinner", "salon", "demo", "night", "growth", "panel", "coffee", "launch", "mixer"]
    rows = []
    for i in range(n):
        title = " ".join(rnd.sample(vocabulary, rnd.randint(1, 6)))
        start = datetime(2026, 8, 25) + timedelta(hours=rnd.randint(0, 60))
        url = f"https://e.com/{rnd.randint(0, n * 3)}"
        rows.append(record(i, title, url, start.isoformat(sep=" ") if rnd.random() < 0.9 else None, rnd.choice(["Oakland", "Berkeley", None]), (rnd.choice(["h1", "h2", "h3"]),), timezone="UTC"))
    # A third of the rows are copies of one record.
    hot = rows[0]
    return rows + [(str(n + k), n + k, *hot[2:]) for k in range(n // 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force_components(spark, seed):
    rows = random_records(60, seed)
    df = frame(spark, *rows)
    dicts = [dict(zip(df.columns, r)) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if _duplicates(dicts[i], dicts[j]) and (dicts[i]["city"] == dicts[j]["city"] or dicts[i]["canonical_url"] == dicts[j]["canonical_url"]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    # Then each group without a city joins the group of the first record it agrees with.
    homes = {}
    for root in {find(i) for i in range(len(rows))}:
        members = [i for i in range(len(rows)) if find(i) == root]
        if not any(dicts[i]["city"] for i in members):
            homes[root] = next((find(j) for j in range(len(rows)) if dicts[j]["city"] and any(_duplicates(dicts[i], dicts[j]) for i in members)), root)
    for root, home in homes.items():
        parent[root] = home
    want = {}
    for i in range(len(rows)):
        want.setdefault(find(i), set()).add(str(i))
    got = {}
    for r in dedupe.duplicate_groups(df).select("group_id", "id").collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_record_without_a_city_joins_one_city(spark):
    rows = [record(i, "Robotics Founders Breakfast Club", start="2026-08-25 02:00:00", city=city, hosts=(f"h{i}",)) for i, city in enumerate(["Rome", None, "Paris", "unknown", "Paris"], 1)]
    merged = dedupe.dedupe_records(frame(spark, *rows)).collect()
    assert sorted((r["id"], r["city"], r["merged_count"]) for r in merged) == [("1", "Rome", 3), ("3", "Paris", 2)]
    assert dedupe.dedupe_records(frame(spark, *rows).limit(0)).count() == 0


def test_dedupe_ignores_order_and_is_idempotent(spark):
    rows = random_records(30, 3)
    df = frame(spark, *rows)
    first = dedupe.dedupe_records(df)
    again = dedupe.dedupe_records(first.withColumn("source_urls", F.array("canonical_url")).select(df.columns))
    assert again.count() <= first.count()
    shuffled = dedupe.dedupe_records(df.orderBy(F.desc("title")).repartition(3))
    assert sorted(r["id"] for r in first.select("id").collect()) == sorted(r["id"] for r in shuffled.select("id").collect())


def test_history_golden_and_partition(spark):
    past = frame(spark, record(1, url="https://lu.ma/old"))
    now = frame(spark, record(10, "Other Evening", "https://lu.ma/old?utm_source=x", "2026-09-01 02:00:00"), record(11, "AI Builders Dinner Bay Area", "https://e.com/x"),
                record(12, "Fresh Salon Night", "https://e.com/y", "2026-09-05 02:00:00"))
    picks = spark.createDataFrame([("1",)], "record_id string")
    eligible, skipped = history.split_by_history(now, picks, past)
    assert [r["id"] for r in eligible.collect()] == ["12"]
    assert {r["id"] for r in skipped.collect()} == {"10", "11"}


def test_exact_rank_with_a_hot_key(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 9)}", rnd.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, p int, seq int")
    got = {r["seq"]: r["rank"] for r in ranking.exact_rank(df, ["k"], [F.desc("p"), C("seq")], partitions=7).collect()}
    want = {}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[1], r[2])), key=lambda r: r[0]):
        want.update({r[2]: i for i, r in enumerate(group, 1)})
    assert got == want


def test_round_robin_order(spark):
    df = spark.createDataFrame([("a", 9, 1), ("a", 8, 2), ("a", 1, 3), ("b", 9, 4), ("b", 2, 5), ("c", 10, 6)], "g string, p int, seq int")
    out = ranking.round_robin(df, ["g"], "p", "seq").orderBy("position").select("seq").collect()
    assert [r["seq"] for r in out] == [6, 1, 4, 2, 5, 3]


def test_half_mean_fold_over_long_keys(spark):
    values = [60.0, *([50.0] * 1200), *(random.Random(i).uniform(0, 100) for i in range(3800))]
    acc = values[0]
    for v in values[1:]:
        acc = (acc + v) / 2
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("one", 0, 80.0), ("one", 1, 40.0), ("one", 2, None), ("one", 3, 20.0), ("none", 0, None)], "k string, seq int, q double")
    got = {r["k"]: round(r["q"], 9) for r in reputation.running_half_mean(df, ["k"], "seq", ["q"]).collect()}
    assert got == {"k": round(acc, 9), "one": 40.0}


def test_half_mean_maps_compose_over_tasks(spark):
    rnd = random.Random(5)
    rows = [(key, i, rnd.choice([None, rnd.uniform(0, 100)]), rnd.uniform(0, 1)) for key in ("hot",) * 40 + ("a", "b", None) for i in range(rnd.randint(1, 60))]
    rows = [(k, at, q, w) for at, (k, _, q, w) in enumerate(rows)]
    want = {}
    for k, _, *values in rows:
        for v, x in enumerate(values):
            if x is not None:
                want[k, v] = (want[k, v] + x) / 2 if (k, v) in want else x
    df = spark.createDataFrame(rows, "k string, seq int, q double, w double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    for partitions in (1, 6):
        maps = reputation.half_mean_maps(df, ["k"], "seq", ["q", "w"], partitions)
        got = {
            (r["k"], v): r[c] for r in maps.select("k", reputation.half_mean(F.col("q")).alias("q"), reputation.half_mean(F.col("w")).alias("w")).collect() for v, c in enumerate("qw") if r[c] is not None}
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


SOURCE_ROW = "id string, seq int, quality_score double, noise_rate double, freshness_score double, events_found long, recommended_events long, last_seen timestamp, source_type string, name string, url string, handle string"


def test_reputation_goes_on_from_stored_rows(spark, tmp_path):
    """Three batches equal one, stored versions stay, a replay changes nothing, and rows saved in between count."""
    at = datetime(2024, 5, 1)
    rows = [(key, i, float(10 * i % 97), 0.25, 75.0 + i % 3, 1, i % 2, at + timedelta(days=i), "x", f"{key}{i}", None, None) for i in range(30) for key in ("new", "old")]
    rows += [("null", 31, None, None, None, None, None, None, None, None, None, None), (None, 32, 1.0, 1.0, 1.0, 1, 1, at, "x", None, None, None)]
    df = spark.createDataFrame(rows, SOURCE_ROW)
    found = []
    for ends in ([40], [9, 20, 40]):
        tables = Tables(spark, str(tmp_path / str(len(ends))))
        for quality in (80.0, 40.0):
            tables.save_sources(spark.createDataFrame([("old", quality, 5), ("kept", quality, 1)], "id string, quality_score double, events_found long"))
        assert tables.versions("sources") == [0, 1]
        low = -1
        for mark, high in enumerate(ends):
            batch = df.filter((F.col("seq") > low) & (F.col("seq") <= high))
            for _ in range(2):
                tables.fold_sources(batch, "seq", mark)
            low = high
        assert tables.read("sources", 1).filter("id = 'old'").first()["quality_score"] == 60.0
        assert tables.last_mark("sources") == len(ends) - 1
        found.append(sorted(map(str, tables.read("sources").withColumns({c: F.round(c, 9) for c in ("quality_score", "noise_rate")}).collect())))
    assert found[0] == found[1] and len(found[0]) == 4
    acc = 60.0
    for r in rows[:60]:
        acc = (acc + r[2]) / 2 if r[0] == "old" else acc
    last = {r["id"]: r for r in tables.read("sources").collect()}
    assert round(last["old"]["quality_score"], 9) == round(acc, 9) and last["old"]["events_found"] == 40 and last["kept"]["quality_score"] == 60.0
    assert (last["new"]["name"], last["new"]["last_seen"]) == ("new0", at + timedelta(days=29))
    tables.save_sources(spark.createDataFrame([("old", 0.0, 2)], "id string, quality_score double, events_found long"))
    tables.fold_sources(df.filter("seq = 29"), "seq", 3)  # a later batch
    again = tables.read("sources").filter("id = 'old'").first()
    assert again["events_found"] == 43 and round(again["quality_score"], 9) == round((acc / 2 + rows[58][2]) / 2, 9)


def test_reputation_stream_restarts(spark, tmp_path):
    """A stream over a stored table, stopped and started again with more rows."""
    tables = Tables(spark, str(tmp_path / "tables"))
    tables.save_sources(spark.createDataFrame([("a", 40.0)], "id string, quality_score double"))
    for i, x in enumerate((80.0, 20.0, 60.0)):
        row = ("a", i, x, 0.5, 75.0, 1, 0, datetime(2024, 5, 1), "x", None, None, None)
        spark.createDataFrame([row], SOURCE_ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.keep_reputation(spark.readStream.schema(SOURCE_ROW).parquet(str(tmp_path / "in")), tables, str(tmp_path / "state")).awaitTermination()
    row = tables.read("sources").first()
    assert (row["quality_score"], row["events_found"]) == (50.0, 3) and tables.versions("sources") == [0, 1, 2, 3]


def test_daily_budget_in_summer(spark):
    runs = spark.sql("SELECT timestamp '2024-07-02 06:30:00' AS started_at, 2L AS x_posts_read UNION ALL SELECT timestamp '2024-07-02 07:30:00', 3L UNION ALL SELECT timestamp '2024-01-02 07:30:00', 5L")
    got = {str(r["day"]): r["used"] for r in jobs.daily_budget(runs).collect()}
    assert got == {"2024-07-01": 2, "2024-07-02": 3, "2024-01-01": 5}


def test_stream_never_picks_a_repeat(spark, tmp_path):
    """The same url in a later micro-batch is not picked again."""
    tables = Tables(spark, str(tmp_path / "tables"))
    columns = "id string, canonical_url string, source_urls array<string>, title string, start_at timestamp, timezone string, city string, hosts array<string>, organizers array<string>, score double"
    for i, (key, url) in enumerate([("a", "https://x.example.com/1"), ("b", "https://x.example.com/1"), ("c", "https://x.example.com/2")]):
        row = (key, url, [url], {"1": "Potters and glaziers supper", "2": "Night swim"}[url[-1]], datetime(2024, 6, 20, 12), None, None, [], [], 90.0)
        spark.createDataFrame([row], columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.pick_new(spark.readStream.schema(columns).parquet(str(tmp_path / "in")), tables, R.DEFAULT_RULES, datetime(2024, 6, 15), 5, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["record_id"] for r in tables.read("picks").collect()) == ["a", "c"]


def test_pick_index_agrees_with_the_whole_history(spark, tmp_path):
    """Repeats found through the index, batch by batch, are those found by comparing with all picks."""
    rnd = random.Random(3)
    words = "potters glaziers night swim river walk founder dinner makers supper open studio late jazz".split()

    def some(first, n):
        rows = []
        for i in range(first, first + n):
            title = " ".join(rnd.sample(words, rnd.randint(1, 5)))
            start = None if rnd.random() < 0.1 else datetime(2024, 6, 20) + timedelta(hours=rnd.choice([0, 1, 2, 3, 4, 23, 26, 50, 51, 300]))
            url = rnd.choice([None, "", f"https://x.example.com/{rnd.randint(0, 60)}", f"https://www.x.example.com/{rnd.randint(0, 60)}/?utm_source=a"])
            city = rnd.choice([None, "", "SF", "San Francisco", "Oakland"])
            rows.append((str(i), url, [u for u in [url] if u], rnd.choice([title, title, None]), start, rnd.choice([None, "America/Los_Angeles"]), city, rnd.sample(["ann", "bob"], rnd.randint(0, 2)), [], 90.0))
        return rows

    columns = "id string, canonical_url string, source_urls array<string>, title string, start_at timestamp, timezone string, city string, hosts array<string>, organizers array<string>, score double"
    index = PickIndex(spark, str(tmp_path / "index"))
    assert index.last_batch() == -1
    told = []
    for batch in range(3):
        fresh = some(100 * batch, 40) + ([told[0]] if told else [])
        rows = spark.createDataFrame(fresh, columns)
        got = {r["id"] for r in index.repeated(rows, batch).collect()}
        old = spark.createDataFrame(told, columns)
        want = {r["id"] for r in history.repeated_ids(rows, old.select(F.col("id").alias("record_id")), old).collect()} if told else set()
        assert got == want and (batch == 0 or 0 < len(want) < 41)
        chosen = rows.filter(F.col("id").cast("int") % 2 == 0)
        for _ in range(2):  # a replay overlooks its own entries and replaces them
            assert {r["id"] for r in index.repeated(rows, batch).collect()} == want
            index.add(chosen, batch)
        told += [r for r in fresh if int(r[0]) % 2 == 0]
        entries = spark.read.parquet(str(tmp_path / "index" / "entries"))
        assert entries.count() == entries.distinct().count() and index.last_batch() == batch


def test_pick_index_reads_the_days_of_a_batch(spark, tmp_path):
    """Rows read for a batch do not grow with picks of other days."""
    columns = "id string, canonical_url string, source_urls array<string>, title string, start_at timestamp, timezone string, city string, hosts array<string>, organizers array<string>"
    index = PickIndex(spark, str(tmp_path / "index"))
    sizes = []
    for batch in range(3):
        days = spark.range(200).selectExpr(f"concat({batch}, '-', id) AS id", "CAST(NULL AS string) AS canonical_url", "CAST(array() AS array<string>) AS source_urls", "concat('supper number', id) AS title",
                                           f"timestamp '2024-06-20 12:00:00' + make_interval(0, 0, 0, {100 * batch} + CAST(id AS int) % 5) AS start_at", "CAST(NULL AS string) AS timezone", "'sf' AS city",
                                           "CAST(array() AS array<string>) AS hosts", "CAST(array() AS array<string>) AS organizers")
        index.add(spark.createDataFrame(days.collect(), columns), batch)
        first = str(19894)  # 2024-06-20
        sizes.append(index.read("entries", [first]).count())
        assert "PartitionFilters" in index.read("entries", [first])._jdf.queryExecution().toString()
    assert sizes[0] == sizes[1] == sizes[2] > 0


@pytest.mark.parametrize("files", [1, 3])
def test_silence_of_jobs_with_and_without_success(spark, tmp_path, files):
    log = [("never", "failed", 0), ("never", "failed", 20), ("never", "failed", 30), ("old", "succeeded", 1), ("old", "failed", 28), ("old", "succeeded", 40), ("fine", "failed", 2), ("fine", "succeeded", 20),
           ("fine", "succeeded", 40), ("new", "failed", 41), ("late first", "failed", 3), ("late first", "succeeded", 29), ("end", "running", 60), (None, "failed", 5), ("never", "failed", None)]
    rows = sorted(((j, s, None if h is None else datetime(2024, 7, 1) + timedelta(hours=h)) for j, s, h in log), key=lambda r: (r[2] is None, r[2]))
    schema = "job string, status string, at timestamp"
    for k in range(files):
        spark.createDataFrame(rows[len(rows) * k // files:len(rows) * (k + 1) // files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = jobs.latest_result(jobs.silence_alerts(stream), str(tmp_path / "out"), str(tmp_path / "state"), "append").collect()
    hour = lambda t: None if t is None else int((t - datetime(2024, 7, 1)).total_seconds() // 3600)
    assert len(out) == 4 and {(r["job"], hour(r["last_success"]), hour(r["alert_at"])) for r in out} == {("late first", None, 27), ("late first", 29, 53), ("never", None, 24), ("old", 1, 25)}


def _sets(rnd, count, tokens, most):
    return {f"n{i}": sorted(rnd.sample([f"t{j}" for j in range(tokens)], rnd.randint(1, most))) for i in range(count)}


def _matches(sets, blocks, ratio, pairs, min_shared=1):
    shared = lambda a, b: len(set(sets[a]) & set(sets[b]))
    return {(a, b) for a, b in pairs if set(blocks[a]) & set(blocks[b]) and shared(a, b) >= max(min_shared, ratio * min(len(sets[a]), len(sets[b])) - 1e-9)}


@pytest.mark.parametrize("ratio,min_shared,split", [(0.72, 1, 20_000), (0.82, 1, 3), (0.8, 3, 5), (1.0, 2, 1)])
def test_similarity_pairs_miss_nothing(spark, ratio, min_shared, split):
    rnd = random.Random(11)
    sets = _sets(rnd, 70, 14, 9)
    blocks = {k: rnd.sample(["a", "b", "c"], rnd.randint(1, 3)) for k in sets}
    schema = "node string, tokens array<string>, blocks array<string>"
    nodes = spark.createDataFrame([(k, v, blocks[k]) for k, v in sets.items()], schema)
    rows = [(r["x"], r["y"]) for r in similarity.similar_pairs(nodes, None, ratio, min_shared, split).collect()]
    need = {frozenset(p) for p in _matches(sets, blocks, ratio, itertools.combinations(sets, 2), min_shared)}
    got = {frozenset(p) for p in rows}
    df = {t: sum(t in v for v in sets.values()) for v in sets.values() for t in v}

    def probes(a):
        n = len(sets[a])
        return set(sorted(sets[a], key=lambda t: (df[t], t))[:max(n - max(min_shared, math.ceil(ratio * n - 1e-9)) + 1, 0)])

    by_prefix = {frozenset(p) for p in itertools.combinations(sets, 2) if set(blocks[p[0]]) & set(blocks[p[1]])
                 and probes(min(p, key=lambda a: (len(sets[a]), a))) & set(sets[max(p, key=lambda a: (len(sets[a]), a))])}
    assert need <= got and len(got) == len(rows) and 2 * len(got - need) <= len(by_prefix - need)  # each pair once, candidates in vain halved at least
    names = sorted(sets)
    left, right = names[:40], names[30:]  # some nodes stand on both sides
    both = similarity.similar_pairs(nodes.filter(C("node").isin(left)), nodes.filter(C("node").isin(right)), ratio, min_shared, split)
    rows = [(r["x"], r["y"]) for r in both.collect()]
    assert _matches(sets, blocks, ratio, itertools.product(left, right), min_shared) <= set(rows) and len(set(rows)) == len(rows)
    assert {x for x, _ in rows} <= set(left) and {y for _, y in rows} <= set(right)
    empty = nodes.limit(0)
    assert similarity.similar_pairs(empty, None, ratio).count() == 0 and similarity.similar_pairs(nodes, empty, ratio).count() == 0


def test_a_hot_token_is_met_in_parts(spark):
    """Half of all sets hold only tokens of which each stands in at least a quarter of them: no list is met whole."""
    rnd = random.Random(5)
    rows = [(f"n{i}", [f"h{j}" for j in rnd.sample(range(4), 2)] + [f"r{i}"] if i % 2 else [f"r{i}", f"s{i}"], ["all"]) for i in range(1200)]
    nodes = spark.createDataFrame(rows, "node string, tokens array<string>, blocks array<string>")
    sets = similarity.ordered_sets(nodes).drop("tokens").withColumn("side", F.lit(0)).cache()
    split = 50
    whole = similarity.pair_entries(sets, False, 0.3)
    assert min(e.groupBy("_k").count().agg(F.max("count")).first()[0] for e in whole) > 4 * split
    for entries in similarity.pair_entries(sets, False, 0.3, 1, split):
        assert entries.groupBy("_k", "_p", "_q").count().agg(F.max("count")).first()[0] < 2 * split


def test_contained_titles_equal_substring_search(spark):
    rnd = random.Random(13)
    words = ["founders", "dinner", "salonnight", "supercalifragilistic", "ab", "growthhackers", "meetupgroup", "x"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 25)))) for i in range(60)]
    titles = ["dinner founders ab", "ers salonnight din", "rowthhackers", "owthhackers meet", "inner founders", "califragilist", "ounders x dinn", "supercalifragilistic"]
    got = joins.contained_titles(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([(t,) for t in titles], "p string"), "p")
    assert {(r["k"], r["p"]) for r in got.collect()} == {(k, p) for k, t in texts for p in titles if p in t}


def test_upsert_rules(spark):
    old = spark.createDataFrame([("a", "t1", 1, 5), ("b", "t2", 2, 6)], "id string, title string, first int, last int")
    new = spark.createDataFrame([("a", "n1", 9, 9), ("a", "n2", 0, 7), ("c", "n3", 3, 3)], "id string, title string, first int, last int").withColumn("s", F.monotonically_increasing_id())
    out = {r["id"]: tuple(r)[1:] for r in upsert.upsert(old, new, ["id"], "s", ["title"], ["first"], ["last"]).collect()}
    assert out == {"a": ("n2", 0, 7), "b": ("t2", 2, 6), "c": ("n3", 3, 3)}


def test_tables_append_in_place_and_insert_picks_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    assert tables.read("picks").count() == 0
    picks = spark.createDataFrame([("p1", "r", "e", 80.0)], "pick_id string, run_id string, record_id string, score double")
    tables.save_picks(picks)
    tables.save_picks(picks.withColumn("pick_id", F.lit("p2")))
    assert tables.read("picks").count() == 1 and tables.versions("picks") == [0]
    bad = tables.save_feedback(spark.createDataFrame([("1", "e", "good"), ("2", "e", "nope")], "id string, record_id string, feedback_type string"))
    assert bad.count() == 1 and tables.read("feedback").count() == 1


def test_snapshot_reads_missing_arrays_and_sets_bad_files_aside(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"runs": [{"run_id": "r1", "status": "succeeded"}], "feedback": [{"id": "f", "feedback_type": "good"}]}')
    (tmp_path / "bad.json").write_text("{not json")
    tables, rejects = snapshot.read_snapshot(spark, str(tmp_path))
    assert {n: df.count() for n, df in tables.items() if n in ("runs", "feedback", "scores")} == {"runs": 1, "feedback": 1, "scores": 0}
    assert rejects.count() == 1


def test_display_run_and_health(spark):
    runs = spark.createDataFrame([("new", datetime(2026, 8, 23, 11), "running", None), ("old", datetime(2026, 8, 23, 9), "succeeded", None)], "run_id string, started_at timestamp, status string, error string")
    assert rollups.display_run(runs).first()["run_id"] == "old"
    assert rollups.health(runs, datetime(2026, 8, 23, 12)).first()["status"] == "healthy"
    assert rollups.health(runs, datetime(2026, 8, 23, 14)).first()["message"] == "Latest run appears stuck."
    assert rollups.health(runs.limit(0), datetime(2026, 8, 23, 14)).first()["message"] == "No runs have been recorded yet."


# --- Links and scoring goldens ------------------------------------------------------------

AS_OF = datetime(2026, 8, 23, 19)


def assess(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, canonical_url string, title string, snippet string")
    return links.assess_links(df, R.DEFAULT_RULES, AS_OF.date()).orderBy("i").collect()


def test_rejection_goldens(spark):
    rows = assess(
        spark, ("https://example.com/events/2024/09/12/ai-founders-dinner", "AI Founders Dinner", "Small dinner for AI founders in SF."),
        ("https://example.com/events/ai-builders", "AI Builders Salon September 12, 2024", "Join founders in San Francisco."),
        ("https://example.com/events/agent-demo", "Agent Demo Night", "Event recap from 2025 with videos and photos."),
        ("https://lu.ma/ai-founders-2026-09-12", "AI Founders Dinner", "Approval required dinner in San Francisco."),
        ("https://foundercal.com/events/agents-in-production-devtools-demo-night-ZyFjwNGmPr04VjZ", "Public source link from FounderCal SF",
         "199 upcoming startup & tech events in San Francisco. Startup School 2026 July 25-26. Agents in Production Devtools Demo Night September 10, 2026."),
        ("https://example.com/hack", "SF Hackathon", "Build all weekend."))
    assert [r["rejection_reason"] for r in rows] == [links.PAST] * 3 + [None, None, "excluded_format:hackathon"]
    assert rows[4]["source_score"] >= 40


def test_intent_and_signal_goldens(spark):
    rows = assess(
        spark, ("https://lu.ma/agent-demo-night", "Agent Demo Night", "Apply to attend this San Francisco builder demo night on September 12, 2026."),
        ("https://sf.aitinkerers.org/events", "AI Tinkerers - San Francisco - Events", "Upcoming events calendar with builder demos in San Francisco."),
        ("https://homebrewclub.berrry.app/", "Homebrew Club - Community Coworking Space", "Community space and event space in San Francisco."),
        ("https://eventbrite.com/e/founder-conference-side-dinner-tickets-123", "Founder Conference Side Dinner", "San Francisco dinner. Apply to attend."),
        ("https://lu.ma/ai-founder-dinner", "AI Founder Dinner San Francisco", "Approval required dinner for agent builders and operators."),
        ("https://example.com/webinar", "Online AI Webinar Course", "Virtual only vendor training and sponsorship."))
    assert [r["intent"] for r in rows[:4]] == ["concrete_event", "listing_source", "organizer_source", "concrete_event"]
    assert rows[4]["source_score"] >= 80 > rows[5]["source_score"]


def test_topic_adjustment_goldens(spark):
    b2b = record(1, "B2B AI Enterprise GTM Dinner", hosts=("Enterprise SaaS Community",), description="Approval required roundtable for enterprise SaaS sales, RevOps, pipeline, CIO buyers, and B2B GTM leaders.")
    consumer = record(2, "Consumer AI Founders Dinner", hosts=("Credible Founder",), description="Approval required dinner for founders building consumer AI and creator apps.")
    conference = record(3, "Consumer AI Conference", hosts=("Credible Founder",), description="Annual conference for consumer AI builders.", event_type="conference")
    out = {r["id"]: r for r in scoring.adjust_scores(scoring.rubric_scores(frame(spark, b2b, consumer, conference), R.DEFAULT_RULES), R.DEFAULT_RULES).collect()}
    assert (out["1"]["boost"], out["1"]["penalty"]) == (0, 20)
    assert (out["2"]["boost"], out["3"]["boost"]) == (8, 4)
    assert "lower_priority_topic:b2b_enterprise_saas" in out["1"]["penalties"] and out["2"]["should_recommend"]


def test_score_rows_golden(spark):
    rules = R.Rules(recommend=85)
    row = scoring.score_rows(spark.createDataFrame([("a", 82.0)], "id string, score double"), rules).first()
    assert (row["user_fit"], row["next_action"], row["should_recommend"]) == (21, "monitor", False)


# --- Scans ---------------------------------------------------------------------------------


def test_page_anchor_goldens(spark):
    html = ('<html><head><link rel="icon" href="https://lu.ma/favicon.ico"></head><a href="https://lu.ma/agent-dinner?utm_source=newsletter">A</a><a href="/events/internal-founder-breakfast">B</a>'
            '<a href="mailto:t@e.com">M</a><a href="https://luma.com/signin">S</a><a href="/static/banner.png">P</a></html>')
    page = spark.createDataFrame([("https://example.com/roundup", html)], "url string, html string")
    assert [r["link"] for r in landed.anchor_links(page).collect()] == ["https://lu.ma/agent-dinner", "https://example.com/events/internal-founder-breakfast"]
    pages = page.select(F.lit("q").alias("query_id"), F.lit("t").alias("query_text"), F.lit(97.0).alias("own_score"), F.lit(1).alias("max_links"), "url", "html")
    rows = landed.page_links(pages, R.DEFAULT_RULES, AS_OF, "run").collect()
    assert len(rows) == 1 and rows[0]["platform"] == "luma" and rows[0]["source_score"] >= 97


def test_feed_and_post_goldens(spark):
    feed = "<rss><channel><item><title>Agents</title><link>https://n.example.com/1</link><description><![CDATA[See https://lu.ma/agent-breakfast?utm_source=n.]]></description></item></channel></rss>"
    feeds = spark.createDataFrame([("q", "t", "https://n.example.com/feed", feed), ("q2", "t", "https://n.example.com/bad", "nope")], "query_id string, query_text string, feed_url string, body string")
    rows = {r["source_id"]: r for r in landed.feed_links(feeds, R.DEFAULT_RULES, AS_OF, "run").collect()}
    assert rows["https://n.example.com/feed"]["canonical_url"] == "https://lu.ma/agent-breakfast"
    assert (rows["https://n.example.com/bad"]["status"], rows["https://n.example.com/bad"]["rejection_reason"]) == ("error", landed.FEED_FAILED)
    post = ('{"data":[{"id":"10","text":"Apply here https://t.co/a","author_id":"u1","created_at":"2026-08-22T10:00:00Z","entities":{"urls":[{"expanded_url":"https://lu.ma/agents?utm_source=x"}]}},'
            '{"id":"11","text":"no link","author_id":"u1"}],"includes":{"users":[{"id":"u1","name":"Builder","username":"builder"}]}}')
    posts = spark.createDataFrame([("q", "t", post)], "query_id string, query_text string, body string")
    first = landed.social_posts(posts, R.DEFAULT_RULES, AS_OF, "run", max_posts=1).collect()
    assert [(r["canonical_url"], r["source_handle"], r["platform"]) for r in first] == [("https://lu.ma/agents", "builder", "x")]
    both = landed.social_posts(posts, R.DEFAULT_RULES, AS_OF, "run").collect()
    assert [r["rejection_reason"] for r in both if r["source_id"] == "11"] == [landed.NO_POST_LINK]
    assert landed.skipped_social(spark, "r", AS_OF).first()["status"] == "rejected"


def test_batch_never_repeats_a_pick(spark):
    link_rows = spark.createDataFrame([(str(i), i, f"https://lu.ma/e{i}", f"Founder Dinner number{i} San Francisco", "Approval required dinner for agent founders.", "luma") for i in range(6)],
                                      "id string, seq int, canonical_url string, title string, snippet string, platform string")
    none = F.lit(None).cast("string")
    found = links.assess_links(link_rows.withColumns({"url": C("canonical_url"), "source_url": C("canonical_url"), "source_query": none, "source_id": none}), R.DEFAULT_RULES, AS_OF.date())
    raw = link_rows.select(C("id").alias("link_id"), F.to_json(F.struct("id", "canonical_url", F.array("canonical_url").alias("source_urls"), "title", C("snippet").alias("description"), F.lit("2026-09-01T02:00:00Z").alias("start_at"),
                                                                        F.lit("exact").alias("location_precision"), F.lit(0.9).alias("confidence"))).alias("raw"))
    history_rows = frame(spark, record(3, "Founder Dinner number3 San Francisco", "https://lu.ma/e3", "2026-09-01 02:00:00"))
    picks = spark.createDataFrame([("p", "r0", "3", 90.0)], "pick_id string, run_id string, record_id string, score double")
    result = batch.run_batch(found, raw, picks, history_rows, R.DEFAULT_RULES, AS_OF, "run1")
    chosen = {r["record_id"] for r in result.picks.collect()}
    assert chosen and "3" not in chosen
    assert result.counters["candidates_found"] == 6 and result.counters["recommendations_created"] == len(chosen)
    assert "recommended" in result.digest.first()["text"]
    assert {r["link_id"] for r in result.attribution.collect()} >= chosen


def digest_of(spark, rows, **options):
    from linksift.plans.digest import render_digests

    base = frame(spark, *[record(i, title, start=start) for i, (title, start, _) in enumerate(rows)])
    scores = spark.createDataFrame([(str(i), float(s)) for i, (_, _, s) in enumerate(rows)], "id string, score double")
    events = base.join(scores, "id").withColumns({"run_id": F.lit("r"), "reasons": F.array(F.lit("Strong AI/founder fit. More."))})
    return render_digests(events, 80, 65, datetime(2026, 8, 22, 12), **options).first()["text"]


def test_digest_goldens(spark):
    day = "2026-09-10 02:00:00"
    text = digest_of(spark, [("Top Dinner", day, 92), ("R&D Salon", day, 84), ("Maybe One", day, 72), ("Maybe Two", day, 66), ("Weak Meetup", day, 59), ("Past Dinner", "2026-08-20 02:00:00", 99)],
                     max_possible=1, report_url="https://admin.example.com/?token=secret")
    lines = text.split("\n")
    assert lines[0] == "Link digest: 3 events" and lines[1] == "2 recommended, 1 review-worthy"
    assert "1. Top Dinner (92)\nSep 9, 7:00 PM - San Francisco\nWhy: Strong AI/founder fit.\nLink: https://example.com/0" in text
    assert "2. R&amp;D Salon (84)" in text and "Possible (65-79)\n\n1. Maybe One (72)" in text
    assert not any(w in text for w in ("Maybe Two", "Weak", "Past", "secret")) and text.endswith("admin dashboard</a>")
    long = digest_of(spark, [(f"Very Long AI Founder Dinner {i} " + "x" * 90, day, 90 - i) for i in range(8)], max_length=1200)
    assert len(long) <= 1200 and long.endswith("for the full run.") and "1. Very Long" in long


def test_run_row_round_trips_through_the_log(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    start = datetime(2026, 8, 23, 12)
    tables.log_run(spark.createDataFrame([("r", 0, start, "running", 5)], "run_id string, seq long, started_at timestamp, status string, candidates_found long"))
    tables.log_run(batch.run_row(spark, "r", start, start + timedelta(minutes=3), {"candidates_found": 9, "scoring_attempted": 4}))
    row = tables.runs().first()
    assert (row["status"], row["candidates_found"], row["scoring_attempted"], row["scores_created"], row["scoring_limit"]) == ("succeeded", 9, 4, 0, None)


def test_rules_judge_whole_texts_behind_a_short_snippet(spark):
    late = "a plain sentence " * 60 + "then a hackathon"
    body = '{"results": [{"id": "1", "title": "t", "url": "https://example.com/a", "text": "%s"}]}' % late
    row = landed.search_results(spark.createDataFrame([("q", "w", body)], "query_id string, query_text string, body string"), R.DEFAULT_RULES, AS_OF, "run").first()
    assert (row["rejection_reason"], len(row["snippet"])) == ("excluded_format:hackathon", 500)
    html = f"<title>P</title><p>{late}</p><a href='/events/7'>e</a>"
    pages = spark.createDataFrame([("q", "w", "https://n.example.com/x", html)], "query_id string, query_text string, url string, html string")
    row = landed.page_links(pages, R.DEFAULT_RULES, AS_OF, "run").first()
    assert (row["rejection_reason"], len(row["snippet"])) == ("excluded_format:hackathon", 500)


@pytest.mark.parametrize("files", [1, 3])
def test_stuck_alerts_do_not_depend_on_batches(spark, tmp_path, files):
    log = [("late end", "running", 0), ("late end", "succeeded", 200), ("in time", "running", 0), ("in time", "failed", 100), ("open", "running", 10),
           ("open", "running", 30), ("just begun", "running", 590), ("clock", "succeeded", 600), (None, "running", None)]
    rows = [(r, s, None if m is None else datetime(2024, 7, 1) + timedelta(minutes=m)) for r, s, m in log]
    rows.sort(key=lambda r: (r[2] is None, r[2]))
    schema = "run_id string, status string, at timestamp"
    for k in range(files):
        part = rows[len(rows) * k // files:len(rows) * (k + 1) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = jobs.latest_result(jobs.stuck_run_alerts(stream), str(tmp_path / "out"), str(tmp_path / "state"), "append").collect()
    assert sorted((r["run_id"], r["started_at"].minute) for r in out) == [("late end", 0), ("open", 10)]


def test_upsert_breaks_ties_by_value_and_ignores_late_rows(spark, tmp_path):
    old = spark.createDataFrame([("a", "x")], "id string, v string")
    rows = [("a", "m"), ("a", "z"), ("b", "k"), ("b", None), (None, "n")]
    for order in (rows, rows[::-1]):
        new = spark.createDataFrame(order, "id string, v string").repartition(3).withColumn("s", F.lit(1))
        assert {r["id"]: r["v"] for r in upsert.upsert(old, new, ["id"], "s").collect()} == {"a": "z", "b": "k", None: "n"}
    tables = Tables(spark, str(tmp_path))
    for seq, text in ((5, "new"), (3, "late"), (None, "no order")):
        tables.save_queries(spark.createDataFrame([("q", text, seq)], "id string, query_text string, s long"), "run", "s")
    assert [(r["id"], r["query_text"]) for r in tables.read("queries").collect()] == [("run:q", "new")]
    scores = spark.createDataFrame([("1", 90.0), ("2", 10.0)], "record_id string, total double").withColumns({"next_action": F.lit(None).cast("string"), "should_recommend": F.lit(None).cast("boolean")})
    for run in ("r1", "r2", "r1"):
        tables.save_scores(scores, run, "m", "p", 80)
    assert sorted((r["run_id"], r["record_id"]) for r in tables.read("scores").collect()) == [("r1", "1"), ("r1", "2"), ("r2", "1"), ("r2", "2")]


def _query_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, query_text string, s long")


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), buckets=16)
    expected = {}
    rnd = random.Random(5)

    def save(rows, tables=tables):
        tables.upsert("queries", _query_rows(spark, rows), "s", whole_row=True)
        for key, text, seq in rows:
            if key not in expected or seq > expected[key][1]:
                expected[key] = (text, seq)

    save([(f"q{i}", "first", 10) for i in range(600)])
    before, held = tables.folders("queries"), tables.read("queries")
    assert len(before) == 16 and {f[0] for f in before} == {16}
    ten = [(f"q{i}", "again", 20) for i in rnd.sample(range(600), 10)]
    save(ten)
    after = tables.folders("queries")
    assert set(before) <= set(after) and 1 <= len(set(after) - set(before)) <= 10
    assert held.filter("query_text = 'first'").count() == 600  # a reader keeps the files it opened
    save([(key, "late", 15) for key, _, _ in ten])
    save([(f"q{rnd.randrange(700)}", f"t{n}", n) for n in rnd.sample(range(1000), 200)], Tables(spark, str(tmp_path), buckets=4))  # stored tables keep their number of buckets
    found = {r["id"]: r["query_text"] for r in tables.read("queries").collect()}
    assert found == {key: text for key, (text, _) in expected.items()}
    for _ in range(2):
        save([("q1", "last", 5000)])
    assert {f[0] for f in tables.folders("queries")} == {16}
    assert max(len([f for f in tables.folders("queries") if f[1] == b]) for b in range(16)) == 2  # the newest, and the one before it
    assert tables.read("queries").count() == len(expected)


def test_an_upsert_that_failed_half_way_is_made_whole_by_the_next(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), buckets=8)
    tables.upsert("queries", _query_rows(spark, [(f"q{i}", "old", 1) for i in range(100)]), "s", whole_row=True)
    rows = _query_rows(spark, [(f"q{i}", "new", 2) for i in range(150)])
    tables.upsert("queries", rows, "s", whole_row=True)
    for folder in [f for f in tables.folders("queries") if f[2] == 1][::2]:  # half of its buckets were never put in place
        delete_path(spark, tables._folder("queries", folder))
    assert {r["query_text"] for r in tables.read("queries").collect()} == {"old", "new"}
    tables.upsert("queries", rows, "s", whole_row=True)
    assert sorted((r["id"], r["query_text"]) for r in tables.read("queries").collect()) == sorted((f"q{i}", "new") for i in range(150))


def test_new_links_are_inserted_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), buckets=8)
    columns = "id string, title string, discovered_at timestamp"
    at = [datetime(2024, 5, d) for d in range(1, 5)]
    tables.save_new_links(spark.createDataFrame([("a", "a2", at[1]), ("a", "a1", at[0]), ("b", "b", None), (None, "nobody", at[0])], columns))
    folders = tables.folders("links")
    tables.save_new_links(spark.createDataFrame([("a", "a3", at[2]), ("b", "b2", at[0])], columns))
    assert tables.folders("links") == folders  # nothing new, nothing written
    tables.save_new_links(spark.createDataFrame([("c", "c", at[3]), ("a", "a0", at[0])], columns))
    assert sorted((r["id"], r["title"]) for r in tables.read("links").collect()) == [("a", "a1"), ("b", "b"), ("c", "c")]
    tables.save_new_links(spark.createDataFrame([], columns))
    with pytest.raises(ValueError):
        tables.read("links", 0)


def test_a_url_stays_known_after_it_left_the_state(spark, tmp_path):
    """A repeat that comes long after the horizon is dropped, and the state holds recent urls alone."""
    tables = Tables(spark, str(tmp_path / "tables"), buckets=4)
    days = [("u1", 1), ("u2", 1), ("u3", 20), ("u1", 40), ("u4", 40), ("u1", 60), ("u2", 60)]
    kept = []
    for i, day in enumerate((1, 20, 40, 60)):
        rows = [(u, datetime(2024, 1, 1) + timedelta(days=d)) for u, d in days if d == day]
        spark.createDataFrame(rows, "canonical_url string, discovered_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("canonical_url string, discovered_at timestamp").parquet(str(tmp_path / "in"))
        query = jobs.keep_new_links(stream, tables, str(tmp_path / "state"), keep="7 days")
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert {r["id"]: r["discovered_at"].day for r in tables.read("links").collect()} == {"u1": 2, "u2": 2, "u3": 21, "u4": 10}
    assert max(kept) <= 3


def test_rotation_joins_days_by_remainder(spark):
    rnd = random.Random(11)
    sources = [(rnd.choice(["a", "source", "é", ""]) + str(rnd.randrange(10**rnd.randrange(1, 9))), rnd.choice(["must_scan", "high", "medium", "paused", None]),
                rnd.choice(["x", "rss", "exa", "public_source"])) for _ in range(60)] + [(None, "must_scan", "exa"), (None, "high", "exa")]
    numbers = sorted({0, 7, -1, -40, 99, 100, 19_999, 2_932_896, *(rnd.randrange(-800, 30_000) for _ in range(50))})
    registry = spark.createDataFrame(sources, "id string, priority string, connector string")
    days = spark.createDataFrame([(n,) for n in [*numbers, 7, None]], "n int").select(F.date_add(F.lit("1970-01-01").cast("date"), C("n")).alias("day"))
    windows = spark.createDataFrame([(w,) for w in rotation.WINDOWS], "scan_window string")
    each = registry.crossJoin(windows).crossJoin(days.filter("day is not null").distinct()).withColumn("slot", rotation.rotation_slot(C("id"), C("day")))
    columns = ["id", "priority", "connector", "scan_window", "day", "slot"]
    expected = sorted(map(str, each.filter(rotation.eligible(C("priority"), C("slot"), C("scan_window"), C("connector"))).select(columns).collect()))
    for most in (20_000, 3):
        met = rotation.rotation_days(registry, days, most_days=most)
        assert sorted(map(str, met.select(columns).collect())) == expected
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rotation.rotation_days(registry, days.limit(0)).count() == 0


def test_containment_over_hot_anchors(spark):
    """A title in a third of all texts, titles without text, odd texts; listed and joined anchors, whole and split, all equal substring search."""
    rnd = random.Random(29)
    letters = "ab cé"
    texts = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) + ("a hot title of all" if i % 3 == 0 else "")) for i in range(120)]
    texts += [(500, None), (501, ""), (502, "a hot title"), (503, "x" * 3_000_000 + "a hot title of all"), (3, "twice the same key, a hot title of all")]
    cut = {t[k:k + rnd.randint(12, 20)] for _, t in texts[:120] if len(t) > 40 for k in [rnd.randrange(20)]}
    titles = sorted({"a hot title of all", "hot title of", "title of all", "nobody has this one", "x" * 12, *(c for c in cut if len(c) >= 12)})
    df, named = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(t,) for t in titles], "p string")
    expected = {(k, p) for k, t in texts if t for p in titles if p in t}
    for options in ({}, {"most_anchors": 0}, {"split_rows": 5}):
        got = containment.contained_titles(df, "k", "t", named, "p", **options)
        assert {(r["k"], r["p"]) for r in got.collect()} == expected
        keys = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
        assert not any(f"hashpartitioning({c}#" in line for line in keys for c in "tp")
    assert containment.contained_titles(df.limit(0), "k", "t", named, "p").count() == 0
    assert containment.contained_titles(df, "k", "t", named.limit(0), "p").count() == 0


def test_minimizers_of_a_text_include_those_of_its_parts():
    rnd = random.Random(31)
    text = bytes(rnd.randrange(97, 101) for _ in range(3000))
    whole = set(containment.minimizers(text).tolist())
    for _ in range(200):
        at = rnd.randrange(2900)
        part = containment.minimizers(text[at:at + rnd.randint(12, 90)])
        assert part.size and set(part.tolist()) <= whole
    assert containment.minimizers(b"elevenchars").size == 0 and containment.minimizers(b"").size == 0


def test_sketches_merge_over_days_within_their_bounds(spark, tmp_path):
    rows = spark.range(60_000).select(F.date_add(F.lit("2024-01-01").cast("date"), (C("id") % 5).cast("int")).alias("day"), (C("id") % 2).alias("kind"),
                                      F.when(C("id") % 100 != 0, C("id") % 20_000).alias("who"), ((C("id") * 7919) % 10_007).cast("double").alias("size"))
    path = str(tmp_path / "sketches")
    for _ in range(2):  # days that are written again are replaced
        sketches.store_days(sketches.sketched(rows, ["day", "kind"], ["who"], ["size"]), path)
    sketches.store_days(sketches.sketched(rows.filter("day = '2024-01-02'"), ["day", "kind"], ["who"], ["size"]), path)
    for first, last in ((None, None), ("2024-01-02", "2024-01-03")):
        days = rows if first is None else rows.filter(f"day between '{first}' and '{last}'")
        told = {r["kind"]: r for r in sketches.estimated(sketches.merged(sketches.read_days(spark, path, first, last), ["kind"]), [0.1, 0.5, 0.9]).collect()}
        exact = {r["kind"]: r for r in rollups.distinct_counts(days, ["kind"], {"who": C("who")}).collect()}
        sizes = {k: sorted(r["size"] for r in days.filter(C("kind") == k).collect()) for k in told}
        assert set(told) == set(exact) == {0, 1}
        for k, row in told.items():
            assert row["n"] == len(sizes[k]) and abs(row["who_distinct"] - exact[k]["who"]) <= 0.05 * exact[k]["who"]
            for q, at in zip((0.1, 0.5, 0.9), row["size_quantiles"]):
                assert abs(sum(s <= at for s in sizes[k]) / len(sizes[k]) - q) <= 0.03
    lists = rollups.ordered_values(spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 2, "b"), ("b", 1, None)], "k string, o int, v string"), ["k"], ["o"], "v")
    assert {r["k"]: r["values"] for r in lists.collect()} == {"a": ["z", "b", "x"], "b": [None]}


def test_open_runs_share_a_state_and_keep_their_own_alerts(spark, tmp_path, monkeypatch):
    """One share of ids for all runs: some time out, some end, some go on; a null id is a run of its own."""
    monkeypatch.setattr(jobs, "STUCK_KEYS", 1)
    log = [[("a", "running", 0), ("b", "running", 5), (None, "running", 1)], [("b", "succeeded", 60), ("c", "running", 200)], [("d", "running", 210), ("c", "failed", 215)], [("e", "running", 900), ("e", "failed", 905)]]
    schema = "run_id string, status string, at timestamp"
    for rows in log:
        spark.createDataFrame([(r, s, datetime(2024, 7, 1) + timedelta(minutes=m)) for r, s, m in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    alerts = jobs.stuck_run_alerts(stream)
    assert "share" in alerts._jdf.queryExecution().analyzed().toString()
    out = jobs.latest_result(alerts, str(tmp_path / "out"), str(tmp_path / "state"), "append").collect()
    assert sorted((r["run_id"] or "", (r["started_at"] - datetime(2024, 7, 1)).seconds // 60) for r in out) == [("", 1), ("a", 0), ("d", 210)]


def test_batches_in_turn_spread_over_files_and_keep_their_rows(spark, tmp_path):
    """A part of a large table is written by several tasks, and still is one micro-batch; an empty part is one too."""
    from linksift.catalog.stream_queries import batches_in_turn

    spark.range(0, 90, 1, 9).selectExpr("id", "id % 3 * 2 as part").write.parquet(str(tmp_path / "in"))
    rows = spark.read.option("maxPartitionBytes", "1").parquet(str(tmp_path / "in")).repartition(9)
    seen = []
    stream = batches_in_turn(spark, rows, "parts", "part", [0, 1, 2])
    stream.writeStream.foreachBatch(lambda df, _id: seen.append((sorted({r["part"] for r in df.collect()}), df.select(F.input_file_name()).distinct().count()))).option("checkpointLocation", str(tmp_path / "state")) \
        .trigger(availableNow=True).start().awaitTermination()
    assert seen == [([0], 3), ([], 0), ([2], 3), ([4], 3)]


def test_ranked_scores_are_not_worked_out_twice(spark):
    from linksift.plans.scoring import rank_scored

    scored = spark.createDataFrame([(str(i), i % 5, None, None, None if i == 4 else i % 2 == 0) for i in range(12)], "id string, total int, confidence double, start_at timestamp, should_recommend boolean")
    ranked = rank_scored(scored, 3)
    assert [(r["id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [("8", 1), ("2", 2), ("6", 3)]
    assert "Filter" not in ranked._jdf.queryExecution().optimizedPlan().toString().split("GlobalLimit")[-1]


def test_growing_sides_of_the_dedupe_are_not_broadcast(spark):
    from linksift.operators.similarity import similar_pairs

    sets = spark.createDataFrame([(str(i), ["a", "b", str(i)], ["x"]) for i in range(5)], "node string, tokens array<string>, blocks array<string>")
    plan = similar_pairs(sets, None, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1  # the other joins are with the bounded list of cuts


def test_source_nodes_stage_their_links_once(spark):
    from linksift.operators import reputation

    links = spark.createDataFrame([("https://www.a.com/?utm_source=x", "https://b.com/1", "web", None, None, None, 40.0, None, "t", None, 1)],
                                  "source_url string, canonical_url string, platform string, source_type string, source_handle string, source_name string, source_score double, rejection_reason string, title string, discovered_at timestamp, seq int")
    nodes = reputation.source_nodes(links)
    assert "utm_source" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["url"], r["quality_score"]) for r in nodes.collect()} == {("https://a.com/", 40.0), ("https://b.com/1", 40.0)}


def test_keywords_that_all_decide_need_one_pass_over_the_texts(spark):
    from linksift.functions.rules import match_many

    texts = spark.createDataFrame([("x", "Big cats & c++ dogs"), ("y", None)], "id string, text string")
    rules = spark.createDataFrame([(1, "cat"), (2, "dog")], "ordinal int, keyword string")
    hits = match_many(texts, "id", "text", rules)
    assert "rlike(_text" not in hits._jdf.queryExecution().analyzed().toString().lower()
    assert {(r["id"], r["keyword"]) for r in hits.collect()} == {("x", "cat"), ("x", "dog")}
    more = match_many(texts, "id", "text", rules.union(spark.createDataFrame([(3, "c++"), (4, "&"), (5, "big cat")], rules.schema)))
    assert {r["keyword"] for r in more.collect()} == {"cat", "dog", "c++", "&", "big cat"}


def test_only_rows_that_may_be_picked_are_compared(spark, tmp_path, monkeypatch):
    from linksift.plans.pick_index import PickIndex

    asked, repeated = [], PickIndex.repeated
    monkeypatch.setattr(PickIndex, "repeated", lambda self, records, before=None: asked.append(sorted(r["id"] for r in records.collect())) or repeated(self, records, before))
    rows = [(i, f"https://a.com/{i}", [f"https://a.com/{i}"], f"title {i}", datetime(2024, 7, d), None, None, [], [], s) for i, d, s in (("a", 5, 90.0), ("b", 5, 1.0), ("b", 6, 95.0), ("c", 5, 1.0), ("d", 1, 99.0))]
    schema = "id string, canonical_url string, source_urls array<string>, title string, start_at timestamp, timezone string, city string, hosts array<string>, organizers array<string>, score double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    tables = Tables(spark, str(tmp_path / "tables"))
    jobs.pick_new(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), tables, R.DEFAULT_RULES, datetime(2024, 7, 2), 5, str(tmp_path / "state")).awaitTermination()
    assert asked == [["a", "b", "b"]]
    assert sorted(r["record_id"] for r in tables.read("picks").collect()) == ["a", "b"]


def test_upserts_shuffle_rows_once(spark):
    """Rows dealt by bucket and part are merged where they are; the order of ties stays out of the shuffle and the sort."""
    stored = spark.createDataFrame([("a", 5, "old")], "id string, _seq long, v string").withColumn("_stored", F.lit(True))
    incoming = spark.createDataFrame([("a", 6, "new")], "id string, _seq long, v string").withColumn("_stored", F.lit(False))
    dealt = stored.unionByName(incoming).withColumns({"bucket": F.lit(0), "part": F.lit(0)}).repartition("bucket", "part")
    plan = upsert.upsert_dealt(dealt, "_stored", ["bucket", "part"], ["id"], "_seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "_w0" not in plan
    newest = upsert.upsert(stored, incoming, ["id"], "_seq")._jdf.queryExecution().executedPlan().toString()
    assert "_w0" not in newest


@pytest.mark.parametrize("update_cols", [None, ["query_text"]])
def test_stored_upserts_equal_the_joined_ones(spark, tmp_path, monkeypatch, update_cols):
    """Odd keys and orders, hot keys thinned first or not: the stored rows equal what ``upsert`` makes of the same calls."""
    from linksift.sources import tables as sources

    rnd = random.Random(17)
    schema = "id string, query_text string, platform string, budget_cost long, s long"
    calls = [[(rnd.choice([*"abcdefgh", None]), rnd.choice(["x", "y", None]), rnd.choice("pq"), rnd.choice([1, None]), rnd.choice([1, 2, 3, None])) for _ in range(60)] for _ in range(4)]
    for most, size in ((250_000, 4 << 20), (3, 400)):
        monkeypatch.setattr(sources, "HOT_ROWS", most)
        monkeypatch.setattr(sources, "HOT_TIMES", 1)
        monkeypatch.setattr(sources, "PART_BYTES", size)
        stored = Tables(spark, str(tmp_path / str(most)), buckets=3)
        expected = stored._stored("queries")
        for rows in calls:
            df = spark.createDataFrame(rows, schema)
            stored._merge("queries", df, "s", update_cols)
            merged = upsert.upsert(expected, stored._shape("queries", df.withColumn("_seq", C("s"))), ["id"], "_seq", update_cols)
            expected = spark.createDataFrame(merged.collect(), merged.schema)
        assert sorted(map(str, stored._stored("queries").collect())) == sorted(map(str, expected.collect()))


def test_stored_edges_and_sources_keep_their_rules(spark, tmp_path):
    """Two keys of which one is null, and first and last sights: what two calls leave."""
    stored = Tables(spark, str(tmp_path), buckets=2)
    for order, platform in enumerate("xy"):
        stored.save_record_sources(spark.createDataFrame([("r", "l", platform, order), ("r", None, platform, order), ("r", "l", "late", -1)], "record_id string, link_id string, platform string, s long"), "s")
    assert sorted(map(str, (tuple(r) for r in stored.read("record_sources").collect()))) == sorted(map(str, [("r", "l", "y"), ("r", None, "x"), ("r", None, "y")]))
    for order, day in ((1, 5), (3, 9), (2, 2)):
        stored.save_edges(spark.createDataFrame([("e", f"from{day}", float(day), datetime(2024, 5, day), datetime(2024, 5, day), order)], "id string, from_id string, weight double, first_seen timestamp, last_seen timestamp, s long"), "s")
    (row,) = stored.read("source_edges").collect()
    assert (row["from_id"], row["weight"], row["first_seen"].day, row["last_seen"].day) == ("from5", 9.0, 2, 9)
