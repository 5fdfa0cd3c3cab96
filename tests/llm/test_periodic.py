"""Periodic runs against brute force over all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from linksift.llm import periodic
from linksift.llm.queries import planted_period

KEYS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute_runs(words):
    """(start, length, period) of every run, from its definition."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)  # periods come in order, so the smallest stays
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def in_one_go(words):
    """Runs by the operator's parts, without Spark."""
    numbers, stretches = periodic.numbered(words), {}
    for tile in periodic.tiles(numbers):
        for q, start, stop in periodic.tile_fragments(*tile):
            stretches.setdefault(q, []).append((start, stop))
    found = {}
    for q in sorted(stretches):
        whole = []
        for start, stop in sorted(stretches[q]):
            if whole and start <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], stop)
            else:
                whole.append([start, stop])
        for start, stop in whole:
            if stop - start >= periodic.needed(q):
                found.setdefault((start, stop - start + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def row(doc, words):
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *tail, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts():
    random = np.random.default_rng(3)
    word = lambda n, k: [f"w{i}" for i in random.integers(0, k, n)]
    found = [None, "", " \n ", "one", "a " * 11, "a " * 12, "a b " * 6, "a b " * 5 + "a", "x " + "a b c " * 9 + "y z " * 7]
    found += [" ".join(word(int(n), int(k))) for n, k in zip(random.integers(1, 300, 60), random.integers(1, 40, 60))]
    for _ in range(60):
        period = int(random.integers(1, 400))
        part = word(period, 50)
        found.append(" ".join(word(int(random.integers(0, 50)), 50) + (part * 6)[:int(random.integers(period, 5 * period + 2))] + word(int(random.integers(0, 50)), 50)))
    return found + [" ".join(["the"] * 5000), " ".join((word(2100, 900) * 4)[:7000]), " ".join(word(40, 9) * 150)]


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=90))
@example([b"a"] * 64)
@settings(max_examples=400, deadline=None)
def test_all_runs(words):
    assert in_one_go(words) == brute_runs(words)


@pytest.mark.parametrize("n", [60, 700, 5000])
def test_runs_over_tiles(n):
    random = np.random.default_rng(n)
    for period in {1, 2, 3, 5, 7, 8, 9, 15, 16, 17, n // 5, n // 3, n // 2}:
        part = [b"%d" % i for i in random.integers(0, 3 if period < 40 else 60, period)]
        words = [b"x", b"y"] * 3 + (part * n)[:n] + [b"z"]
        assert in_one_go(words) == brute_runs(words), period


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t, 5, "c") for i, t in enumerate(texts())] + [(None, "a b " * 9, 1, "c"), (3, "one", 2, "d"), (3, "a " * 30, 2, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, words string")
    found = periodic.digest(periodic.collapsed(docs, prepare=planted_period))
    want = [row(i, (t or "").split()) for i, t, *_ in rows]
    key = lambda r: tuple((v is None, v or 0) for v in r[:2]) + r[6:]
    assert sorted((tuple(r) for r in found.select(*KEYS).collect()), key=key) == sorted(want, key=key)
    assert any(r[1] > 1 for r in want) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)
    assert periodic.digest(periodic.collapsed(docs.limit(0))).count() == 0


def test_unicode_space_stays_in_words(spark):
    docs = spark.createDataFrame([(1, "a\u00a0b " * 12)], "doc_id long, text string")
    r = periodic.digest(periodic.collapsed(docs)).first()
    assert (r["length"], r["period"]) == (12, 1) and r["collapsed_sha256"] == hashlib.sha256("a\u00a0b".encode()).hexdigest()
