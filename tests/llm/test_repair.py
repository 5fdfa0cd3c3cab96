"""Conversation repair against a search over all plans."""

import collections
import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linksift.llm import repair
from linksift.llm.queries import damaged_conversations

KEYS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GOOD = re.compile(r"(s?(ua)+)?")


def brute_plan(rows):
    """(cost, letters, roles given) of the cheapest plan, by trying all in order of cost, then letters."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, letters, at, roles = heapq.heappop(heap)
        if at == len(rows) and GOOD.fullmatch(roles):
            return cost, letters, roles
        if re.fullmatch(r"s?(ua)*u?", roles):  # what can still be continued
            for role in "ua":
                if len(letters) < 2 * len(rows) + 2:
                    heapq.heappush(heap, (cost + 3, letters + "I", at, roles + role))
            if at < len(rows):
                letter, fault = rows[at]
                heapq.heappush(heap, (cost + 4, letters + "D", at + 1, roles))
                if fault not in (repair.BLANK, repair.DUPLICATE):
                    cut = 3 if fault == repair.TRUNCATED else 0
                    heapq.heappush(heap, (cost + cut, letters + "K", at + 1, roles + (letter or "-")))
                    for role in "ua":
                        heapq.heappush(heap, (cost + cut + 3, letters + "R", at + 1, roles + role))


@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.integers(0, 3)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_cheapest_plan(rows):
    want = brute_plan(rows)[:2]
    assert repair.best_plan(rows, {repair.START: (0, "")}, repair.ENDS) == want
    for segment in (1, 2):
        solver = repair.Repair(segment)
        for row in rows:
            solver.add(row)
        assert solver.plan() == want


def test_segments_agree_on_long_conversations():
    random = np.random.default_rng(4)
    rows = [("suax"[i], int(f)) for i, f in zip(random.choice(4, 500, p=[0.1, 0.45, 0.4, 0.05]), random.choice(4, 500, p=[0.7, 0.1, 0.1, 0.1]))]
    whole = repair.best_plan(rows, {repair.START: (0, "")}, repair.ENDS)
    for segment in (7, 64, 499):
        solver = repair.Repair(segment)
        for row in rows:
            solver.add(row)
        assert solver.plan() == whole


def expected(table):
    """Contract of the query, row by row."""
    told = collections.defaultdict(list)
    for conv, turn, role, text in table:
        read = lambda v: " " if v is None else str(v)
        harm = zlib.crc32(f"{read(conv)}:{read(turn)}".encode()) % 20
        role, text, kept = read(role), read(text), told[conv]
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub(r"[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        kept += [(turn is not None, turn or 0, role, name, text)] * (2 if harm == 3 else 1)
    out = []
    for conv, kept in told.items():
        kept.sort()
        turns = [t for known, t, *_ in kept if known]
        seen, rows, counts = set(), [], [0] * 4
        for _, _, role, _, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = repair.BLANK if not solid else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if solid[-1] not in ".!?" else repair.OK
            seen.add((role, text))
            counts[fault] += 1
            rows.append((role[:1], fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, roles = brute_plan(rows)
        lines, places, texts = [], iter(roles), iter(kept)
        for edit in audit:
            row = next(texts) if edit != "I" else None
            if edit != "D":
                given_ = {"u": "user", "a": "assistant"}.get(letter := next(places), letter)
                lines.append(f"{row[2]}:{row[4]}" if edit == "K" else f"{given_}:{row[4] if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations():
    random = np.random.default_rng(8)
    texts = ["Hi.", "Hi.", "What now?", "cut of", " \n", "", None, "Yes!  ", "naïve 日本。", "Hi. ", "word " * 5000 + "."]
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (901, None, "user", "Hi."), (901, None, "user", "Hi."), (902, 5, None, "Hi."), (903, 1, "User", "Hi."), (903, 4, "", "Hi.")]
    for conv in range(150):
        for turn in range(int(random.integers(1, 6))):
            role = random.choice(["user", "assistant", "system", "tool"], p=[0.45, 0.4, 0.1, 0.05]) if random.random() < 0.4 else ["user", "assistant"][turn % 2]
            rows.append((conv, int(turn * random.choice([1, 1, 1, 2])), str(role), texts[random.integers(0, len(texts))]))
    return rows + [(77, 1, "user", "Twice.")] * 2


def test_query_against_all_plans(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, gaps int").repartition(5)
    want = sorted(expected(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for segment in (2, repair.SEGMENT):
        found = repair.digest(damaged_conversations(table), segment)
        assert sorted((tuple(r) for r in found.select(*KEYS).collect()), key=lambda r: (r[0] is None, r[0] or 0)) == want
    assert len({r[0] for r in want}) == len({r[0] for r in rows}) and {len(r[7]) for r in want} > {0, 2}
    assert repair.digest(damaged_conversations(table.limit(0))).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (2, 0, "user", " "), (3, 1, "system", "Be kind."), (3, 2, "user", "Yes?"), (3, 3, "assistant", "No.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(tuple(r) for r in repair.repaired_turns(table).collect())
    assert [r[2] for r in found if r[0] == 1] == ["I", "K", "K", "I"]
    assert [r[4:] for r in found if r[0] == 1] == [("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "")]
    assert not [r for r in found if r[0] == 2] and [r[1:3] for r in found if r[0] == 3] == [(0, "K"), (1, "K"), (2, "K")]


@pytest.mark.parametrize("n", [3 * repair.SEGMENT + 5])
def test_very_long_conversation(spark, n):
    table = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('Line ', id, '.') AS text")
    got = repair.digest(table).first()
    assert (got["cost"], got["audit"]) == (3, "K" * n + "I") and got["gaps"] == got["illegal"] == 0
