"""SimHash groups against brute force over all pairs."""

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from linksift.llm import simhash


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(rows):
    """component_id of each row (doc_id, fingerprint), by search over all pairs."""
    out = []
    for k in range(len(rows)):
        seen, stack = {k}, [k]
        while stack:
            i = stack.pop()
            for j in range(len(rows)):
                same = rows[i][0] is not None and rows[i][0] == rows[j][0]
                if j not in seen and (same or (rows[i][1] ^ rows[j][1]).bit_count() <= 2):
                    seen.add(j)
                    stack.append(j)
        out.append(min((rows[i][0] for i in seen if rows[i][0] is not None), default=None))
    return out


def texts():
    random = np.random.default_rng(5)
    word = lambda: f"W{random.integers(0, 60)}"
    found = [None, "", " \t\n", "one", "One", "one two", "ONE two three", "É one two", "É one two three", "the " * 5000]
    base = [" ".join(word() for _ in range(int(n))) for n in random.integers(5, 300, 25)]
    for text in base:
        for _ in range(6):
            parts = text.split()
            for _ in range(int(random.integers(0, 3))):
                parts[random.integers(0, len(parts))] = word()
            found.append(" ".join(parts))
    return found + base[:5]


def test_groups_against_brute_force(spark, monkeypatch):
    rows = [(i + 100, t) for i, t in enumerate(texts())] + [(None, texts()[12]), (None, "nothing like it at all"), (3, "one"), (3, "quite another text of one id"), (2, "quite another text of one id")]
    want = [(i, fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(want, components(want))), key=str)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, print int, component int")
    for shard in (simhash.SHARD, 3):
        monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (shard,))
        found = simhash.near_components(docs)
        assert found.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert simhash.near_components(docs.limit(0)).count() == 0


@given(st.lists(st.integers(0, 2 ** 64 - 1), min_size=1, max_size=30, unique=True), st.integers(0, 40), st.integers(0, 2 ** 64 - 1))
@settings(max_examples=100, deadline=None)
def test_tree_finds_all(values, radius, wanted):
    tree = simhash.BKTree()
    for value in values:
        tree.add(value)
    assert sorted(tree.within(wanted, radius)) == sorted(v for v in values if (v ^ wanted).bit_count() <= radius)


def test_keys_meet_for_two_bits(spark):
    random = np.random.default_rng(2)
    numbers = [int(v) for v in random.integers(0, 2 ** 63, 40)]
    pairs = [(v, v ^ 1 << a ^ 1 << b) for v in numbers for a, b in [random.choice(64, 2, replace=False).tolist()]]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    classes = spark.createDataFrame([(signed(v),) for pair in pairs for v in pair], "print long").distinct()
    links = {frozenset(r) for r in simhash.fingerprint_links(classes).collect()}
    assert {frozenset(map(signed, pair)) for pair in pairs} <= links


def test_bits_of_long_texts():
    hashes = [int(v) for v in np.random.default_rng(1).integers(0, 2 ** 63, 20_000)]
    assert simhash.majority(hashes) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.majority([1, 0]) == 0 and simhash.majority([1]) == 1
