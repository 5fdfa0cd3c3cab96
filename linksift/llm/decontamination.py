"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ in ``errors = floor(error_rate * n)`` edits. Split into
errors + 1 pieces, at least one piece of it must stand unchanged in a text that holds the item;
an Aho-Corasick automaton finds the pieces, and Myers' bit-parallel distance checks the stretches
around all hits, each place once: the distance found is the least of the whole text, and the end the
first with it. Both sides are compared in lower case with each run of white space as one space.

The items are a query set: they are read in blocks of bounded size, and each block meets all
texts, so no block grows with either table. Null or empty items match nothing; an item whose
pieces would be shorter than MIN_PIECE characters gets a smaller error budget. Equal items each
match. Null and empty texts hold nothing; whole texts are searched. Rows that repeat are searched
again; null ids are returned as null. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

ERROR_RATE = 0.05
MIN_PIECE = 8
#: Characters of items in one block, and the most items.
BLOCK_CHARS = 4 << 20
BLOCK_ITEMS = 20_000


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, error_rate: float) -> tuple[int, list[tuple[int, str]]]:
    """(errors, [(start, piece)]) with errors + 1 pieces of near equal length."""
    errors = min(int(error_rate * len(item)), max(0, len(item) // MIN_PIECE - 1))
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return errors, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_ending(item: str, masks: dict[str, int], stretch: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in ``stretch`` where the item ends, at most ``most`` edits off.

    Myers: one bit for each row of the distance matrix, one step for each character of the stretch;
    a match may start anywhere. The first of equally good ends is returned.
    """
    size = len(item)
    top, every = 1 << (size - 1), (1 << size) - 1
    plus, minus, distance, best = every, 0, size, None
    for i, letter in enumerate(stretch):
        eq = masks.get(letter, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & every
        h_plus, h_minus = minus | (~(d0 | plus) & every), d0 & plus
        if h_plus & top:
            distance += 1
        elif h_minus & top:
            distance -= 1
        h_plus, h_minus = (h_plus << 1) & every, (h_minus << 1) & every
        plus, minus = h_minus | (~(d0 | h_plus) & every), d0 & h_plus
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, i + 1)
            if distance == 0:
                break
    return best


def add_stretch(parts: list[tuple[int, int]], low: int, high: int) -> None:
    """Add a stretch to those of an item, which are in order; stretches that meet become one.

    Hits come by their ends, so a stretch may begin before the last one by the item's length at most.
    """
    after = len(parts)
    while after and parts[after - 1][0] > high:
        after -= 1
    at = after
    while at and parts[at - 1][1] >= low:
        at -= 1
        low, high = min(low, parts[at][0]), max(high, parts[at][1])
    parts[at:after] = [(low, high)]


class ItemMatcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = plain(text)
            if not item:
                continue
            errors, parts = pieces(item, error_rate)
            for start, part in parts:
                places.setdefault(part, []).append((len(self.items), start))
            self.items.append((item_id, item, errors))
        self.automaton = ahocorasick.Automaton()
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        if places:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def _masks(self, k: int) -> dict[str, int]:
        if k not in self.masks:
            found: dict[str, int] = {}
            for i, letter in enumerate(self.items[k][1]):
                found[letter] = found.get(letter, 0) | 1 << i
            self.masks[k] = found
        return self.masks[k]

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the compared form) for each item that the text holds."""
        body = plain(text)
        if not body or not self.items:
            return []
        stretches: dict[int, list[tuple[int, int]]] = {}  # item -> what to search, in order and apart
        for last, (length, where) in self.automaton.iter(body):
            begin = last + 1 - length
            for k, start in where:
                _, item, errors = self.items[k]
                low = max(0, begin - start - errors)
                add_stretch(stretches.setdefault(k, []), low, begin - start + len(item) + errors)
        found: dict[int, tuple[int, int]] = {}
        for k, parts in stretches.items():
            _, item, errors = self.items[k]
            for low, high in parts:
                match = best_ending(item, self._masks(k), body[low:high], errors)
                if match and (k not in found or match[0] < found[k][0]):
                    found[k] = (match[0], low + match[1])
                    if match[0] == 0:
                        break
        return [(self.items[k][0], *match) for k, match in sorted(found.items())]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read partition by partition."""
    block, held = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
    for row in rows.toLocalIterator():
        if block and (held + len(row["text"]) > BLOCK_CHARS or len(block) >= BLOCK_ITEMS):
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end), one row for each document and item that it holds."""
    schema = "doc_id long, item_id long, distance int, end long"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    result = None
    for block in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS at most

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = ItemMatcher(sent.value, error_rate)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in matcher.search(text)]
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "distance", "end"])

        part = arrow_map(source, search, schema)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns, no shuffle."""
    for block in item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = ItemMatcher(sent.value, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(t) for t in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = arrow_map(docs, keep, docs.schema)
    return docs
