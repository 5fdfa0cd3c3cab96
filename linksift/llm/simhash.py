"""SimHash near-dedup with BK-trees.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of the hashes (XXH64) of
the text's word shingles, repeats included. Fingerprints that differ in at most RADIUS bits are
linked, and the connected components of the links are the groups.

Each different fingerprint is one class, however many rows carry it. Classes are dealt to shards by
pigeonhole: of four 16-bit quarters, two differing bits leave at least two untouched, so a linked
pair agrees in one of the six pairs of quarters, and each class goes to six buckets of 32 equal
bits. A bucket is cut into shards of about SHARD classes; a shard's BK-tree is made in the tasks
that query it, those of the shards of its own bucket, and holds children keyed by their Hamming
distance to the parent. A search follows only edges within the radius of the distance to the node.
Trees go to the tasks that need them instead of to all executors, because their number grows with
the data; a task holds one shard's tree at a time. All links of a bucket are found; one that joins
classes already joined inside the task is left out, which changes no component.

Words are split at ASCII white space and A-Z lowered; fewer words than a shingle are one shingle.
Null, empty and blank texts have fingerprint zero, which links like any other. Rows that repeat an
id are one document: its texts' groups are one. A row without an id keeps its fingerprint and group; a
group without any id has a null component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import arrow_map, cut_lineage, raw_texts

WORDS, SEED, RADIUS = 3, 42, 2
QUARTERS, QUARTER_BITS = 4, 16
#: Classes in a shard's tree, about.
SHARD = 1024
_CHUNK = 255 * 32


def shingle_hashes(raw: bytes, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle, in order, repeats included."""
    parts = raw.lower().split()
    if not parts:
        return []
    joined = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    return [xxhash.xxh64_intdigest(s, seed) for s in joined]


def majority(hashes: list[int]) -> int:
    """The number whose bits are set in over half of ``hashes``; zero for none."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at:at + _CHUNK], "<u8")
        part = np.concatenate([part, np.zeros(-len(part) % 255, "<u8")])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 255, 64)
        counts += bits.sum(1, dtype=np.uint8).sum(0, dtype=np.int64)  # 255 ones fit a byte
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Different numbers by Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node, fresh = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while fresh:
            edge = (value ^ self.values[node]).bit_count()
            below = self.children[node].setdefault(edge, fresh)
            if below == fresh:
                return
            node = below

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most ``radius`` away."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            away = (value ^ self.values[node]).bit_count()
            if away <= radius:
                found.append(self.values[node])
            edges = self.children[node]
            stack += [below for edge, below in edges.items() if -radius <= edge - away <= radius]
        return found


def shard_links(first: list[int], second: list[int] | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links inside ``first``, or between ``first`` and ``second``; none between numbers already joined."""
    tree, root = BKTree(), {}
    links = []

    def top(value: int) -> int:
        while (above := root.get(value, value)) != value:
            root[value] = root.get(above, above)
            value = above
        return value

    def link(value: int) -> None:
        for other in tree.within(value, radius):
            a, b = top(value), top(other)
            if a != b:
                root[a] = b
                links.append((value, other))

    for value in first:
        if second is None:
            link(value)
        tree.add(value)
    for value in second or ():
        link(value)
    return links


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print), one row for each row; ``print`` is the fingerprint as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            prints = []
            for raw in raw_texts(batch, "text"):
                if raw not in known:
                    known[raw] = majority(shingle_hashes(raw, words, seed))
                prints.append(known[raw])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "print"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(source, run, "doc_id long, print long")


def _quarter(i: int) -> Column:
    return F.shiftrightunsigned("print", i * QUARTER_BITS).bitwiseAND((1 << QUARTER_BITS) - 1)


def bucket_keys() -> list[Column]:
    """One key for each pair of quarters: the pair's number, then its 32 bits."""
    return [F.lit(k << 32) + F.shiftleft(_quarter(i), QUARTER_BITS) + _quarter(j) for k, (i, j) in enumerate(combinations(range(QUARTERS), 2))]


def fingerprint_links(classes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b) of linked fingerprints from ``classes`` with distinct ``print``; written once. Joins all that are linked."""
    keyed = cut_lineage(classes.select("print", F.explode(F.array(*bucket_keys())).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    placed = keyed.join(sizes, "key").withColumn("shards", F.ceil(F.col("size") / F.lit(shard)).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("print"), F.col("shards")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "print")

    def compare(group: tuple, rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
        _, i, j = group
        sides = [[p & 0xFFFFFFFFFFFFFFFF for own, p in rows if own == side] for side in (i, j)]
        return shard_links(sides[0], None if i == j else sides[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        links: list[tuple[int, int]] = []

        def found() -> pa.RecordBatch:
            ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            for key, i, j, own, number in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != group:
                    if rows:
                        links += compare(group, rows)
                    group, rows = (key, i, j), []
                rows.append((own, number))
            if links:
                yield found()
        if rows:
            links += compare(group, rows)
        yield found()

    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "print")
    return cut_lineage(arrow_map(dealt, run, "a long, b long"))


def near_components(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``."""
    rows = cut_lineage(fingerprints(docs, words, seed, id_col, text_col))
    classes = cut_lineage(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    ids = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).filter("a <> z").select("doc_id", "a")
    repeated = rows.join(ids, "doc_id").filter("print <> a").select("a", F.col("print").alias("b"))
    labels = connected_components(fingerprint_links(classes).unionByName(repeated))
    grouped = classes.join(labels.withColumnRenamed("vertex", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut_lineage(grouped.join(least, "component").select("print", "component_id"))
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
