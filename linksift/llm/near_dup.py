"""MinHash near-dedup on SetSketch registers.

A document is the set of its word shingles. Its sketch has REGISTERS truncated, exponentially
spaced minima: register K is the level floor(1 - log_b(x)) of the smallest of exponentially
distributed hash values x, so sketches merge by maximum and equal registers are as likely as the
similarity. Documents with equal sets are one class. Bands of ROWS registers name the buckets in
which classes meet; a similarity of 0.8 misses every one of the 40 bands once in 8 million pairs.

Links are found without listing the pairs of a bucket. First each member is compared with its
bucket's hub, the class of the smallest number. Connected classes then count as one component. Only
buckets that still hold several components are searched again, in blocks of about BLOCK members:
by registers alone for members with candidates in another component, then, with the texts of those
members, for links across components. A pair is a candidate if
the joint likelihood of both sketches puts its similarity at SLACK below the threshold or above (four
standard errors, so a true link is left out once in 30,000 pairs at the threshold itself); every
candidate is confirmed on the full sets, from one text of each class. Components are then the same as
from all links. Classes have numbers of their own, so an id may stand in several; they are linked.

Words are split at ASCII white space and A-Z lowered; fewer words than a shingle are one shingle.
A document without words, or without an id, is linked with nothing: its component is its own id,
and it is kept. Repeated rows of one id are one document, also if their texts differ, each with its own
row of the result: what links one of its texts links them all. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import arrow_map, cut_lineage, free_name, raw_texts

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: SetSketch's rate, base and last level: 16 bits a register.
RATE, BASE, LEVELS = 20.0, 1.001, (1 << 16) - 2
#: Members of a bucket that one task compares with each other.
BLOCK = 1024
#: Standard errors of the estimate below the threshold that are still confirmed.
SLACK_ERRORS = 4.0
_random = np.random.default_rng(20)
_FACTOR = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text."""
    parts = raw.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    n = len(parts) - size + 1
    mixed = np.full(n, size if size < words else 0, np.uint64)
    for j in range(size):
        mixed = (mixed ^ hashes[j:n + j]) * _GOLD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch levels (uint16) of a non-empty set of 64-bit hashes."""
    low = np.full(REGISTERS, (1 << 32) - 1, np.uint32)
    short = (members >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        mixed = short[at:at + 2048, None] * _FACTOR + _ADD
        mixed ^= mixed >> np.uint32(15)
        np.minimum(low, mixed.min(0), out=low)
    smallest = -np.log1p(-(low + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def band_keys(levels: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name for each band."""
    parts = levels.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        keys = (keys ^ parts[:, j]) * _GOLD
        keys ^= keys >> np.uint64(31)
    return keys.astype(np.int64)


_GRID = np.linspace(0.4, 1.0, 121)


def likely_similarity(equal: np.ndarray, above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of most joint likelihood, from 0.4 up, given numbers of registers.

    ``above`` counts the registers in which a's level is larger; with shares u and v of the sizes
    that happens with probability p(u - vJ), where p(x) = -log_b(1 - x (b - 1) / b).
    """
    u = (n_a / (n_a + n_b))[:, None]
    v, j = 1 - u, _GRID[None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    return _GRID[(above[:, None] * np.log(up) + below[:, None] * np.log(down) + equal[:, None] * np.log(np.clip(1 - up - down, 1e-9, 1))).argmax(1)]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, n, class, levels): set size, name of the set (null if empty) and registers; written once."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, tuple] = {}
            rows = []
            for raw in raw_texts(batch, "text"):
                found = seen.get(raw)
                if found is None:
                    members = shingles(raw, words)
                    found = seen[raw] = (len(members), xxhash.xxh3_128_digest(members.tobytes()), registers(members).astype("<u2").tobytes()) if len(members) else (0, None, None)
                rows.append(found)
            n, names, levels = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(levels, pa.binary())], ["doc_id", "mark", "n", "class", "levels"])

    return cut_lineage(arrow_map(docs, sketch, "doc_id long, mark string, n long, class binary, levels binary"))


def _levels(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, cls), one row for each class and band."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [band_keys(levels) for levels in _levels(batch.column("levels"))] or [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), BANDS), pa.int64())], ["key", "cls"])

    return arrow_map(classes.select("cls", "levels"), keys, "key long, cls long")


def _likely(threshold: float) -> float:
    return threshold - SLACK_ERRORS * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def likely_edges(edges: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The edges (a, b) whose sketches allow the threshold."""
    least = _likely(threshold)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _levels(batch.column("la")), _levels(batch.column("lb"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            similar = likely_similarity((a == b).sum(1), (a > b).sum(1), (a < b).sum(1), n_a, n_b)
            fine = (similar >= least) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    side = lambda x: classes.select(F.col("cls").alias(x), F.col("levels").alias(f"l{x}"), F.col("n").alias(f"n{x}"))
    return arrow_map(edges.join(side("b"), "b").join(side("a"), "a"), estimate, "a long, b long")


def confirmed(edges: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The edges (a, b, ...) with 100 * intersection >= percent * union on the full sets; written once."""
    columns = edges.columns

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, members = None, np.zeros(0, np.uint64)
        for batch in batches:
            fine = []
            for a, raw_a, raw_b in zip(batch.column("a").to_pylist(), raw_texts(batch, "ta"), raw_texts(batch, "tb")):
                if a != hub:
                    hub, members = a, shingles(raw_a, words)
                other = shingles(raw_b, words)
                common = len(np.intersect1d(members, other, assume_unique=True))
                fine.append(100 * common >= percent * (len(members) + len(other) - common))
            yield batch.select(columns).filter(pa.array(fine, pa.bool_()))

    side = lambda x: texts.select(F.col("cls").alias(x), F.col("text").alias(f"t{x}"))
    joined = edges.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select(*columns, "ta", "tb")
    return cut_lineage(arrow_map(joined, confirm, edges.schema))


class _Group:
    """Members of a bucket in one block, or in two blocks that meet."""

    def __init__(self, rows: list, threshold: float):
        key, i, j, own, cls, comp, n, levels = list(zip(*rows))[:8]
        self.cls, self.comp, self.n, own = np.array(cls), np.array(comp), np.array(n, float), np.array(own)
        self.levels = np.frombuffer(b"".join(levels), "<u2").reshape(-1, REGISTERS)
        self.band = int(np.flatnonzero(band_keys(self.levels[0]) == key[0])[0])
        self.left, self.right, self.same = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0]), i[0] == j[0]
        self.threshold, self.least = threshold, _likely(threshold)

    def candidates(self, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(x, ys) that may be linked though their ``root`` differs, the most similar first; a pair that shares several buckets is of the first."""
        cls, n, levels, least = self.cls, self.n, self.levels, self.least
        for x in self.left:
            ys = self.right[(root[self.right] != root[x]) & ((cls[self.right] > cls[x]) | (not self.same))]
            ys = ys[np.minimum(n[ys], n[x]) >= self.threshold * np.maximum(n[ys], n[x]) - 1e-6]
            if not len(ys):
                continue
            alike = levels[ys] == levels[x]
            equal = alike.sum(1)
            first = (equal >= (least - 0.05) * REGISTERS) & (alike.reshape(-1, BANDS, ROWS).all(2).argmax(1) == self.band)
            ys, equal = ys[first], equal[first]
            if not len(ys):
                continue
            above = (levels[x] > levels[ys]).sum(1)
            similar = likely_similarity(equal, above, REGISTERS - equal - above, np.full(len(ys), n[x]), n[ys])
            ys = ys[np.argsort(-similar, kind="stable")][: int((similar >= least).sum())]
            if len(ys):
                yield int(x), ys


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows of each (key, i, j), which are the first columns; rows come sorted."""
    every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, rows in groupby(every, key=lambda row: row[:3]):
        yield list(rows)


_GROUP = "key long, i int, j int, own int, cls long, comp long, n long, levels binary"


def open_members(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The members of each pair of blocks that have a candidate in another component; written once.

    ``members`` has (key, size, cls, comp, n, levels) for buckets with several components. Buckets
    are cut into blocks by hash, and a task compares one block with itself or another, so a bucket
    of any size spreads over tasks of bounded memory. Registers alone are sent and compared.
    """
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    spread = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "comp", "n", "levels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            group, met = _Group(rows, percent / 100), set()
            for x, ys in group.candidates(group.comp):
                met.add(x)
                met.update(ys.tolist())
            if met:
                columns = zip(*(rows[k] for k in sorted(met)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = [part.split()[0] for part in _GROUP.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cut_lineage(arrow_map(dealt, run, _GROUP))


def cross_links(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components, from ``open_members`` and (cls, text).

    Texts go with members that have candidates, once for each pair of blocks they have them in. A task
    confirms its candidates and leaves out those that its own links have joined, so a group of
    near copies costs no pair but its links. Only links leave the task.
    """
    def compare(rows: list) -> set[tuple[int, int]]:
        group = _Group(rows, percent / 100)
        root, links, sets = group.comp.copy(), set(), {}

        def members_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles((rows[k][8] or "").encode("utf-8", "surrogatepass"), words)
            return sets[k]

        for x, ys in group.candidates(root):
            for y in ys.tolist():
                if root[y] == root[x]:
                    continue
                common = len(np.intersect1d(members_of(x), members_of(y), assume_unique=True))
                if 100 * common >= percent * (group.n[x] + group.n[y] - common):
                    links.add((int(min(group.comp[x], group.comp[y])), int(max(group.comp[x], group.comp[y]))))
                    root[root == root[y]] = root[x]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            links = sorted(compare(rows))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = members.join(texts, "cls").select(*(part.split()[0] for part in _GROUP.split(", ")), "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cut_lineage(arrow_map(dealt, run, "a long, b long").distinct())


def near_components(docs: DataFrame, words: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each document."""
    threshold = percent / 100
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.md5(F.col(text_col).cast("binary")).alias("mark"))
    rows = sketches(source, words)
    named = rows.filter("class is not null and doc_id is not null")
    merged_rows = named.groupBy("class").agg(F.min(F.struct("doc_id", "mark")).alias("pick"), F.first("n").alias("n"), F.first("levels").alias("levels"))
    classes = cut_lineage(merged_rows.withColumn("cls", F.monotonically_increasing_id()))
    keyed = cut_lineage(bucket_rows(classes))
    buckets = cut_lineage(keyed.groupBy("key").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    met = cut_lineage(keyed.join(buckets, "key"))  # classes that share a bucket
    wanted = classes.join(met.select("cls").distinct(), "cls", "left_semi").select("cls", "pick.*")
    texts = cut_lineage(source.join(wanted, ["doc_id", "mark"]).select("cls", "text").dropDuplicates(["cls"]))

    stars = met.filter("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    links = confirmed(likely_edges(stars, classes, threshold), texts, words, percent)
    # An id that stands in several classes links them.
    repeated = named.join(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "doc_id").select("doc_id", "class").distinct()
    held = repeated.join(classes.select("class", "cls"), "class").select("doc_id", "cls")
    one_id = held.join(held.groupBy("doc_id").agg(F.min("cls").alias("a")), "doc_id").filter("a <> cls").select("a", F.col("cls").alias("b"))
    first = connected_components(links.unionByName(one_id)).withColumnsRenamed({"vertex": "cls", "component": "comp"})

    placed = met.join(first, "cls", "left").select("key", "size", "cls", F.coalesce("comp", "cls").alias("comp"))
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    open_ = placed.join(cut_lineage(several), "key").join(classes.select("cls", "n", "levels"), "cls")
    merged = connected_components(cross_links(open_members(open_, percent), texts, words, percent)).withColumnsRenamed({"vertex": "comp", "component": "last"})

    grouped = classes.select("class", "cls", F.col("pick.doc_id").alias("least")).join(first, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    grouped = grouped.join(merged, "comp", "left").select("class", "least", F.coalesce("last", "comp").alias("group"))
    named_classes = cut_lineage(grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("class", "component_id"))
    linked = named.select("doc_id", "n", "class").join(named_classes, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("class is null and doc_id is not null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if_linked = linked.groupBy("doc_id").agg(F.min("component_id").alias("_other"))  # an id without words here, with words elsewhere
    alone = alone.join(if_linked, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_other", "component_id").alias("component_id"))
    nameless = rows.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(alone).unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component, all columns; rows without an id stay."""
    name = free_name(docs, "_dropped")
    dropped = near_components(docs, words, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col(id_col).cast("long") == F.col(name), "left_anti")
