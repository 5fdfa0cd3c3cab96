"""Exact dedup by an extendible-hash index on shared files.

Tasks first combine the copies that they read themselves: one entry for each different text, with
its whole row, and one small line for each row; both go to an index table in the shared folder.
From the entries' hash prefixes a directory is built by doubling: a bucket with more entries than
fit is split by its next bit. Each owner task takes whole buckets, sorted by hash, so it holds one
hash value's chain at a time; entries with equal hash are compared byte by byte, and different
texts stay apart. A hot text costs its owner one entry a reading task, never its rows.

The directory has at most 2**MOST_DEPTH places; beyond, buckets only grow longer, and memory still
goes by the chain. Texts are equal when identical after each run of white space is one space;
null is empty. Of equal texts the smallest id stays (null ids only if all are null: then none is
kept). Rows that repeat an id are one document: each gets its line, and ``keep_first`` returns one
row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import arrow_map, cut_lineage, raw_texts

#: Entries a bucket holds before it is split.
BUCKET_ENTRIES = 4096
MOST_DEPTH = 16
#: Bytes of different texts that a reading task remembers to combine copies.
COMBINE_BYTES = 48 << 20
_SPACES = b" \t\n\v\f\r"


def normalised(raw: bytes) -> bytes:
    """Each run of white space as one space."""
    if not raw:
        return raw
    words = raw.split()
    if not words:
        return b" "
    return b" " * (raw[0] in _SPACES) + b" ".join(words) + b" " * (raw[-1] in _SPACES)


def hash_key(text: bytes) -> int:
    """Signed 64-bit key of a normalised text."""
    return int.from_bytes(xxhash.xxh3_64_digest(text), "big", signed=True)


def _copied(batch: pa.RecordBatch, row: int, columns: list[str]) -> pa.RecordBatch | None:
    """One row by itself, without the batch it came in; a slice would keep the whole batch in memory."""
    return batch.select(columns).take(pa.array([row])) if columns else None


def directory(counts: list[tuple[int, int]], depth: int = MOST_DEPTH, capacity: int = BUCKET_ENTRIES) -> np.ndarray:
    """Bucket of each prefix of ``depth`` bits, given (prefix, entries).

    Starts with one bucket and doubles: an overfull bucket becomes two, told apart by one more bit.
    """
    sizes = np.zeros(1 << depth, np.int64)
    for prefix, n in counts:
        sizes[prefix] += n
    places, last = np.zeros(1, np.int64), 0  # the directory at the present depth
    for d in range(depth + 1):
        held = np.bincount(places, weights=sizes.reshape(1 << d, -1).sum(1), minlength=last + 1)
        full = held > capacity
        if d == depth or not full.any():
            return np.repeat(places, 1 << (depth - d))
        places = np.repeat(places, 2)  # doubling
        splits = full[places] & (np.arange(places.size) % 2 == 1)
        fresh = np.cumsum(splits)
        places[splits] = last + fresh[splits]
        last += int(fresh[-1]) if fresh.size else 0
    raise AssertionError("unreachable")


def index_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """One row for each document and one for each different text of a reading task, written once.

    Rows of documents have ``low`` (the id) and no ``n``; entries have the normalised text, the
    smallest id and the number of rows ``n``, or, with ``whole_rows``, that row's columns as
    c0, c1, ... in place of the text.
    """
    kept = docs.columns if whole_rows else []
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    payload = [f"c{i}" for i in range(len(kept))]
    schema = StructType([StructField("key", LongType()), StructField("sha", StringType()), StructField("low", LongType()), StructField("text", BinaryType()), StructField("n", LongType()), *(StructField(c, source.schema[c].dataType, True) for c in payload)])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}  # text -> [key, sha, smallest id, rows, its columns]
        held = 0

        def entries() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            for at in range(0, len(items), 256):
                part = items[at:at + 256]
                columns = [pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.string()), pa.array([v[2] for _, v in part], pa.int64()), pa.array([None if payload else t for t, _ in part], pa.binary()), pa.array([v[3] for _, v in part], pa.int64())]
                if payload:
                    rows = pa.concat_tables([pa.Table.from_batches([v[4]]) for _, v in part]).combine_chunks()
                    columns += [rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0) for c in payload]
                yield pa.RecordBatch.from_arrays(columns, ["key", "sha", "low", "text", "n", *payload])

        for batch in batches:
            keys, shas = [], []
            ids = batch.column("_id").to_pylist()
            for i, raw in enumerate(raw_texts(batch, "_text")):
                text = normalised(raw)
                found = seen.get(text)
                if found is None:
                    row = _copied(batch, i, payload)
                    found = seen[text] = [hash_key(text), hashlib.sha256(text).hexdigest(), ids[i], 0, row]
                    held += len(text) + (row.nbytes if payload else 0)
                elif ids[i] is not None and (found[2] is None or ids[i] < found[2]):
                    found[2] = ids[i]
                    found[4] = _copied(batch, i, payload)
                found[3] += 1
                keys.append(found[0])
                shas.append(found[1])
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shas, pa.string()), batch.column("_id"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), *(pa.nulls(n, batch.schema.field(c).type) for c in payload)], ["key", "sha", "low", "text", "n", *payload])
            if held > COMBINE_BYTES:
                yield from entries()
                seen.clear()
                held = 0
        yield from entries()

    return cut_lineage(arrow_map(source, combine, schema))


def merge_entries(index: DataFrame, text_col: str | None = None, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """One row for each different text: key, sha, low, n and the columns that ``index`` carries.

    ``text_col`` names the carried column that holds the texts, if whole rows are carried.
    """
    spark = index.sparkSession
    entries = index.filter("n is not null")
    prefix = F.shiftrightunsigned(F.col("key"), 64 - MOST_DEPTH).cast("int")
    counts = entries.groupBy(prefix.alias("prefix")).count().collect()  # at most 2**MOST_DEPTH rows
    places = directory([(r["prefix"], r["count"]) for r in counts], capacity=capacity)
    sent = spark.createDataFrame([(r["prefix"], int(places[r["prefix"]])) for r in counts], "prefix int, bucket int")
    payload = [c for c in index.columns if c not in ("key", "sha", "low", "text", "n")]
    schema = StructType([f for f in index.schema.fields if f.name != "text"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[list] = []  # of the present key: [text, sha, smallest id, rows, columns]
        key = None

        def ended(chains: list[tuple[int, list]]) -> pa.RecordBatch:
            columns = [pa.array([k for k, _ in chains], pa.int64()), pa.array([c[1] for _, c in chains], pa.string()), pa.array([c[2] for _, c in chains], pa.int64()), pa.array([c[3] for _, c in chains], pa.int64())]
            if payload:
                rows = pa.concat_tables([pa.Table.from_batches([c[4]]) for _, c in chains]).combine_chunks()
                columns += [rows.column(c).chunk(0) for c in payload]
            return pa.RecordBatch.from_arrays(columns, ["key", "sha", "low", "n", *payload])

        for batch in batches:
            closed: list[tuple[int, list]] = []
            keys, shas, lows, ns = (batch.column(c).to_pylist() for c in ("key", "sha", "low", "n"))
            texts = [normalised(t) for t in raw_texts(batch, text_col)] if text_col else batch.column("text").to_pylist()
            for i in range(batch.num_rows):
                if keys[i] != key:
                    closed += [(key, c) for c in chain]
                    key, chain = keys[i], []
                for link in chain:
                    if link[0] == texts[i]:  # byte by byte
                        link[3] += ns[i]
                        if lows[i] is not None and (link[2] is None or lows[i] < link[2]):
                            link[2] = lows[i]
                            link[4] = _copied(batch, i, payload)
                        break
                else:
                    chain.append([texts[i], shas[i], lows[i], ns[i], _copied(batch, i, payload)])
            if closed:
                yield ended(closed)
        if chain:
            yield ended([(key, c) for c in chain])

    owned = entries.join(F.broadcast(sent), prefix == F.col("prefix")).drop("prefix")
    owned = owned.repartition("bucket").drop("bucket").sortWithinPartitions("key").select("key", "sha", "low", "text", "n", *payload)
    return arrow_map(owned, own, schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each document."""
    index = index_entries(docs, id_col, text_col)
    groups = merge_entries(index, capacity=capacity).select("key", "sha", F.col("low").alias("keep_id"), F.col("n").alias("group_size"))
    rows = index.filter("n is null").select("key", "sha", F.col("low").alias("doc_id"))
    joined = rows.join(groups, ["key", "sha"])
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row, that of the smallest id, for each different text; all columns."""
    merged = merge_entries(index_entries(docs, id_col, text_col, whole_rows=True), f"c{docs.columns.index(text_col)}")
    return merged.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
