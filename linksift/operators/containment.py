"""Which titles stand inside which texts, by winnowed grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage, small_enough

#: Bytes of a gram, and grams of a window. Every title is at least a window long.
GRAM, WINDOW = 8, 5
MIN_TITLE = GRAM + WINDOW - 1
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
#: Anchors of titles that tasks get as a list (8 MB); more are joined.
MOST_ANCHORS = 1 << 20
#: Texts with one anchor that one task meets; the anchors above are split, of the hottest MOST_SPLIT ones.
SPLIT_ROWS, MOST_SPLIT = 200_000, 100_000


def minimizers(text: bytes) -> np.ndarray:
    """Distinct least gram hashes of all windows of ``text``, sorted; none for a text shorter than a window.

    A text that contains a title contains its windows, so it has all of the title's minimizers. Eight bytes are one number and
    the mixing is one-to-one, so different grams have different hashes.
    """
    found = []
    for start in range(0, max(len(text) - MIN_TITLE + 1, 0), PIECE):
        raw = np.frombuffer(text, np.uint8, count=min(PIECE + MIN_TITLE - 1, len(text) - start), offset=start).astype(np.uint64)
        n = raw.size - GRAM + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(GRAM):
            mixed |= raw[k:k + n] << np.uint64(8 * k)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = mixed[:n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            np.minimum(least, mixed[k:k + least.size], out=least)
        found.append(np.unique(least))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def anchors_of(df: DataFrame, key: str, text: str, among: np.ndarray | None = None) -> DataFrame:
    """(key, anchor): the minimizers of each text, or those ``among`` the given ones; a null text has none."""
    spark = df.sparkSession
    wanted = None if among is None else spark.sparkContext.broadcast(np.sort(among))
    schema = StructType([df.schema[key], StructField("anchor", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws, rows, found, held = batch.column(key), batch.column(text).cast(pa.binary()), [], [], 0

            def told() -> pa.RecordBatch:
                at = np.repeat(np.array(rows, np.int64), [f.size for f in found])
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(np.concatenate(found))], [key, "anchor"])

            for i, raw in enumerate(raws):
                own = minimizers(raw.as_py() or b"")
                own = own if wanted is None else own[np.isin(own, wanted.value, assume_unique=True)]
                if own.size:
                    rows.append(i)
                    found.append(own)
                    held += own.size
                if held > PIECE:
                    yield told()
                    rows, found, held = [], [], 0
            if found:
                yield told()

    return df.select(key, text).mapInArrow(cut, schema)


def contained_titles(texts: DataFrame, key: str, text: str, titles: DataFrame, title: str,
                     most_anchors: int = MOST_ANCHORS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(key, title) pairs where ``title`` is a substring of ``text``; titles are distinct and at least ``MIN_TITLE`` long.

    Titles get numbers. Each joins on that of its minimizers that the fewest texts have; one that no text has rules its
    title out. (key, anchor) and (key, number) rows alone shuffle for that; texts and titles come to the candidates at the end,
    as rows that their key or number leads to, and are compared in full. An anchor in more than ``split_rows`` texts is split by key,
    with a copy of its titles for each part.
    """
    numbered = cut_lineage(titles.select(title).withColumn("_no", F.monotonically_increasing_id()))
    owned = cut_lineage(anchors_of(numbered, "_no", title))
    distinct = owned.select("anchor").distinct()
    if small_enough(distinct, most_anchors):
        among = np.array([r[0] for r in distinct.collect()], np.int64)
        hits = cut_lineage(anchors_of(texts, key, text, among))
    else:
        hits = cut_lineage(anchors_of(texts, key, text).join(distinct, "anchor", "left_semi").select(key, "anchor"))
    held = hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("_texts"))
    rated = owned.join(held, "anchor", "left").groupBy("_no").agg(F.min(F.struct("_texts", "anchor")).alias("_least"), F.count_if(F.col("_texts").isNull()).alias("_absent"))
    chosen = rated.filter("_absent = 0").select("_no", "_least.*")
    # Anchors left unsplit beyond the hottest ones have at most 1 / MOST_SPLIT of all rows each.
    hot = chosen.filter(F.col("_texts") > split_rows).groupBy("anchor").agg(F.max("_texts").alias("_texts")).orderBy(F.desc("_texts"), "anchor").limit(MOST_SPLIT)
    parts = F.broadcast(hot.select("anchor", F.ceil(F.col("_texts") / F.lit(split_rows)).cast("int").alias("_parts")))
    of = F.coalesce("_parts", F.lit(1))
    text_side = hits.join(parts, "anchor", "left").select(key, "anchor", F.pmod(F.xxhash64(key), of).cast("int").alias("_part"))
    title_side = chosen.join(parts, "anchor", "left").select("_no", "anchor", F.explode(F.sequence(F.lit(0), of - 1)).alias("_part"))
    candidates = text_side.join(title_side, ["anchor", "_part"]).select(key, "_no").distinct()
    met = candidates.join(numbered, "_no").join(texts.select(key, text), key)
    return met.filter(F.expr(f"instr(`{text}`, `{title}`) > 0")).select(key, title)
