"""Periodic runs of words: stretches that repeat themselves with a period, and their collapse.

A run is a maximal stretch of words with smallest period q (words q apart are identical), at least
max(LEAST, 2 q) words long. It is known by its equal places: the places i with word i = word i + q
form an unbroken stretch of (length - q) places, and runs are found as such stretches.

Scale by scale: octave k holds the periods from 2**k to 2**(k + 1) - 1. A document is exploded into
tiles for each octave, some periods long and overlapping by a window on both sides; the tiles are
shuffled and solved independently of each other. Inside a tile stand boundaries at even places. At
each boundary, Z-functions of the words after it and of the reversed words before it give, for all
periods of the octave, how far the words go on to equal those a period later, up to the window. A
run has a boundary inside or at its end, so it is met; windows of neighbouring boundaries touch, so
a longer run comes out in touching fragments. Fragments are shuffled by document and period and
stitched there. A stretch whose smallest period is smaller was found under that period as well, with the
same ends, so of equal stretches the smallest period stays.

Only boundaries that can matter are solved: a run's equal places hold a whole block of half a window
at an even place, so a block must recur a period of the octave later. That is tested for all blocks
on rolling hashes, while the document is read; equal blocks have equal hashes, so no run is lost.
Tiles without such a block are not made, and texts without such a tile are not shuffled.

Words are split at ASCII white space, as they stand. Null, empty and short texts have no runs, and
their collapsed text is their words. Rows are told apart by a number of their own, so repeated rows,
and rows without an id, each give a row. Documents of any length are read whole. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut_lineage, raw_texts

LEAST = 12
#: Words of a tile between its overlaps, at least; large octaves have TILE_PERIODS periods.
TILE_WORDS, TILE_PERIODS = 2048, 8
#: Bytes of tiles and texts that a worker sends at once, about.
SENT_BYTES = 8 << 20
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

Words = list[bytes]


def needed(period: int) -> int:
    """Equal places of the shortest run of a period."""
    return max(LEAST - period, period)


def window(octave: int) -> int:
    """Words that a boundary looks either way; twice the block. No run of the octave is shorter than twice the block less one."""
    return 2 * ((min(needed(q) for q in range(1 << octave, 2 << octave)) + 1) // 2) if octave < 3 else 1 << octave


def numbered(words: Words) -> np.ndarray:
    """Equal words have equal numbers, others do not."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return np.array([known[w] for w in words], np.int32)


def _hashes(numbers: np.ndarray) -> Callable[[int], np.ndarray]:
    """Hashes of each stretch of so many words, never zero; those of long stretches come from shorter ones."""
    made = {1: numbers.astype(np.uint64) * _GOLD | np.uint64(1)}

    def of(size: int) -> np.ndarray:
        if size not in made:
            half = 1 << (size - 1).bit_length() - 1
            first, second = of(half), of(size - half)
            mixed = (first[:len(numbers) - size + 1] ^ (second[half:half + len(numbers) - size + 1] * _MIX)) * _GOLD
            made[size] = mixed ^ (mixed >> np.uint64(29)) | np.uint64(1)
        return made[size]

    return of


def boundaries(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, places of boundaries to solve) of a document, octaves without any left out."""
    n, octave, hashes = len(numbers), 0, _hashes(numbers)
    while n >= LEAST and 2 << octave <= n:
        period, block = 1 << octave, window(octave) // 2
        own = hashes(block) if n >= block else np.zeros(0, np.uint64)
        if len(own) > period:
            padded = np.concatenate([own, np.zeros(2 * period, np.uint64)])
            later = np.lib.stride_tricks.sliding_window_view(padded, period)[period::block]
            own = own[::block]
            recurring = np.flatnonzero((later[:len(own)] == own[:, None]).any(1)) * block
            if len(recurring):
                odd = recurring % (2 * block) != 0
                places = np.unique(np.concatenate([recurring[~odd], recurring[odd] - block, recurring[odd] + block]))
                places = places[places + period <= n]
                if len(places):
                    yield octave, places
        octave += 1


def tiles(numbers: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(octave, place of the first word, tile's own begin, words, boundaries) of the tiles to solve."""
    for octave, places in boundaries(numbers):
        period, reach = 1 << octave, window(octave)
        size = max(TILE_WORDS, TILE_PERIODS * period) // reach * reach
        for own in np.split(places, np.flatnonzero(np.diff(places // size)) + 1):
            low, high = max(0, int(own[0]) - reach), min(len(numbers), int(own[-1]) + 2 * period + reach)
            yield octave, low, int(own[0]) // size * size, numbers[low:high], own


def prefix_lengths(pattern: list[int], text: list[int], places: list[int], own: dict[int, int] | None = None) -> dict[int, int]:
    """Z-function: the length of the longest prefix of ``pattern`` that begins at each of ``places`` of ``text``.

    ``places`` are in order; the others do not begin with the pattern's first word. ``own`` is the
    same for the pattern itself, from its second word on; it is left out when the text is the
    pattern. So each word of the text is compared about once.
    """
    found: dict[int, int] = {}
    own = found if own is None else own
    left = right = 0
    most, end = len(pattern), len(text)
    for i in places:
        length = min(own.get(i - left, 0), right - i) if i < right else 0
        if i + length >= right:
            stop = min(end - i, most)
            while length < stop and text[i + length] == pattern[length]:
                length += 1
            left, right = i, i + length
        found[i] = length
    return found


def _alike(pattern: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """Prefix lengths of ``pattern`` at the first ``count`` places of ``text``."""
    lengths = np.zeros(count, np.int64)
    places = np.flatnonzero(text[:count] == pattern[0]).tolist() if len(pattern) else []
    if places:
        told = pattern.tolist()
        own = prefix_lengths(told, told, (np.flatnonzero(pattern[1:] == pattern[0]) + 1).tolist())
        found = prefix_lengths(told, text.tolist(), places, own)
        lengths[list(found)] = list(found.values())
    return lengths


def tile_fragments(octave: int, low: int, begin: int, words: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, start, stop) of stretches of equal places in a tile, as far as its boundaries see.

    Those too short for a run are left out unless they reach the end of what the tile sees.
    """
    period, reach = 1 << octave, window(octave)
    size = max(TILE_WORDS, TILE_PERIODS * period) // reach * reach
    periods = np.arange(period, 2 * period)
    least = np.maximum(LEAST - periods, periods)
    open_: dict[int, list[int]] = {}
    done: list[tuple[int, int, int]] = []
    for place in places.tolist():
        at = place - low
        count = min(period, len(words) - at - period + 1)  # periods whose later words lie in the document
        ahead = _alike(words[at:at + reach], words[at + period:at + 2 * period + reach - 1], count)
        back = min(reach, at)
        # Reversed, the place of period q is the last one first: from the largest period down.
        before = _alike(words[at - back:at][::-1], words[at + period - back:at + period + count - 1][::-1], count)[::-1] if back else np.zeros(count, np.int64)
        kept = np.flatnonzero((ahead + before >= least[:count]) | (ahead == reach) | (before == reach))
        for q, start, stop in zip(periods[kept].tolist(), (place - before[kept]).tolist(), (place + ahead[kept]).tolist()):
            last = open_.get(q)
            if last and start <= last[1]:
                last[1] = max(stop, last[1])
            else:
                if last:
                    done.append((q, *last))
                open_[q] = [start, stop]
    done += [(q, *last) for q, last in open_.items()]
    return [(q, start, stop) for q, start, stop in done if stop - start >= needed(q) or start <= begin - reach or stop >= begin + size]


_SCAN = "row long, doc_id long, n long, text binary, words_sha256 string, octave int, low long, begin long, words binary, places binary"
_SCAN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """Documents (octave null) and their tiles in one table, written once.

    A document's row has the hash of its words or, if it has tiles, the words themselves.
    ``prepare`` may change a document's words beforehand.
    """
    names = [part.split()[0] for part in _SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def sent() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCAN_TYPES)], names)

        for batch in batches:
            for row, doc, raw in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), raw_texts(batch, "text")):
                words = raw.split()
                if prepare:
                    words = prepare(doc, words)
                joined, tiled = b" ".join(words), False
                for octave, low, begin, part, places in tiles(numbered(words)) if len(words) >= LEAST else ():
                    tiled = True
                    rows.append((row, None, None, None, None, octave, low, begin, part.astype("<i4").tobytes(), places.astype("<i8").tobytes()))
                    held += 4 * len(part) + 8 * len(places)
                    if held >= SENT_BYTES:
                        yield sent()
                        rows, held = [], 0
                rows.append((row, doc, len(words), joined if tiled else None, None if tiled else hashlib.sha256(joined).hexdigest(), None, None, None, None, None))
                held += len(joined) if tiled else 64
                if held >= SENT_BYTES:
                    yield sent()
                    rows, held = [], 0
        if rows:
            yield sent()

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut_lineage(arrow_map(source, run, _SCAN))


def fragments(scanned: DataFrame) -> DataFrame:
    """(row, period, start, stop) of all tiles, each solved on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, octave, low, begin, words, places in zip(*(batch.column(c).to_pylist() for c in ("row", "octave", "low", "begin", "words", "places"))):
                found = tile_fragments(octave, low, begin, np.frombuffer(words, "<i4"), np.frombuffer(places, "<i8"))
                if found:
                    parts = np.array(found, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), row, np.int64)), *(pa.array(parts[:, k]) for k in range(3))], ["row", "period", "start", "stop"])

    dealt = scanned.filter("octave is not null").select("row", "octave", "low", "begin", "words", "places").repartition("row", "octave", "low")
    return arrow_map(dealt, run, "row long, period long, start long, stop long")


def _needed(period: Column) -> Column:
    return F.greatest(F.lit(LEAST) - period, period)


def runs(scanned: DataFrame) -> DataFrame:
    """(row, start, length, period) of every run: fragments stitched by document and period."""
    order = Window.partitionBy("row", "period").orderBy("start", "stop")
    far = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = fragments(scanned).withColumn("fresh", F.coalesce(F.col("start") > far, F.lit(True)).cast("int"))
    joined = joined.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = joined.groupBy("row", "period", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).filter(F.col("stop") - F.col("start") >= _needed(F.col("period")))
    ended = whole.select("row", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")
    return ended.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def collapse(words: Words, found: list[tuple[int, int, int]]) -> Words:
    """``words`` without what runs (start, length, period) repeat after their first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, over in zip(words, np.cumsum(change).tolist()) if not over]


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """(doc_id, n, runs, text, words_sha256), one row for each row of ``docs``.

    ``runs`` are (start, length, period) by start, then period; ``text`` is the collapsed text of a
    document that has candidates for runs, else null: it is then the words as they stand, and their
    hash is in ``words_sha256``.
    """
    scanned = scan(docs, id_col, text_col, prepare)
    found = runs(scanned).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # a document's own
    rows = scanned.filter("octave is null").select("row", "doc_id", "n", "text", "words_sha256").join(found, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                out.append(b" ".join(collapse(text.split(b" "), [(r["start"], r["length"], r["period"]) for r in own])) if own and text is not None else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("runs"), pa.array(out, pa.binary()), batch.column("words_sha256")],
                                             ["doc_id", "n", "runs", "text", "words_sha256"])

    told = rows.select("doc_id", "n", "text", "words_sha256", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    return arrow_map(told, run, "doc_id long, n long, runs array<struct<start: bigint, length: bigint, period: bigint>>, text binary, words_sha256 string")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run and hashes of all."""
    every = F.coalesce("runs", F.array().cast("array<struct<start: bigint, length: bigint, period: bigint>>"))
    longest = F.array_min(F.transform(every, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform(every, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("_best", longest).select(
        "doc_id", F.size(every).cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.l")).alias("length"), F.col("_best.period").alias("period"),
        F.expr("-(1000 * _best.l) div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.coalesce(F.sha2("text", 256), "words_sha256").alias("collapsed_sha256"))
