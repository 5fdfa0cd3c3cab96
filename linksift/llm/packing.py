"""Best-fit packing of token sequences, improved by swap-based local search.

``token_pieces`` tokenises documents and cuts those longer than a sequence; ``pack`` puts the
pieces into sequences. Packing runs in buckets of a fixed number of pieces dealt out by a seeded
hash. In a bucket, pieces go longest first into the fullest sequence that has room; then moves,
one-for-one and two-for-one exchanges between underfull sequences raise the sum of squared fills
until the emptiest sequences are empty. Sequences that stay underfull are opened again and meet
those of other buckets in the next, much smaller round, so the waste does not grow with the
number of buckets.

Null and empty texts have the end token alone. A row that repeats another is packed again, as a
document of its own. Null ids are kept. An empty table gives an empty result. Ties go to the
smaller row number; sequence numbers are unique and otherwise arbitrary.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut_lineage, raw_texts

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Pieces that one task packs together.
BUCKET_PIECES = 4096
#: A sequence filled less than this share is opened again in the next round.
REOPEN_BELOW = 0.97
#: Memory for the ids of frequent words, in a task, about; and of an entry besides its word and ids.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 180
#: Letters up to here have one form in all Unicode versions.
_LATIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """Byte-level letter of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(256 + k) for k, b in enumerate(others)}


class WordTokenizer:
    """Token ids of whole texts as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins letters across it, so a text's ids are those
    of its words one after another; the ids of frequent words are remembered, in two halves of
    which the older one is let go when the newer is full. ASCII letters are lowered first, as the
    tokenizer does itself, unless the text may hold a special token. Words of Latin letters go to
    the model directly: lowered, and in the letters that stand for their bytes. A task makes
    its own, so that what it remembers goes with it.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.whole = _loaded(path)
        self.model = self.whole.model
        self.half, self.held = cache_bytes // 2, 0
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if len(text) > 1 and text[-1] in ".," and text[-2].isalpha() and text[-2] < _LATIN_END:  # letters and a stop are always two tokens' places
            end = len(word) - 1
            return self._get(word[:end]) + self._get(word[end:])
        if text.isalpha() and max(text) < _LATIN_END and (low := text.lower()).isalpha():
            return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters)))
        return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)

    def _get(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = self._ids(word)
            self.held += len(word) + len(ids) + ENTRY_BYTES
            if self.held > self.half:
                self.older, self.known, self.held = self.known, {}, 0
            self.known[word] = ids
        return ids

    def ids(self, raw: bytes) -> bytes:
        words = (raw if b"<|" in raw else raw.lower()).split()
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._get(w) if f is None else f for f, w in zip(found, words)]
        return b"".join(found)


@lru_cache(maxsize=1)
def _loaded(path: str):
    """The tokenizer of a file, once a worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row), written once; ``row`` numbers the pieces."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text")):
                ids = tokens.ids(raw) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = arrow_map(source, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return cut_lineage(pieces.withColumn("row", F.monotonically_increasing_id()))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free place
    mask = 0  # bit f: some bin has f places free
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fitting = mask >> lengths[i]
        if fitting:
            free = lengths[i] + (fitting & -fitting).bit_length() - 1
            at = with_room[free].pop()
            if not with_room[free]:
                mask &= ~(1 << free)
        else:
            free, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        free -= lengths[i]
        with_room[free].append(at)
        mask |= 1 << free
    return bins


def _exchange(source: list[int], target: list[int], room: int, lengths: list[int]) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The change that fills ``target`` most, at most by ``room``: (gain, out of source, out of target)."""
    best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None
    giving = [((i,), lengths[i]) for i in source]
    giving += [((i, j), lengths[i] + lengths[j]) for k, i in enumerate(source) for j in source[:k]]
    taking: list[tuple[tuple[int, ...], int]] = [((), 0)] + [((i,), lengths[i]) for i in target]
    for out, size in giving:
        for back, less in taking:
            gain = size - less
            if 0 < gain <= room and (back or len(out) == 1) and (best is None or gain > best[0]):
                best = (gain, out, back)
                if gain == room:
                    return best
    return best


def _lengths_once(members: list[int], lengths: list[int], times: int) -> list[int]:
    """Longest first, pieces of every length in a bin, ``times`` of a length at most; equal lengths exchange alike.

    A bin has less than sqrt(2 x capacity) different lengths.
    """
    seen: dict[int, int] = {}
    kept = []
    for i in sorted(members, key=lambda i: -lengths[i]):
        seen[lengths[i]] = seen.get(lengths[i], 0) + 1
        if seen[lengths[i]] <= times:
            kept.append(i)
    return kept


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty underfull bins into others by moves, one-for-one and two-for-one exchanges.

    Each change takes places from the emptiest bin and gives them to one at least as full, which
    raises the sum of squared fills; so the search ends. Pieces of all lengths are offered: two of
    each length of the emptiest bin, as two may go together, and one of each length in return.
    """
    fills = [sum(lengths[i] for i in b) for b in bins]
    open_bins = sorted((k for k in range(len(bins)) if fills[k] < capacity), key=lambda k: (fills[k], k))
    room = sum(capacity - fills[k] for k in open_bins)
    while len(open_bins) > 1:
        source = open_bins.pop(0)
        room -= capacity - fills[source]
        if room < fills[source]:
            break  # nor has a fuller one a place to go
        changed = True
        while changed and bins[source]:
            changed = False
            for target in reversed(open_bins):  # fullest first
                free = capacity - fills[target]
                if free == 0 or fills[target] < fills[source]:
                    continue
                found = _exchange(_lengths_once(bins[source], lengths, 2), _lengths_once(bins[target], lengths, 1), free, lengths)
                if found:
                    gain, out, back = found
                    bins[source] = [i for i in bins[source] if i not in out] + list(back)
                    bins[target] = [i for i in bins[target] if i not in back] + list(out)
                    fills[source] -= gain
                    fills[target] += gain
                    room -= gain
                    changed = True
                    if not bins[source]:
                        break
        open_bins = sorted((k for k in open_bins if fills[k] < capacity), key=lambda k: (fills[k], k))
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes for one bucket; the search is left out where no bin can go."""
    bins = best_fit(lengths, capacity)
    return local_search(bins, lengths, capacity) if len(bins) > math.ceil(sum(lengths) / capacity) else bins


def _bucket_packer(number: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the pieces of one bucket of a round."""
    def bucket(pieces: pa.Table) -> pa.Table:
        order = pieces.sort_by([("length", "descending"), ("row", "ascending")])
        lengths, rows = order.column("length").to_pylist(), order.column("row").to_pylist()
        base = ((number << 40) + order.column("bucket")[0].as_py()) << 16
        out: list[list[int]] = [[], [], [], []]
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            fill, at = sum(lengths[i] for i in members), 0
            for i in members:
                for column, value in zip(out, (rows[i], base + k, at, fill)):
                    column.append(value)
                at += lengths[i]
        return pa.table([pa.array(c, pa.int64()) for c in out], ["row", "sequence_id", "offset", "fill"])

    return bucket


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, bucket_pieces: int = BUCKET_PIECES, reopen_below: float = REOPEN_BELOW) -> DataFrame:
    """``pieces`` (with ``row`` and ``length``) plus sequence_id and offset."""
    schema = "row long, sequence_id long, offset long, fill long"
    sizes = pieces.select("row", "length")
    left, round_, done = pieces.count(), 0, []
    while left:
        buckets = math.ceil(left / bucket_pieces)

        dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64(F.lit(round_), "row"), F.lit(buckets)))
        placed = cut_lineage(dealt.groupBy("bucket").applyInArrow(_bucket_packer(round_, capacity), schema))
        open_ = F.col("fill") < F.lit(reopen_below * capacity)
        again = placed.filter(open_).count() if buckets > 1 else 0
        if again > 0.9 * left:
            again = 0  # such pieces leave room in any company
        done.append(placed.filter(~open_) if again else placed)
        sizes = placed.filter(open_).join(sizes, "row").select("row", "length") if again else sizes
        left, round_ = again, round_ + 1
    if not done:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return pieces.join(placed.drop("fill"), "row")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(token_pieces(docs, tokenizer_path, capacity=capacity), capacity).drop("row")
