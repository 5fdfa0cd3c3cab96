"""Token counts of a unigram vocabulary without its tokens: a Viterbi pass that only counts.

An Aho-Corasick automaton lists the vocabulary's pieces that end at each place; dynamic
programming carries the best score and its number of pieces. Ties go as in the tokenizer: the
longest piece (the first start) wins, as only a better score replaces one. A character that
begins no piece of its own is unknown; its score is ten below the vocabulary's least, and with
byte fallback it counts as its UTF-8 bytes, else a run of unknown ones counts as one.

The text is cut where every path must pass: before a word mark that follows something else, if
no piece goes on over such a place, and around characters that no piece holds. Counts of frequent
segments are remembered. Sums are exact for vocabularies whose scores are whole numbers; others
are summed segment by segment.

Null and empty texts have no tokens and score 0. Each row, repeated or without an id, gives one
row; an empty table gives none. No row is longer than its segments need: memory goes by segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS = 500_000


class UnigramCounter:
    """Counts the pieces of the best path over normalised text."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        letters = "".join(sorted(set("".join(scores)) - {MARK}))
        known = re.escape(letters)
        inside = any(MARK in p.lstrip(MARK) for p in scores)
        #: Segments: of known characters (a word with its marks), or one character that no piece holds.
        self.segment = re.compile(f"[{known}{MARK}]+|[^{known}{MARK}]" if inside else f"{MARK}*[{known}]+|{MARK}+|[^{known}{MARK}]" if letters else f"{MARK}+|[^{MARK}]", re.S)
        self.one = {p for p in scores if len(p) == 1}
        self.known: dict[str, tuple[int, float]] = {}

    def _best(self, segment: str) -> tuple[int, float]:
        size = len(segment)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, match in self.automaton.iter(segment):
            ends[last + 1].append(match)  # longest first
        score, count, open_run = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end in range(1, size + 1):
            best, pieces, run, single = None, 0, False, False
            for length, gain in ends[end]:
                single = single or length == 1
                now = score[end - length] + gain
                if best is None or now > best:
                    best, pieces, run = now, count[end - length] + 1, False
            if not single:
                now = score[end - 1] + self.unknown
                if best is None or now > best:
                    more = len(segment[end - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not open_run[end - 1])
                    best, pieces, run = now, count[end - 1] + more, True
            score[end], count[end], open_run[end] = best, pieces, run
        return count[size], score[size]

    def _segment(self, segment: str) -> tuple[int, float]:
        found = self.known.get(segment)
        if found is None:
            if len(self.known) >= CACHE_SEGMENTS:
                self.known.clear()
            found = self._best(segment)
            if len(segment) <= 64:
                self.known[segment] = found
        return found

    def count(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a normalised text."""
        if not self.byte_fallback:  # runs of unknown characters go over the cuts
            return self._best(text)
        tokens, total = 0, 0.0
        for segment in self.segment.findall(text):
            n, s = self._segment(segment)
            tokens += n
            total += s
        return tokens, total


def load_vocabulary(model_path: str) -> tuple[dict[str, float], bool]:
    """Pieces with scores of a sentencepiece file, without control and byte pieces; whether it falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i): float(model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return pieces, any(model.is_byte(i) for i in ids)


_COUNTERS: dict[str, tuple] = {}


def counter(model_path: str) -> tuple:
    """(normaliser, counter) of a vocabulary file, one a worker process."""
    if model_path not in _COUNTERS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        _COUNTERS[model_path] = (model.normalize, UnigramCounter(*load_vocabulary(model_path)))
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of every whole text; no shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalise, best = counter(model_path)
        for batch in batches:
            found = [best.count(normalise(t)) if t else (0, 0.0) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(source, count, "doc_id long, n_tokens long, score double")
