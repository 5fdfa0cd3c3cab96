"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's score is a logistic function of a bias, a weight for each feature and low-rank
interactions of each pair of features. The pair sum is never formed: for every factor it is half
the square of the sum less the sum of squares, so a text costs its number of features times the
rank. Features are hashed lower-case words (square root of their share), statistics of form
(letter case, signs, digits, repeated words and lines, word and line lengths, the worst tenth of
the text) and numeric metadata columns that the caller names.

The machine is trained by AdaGrad on the driver from a bounded, hash-chosen sample of labelled
rows (SAMPLE_PER_LABEL for each label). A document with several labels has its highest. Null and
empty texts have no words and get the score of their form; whole texts are read. Null ids are not
held out and teach nothing. Without labelled rows of both kinds, the score is the share of ones,
or 0.5 without any. Each row, repeated ones too, gives one row; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, learned_share, raw_texts

#: Hashed word places; statistics and metadata stand behind them.
WORDS = 1 << 15
#: Rows of each label in the training sample, about: the bound of what the driver gathers.
SAMPLE_PER_LABEL = 3000
RANK = 6
EPOCHS = 12
THRESHOLD = 0.5
FORM = 16
_CAPS = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-")
_DIGITS = b"0123456789"


def _share(part: bytes, of: bytes) -> float:
    """Share of the non-space bytes of ``part`` that are among ``of``."""
    solid = part.translate(None, b" \t\n\v\f\r")
    return 1.0 - len(solid.translate(None, of)) / len(solid) if solid else 0.0


def form(raw: bytes, words: list[bytes], different: int) -> list[float]:
    """FORM statistics between 0 and about 1."""
    n, lines = len(words), [line for line in raw.split(b"\n") if line.strip()]
    tenth = max(1, n // 10)
    parts = [words[i:i + tenth] for i in range(0, n, tenth)]
    joined = [b" ".join(p) for p in parts]
    return [
        1.0, min(1.0, n / 100), min(1.0, n / 2000), different / n if n else 0.0,
        _share(raw, _CAPS), max((_share(p, _CAPS) for p in joined), default=0.0),
        _share(raw, _MARKS), max((_share(p, _MARKS) for p in joined), default=0.0),
        _share(raw, _DIGITS), max((_share(p, _DIGITS) for p in joined), default=0.0),
        max((1 - len(set(p)) / len(p) for p in parts), default=0.0),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(1.0, len(raw) / n / 20) if n else 0.0, min(1.0, max(map(len, words), default=0) / 60),
        min(1.0, len(lines) / (n + 1) * 5), min(1.0, 4 * sum(a == b for a, b in zip(words, words[1:])) / n) if n else 0.0,
    ]


def features(raw: bytes, extra: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text; word values have the same norm whatever its length."""
    words = raw.split()
    counts = Counter(raw.lower().split())
    shape = form(raw, words, len(counts)) + extra
    hashed = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORDS
    places = np.concatenate([hashed, np.arange(WORDS, WORDS + len(shape))]).astype(np.int32)
    share = np.array(list(counts.values()), np.float32) / max(1, len(words))
    return places, np.concatenate([np.sqrt(share), np.array(shape, np.float32)])


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray  # places
    factors: np.ndarray  # places x rank

    def raw_scores(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, sums of factors) of rows that begin at ``starts``; every row has features."""
        scaled = self.factors[places] * values[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(1), starts)
        return self.bias + np.add.reduceat(self.weights[places] * values, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(p) for p, _ in rows[:-1]])
        raw, _ = self.raw_scores(np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, rank: int = RANK, epochs: int = EPOCHS, seed: int = 5, rate: float = 0.1, decay: float = 1e-5) -> FactorisationMachine:
    """AdaGrad over small batches; both labels weigh the same in total."""
    random = np.random.default_rng(seed)
    ones = float(labels.mean()) if len(labels) else 0.5
    machine = FactorisationMachine(0.0, np.zeros(size, np.float32), random.normal(0, 0.01, (size, rank)).astype(np.float32))
    if not len(labels) or ones in (0.0, 1.0):
        machine.bias = float(np.clip(np.log((ones + 1e-9) / (1 - ones + 1e-9)), -30, 30))
        machine.factors[:] = 0
        return machine
    cost = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 32):
            chosen = order[at:at + 32]
            lengths = np.array([len(rows[i][0]) for i in chosen])
            places, values = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            raw, sums = machine.raw_scores(places, values, np.cumsum(lengths) - lengths)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) * cost[chosen] / len(chosen)
            each = np.repeat(slope, lengths)
            to_v = (each * values)[:, None] * (np.repeat(sums, lengths, axis=0) - machine.factors[places] * values[:, None])
            used, back = np.unique(places, return_inverse=True)
            grad_w = np.bincount(back, each * values, len(used)) + decay * machine.weights[used]
            grad_v = np.stack([np.bincount(back, to_v[:, f], len(used)) for f in range(rank)], 1) + decay * machine.factors[used]
            seen_w[used] += grad_w ** 2
            seen_v[used] += grad_v ** 2
            seen_b += slope.sum() ** 2
            machine.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            machine.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            machine.bias -= rate * float(slope.sum() / np.sqrt(seen_b))
    return machine


def _extra(batch: pa.RecordBatch, columns: list[str]) -> list[list[float]]:
    """Metadata squeezed between 0 and 1; null is 0."""
    lists = [[0.0 if x is None else float(abs(x) / (abs(x) + 1000)) for x in batch.column(c).to_pylist()] for c in columns]
    return [list(row) for row in zip(*lists)] if lists else [[]] * batch.num_rows


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), per_label: int = SAMPLE_PER_LABEL, seed: int = 9) -> FactorisationMachine:
    """Learn from about ``per_label`` ids of each label (0 or 1), chosen by a hash; of rows that repeat an id, from one."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_label / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, per_label / max(1, counts.get(0, 0)))))
    sample = marked.filter(learned_share(F.col("doc_id"), share, seed)).groupBy("doc_id").agg(F.max("label").alias("label")).limit(4 * per_label)
    names = [f"m{i}" for i in range(len(metadata))]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(raw, extra) for raw, extra in zip(raw_texts(batch, "text"), _extra(batch, names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([p.astype("<i4").tobytes() for p, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], ["doc_id", "label", "places", "shares"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).cast("double").alias(n) for c, n in zip(metadata, names)))
    told = ["text", *names]
    first = F.min_by(F.struct("label", *told), F.xxhash64(*told)).alias("row")  # whatever the order of rows
    chosen = source.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(first)  # 4 * per_label rows at most
    chosen = chosen.select("doc_id", "row.*")
    found = arrow_map(chosen, extract, "doc_id long, label int, places binary, shares binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"], r["places"], r["shares"]))
    rows = [(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in found]
    return fit(rows, np.array([r["label"] for r in found], np.float64), WORDS + FORM + len(metadata))


def _batch_scores(machine: FactorisationMachine, raws: list[bytes], extras: list[list[float]]) -> list[float]:
    scores: list[float] = []
    for at in range(0, len(raws), 64):
        scores += machine.score([features(r, e) for r, e in zip(raws[at:at + 64], extras[at:at + 64])]).tolist()
    return scores


def score(docs: DataFrame, machine: FactorisationMachine, held_out: Column, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # places x rank, whatever the input
    names = [f"m{i}" for i in range(len(metadata))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _batch_scores(sent.value, raw_texts(batch, "text"), _extra(batch, names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"), *(F.col(c).cast("double").alias(n) for c, n in zip(metadata, names)))
    return arrow_map(source, run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", metadata: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``; all columns, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _batch_scores(sent.value, raw_texts(batch, text_col), _extra(batch, list(metadata)))
            yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return arrow_map(docs, keep, docs.schema)
