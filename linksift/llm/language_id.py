"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; for each bit a binary classifier over hashed byte n-grams
tells the languages with a one from those with a zero. The classifiers are log-odds of smoothed
n-gram frequencies, learned from a bounded, seeded sample of labelled texts. A text's bit margins
are compared with every codeword by a logistic loss; the codeword with the least total loss wins,
the share of its weight is the score, and a text whose two best are near is flagged ambiguous.

A null text, or one without a letter, is ``und`` with score 0. Without labelled rows all are
``und``. Null languages teach nothing; null ids count as not held out and teach nothing. Equal
losses go to the language that sorts first. Each row, repeated ones too, gives one row.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, learned_share

UNDETERMINED = "und"
#: Hashed n-gram places; a power of two.
FEATURES = 1 << 15
#: About so many labelled texts of each language are learned from: the bound of the sample.
SAMPLE_PER_LANGUAGE = 2000
#: Languages with labels; more raise an error, as each needs a codeword on the driver.
MOST_LANGUAGES = 1000
SMOOTHING = 0.5
#: Steepness of the loss over a text's mean log-odds.
SHARPNESS = 6.0
AMBIGUOUS_BELOW = 0.6
_MAYBE_LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a text has a letter (Unicode category L); numeric signs such as one half are none."""
    return any(c.isalpha() for run in _MAYBE_LETTER.finditer(text) for c in run.group())


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1/-1: all splits for few languages, else the best-spread of random codes."""
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).T.reshape(n, -1) if splits else np.ones((n, 1), np.float32)
    random, bits, best = np.random.default_rng(seed), int(10 * np.log2(n)) + 1, None
    for _ in range(50):
        code = random.choice(np.array([1, -1], np.float32), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - (code @ code.T)[~np.eye(n, dtype=bool)].max()) / 2
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def gram_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the byte bigrams, trigrams and 4-grams of the texts, and where each text's begin.

    Texts stand in one buffer, each with a space before and after it; grams are counted from the
    byte they end at, so a text's share of the result is as long as the text plus one.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"   " + b"".join(t + b" " for t in texts), np.uint8).astype(np.uint32)
    two = data[2:-1] * np.uint32(0x9E3779B1) + data[3:] * np.uint32(0x85EBCA6B)
    three = two + data[1:-2] * np.uint32(0xC2B2AE35)
    four = three + data[:-3] * np.uint32(0x27D4EB2F)
    mask = np.uint32(FEATURES - 1)
    places = np.stack([((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(12)) & mask for g in (two, three ^ np.uint32(0x5BD1E995), four ^ np.uint32(0x1B873593))])
    return places, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def plain(text: str) -> bytes:
    """Lower case with white space, digits and signs as one space."""
    return " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode("utf-8", "surrogatepass")


@dataclass
class OutputCodes:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # places x bits

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) for each text."""
        out = [(UNDETERMINED, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        if not known:
            return out
        cleaned = [plain(texts[i]) for i in known]
        margins = np.empty((len(known), self.codes.shape[1]), np.float32)
        for first in _runs([len(c) for c in cleaned], 1 << 20):
            places, starts = gram_places(cleaned[first])
            sums = sum(np.add.reduceat(self.weights[p], starts, axis=0) for p in places)
            margins[first] = sums / (3 * np.array([len(c) + 1 for c in cleaned[first]]))[:, None]
        losses = np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.codes[None]).sum(2)
        weight = np.exp(losses.min(1, keepdims=True) - losses)
        shares = weight / weight.sum(1, keepdims=True)
        for i, share in zip(known, shares):
            k = int(share.argmax())
            out[i] = (self.languages[k], float(share[k]), bool(share[k] < AMBIGUOUS_BELOW))
        return out


def _runs(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of about ``most`` bytes, so that the buffers stay small."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if sizes:
        yield slice(first, len(sizes))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, seed: int = 3) -> OutputCodes:
    """Learn from a hash-chosen sample of about ``per_language`` rows of each language."""
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return OutputCodes([], np.ones((0, 1), np.float32), np.zeros((FEATURES, 1), np.float32))
    share = F.lit(None)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / counts[lang]))).otherwise(share)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                cleaned = plain(text)
                if cleaned:
                    found = np.bincount(gram_places([cleaned])[0].ravel(), minlength=FEATURES)
                    # A very long text teaches no more than one of a few thousand grams.
                    sums[lang] = sums.get(lang, 0) + found * min(1.0, 6000 / found.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([np.asarray(v, "<f8").tobytes() for v in sums.values()], pa.binary())], ["lang", "sums"])

    sample = rows.filter(learned_share(F.col("doc_id"), share, seed)).select("lang", "text").repartition(8)
    totals = {lang: np.full(FEATURES, SMOOTHING) for lang in languages}
    for row in arrow_map(sample, grams, "lang string, sums binary").collect():  # 8 tasks, a vector for each language
        totals[row["lang"]] += np.frombuffer(row["sums"], "<f8")
    frequency = np.stack([totals[lang] / totals[lang].sum() for lang in languages])
    codes = codewords(len(languages))
    weights = np.stack([np.log(frequency[codes[:, b] > 0].mean(0)) - np.log(frequency[codes[:, b] < 0].mean(0)) if (codes[:, b] < 0).any() else np.zeros(FEATURES) for b in range(codes.shape[1])], axis=1)
    return OutputCodes(languages, codes, np.ascontiguousarray(weights, np.float32))


def identify(docs: DataFrame, model: OutputCodes, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every whole text; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(source, score, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
