"""License scans by template mark-up, compiled into token automata.

A template is wording with mark-up: ``[...]`` may be missing, ``{n}`` stands for up to n words of
any kind, ``(a|b)`` for one of several wordings. Each becomes an automaton over words. It accepts a
stretch of a text only if every mandatory word stands there exactly, in order, with nothing but the
marked-up parts between. Base phrases are templates without mark-up.

A word is a run of ASCII letters, digits and non-ASCII characters; A-Z are lowered. A text whose
words lack a template's rarest mandatory run is not run through its automaton. Score: 1 if a
template accepts, else 0.5 if a base phrase stands in the text, else 0. Null and empty texts have
no words, no labels and score 0. Each row, repeated or without an id, gives one row; an empty
table gives none. Whole texts are read; no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, raw_texts

#: Base phrases and their labels (fixed values of the contract).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates and their labels, in the mark-up above.
TEMPLATES = {
    "[this {4} is] (licensed|released|distributed) under [the terms of] the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction": "mit",
    "[this {4} is] (licensed|released|distributed) under [the terms of] the apache license [version] (2|2 0)": "apache-2",
    "licensed under the apache license version 2 0 [the license] [you may not use this file except in compliance with the license]": "apache-2",
    "[this {4} is] licensed under [a|the] (cc|creative commons) (by|attribution) (nc|noncommercial|non commercial) [{2} license]": "cc-by-nc",
    "[this {4} is] (licensed|released|distributed) under [the terms of] the gnu general public license [{6} version] [(2|3)]": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that": "bsd",
    "[this {4} is] (licensed|released|distributed) under [the terms of] the (bsd|2 clause bsd|3 clause bsd|new bsd) license": "bsd",
    "[this {4} is] (licensed|released|distributed) under [the terms of] the mozilla public license [version] (1 1|2|2 0)": "mpl",
}
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-case words; what parts them in ASCII is everything but letters and digits."""
    return raw.translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """States 0.. with word moves, any-word moves and free moves; the last state accepts."""

    moves: list[dict[bytes, set[int]]]
    any_word: list[set[int]]
    free: list[set[int]]
    needed: bytes  # a run of words that every accepted stretch holds

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for after in self.free[todo.pop()] - found:
                found.add(after)
                todo.append(after)
        return frozenset(found)

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, end) of accepted stretches: earliest start, longest from there, then onwards."""
        last, out, at = len(self.moves) - 1, [], 0
        begin = self.closed({0})
        first = {w for s in begin for w in self.moves[s]}
        while at < len(words):
            if words[at] not in first:
                at += 1
                continue
            states, end, i = begin, None, at
            while states and i < len(words):
                word = words[i]
                states = self.closed({a for s in states for a in self.moves[s].get(word, ())} | {a for s in states for a in self.any_word[s]})
                i += 1
                if last in states:
                    end = i
            if end is None:
                at += 1
            else:
                out.append((at, end))
                at = end
        return out


def compile_template(template: str) -> Automaton:
    """Build the automaton of one template."""
    tokens = re.findall(r"\{\d+\}|[\[\]()|]|[^\s\[\](){}|]+", template)
    moves: list[dict[bytes, set[int]]] = [{}]
    any_word: list[set[int]] = [set()]
    free: list[set[int]] = [set()]

    def state() -> int:
        moves.append({})
        any_word.append(set())
        free.append(set())
        return len(moves) - 1

    def sequence(at: int, now: int) -> tuple[int, int]:
        """Reads tokens from ``at`` up to a closing mark; returns (where, state reached)."""
        begin, ends = now, []
        while at < len(tokens) and tokens[at] not in ("]", ")"):
            token = tokens[at]
            if token == "|":
                ends.append(now)
                now = state()
                free[begin].add(now)
                at += 1
            elif token in ("[", "("):
                inner = state()
                free[now].add(inner)
                at, reached = sequence(at + 1, inner)
                after = state()
                free[reached].add(after)
                if token == "[":
                    free[now].add(after)
                now, at = after, at + 1
            elif token[0] == "{":
                for _ in range(int(token[1:-1])):
                    after = state()
                    any_word[now].add(after)
                    free[now].add(after)
                    now = after
                at += 1
            else:
                after = state()
                moves[now].setdefault(token.encode(), set()).add(after)
                now, at = after, at + 1
        end = state()
        for reached in [*ends, now]:
            free[reached].add(end)
        return at, end

    _, end = sequence(0, 0)
    last = state()
    free[end].add(last)
    depth, run, runs = 0, [], []
    for token in [*tokens, "("]:
        if token in "[]()|" or token[0] == "{" or depth:
            runs.append(" ".join(run))
            run = []
            depth += (token in ("[", "(")) - (token in ("]", ")"))
        else:
            run.append(token)
    return Automaton(moves, any_word, free, max(runs, key=len).encode())


class LicenseScanner:
    """Base phrases and templates over one text at a time."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases = [(compile_template(p), len(p.split()), p.encode(), label) for p, label in phrases.items()]
        self.templates = [(compile_template(t), label) for t, label in templates.items()]

    def scan(self, raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float, str]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
        words = words_of(raw)
        joined = b" " + b" ".join(words) + b" "
        places, base, labels, spans = [], set(), set(), []
        for automaton, length, text, label in self.phrases:
            if b" " + text + b" " in joined:
                first = text.split()[0]
                hits = [i for i, w in enumerate(words) if w == first and automaton.spans(words[i:i + length])[:1] == [(0, length)]]
                places += hits
                base.add(label)
        for automaton, label in self.templates:
            if b" " + automaton.needed + b" " in joined:
                found = automaton.spans(words)
                spans += [(a, b, label) for a, b in found]
                labels |= {label} if found else set()
        score = 1.0 if spans else 0.5 if base else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, ",".join(f"{label}:{a}:{b}" for a, b, label in sorted(spans))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts, first and last base place, labels, score, spans (in words)."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(phrases, templates)
        for batch in batches:
            columns = list(zip(*(scanner.scan(raw) for raw in raw_texts(batch, "text")))) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *names])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(source, scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
