"""Operator 9: licence scan with a generalised suffix automaton.

The automaton is built over the words of a few licence templates (phrases,
notices, licence texts).  Each file is streamed once: words outside the
templates' vocabulary send it to the start state, so only runs of known words
are walked, giving for every word the length of the longest template substring
that ends there (matching statistics).  Base phrases are read off the states:
every state knows which phrases are suffixes of what it has read.  Matches that
cannot be extended and have MIN_MATCH words or more are chained per template, in
the order of both text and template, with gaps of at most MAX_GAP words; a chain
that covers MIN_COVER of its template adds the template's label and a span.

The automaton is built from constants (under a thousand words), so each worker
builds its own; nothing is shuffled.

Defined results: a null or empty text has no words, no label and score 0;
repeated rows each get their result; very long texts are streamed in one pass;
other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prlens.llm.common import documents, map_batches, table
from prlens.llm.registry import register
from prlens.llm.words import alnum_words

# Base phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Notices and opening paragraphs of public licences, and their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]

MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.7


class SuffixAutomaton:
    """Generalised suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for t, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, at)
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            for t, at in self.ends[v].items():
                up = self.ends[self.link[v]]
                up[t] = min(at, up.get(t, at))

    def _state(self, length: int, like: int | None = None) -> int:
        self.len.append(length)
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.ends.append({})
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of exactly the strings read through p and w."""
        copy = self._state(self.len[p] + 1, q)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.len[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state and matched length after reading one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    def __init__(self, phrases, templates):
        texts = [(p.encode().split(), label) for p, label in [*phrases, *templates]]
        vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t, _ in texts for w in t))}
        self.known = vocabulary.get
        self.labels = [label for _, label in texts]
        self.sizes = [len(t) for t, _ in texts]
        #: Words that a run needs to hold a phrase or a match.
        self.shortest = min([MIN_MATCH, *self.sizes[:len(phrases)]])
        coded = [[vocabulary[w] for w in t] for t, _ in texts]
        self.machine = m = SuffixAutomaton(coded)
        own: dict[int, list[tuple[int, str]]] = {}
        for seq, (_, label) in zip(coded, phrases, strict=False):
            state = 0
            for w in seq:
                state = m.next[state][w]
            own.setdefault(state, []).append((len(seq), label))
        #: By state: the phrases (length, label) that are suffixes of its strings.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in m.len]
        for v in sorted(range(1, len(m.len)), key=m.len.__getitem__):
            self.phrases[v] = own.get(v, []) + self.phrases[m.link[v]]

    def scan(self, words: list[bytes]):
        """(base places [(start, label)], spans [(label, first, last, cover)], score)."""
        ids = np.fromiter((self.known(w, 0) for w in words), np.int32, len(words))
        edge = np.flatnonzero(np.diff(ids != 0, prepend=False, append=False))
        base, matches, step = [], [], self.machine.step
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = length = 0
            for at, w in enumerate(ids[a:b].tolist(), a):
                before = state, length
                state, length = step(state, length, w)
                if before[1] >= MIN_MATCH and length <= before[1]:
                    matches.append((at - before[1], *before))
                for n, label in self.phrases[state]:
                    if length >= n:
                        base.append((at - n + 1, label))
            if length >= MIN_MATCH:
                matches.append((b - length, state, length))
        spans, best = self._chains(matches)
        return base, spans, 1.0 if base else best

    def _chains(self, matches):
        open_: dict[int, list] = {}
        spans, best = [], 0.0

        def close(t):
            nonlocal best
            first, last, _, covered = open_.pop(t)
            share = min(1.0, covered / self.sizes[t])
            best = max(best, share)
            if share >= MIN_COVER:
                spans.append((self.labels[t], first, last, share))

        for start, state, length in sorted(matches):
            for t, end in self.machine.ends[state].items():
                begin = end - length + 1
                if t in open_:
                    first, last, upto, covered = open_[t]
                    shift = max(0, upto + 1 - begin, last + 1 - start)
                    if shift < length and start - last <= MAX_GAP + 1:
                        open_[t] = [first, start + length - 1, end, covered + length - shift]
                        continue
                    if shift >= length and start <= last:
                        continue
                    close(t)
                open_[t] = [start, start + length - 1, end, length]
        for t in list(open_):
            close(t)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0])), best


@functools.cache
def scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, "
          "spans array<struct<label:string,first:long,last:long,cover:double>>")
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                            ("cover", pa.float64())]))


def _scan(batches):
    s = scanner()
    for batch in batches:
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                               "spans")}
        for text in batch.column("text"):
            words = alnum_words(text.as_py())
            base, spans, score = s.scan(words)
            labels = sorted({label for _, label in base})
            starts = [at for at, _ in base]
            row = (len(words), len(base), min(starts, default=None), max(starts, default=None), labels,
                   sorted({*labels, *(x[0] for x in spans)}), score,
                   [dict(zip(("label", "first", "last", "cover"), x, strict=True)) for x in spans])
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        kinds = dict.fromkeys(("n_words", "n_base", "first_word", "last_word"), pa.int64()) | {
            "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(),
            "spans": _SPAN}
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds[k]) for k, v in out.items()})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels and labels (sorted arrays), score (largest share of a template
    covered; 1 with a base phrase), spans."""
    return map_batches(documents(docs), _scan, SCHEMA)


@register("op9_license_scan")
def q_license_scan(spark, sf_dir):
    """Operator 9 over all documents."""
    return scan_licenses(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "array_join(base_labels, ',') AS base_labels",
        "array_join(labels, ',') AS labels", "score", "size(spans) AS n_spans")
