"""Licence scan by a generalised suffix automaton of licence words.

The automaton holds every substring of every template. A text streams through it and gives matching statistics: at each
word the longest suffix that stands in some template. Long matches are chained, in order in both text and template,
into the spans of a template that the text covers; a template that is covered far enough gives its label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import append, documents, only
from .textnum import ALNUM, LOWER, blocks

# Phrases of which every place counts, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# The opening words of common licences and notices, as their publishers give them.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Words of a match that counts, and the share of a template that its chain has to cover.
LONG_MATCH, COVERED = 4, 0.75


@dataclass
class Automaton:
    """States with their longest length, suffix link and moves; ``ends`` are the (template, place after the last word) of a state's strings, ``complete`` the templates that end where a state's strings do."""

    longest: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    complete: list[list[int]] = field(default_factory=lambda: [[]])

    def _state(self, longest: int, moves: dict[int, int], link: int) -> int:
        self.longest.append(longest)
        self.moves.append(moves)
        self.link.append(link)
        self.ends.append([])
        return len(self.longest) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the strings of q that are no longer than p's and one word."""
        half = self._state(self.longest[p] + 1, dict(self.moves[q]), self.link[q])
        self.link[q] = half
        while p >= 0 and self.moves[p].get(word) == q:
            self.moves[p][word] = half
            p = self.link[p]
        return half

    def extend(self, last: int, word: int) -> int:
        if (q := self.moves[last].get(word)) is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, word, q)
        new = self._state(self.longest[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.moves[p]:
            self.moves[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][word]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, word, q)
        return new

    def finish(self, templates: list[list[int]]) -> None:
        """Ends of each template's prefixes, handed on to all their suffixes; and whole templates, to all that end in them."""
        for t, words in enumerate(templates):
            state = 0
            for i, w in enumerate(words):
                state = self.moves[state][w]
                self.ends[state].append((t, i + 1))
        by_length = sorted(range(1, len(self.longest)), key=self.longest.__getitem__)
        self.complete = [[] for _ in self.longest]
        for state in by_length:
            self.complete[state] = [t for t, end in self.ends[state] if end == len(templates[t])] + self.complete[self.link[state]]
        for state in reversed(by_length):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])
        self.ends = [sorted(set(x)) for x in self.ends]


class Scanner:
    """Templates as an automaton, and texts through it. ``phrases`` are templates too, of which all places count."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES, long_match: int = LONG_MATCH, share: float = COVERED) -> None:
        self.labels = [label for label, _ in [*phrases, *templates]]
        self.n_phrases, self.long_match, self.share = len(phrases), long_match, share
        texts = [text for _, text in [*phrases, *templates]]
        found = list(blocks(pa.array(texts, pa.string()), ALNUM, LOWER))
        hashes = [b.hashes[b.first[i] : b.first[i + 1]] for b in found for i in range(len(b.first) - 1)]
        self.vocabulary = np.unique(np.concatenate(hashes))
        self.templates = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.sizes = [len(t) for t in self.templates]
        self.shortest = min(self.sizes)
        self.automaton = Automaton()
        for words in self.templates:
            last = 0
            for w in words:
                last = self.automaton.extend(last, w)
        self.automaton.finish(self.templates)

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest template substring that ends at each word."""
        a, state, size, out = self.automaton, 0, 0, []
        for w in words:
            while state and w not in a.moves[state]:
                state = a.link[state]
                size = a.longest[state]
            if (to := a.moves[state].get(w)) is not None:
                state, size = to, size + 1
            out.append((size, state))
        return out

    def matches(self, words: list[int], at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Places (start, phrase) and matches (template, place in it, place in the text, words) of a run of known words that begins at ``at``.

        Matches are the longest where they stop growing, and all templates that stand whole in the run, inside longer ones too.
        """
        places, long = [], []
        stats = self.statistics(words)
        for i, (size, state) in enumerate(stats):
            for t in self.automaton.complete[state]:
                if self.sizes[t] <= size:
                    long.append((t, 0, at + i + 1 - self.sizes[t], self.sizes[t]))
                    if t < self.n_phrases:
                        places.append((at + i + 1 - self.sizes[t], t))
            grows = i + 1 < len(stats) and stats[i + 1][0] == size + 1
            if not grows and size >= min(self.long_match, self.shortest):
                for t, end in self.automaton.ends[state]:
                    if size >= min(self.long_match, self.sizes[t]):
                        long.append((t, end - size, at + i + 1 - size, size))
        return places, long

    def chained(self, long: list[tuple[int, int, int, int]]) -> dict[int, float]:
        """Share of each template covered by its best chain: matches in order in text and template, close together in the text."""
        best: dict[int, float] = {}
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for t, a, b, size in long:
            by_template.setdefault(t, []).append((b, a, size))
        for t, found in by_template.items():
            covers: list[tuple[int, int, int]] = []
            for b, a, size in sorted(set(found)):
                # Chains that ended too far back can't go on; those that are left lie within a template's length.
                covers = [c for c in covers if c[1] >= b - self.sizes[t]]
                before = max((c[2] - max(0, c[0] - a) for c in covers if c[0] - a < size and c[1] <= b + size), default=0)
                covers.append((a + size, b + size, max(before, 0) + size))
                best[t] = max(best.get(t, 0.0), min(1.0, covers[-1][2] / self.sizes[t]))
        return best

    def scan(self, texts: pa.Array) -> list[tuple]:
        """(n_words, n_base, first, last, base_labels, labels, score, spans) of each text."""
        out = []
        for b in blocks(texts, ALNUM, LOWER):
            ids = np.searchsorted(self.vocabulary, b.hashes)
            ids[ids == len(self.vocabulary)] = 0
            known = self.vocabulary[ids] == b.hashes if len(b.hashes) else np.zeros(0, dtype=bool)
            places: dict[int, list[tuple[int, int]]] = {}
            long: dict[int, list[tuple[int, int, int, int]]] = {}
            edge = np.zeros(len(known) + 1, dtype=bool)
            edge[b.first] = True
            start = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])) if len(known) else known
            stop = known & (edge[1:] | ~np.concatenate([known[1:], [False]])) if len(known) else known
            for i, j in zip(np.flatnonzero(start).tolist(), (np.flatnonzero(stop) + 1).tolist(), strict=True):
                if j - i < self.shortest:
                    continue
                d = int(np.searchsorted(b.first, i, side="right")) - 1
                p, m = self.matches(ids[i:j].tolist(), i - int(b.first[d]))
                if p:
                    places.setdefault(d, []).extend(p)
                if m:
                    long.setdefault(d, []).extend(m)
            for d, n in enumerate(b.n_words.tolist()):
                at, share = places.get(d, []), self.chained(long.get(d, []))
                base = {self.labels[t] for _, t in at}
                more = {self.labels[t] for t, s in share.items() if s >= self.share}
                starts = [s for s, _ in at]
                spans = sorted({(s, s + k, self.labels[t]) for t, _, s, k in long.get(d, []) if share[t] >= self.share})
                out.append((n, len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), max(share.values(), default=0.0), spans))
        return out


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, license_spans array<struct<low: long, high: long, label: string>>"


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``docs`` with the licences of each text.

    Adds n_words, n_base (places of the phrases), first_word and last_word (their smallest and largest start; null without
    any), base_labels and labels (distinct, sorted, joined by commas; empty without any), score (largest covered share of
    a template, 0 to 1) and license_spans (word stretches of the matches behind the labels). Words are runs of a-z, digits and
    non-ASCII with A-Z lower-cased. Null, empty and blank texts have no words and score 0. Rows are scanned alone, so
    repeats and ties do no harm; no rows give no rows. Columns of ``docs`` with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("label", pa.string())]))]

    def make(texts: pa.Array) -> list[pa.Array]:
        rows = shared.value.scan(texts)
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        columns[-1] = [[{"low": a, "high": b, "label": c} for a, b, c in x] for x in columns[-1]]
        return [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]

    return append(docs, make, _FIELDS)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and templates of each document."""
    found = scan_licenses(only(documents(spark, sf_dir), doc_id="long", text="string"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
