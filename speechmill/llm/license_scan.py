"""Operator 5, license scans: which license notices a text holds, and where.

Notices and texts become words without their outer punctuation. Winnowing keeps
the smallest hash of every few word triples of a notice, and all word pairs of a
short one; an inverted index of these fingerprints picks candidate notices and diagonals in a text, and an
alignment in a band around each diagonal gives the share of the notice's words
found in order, and the span they cover.

The templates are a parameter of bounded size (each task holds them all); the
texts are scanned whole, in one pass without a shuffle.

Defined results: null and empty texts have no findings; empty templates are never
found, templates shorter than a pair are one fingerprint; of notices that overlap
the one with most matched words is reported (a short notice inside a long one is
part of it), of ties the better covered, then the first; repeated rows get equal
findings; an empty table gives no rows; the result column replaces one of the same
name.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, words_of

GRAM = 3
WINDOW = 3
#: Notices of fewer words are looked for by all their word pairs.
SHORT = 12
BAND = 12
REMEMBERED = 200_000
EDGES = b"\"'`.,;:!?()[]{}<>*#/|-_\xe2\x80\x9c\xe2\x80\x9d"
FOUND = "array<struct<license: string, coverage: double, start: int, stop: int, matched: int>>"

#: Public notices that name a license.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normal_word(word: bytes) -> bytes:
    return word.strip(EDGES)


def gram_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` word numbers."""
    n = len(ids) - width + 1
    h = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(width):
        h = h * 1_000_003 + ids[k: k + n]
    return h


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Positions of the smallest hash in each window, the rightmost of equal ones."""
    kept: list[int] = []
    for start in range(max(1, len(hashes) - window + 1)):
        part = hashes[start: start + window]
        at = start + len(part) - 1 - int(np.argmin(part[::-1]))
        if not kept or kept[-1] != at:
            kept.append(at)
    return kept if len(hashes) else []


def align(template: np.ndarray, words: np.ndarray, offset: int) -> tuple[int, int, int]:
    """(matched words, start, stop) of the best alignment in a band.

    Cell (i, j): the i-th template word against text position offset + i + j.
    A match adds 2, a word left out on either side takes 1; the template may be
    cut at both ends, which costs only its own words.
    """
    width = 2 * BAND + 1
    none = (0, 0, -1, -1)  # score, matches, start, stop
    above = [none] * width
    best = none
    for i, t in enumerate(template):
        row = [none] * width
        for j in range(width):
            at = offset + i + j - BAND
            options = [none]
            if j + 1 < width and above[j + 1][0] > 1:  # template word left out
                s, m, a, z = above[j + 1]
                options.append((s - 1, m, a, z))
            if j and row[j - 1][0] > 1:  # text word left out
                s, m, a, z = row[j - 1]
                options.append((s - 1, m, a, z))
            if 0 <= at < len(words):
                s, m, a, z = above[j]
                if words[at] == t:
                    options.append((s + 2, m + 1, at if a < 0 else a, at + 1))
                elif s > 1:
                    options.append((s - 1, m, a, z))
            row[j] = max(options, key=lambda x: x[:2])
            if row[j][:2] > best[:2]:
                best = row[j]
        above = row
    return best[1:]


class NoticeFinder:
    def __init__(self, templates: Mapping[str, str], min_coverage: float):
        self.min_coverage = min_coverage
        self.numbers: dict[bytes, int] = {}
        self.templates: list[tuple[str, np.ndarray, int]] = []
        self.index: dict[int, list[tuple[int, int]]] = {}
        for name in sorted(templates):
            words = [w for w in map(normal_word, words_of(templates[name].encode())) if w]
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], dtype=np.int64)
            width = min(GRAM if len(ids) >= SHORT else GRAM - 1, len(ids))
            if not width:
                continue
            hashes = gram_hashes(ids, width)
            # one changed word takes away most triples of a short notice: all its pairs count
            kept = winnow(hashes, WINDOW) if len(ids) >= SHORT else list(range(len(hashes)))
            for at in kept:
                self.index.setdefault((width, int(hashes[at])), []).append((len(self.templates), at))
            self.templates.append((name, ids, len(kept)))
        self.widths = sorted({w for w, _ in self.index})
        self.keys = {w: np.array(sorted(h for w2, h in self.index if w2 == w), dtype=np.int64) for w in self.widths}
        self.known: dict[bytes, int] = {}

    def word_ids(self, text: bytes) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        words = words_of(text)
        for w in words:
            if w not in known:
                known[w] = self.numbers.get(normal_word(w), 0)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def notices(self, t: int, ids: np.ndarray, hits: dict[int, list[tuple[int, int]]]) -> list[dict]:
        """All notices of a template; the words of each are masked before the next is looked for."""
        name, template, kept = self.templates[t]
        found, left = [], ids.copy()
        order = sorted(hits)
        n = 0
        while n < len(order):
            diagonal = order[n]
            near = sum(len(hits.get(diagonal + d, ())) for d in range(-BAND, BAND + 1))
            if not hits[diagonal] or near * 4 < kept:
                n += 1
                continue
            best = align(template, left, diagonal)
            if best[0] / len(template) < self.min_coverage:
                n += 1
                continue
            for other in order[n + 1:]:  # a band further on may hold more of the same notice
                if other >= best[2] or other - diagonal > 2 * BAND or best[0] == len(template):
                    break
                if hits[other] and (more := align(template, left, other))[1] == best[1] and more[0] > best[0]:
                    best = more
            matched, start, stop = best
            found.append({"license": name, "coverage": matched / len(template), "start": start, "stop": stop, "matched": matched})
            left[start:stop] = 0
            for d in range(start - len(template), stop):
                if d in hits:
                    hits[d] = [x for x in hits[d] if x[0] < start or x[1] > stop]
        return found

    def __call__(self, text: bytes) -> list[dict]:
        ids = self.word_ids(text)
        hits: dict[int, dict[int, list[tuple[int, int]]]] = {}  # per template and diagonal, the text words of each fingerprint
        for width in self.widths:
            whole = np.ones(max(len(ids) - width + 1, 0), dtype=bool)
            for k in range(width):
                whole &= ids[k: k + len(whole)] > 0
            places = np.flatnonzero(whole)
            if not len(places):
                continue
            hashes = gram_hashes(ids, width)[places]
            for at, h in zip(places[np.isin(hashes, self.keys[width])].tolist(), hashes[np.isin(hashes, self.keys[width])].tolist()):
                for t, offset in self.index[width, h]:
                    hits.setdefault(t, {}).setdefault(at - offset, []).append((at, at + width))
        found = [f for t in sorted(hits) for f in self.notices(t, ids, hits[t])]
        kept_findings: list[dict] = []  # of findings that overlap, the one with most matched words stays
        for f in sorted(found, key=lambda f: (-f["matched"], -f["coverage"], f["start"], f["license"])):
            if all(f["stop"] <= k["start"] or k["stop"] <= f["start"] for k in kept_findings):
                kept_findings.append(f)
        return sorted(kept_findings, key=lambda f: f["start"])


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: Mapping[str, str] = TEMPLATES,
                  min_coverage: float = 0.8, column: str = "licenses") -> DataFrame:
    """docs with the notices found: name, coverage, span in words."""
    templates = dict(templates)

    def make():
        finder = NoticeFinder(templates, min_coverage)
        return lambda texts: [[finder(t) for t in texts]]

    return add_columns(docs, text_col, [(column, FOUND)], make)


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document and notice found in it."""
    return scan_licenses(docs.select("doc_id", "text")).filter(F.size("licenses") > 0).select("doc_id", F.inline("licenses"))
