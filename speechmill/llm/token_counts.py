"""Operator 6, token counts: the best unigram segmentation, counted and not kept.

An Aho-Corasick automaton enumerates the vocabulary's matches in a unit of text;
dynamic programming carries the best score and its number of pieces to each
position. Ties go to the piece that starts first, as in the public tokenizer
(which replaces a best path only by a strictly better one); a character without a
piece of its own costs its fixed penalty and counts its UTF-8 bytes. Scores are
summed exactly per unit and then per text, where the public tokenizer's single
precision starts to round beyond 2**24.

Defined results: null and empty texts have no tokens and score 0; repeated rows
get equal counts; an empty table gives no rows; very long texts are counted
whole; result columns replace columns of the same name.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import add_columns
from .pieces import DEFAULT_MODEL, Layout, Vocabulary, model_bytes, units_of

#: Units that a task remembers before it starts anew (memory only).
REMEMBERED = 500_000


class Counter:
    """Counts and scores of units, each as one complex number count + score * i."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary.ids))
        self.lengths = np.array([len(t) for t in vocabulary.pieces])
        self.scores = np.append(np.full(len(vocabulary.pieces), -np.inf), -np.inf)  # the last one, at -1, is of no piece
        for t, i in vocabulary.ids.items():
            self.scores[i] = vocabulary.scores[t]
        self.known: dict[str, complex] = {}

    def add(self, units: list[str]) -> None:
        """The best segmentations of new units, one position of all units after another."""
        at = Layout.of(units)
        joined = at.escaped.tobytes().decode("utf-32-le", "surrogatepass")
        found = np.fromiter((end << 20 | i for end, i in self.vocabulary.automaton.iter(joined)), dtype=np.int64)
        end, piece = found >> 20, found & 0xFFFFF
        size = self.lengths[piece]
        score = np.full((len(at.codes), min(self.longest, int(at.lengths.max()))), -np.inf)
        score[end, size - 1] = self.scores[piece]
        pieces = np.ones(len(at.codes), dtype=np.int64)  # of a step of one character
        lone = np.flatnonzero((score[:, 0] == -np.inf) & (at.depth > 0))
        score[lone, 0] = self.vocabulary.unknown_score
        code = at.codes[lone]
        pieces[lone] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        best, count = np.zeros(len(at.codes)), np.zeros(len(at.codes), dtype=np.int64)
        for depth, node in enumerate(at.by_depth(), 1):
            k = min(depth, score.shape[1])
            back = np.arange(k, 0, -1)  # the earliest start first: it wins ties
            ways = best[node[:, None] - back] + score[node[:, None], back - 1]
            step = back[ways.argmax(axis=1)]
            best[node] = ways.max(axis=1)
            count[node] = count[node - step] + np.where(step == 1, pieces[node], 1)
        last = at.first + at.lengths
        self.known.update(zip(units, (count[last] + 1j * best[last]).tolist()))

    def __call__(self, texts: list[str]) -> tuple[list[int], list[float]]:
        """(tokens, score) of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, units = self.known, [units_of(t) for t in texts]
        if new := sorted({u for u in chain.from_iterable(units) if u not in known}):
            self.add(new)
        sums = [sum(map(known.__getitem__, own), 0j) for own in units]
        return [int(s.real) for s in sums], [s.imag + 0.0 for s in sums]


def count_tokens(docs: DataFrame, text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """docs with n_tokens and token_score; one pass, no shuffle."""
    model = model_bytes(model_path)

    def make():
        counter = Counter(Vocabulary(model))
        return lambda texts: list(counter([t.decode("utf-8", "replace") for t in texts]))

    return add_columns(docs, text_col, [("n_tokens", "long"), ("token_score", "double")], make)


def token_report(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text")).drop("text")
