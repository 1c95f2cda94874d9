"""Operator 4, benchmark decontamination: items found in texts within an edit budget.

Item and text are compared as lower-case words joined by one blank. An item of m
characters may differ by k = floor(m * rate) edits, so of its k + 1 pieces at
least one occurs unchanged (pigeonhole). One automaton finds all exact piece
hits; each gives the diagonal on which the item would lie, and Myers' bit-parallel
distance decides on the text around it.

The items are read in blocks of about `BLOCK_CHARS` characters; a block is the
only thing that is shipped whole, so memory stays bounded for any number of
items, and texts are scanned once per block without a shuffle.

Items of fewer than `min_chars` characters have no budget: they are found exactly,
where no letter or digit stands next to them.

Defined results: null or empty texts match nothing; null items and items without
a letter or digit are never matched; a repeated item or row matches as often as it
stands there; of equally good places of an item the first counts; an empty table of items gives no matches; a very long
text is scanned whole; the result column replaces one of the same name.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, parts_for, text_of, words_of

BLOCK_CHARS = 4_000_000
MATCH = "array<struct<item_id: bigint, distance: int, start: int, stop: int>>"


def plain(text: bytes) -> str:
    return b" ".join(words_of(text)).decode("utf-8", "replace")


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end): the best end in text of an occurrence of pattern.

    Anchored occurrences start at the start of text. One big integer holds a
    whole column of the distance table, whatever the length of the pattern.
    """
    m = len(pattern)
    bits, full, top = pattern_bits(pattern), (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, i
    return best, end


class ItemFinder:
    """Finds the items of one block in texts; one per task."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        self.items = [(i, t, int(len(t) * rate) if len(t) >= min_chars else 0) for i, t in items]
        self.min_chars = min_chars
        self.hits = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces_of(t, k):
                by_piece.setdefault(piece, []).append((n, offset + len(piece)))
        for piece, where in by_piece.items():
            self.hits.add_word(piece, where)
        if by_piece:
            self.hits.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, stop) of the best occurrence of each item."""
        if not len(self.hits) or not text:
            return []
        diagonals: dict[int, list[int]] = {}
        for end, where in self.hits.iter(text):
            for n, offset in where:
                diagonals.setdefault(n, []).append(end + 1 - offset)
        found = []
        for n, starts in diagonals.items():
            item_id, item, k = self.items[n]
            starts = sorted(set(starts))
            if len(item) < self.min_chars:  # a short item counts where it stands as words of its own
                at = next((s for s in starts if not (text[s - 1: s] if s else "").isalnum() and not text[s + len(item): s + len(item) + 1].isalnum()), None)
                if at is not None:
                    found.append((item_id, 0, at, at + len(item)))
                continue
            best = None
            lo = hi = starts[0]
            for s in [*starts[1:], None]:
                if s is not None and s - hi <= 2 * k + 1:
                    hi = s
                    continue
                left = max(0, lo - k)
                window = text[left: hi + len(item) + k]
                at = window.find(item)
                d, end = (0, at + len(item)) if at >= 0 else myers(item, window)
                if d <= k and (best is None or d < best[0]):
                    start = end - myers(item[::-1], window[:end][::-1][: len(item) + d], anchored=True)[1] if d else end - len(item)
                    best = (d, left + start, left + end)
                if s is not None:
                    lo = hi = s
            if best:
                found.append((item_id, *best))
        return sorted(found)


def item_blocks(items: DataFrame, id_col: str, text_col: str):
    """Normalised items (id, text), block after block of bounded size."""
    usable = items.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).filter(F.length("_text") > 0)
    blocks = parts_for(usable.agg(F.sum(F.length("_text"))).first()[0] or 0, BLOCK_CHARS)
    for b in range(blocks):
        rows = usable.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)) == b).collect()
        yield [(i, t) for i, t in sorted((r["_id"], plain(r["_text"].encode())) for r in rows if r["_id"] is not None) if any(map(str.isalnum, t))]


def benchmark_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text", rate: float = 0.05, min_chars: int = 32, column: str = "matches") -> DataFrame:
    """docs with the items found in each text: id, distance, span in the normalised text."""
    out = docs.drop(column) if column in docs.columns else docs
    names = []
    for n, block in enumerate(item_blocks(items, item_col, item_text)):
        names.append(f"_{column}_{n}")

        def make(block=block):
            finder = ItemFinder(block, rate, min_chars)
            keys = ("item_id", "distance", "start", "stop")
            return lambda texts: [[[dict(zip(keys, x)) for x in finder(plain(t))] for t in texts]]

        out = add_columns(out, text_col, [(names[-1], MATCH)], make)
    return out.withColumn(column, F.concat(*names)).drop(*names)


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it."""
    found = benchmark_matches(docs.select("doc_id", "text"), items).filter(F.size("matches") > 0)
    return found.select("doc_id", F.inline("matches"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs that hold no benchmark item (pipeline stage)."""
    leaks = "_".join(["leaks", *docs.columns])  # a name that no column has
    return benchmark_matches(docs, items, column=leaks).filter(F.size(leaks) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
