"""Operator 3, document fingerprints: minimum hashes of Lempel-Ziv phrases.

A text is parsed into dictionary phrases: the next phrase is the shortest piece
not seen before. The set of phrases, as hashes, describes what a compressor would
learn from the text; the fingerprint is the `SKETCH` smallest of them, and the
likeness of two fingerprints estimates the Jaccard similarity of the phrase sets
(exactly, where both texts have at most that many phrases).

Neighbours in id order are brought together by one shuffle of the texts into
blocks of ids; the first text of each block is copied to the block before it.

Defined results: null and empty texts have the empty fingerprint, which is like
itself (1) and unlike all others (0); rows with one id follow in text order; rows
with a null id come last; one row alone is its own neighbour; an empty table
gives no rows; very long texts are parsed whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import add_columns, bytes_of, mixed, slices, text_of

SKETCH = 128
#: Ids per block, and blocks per group of blocks, as powers of two.
BLOCK_BITS = 10
_BASE = 0x9E3779B97F4A7C15


def parse(text: str, seen: set[str] | None = None) -> tuple[list[int], set[str]]:
    """(ends of the phrases, all phrases); what is left at the end repeats a phrase."""
    seen = set() if seen is None else seen
    sizes, w = [], ""
    add, note = seen.add, sizes.append
    for c in text:
        w += c
        if w not in seen:
            add(w)
            note(len(w))
            w = ""
    return list(accumulate(sizes)), seen


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """A 32-bit hash per phrase, by powers of a base over the whole text at once."""
    if not ends:
        return np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer(text[: ends[-1]].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.array([0, *ends[:-1]])
    sizes = np.array(ends) - starts
    power = np.full(int(sizes.max()), _BASE, dtype=np.uint64)
    power = np.multiply.accumulate(power)
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    return (mixed(np.add.reduceat(codes * power[place], starts)) >> np.uint64(32)).astype(np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:SKETCH]


def spelled(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of the union that both sketches hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(union, a, assume_unique=True) @ np.isin(union, b, assume_unique=True).astype(np.int64)) / len(union)


def fingerprint(docs: DataFrame, text_col: str = "text", column: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text; no shuffle."""
    def make():
        def one(text):
            t = text.decode("utf-8", "replace")
            return spelled(sketch(phrase_hashes(t, parse(t)[0])))

        return lambda texts: [[one(t) for t in texts]]

    return add_columns(docs, text_col, [(column, "string")], make)


class Parsed:
    """A text with its parse, from which that of an edited text starts."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.ends, self.seen = parse(text)
        self.sketch = sketch(phrase_hashes(text, self.ends))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The last third replaced by as much of the next text; and its sketch.

        The phrases that end before the change stay; only the rest is parsed anew.
        """
        third = len(self.text) // 3
        cut = len(self.text) - third
        changed = self.text[:cut] + following[:third]
        kept = bisect_right(self.ends, cut)
        base = self.ends[kept - 1] if kept else 0
        self.seen.difference_update(self.text[a:b] for a, b in zip([base, *self.ends[kept:]], self.ends[kept:]))
        more, _ = parse(changed[base:], self.seen)
        return changed, sketch(phrase_hashes(changed, self.ends[:kept] + [base + e for e in more]))


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, halo, doc_id, text): every text in its block of ids, and the first
    text of the following block, in descending order, once more as halo."""
    rows = docs.select("doc_id", text_of("text").alias("text"), F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.lit(-(1 << 62))).alias("block"))
    heads = rows.groupBy("block").agg(F.max_by(F.struct("doc_id", "text"), F.struct(F.coalesce("doc_id", F.lit(-(1 << 62))), "text")).alias("head"))
    groups = heads.select("block", F.shiftright("block", BLOCK_BITS).alias("many"))
    # the block below, first inside a group of blocks, then from the group below, then around
    tops = groups.groupBy("many").agg(F.max("block").alias("top"))
    below = tops.withColumn("under", F.lag("top").over(W.orderBy("many")))
    around = tops.agg(F.max("top")).scalar()  # one value
    near = groups.withColumn("lower", F.lag("block").over(W.partitionBy("many").orderBy("block")))
    next_block = near.join(below.select("many", "under"), "many").select(
        F.col("block").alias("asks"), F.coalesce(F.col("lower"), F.col("under"), around).alias("block"))
    halo = heads.join(next_block, "block").select(
        F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), F.col("asks").alias("block"), F.lit(True).alias("halo"))
    return rows.withColumn("halo", F.lit(False)).unionByName(halo).select("block", "halo", "doc_id", "text")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses."""
    def run(batches):
        block, before = None, None
        for part in slices(batches):
            out = []
            for at, doc_id, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), bytes_of(part.column(3)), strict=True):
                now = Parsed(doc_id, text.decode("utf-8", "replace"))
                if at == block:
                    changed, sketched = before.edited(now.text)
                    out.append((before.doc_id, len(before.text), hashlib.sha256(changed.encode()).hexdigest(), spelled(before.sketch),
                                spelled(sketched), likeness(before.sketch, sketched), likeness(before.sketch, now.sketch)))
                block, before = at, now
            names = [f.split()[0] for f in RESULT.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    blocks = in_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    placed = blocks.repartition("block").sortWithinPartitions(F.col("block"), F.col("halo"), F.desc_nulls_last("doc_id"), F.desc("text"))
    return placed.mapInArrow(run, RESULT)
