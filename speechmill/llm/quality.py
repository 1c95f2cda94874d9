"""Operator 12, quality: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's features are its words and word pairs, hashed to 2**20 slots, with the
value 1 + ln(count), scaled to length 1. The weights are learned in one task on a
bounded sample: of all usable labelled rows the `max_rows` of smallest hashed id,
one text each. FTRL-proximal keeps a gradient sum and a squared-gradient sum per
slot, so that every slot has its own rate and `l1` leaves rare slots at zero.
Only the weights (4 MB, fixed) reach the driver. Scoring is one pass over whole
texts, a sparse dot product each, without a shuffle.

Defined results: null text counts as the empty text, whose score is that of the
bias; unlabelled rows, null labels and null ids are never learnt from, and null
ids are not held out; an id with several labels has the largest, one with several
texts is learnt from one of them (ties do not matter); without any usable label
the score is 0.5 and `without_poor` keeps all rows; repeated rows get equal
scores; an empty table gives no rows; result columns replace columns of the same
name, other columns of any name stay.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bytes_of, mixed, slices, words_of

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: A task remembers the hashes of this many words, then starts anew (memory only).
REMEMBERED = 200_000


class Features:
    """(slots, values) of texts; one per task."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words, known = words_of(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        pairs = mixed(mixed(h[:-1]) + h[1:])
        slots, counts = np.unique(np.concatenate([mixed(h), pairs]) >> np.uint64(64 - SLOT_BITS), return_counts=True)
        values = 1 + np.log(counts)
        return slots.astype(np.int64), values / max(float(np.sqrt((values * values).sum())), 1e-9)


def chance(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, alpha: float = 3.0, beta: float = 1.0,
             l1: float = 0.02, l2: float = 0.02, epochs: int = 5, seed: int = 7) -> np.ndarray:
    """Weights of all slots, and last the bias; the same rows in the same order give the same weights."""
    rows, labels = list(rows), np.asarray(labels, dtype=np.float64)
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    if len(labels) and labels.min() == labels.max():
        bias = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
        return np.append(np.zeros(SLOTS), bias)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slots, values = np.append(rows[i][0], SLOTS), np.append(rows[i][1], 1.0)
            zi, ni = z[slots], n[slots]
            w = weights(zi, ni)
            g = (chance(w @ values) - labels[i]) * values
            z[slots] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[slots] = ni + g * g
    return weights(z, n)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, keep: Column, max_rows: int, seed: int = 3) -> DataFrame:
    """(id, label, slots, values) of at most max_rows labelled rows, the smallest by a hash of the id.

    The chosen ids are at most max_rows rows of 16 bytes, which bounds the broadcast.
    """
    usable = (labels.filter(keep & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("label")))
    chosen = usable.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_rows)
    met = (docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "label", "text"))

    def run(batches):
        features = Features()
        for part in slices(batches):
            found = [features(t) for t in bytes_of(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1),
                 pa.array([s.astype(np.int32).tobytes() + v.astype(np.float32).tobytes() for s, v in found], pa.binary())],
                names=["id", "label", "sparse"])

    return met.mapInArrow(run, "id long, label int, sparse binary").groupBy("id").agg(F.min("label").alias("label"), F.min("sparse").alias("sparse"))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> np.ndarray | None:
    """The weights, or None without any usable label."""
    def train(batches):
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        rows.sort(key=lambda r: r[0])
        if rows:
            sparse = [(np.frombuffer(x, np.int32, len(x) // 8).astype(np.int64), np.frombuffer(x, np.float32, -1, len(x) // 2)) for *_, x in rows]
            w = fit_ftrl(sparse, np.array([r[1] for r in rows])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    found = labelled_sample(docs, labels, ~held_out(), max_rows).repartition(1).mapInArrow(train, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32).astype(np.float64) if found else None


def score_quality(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.3, text_col: str = "text",
                  score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with the score and the prediction; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))

    def make():
        features, w = Features(), shared.value

        def compute(texts):
            if w is None:
                p = np.full(len(texts), 0.5)
            else:
                found = [features(t) for t in texts]
                p = chance(np.array([float(w[s] @ v) for s, v in found]) + float(w[-1]))
            return [p, (p >= threshold).astype(np.int32)]

        return compute

    return add_columns(docs, text_col, [(score, "double"), (predicted, "int")], make)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", "text")
    scored = score_quality(plain, fit_quality(plain, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier takes for good; all of them where nothing could be learnt."""
    weights = fit_quality(docs.select("doc_id", "text"), labels)
    if weights is None:
        return docs
    names = ("_quality_score", "_quality_predicted")
    while set(names) & set(docs.columns):
        names = tuple(f"_{n}" for n in names)
    return score_quality(docs, weights, score=names[0], predicted=names[1]).filter(F.col(names[1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
