"""Operator 10, toxicity: a factorization machine over hashed terms.

A document's terms are its distinct words and their prefixes, hashed to 2**26
slots. The machine adds a weight per term and, for each pair of terms present,
the product of their factors, so that two harmless terms can be toxic together.
It is fitted in one task on a bounded sample: of all usable labelled rows the
`max_rows` of smallest hashed id, one text each. Every term of at least
`min_rows` of them is a feature, whatever its label. Weights follow the
regularised leader, which leaves those without a steady gradient at zero; factors
take steps at a rate of their own. Only the model (some 10**5 terms) reaches the
driver. Scoring covers every whole text in one pass without a shuffle.

Defined results: null text counts as the empty text, which gets the bias;
unlabelled rows, null labels and null ids are never learnt from; an id with
several labels has the largest, one with several texts is learnt from one of them;
without any usable label the score is 0.5; without labels of both kinds nothing is
learnt, and the pipeline stage keeps all rows; ties do not matter; repeated rows
get equal scores; an empty table gives no rows; result columns replace columns of
the same name, other columns of any name stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bytes_of, slices, words_of

TERM_BITS = 26
PREFIXES = (4, 5, 6)
#: A task remembers the terms of this many words, then starts anew (memory only).
REMEMBERED = 200_000


def terms_of(word: bytes) -> list[int]:
    """Hashed slots of a word and its prefixes."""
    keys = [b"w" + word]
    text = word.decode("utf-8", "replace")
    keys += [b"p" + text[:n].encode() for n in PREFIXES if len(text) >= n]
    return [xxhash.xxh3_64_intdigest(k) >> (64 - TERM_BITS) for k in keys]


@dataclass
class FactorModel:
    slots: np.ndarray  # sorted hashed slots of the features
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # features x rank

    @property
    def learnt(self) -> bool:
        return len(self.slots) > 0

    def score_rows(self, present: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for rows given as arrays of feature numbers."""
        out = np.array([margin(self.bias, self.weights[f], self.factors[f])[0] for f in present])
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def margin(bias: float, weights: np.ndarray, factors: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the weights and of the products of all pairs of factors, scaled by the
    number of terms; with it the scaled factors and their sum."""
    v = factors / np.sqrt(max(len(factors), 1))
    s = v.sum(axis=0)
    return bias + float(weights.sum()) + 0.5 * float(s @ s - (v * v).sum()), v, s


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, rank: int = 4, epochs: int = 5, alpha: float = 0.5, l1: float = 3.0,
                l2: float = 1.0, rate: float = 0.2, decay: float = 1e-3, spread: float = 0.05, min_rows: int = 5, seed: int = 7) -> FactorModel:
    """Logistic loss, one step per row; the same rows in the same order give the same model."""
    labels = np.asarray(labels, dtype=np.float64)
    n, p = len(labels), float(labels.sum())
    if n == 0 or p == 0 or p == n:
        bias = float(np.log((p + 0.5) / (n - p + 0.5)))
        return FactorModel(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, rank)))
    every, counts = np.unique(np.concatenate(rows), return_counts=True)
    slots = every[counts >= min_rows]
    m = len(slots)
    held = []
    for r in rows:
        at = np.minimum(np.searchsorted(slots, r), max(m - 1, 0))
        held.append(at[slots[at] == r] if m else np.zeros(0, np.int64))
    rng = np.random.default_rng(seed)
    z, squares = np.zeros(m), np.zeros(m)
    factors, steps = rng.normal(0, spread, (m, rank)), np.ones(m)
    bias, bias_steps = float(np.log(p / (n - p))), 1.0

    def weights_of(z: np.ndarray, squares: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((1 + np.sqrt(squares)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(n):
            f = held[i]
            w, q = weights_of(z[f], squares[f]), squares[f]
            x, v, s = margin(bias, w, factors[f])
            g = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - labels[i]
            bias_steps += g * g
            bias -= 0.1 * g / np.sqrt(bias_steps)
            if len(f):
                z[f] += g - (np.sqrt(q + g * g) - np.sqrt(q)) / alpha * w
                squares[f] = q + g * g
                d = g / np.sqrt(len(f)) * (s - v) + decay * factors[f]
                steps[f] += (d * d).sum(axis=1)
                factors[f] -= rate * d / np.sqrt(steps[f])[:, None]
    return FactorModel(slots.astype(np.int64), bias, weights_of(z, squares), factors)


def labelled_terms(docs: DataFrame, labels: DataFrame, keep: Column, max_rows: int, seed: int = 1) -> DataFrame:
    """(id, label, slots) of at most max_rows labelled rows, the smallest by a hash of the id.

    The chosen ids are at most max_rows rows of 16 bytes, which bounds the broadcast.
    """
    usable = (labels.filter(keep & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label")))
    chosen = usable.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_rows)
    met = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "label", "text")

    def run(batches):
        for part in slices(batches, 64):
            found = []
            for text in bytes_of(part.column(2)):
                slots = [t for w in set(words_of(text)) for t in terms_of(w)]
                found.append(np.unique(np.array(slots, dtype=np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["id", "label", "slots"])

    return met.mapInArrow(run, "id long, label int, slots binary").groupBy("id").agg(F.min("label").alias("label"), F.min("slots").alias("slots"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> FactorModel:
    """The machine fitted on labelled rows that are not held out."""
    def train(batches):
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        if rows:
            rows.sort(key=lambda r: r[0])
            model = fit_machine([np.frombuffer(r[2], dtype=np.uint32) for r in rows], np.array([r[1] for r in rows]))
            parts = [model.slots.astype(np.int64), np.float64(model.bias), model.weights.astype(np.float32), model.factors.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["slots", "bias", "weights", "factors"])

    found = (labelled_terms(docs, labels, ~held_out(), max_rows).repartition(1)
             .mapInArrow(train, "slots binary, bias binary, weights binary, factors binary").collect())
    if not found:
        return fit_machine([], np.zeros(0))
    slots, bias, weights, factors = (np.frombuffer(x, kind) for x, kind in zip(found[0], (np.int64, np.float64, np.float32, np.float32)))
    return FactorModel(slots, float(bias[0]), weights, factors.reshape(len(slots), -1) if len(slots) else np.zeros((0, 1)))


def score_toxicity(docs: DataFrame, model: FactorModel, threshold: float = 0.3,
                   score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with the score and the prediction; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known: dict[bytes, tuple[int, ...]] = {}
        machine = shared.value
        numbers = {s: i for i, s in enumerate(machine.slots.tolist())}

        def compute(texts):
            present = []
            for text in texts:
                found: set[int] = set()
                for w in set(words_of(text)):
                    f = known.get(w)
                    if f is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        f = known[w] = tuple(numbers[t] for t in terms_of(w) if t in numbers)
                    if f:
                        found.update(f)
                present.append(np.array(sorted(found), dtype=np.int64))
            p = machine.score_rows(present)
            return [p, (p >= threshold).astype(np.int32)]

        return compute

    return add_columns(docs, "text", [(score, "double"), (predicted, "int")], make)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the machine does not reject (pipeline stage); all of them where nothing could be learnt."""
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    if not model.learnt:
        return docs
    names = ("_tox_score", "_tox_predicted")
    while set(names) & set(docs.columns):
        names = tuple(f"_{n}" for n in names)
    return score_toxicity(docs, model, score=names[0], predicted=names[1]).filter(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
