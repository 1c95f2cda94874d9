"""Operator 1, SentencePiece encoding and decoding: sampled segmentations.

Forward filtering sums the weight of all segmentations up to each position of a
unit's piece lattice; backward sampling then draws pieces from the end, each in
proportion to the weight of the paths through it. Draws are hashes of the row
key, the unit's place and the step, so a retried task repeats them. Decoding any
draw gives back the text, byte for byte.

A piece weighs exp(sharpness * log-probability). A vocabulary of merge ranks has
no probabilities; there the rank r counts as a Zipf probability 1 / (r + 2).

All units of a slice of texts are drawn together, one step of every unit at a
time, on arrays. Defined results: null and empty texts have no pieces and decode
to the empty text; rows with equal key and text get equal pieces; a null key is a
key of its own; an empty table gives no rows; very long texts are encoded whole;
result columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import bytes_of, mixed, slices
from .pieces import DEFAULT_MODEL, Layout, Vocabulary, model_bytes, units_of

#: Lattice edges that a task remembers before it starts anew (memory only).
REMEMBERED_EDGES = 6_000_000
#: Added to a log-probability per character, so that sums stay near 1; it cancels out.
PER_CHARACTER = 4.0


def is_ranked(scores: list[float]) -> bool:
    """Whether scores are minus the rank of a merge, not log-probabilities."""
    plain = [s for s in scores if s > -1e8]
    return len(plain) > 1 and all(s == round(s) for s in plain) and len(set(plain)) == len(plain)


def log_weights(vocabulary: Vocabulary, sharpness: float) -> dict[int, float]:
    ranked = is_ranked(list(vocabulary.scores.values()))
    return {vocabulary.ids[t]: sharpness * (-math.log(2.0 - s) if ranked else s) for t, s in vocabulary.scores.items()}


class PieceTable:
    """Pieces by the hash of their characters, an open hash table in arrays."""

    BITS = 18

    def __init__(self, vocabulary: Vocabulary):
        self.longest = max(map(len, vocabulary.ids))
        self.hashes = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.ids = np.full(1 << self.BITS, -1, dtype=np.int32)
        for t, i in vocabulary.ids.items():
            h = self.start(1)
            for c in t:
                h = self.extend(h, np.array([ord(c)], dtype=np.uint64))
            at = int(h[0]) >> 64 - self.BITS
            while self.ids[at] >= 0:
                if self.hashes[at] == h[0]:
                    raise ValueError("two pieces have one hash")
                at = (at + 1) % len(self.ids)
            self.hashes[at], self.ids[at] = h[0], i

    @staticmethod
    def start(n: int) -> np.ndarray:
        return np.full(n, 0x243F6A8885A308D3, dtype=np.uint64)

    @staticmethod
    def extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ h >> np.uint64(29)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 where there is no piece."""
        at = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.hashes[at] == h, self.ids[at], -1)
        todo = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.ids)
            same = self.hashes[at[todo]] == h[todo]
            out[todo[same]] = self.ids[at[todo[same]]]
            todo = todo[~same & (self.ids[at[todo]] >= 0)]
        return out


class Lattices:
    """Lattices of the units seen so far, as arrays for backward sampling.

    Nodes are numbered through all units. The edges into a node lie side by side
    from ``first_edge`` (-1 for the start of a unit). An edge is one number: the
    summed probability of the node's edges so far (32 bits), how far back it
    starts (10 bits), and its piece, or the number of pieces plus the character
    where that is unknown (22 bits).
    """

    def __init__(self, vocabulary: Vocabulary, weights: dict[int, float]):
        self.vocabulary = vocabulary
        self.weights = np.zeros(len(vocabulary.pieces) + 1)  # the last one, at -1, is of no piece
        for i, w in weights.items():
            self.weights[i] = math.exp(w + PER_CHARACTER * len(vocabulary.pieces[i]))
        self.table = PieceTable(vocabulary)
        self.clear()

    def clear(self) -> None:
        self.last_node: dict[str, int] = {}
        self.edges = np.zeros(0, np.uint64)
        self.first_edge = np.zeros(0, np.int32)

    def add(self, units: list[str]) -> None:
        """Forward filtering of new units, one position of all units after another.

        Column k of a table is for pieces of k + 1 characters that end at a node.
        """
        at = Layout.of(units)
        n, longest = len(at.codes), min(self.table.longest, int(at.lengths.max()))
        left = np.repeat(at.lengths, at.lengths + 1) - at.depth  # characters behind this one
        escaped = at.escaped.astype(np.uint64)
        piece = np.full((n, longest), -1, dtype=np.int32)
        start = np.flatnonzero(at.depth)
        h = self.table.start(len(start))
        for k in range(longest):
            inside = left[start] >= k
            start, h = start[inside], h[inside]
            h = self.table.extend(h, escaped[start + k])
            piece[start + k, k] = self.table.find(h)
        weight = self.weights[piece]
        lone = np.flatnonzero((piece[:, 0] < 0) & (at.depth > 0))
        piece[lone, 0] = len(self.vocabulary.pieces) + at.codes[lone].astype(np.int32)
        weight[lone, 0] = 1.0
        # total: weight of all ways to a node; chance: share of each edge in it
        total, chance = (at.depth == 0).astype(float), np.zeros((n, longest))
        back = np.arange(1, longest + 1)
        for d, node in enumerate(at.by_depth(), 1):
            k = min(d, longest)
            ways = total[node[:, None] - back[:k]] * weight[node, :k]
            whole = ways.sum(axis=1)
            total[node] = whole
            chance[node, :k] = ways / whole[:, None]
            if d % longest == 0:  # only ratios within reach of a piece matter from here on
                total[node[:, None] - back + 1] /= whole[:, None]
        end, k = np.nonzero(piece != -1)
        heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        sizes = np.diff(np.append(heads, len(end)))
        chance = chance[end, k]
        summed = np.cumsum(chance)
        within = np.clip((summed - np.repeat(summed[heads] - chance[heads], sizes)) * 2.0 ** 32, 0, 2 ** 32 - 1).astype(np.uint64)
        within[heads + sizes - 1] = 2 ** 32 - 1
        first_edge = np.full(n, -1, dtype=np.int32)
        first_edge[end[heads]] = len(self.edges) + heads
        self.last_node.update(zip(units, (len(self.first_edge) + at.first + at.lengths).tolist()))
        self.first_edge = np.concatenate([self.first_edge, first_edge])
        edges = within << np.uint64(32) | (k + 1).astype(np.uint64) << np.uint64(22) | piece[end, k].astype(np.uint64)
        self.edges = np.concatenate([self.edges, edges])

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all texts, number of pieces of each text)."""
        if len(self.edges) > REMEMBERED_EDGES:
            self.clear()
        known = self.last_node
        units = [units_of(t) for t in texts]
        if new := sorted({u for u in chain.from_iterable(units) if u not in known}):
            self.add(new)
        n_units = np.array([len(u) for u in units], dtype=np.int64)
        node = np.fromiter(map(known.__getitem__, chain.from_iterable(units)), dtype=np.int64, count=int(n_units.sum()))
        place = np.arange(len(node)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
        key = mixed(np.repeat(seeds, n_units) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        active, steps, drawn = np.arange(len(node)), np.zeros(len(node), dtype=np.int64), []
        first = self.first_edge[node]
        while len(active):
            u = np.minimum(mixed(key[active] + np.uint64(len(drawn) + 1)) >> np.uint64(32), np.uint64(2 ** 32 - 2)) << np.uint64(32)
            edge = self.edges[first]
            beyond = np.flatnonzero(edge < u)
            while len(beyond):
                first[beyond] += 1
                edge[beyond] = self.edges[first[beyond]]
                beyond = beyond[edge[beyond] < u[beyond]]
            drawn.append((active, (edge & np.uint64(0x3FFFFF)).astype(np.int32)))
            steps[active] += 1
            here = node[active] - (edge >> np.uint64(22) & np.uint64(0x3FF)).astype(np.int64)
            node[active] = here
            first = self.first_edge[here]
            more = first >= 0
            active, first = active[more], first[more]
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for step, (who, piece) in enumerate(drawn, 1):
            out[ends[who] - step] = piece
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_units)])]
        return self.spelled(out, ends)

    def spelled(self, pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters replaced by their byte pieces; ends: of each text, from 0."""
        unknown = len(self.vocabulary.pieces)
        odd = np.flatnonzero(pieces >= unknown)
        if not len(odd):
            return pieces, np.diff(ends)
        spelt = [[self.vocabulary.byte_ids[b] for b in chr(int(p) - unknown).encode()] for p in pieces[odd]]
        width = np.ones(len(pieces), dtype=np.int64)
        width[odd] = [len(s) for s in spelt]
        shift = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(pieces, width)
        out[np.concatenate([np.arange(len(s)) for s in spelt]) + np.repeat(shift[odd], width[odd])] = np.concatenate(spelt)
        return out.astype(np.int32), np.diff(shift[ends])


def sample_pieces(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, sharpness: float = 1.0,
                  model_path: str = DEFAULT_MODEL, digest_col: str | None = None) -> DataFrame:
    """(all columns, piece_ids): one sampled segmentation per row; no shuffle.

    With digest_col, also the SHA-256 of the text to which the pieces decode.
    """
    model = model_bytes(model_path)
    keep = [c for c in docs.columns if c not in ("piece_ids", digest_col)]
    keyed = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(key_col).cast("string"), F.lit("\x00null")).alias("_".join(["key", *keep])))  # a name that no column has
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("piece_ids", ArrayType(IntegerType(), False))
    schema = schema.add(digest_col, StringType()) if digest_col else schema
    arrow = to_arrow_schema(schema)
    at = keep.index(text_col)

    def run(batches):
        vocabulary = Vocabulary(model)
        lattices = Lattices(vocabulary, log_weights(vocabulary, sharpness))
        widths = np.array([len(x) for x in vocabulary.surface])
        for part in slices(batches, 128):
            seeds = np.array([xxhash.xxh3_64_intdigest(k, seed) for k in bytes_of(part.column(len(keep)))], dtype=np.uint64)
            pieces, counts = lattices.sample([t.decode("utf-8", "replace") for t in bytes_of(part.column(at))], seeds)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(pieces))]
            if digest_col:
                columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in decoded(vocabulary, widths, pieces, counts)]))
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return keyed.mapInArrow(run, schema)


def decoded(vocabulary: Vocabulary, widths: np.ndarray, pieces: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts of lists of pieces that stand one after another, without their dummy blanks."""
    joined = b"".join(map(vocabulary.surface.__getitem__, pieces.tolist()))
    ends = np.concatenate([[0], np.cumsum(widths[pieces])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [joined[a + 1: b] for a, b in zip(ends, ends[1:])]


def decode_pieces(rows: DataFrame, pieces_col: str = "piece_ids", column: str = "decoded", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """rows with the text of their pieces; a null list decodes to the empty text."""
    model = model_bytes(model_path)
    keep = [c for c in rows.columns if c != column]
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add(column, StringType())
    arrow, at = to_arrow_schema(schema), keep.index(pieces_col)

    def run(batches):
        vocabulary = Vocabulary(model)
        widths = np.array([len(x) for x in vocabulary.surface])
        for part in slices(batches, 128):
            lists = part.column(at)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decoded(vocabulary, widths, lists.flatten().to_numpy(zero_copy_only=False), counts)
            columns = [*part.columns, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def sampling_report(docs: DataFrame) -> DataFrame:
    """Per document its sampled pieces and the digest of the text they decode to."""
    return sample_pieces(docs.select("doc_id", "text"), digest_col="decoded_sha256").select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "decoded_sha256")
