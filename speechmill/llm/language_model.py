"""Operator 7, LM scoring: a bigram model by deleted interpolation.

P(w | v) = l2 c(vw) / c(v) + l1 c(w) / N + l0 / (V + 1); the three weights depend
on the frequency bucket of the context v (powers of two) and are learned by
expectation-maximisation on held-out counts: each training text is scored with
the counts of all other texts, that is, with its own counts deleted from the total.

Texts are taken in blocks where they are read. A block sends its distinct
word and bigram hashes, sorted and packed, with its training counts to parts of
the count table; a part adds them up and answers each block with the totals in
the order in which the block asked. Only packed arrays move, a frequent word is
one entry per block, and blocks and parts are of bounded size and grow in number
with the data; a part answers as many keys as PART_BLOCKS blocks ask for, so that
the packed rows are fewer by that factor than blocks times blocks. Texts are
written once, with their answers. The driver gets N, V and a histogram of fixed size.

The table is read twice, once to ask and once to meet the answers. Blocks are
numbered by partition and place, so `docs` must give its rows in the same order
both times, as a table that was written does; a digest of the asked keys goes with
each block, and a block that does not ask the same again ends the job.

Keys of a part are told apart by 48 bits: of m keys in one part (some 10**6) each
takes the count of another one with a chance of m / 2**48, about 4 in 10**9.

Words are the runs of [^\\x20\\x09-\\x0D], A-Z lower-cased, behind a start mark and
before an end mark, which counts as a token. Defined results: null and empty
texts are one end token; repeated rows count and are scored each; a null id is
hashed as the empty string and is not held out; without training texts the base
is that of an empty table; an empty table gives no rows; only the id and the text
are read, so further columns of any name do not matter, nor do ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bytes_of, mixed, parts_for, settled, slices, text_of, words_of

BLOCK_CHARS = 8_000_000
#: A part of the count table gets as many keys as this many blocks ask for.
PART_BLOCKS = 4
END, START = np.uint64(1), np.uint64(2)
BUCKETS = 24
#: Logarithms of the estimates are binned in steps of 2 ** -(1 / FINE).
FINE, LEVELS = 8, 320


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


class Words:
    """64-bit numbers of words; one per block."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w) | 4  # apart from the marks
        out = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        return np.append(out, END)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, tokens per text) of a block."""
    number = Words()
    rows = [number(t) for t in texts]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    token = np.concatenate(rows)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return token, before, sizes


def bigram(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(before + np.uint64(0x51ED270B)) + token) | np.uint64(1) << np.uint64(63)


def word_key(token: np.ndarray) -> np.ndarray:
    return mixed(token) & ~(np.uint64(1) << np.uint64(63))


def block_keys(texts: list[bytes], trained: np.ndarray):
    """Keys of a block: (sorted distinct keys, training counts, place of each
    token's word, context and bigram among them, tokens per text)."""
    token, before, sizes = tokens_of(texts)
    words, w = np.unique(np.concatenate([token, before]), return_inverse=True)
    pairs, b = np.unique(bigram(before, token), return_inverse=True)
    at = np.argsort(word_key(words))
    place = np.empty(len(words), dtype=np.int64)
    place[at] = np.arange(len(words))
    w = place[w]
    learnt = np.repeat(trained, sizes)
    n = len(token)
    keys = np.concatenate([word_key(words)[at], pairs])
    counts = np.bincount(np.concatenate([w[:n][learnt], b[learnt] + len(words)]), minlength=len(keys))
    # the start mark is a context, but never a token
    contexts = np.bincount(w[n:][learnt], minlength=len(words))
    start = int(np.searchsorted(keys[: len(words)], word_key(np.array([START]))[0]))
    counts[start] = contexts[start]
    return keys, counts.astype(np.uint32), w[:n], w[n:], b + len(words), sizes


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(parts)).astype(np.int64)


def squeezed(data: bytes, level: int = 1) -> bytes:
    """The bytes behind their length, compressed: Zstandard takes a fraction of zlib's time for the same size."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", level).compress(data, asbytes=True)


def restored(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(pa.py_buffer(blob).slice(8), int.from_bytes(blob[:8], "little"), asbytes=True)


def packed(numbers: np.ndarray) -> bytes:
    """Integers with their bytes of equal weight side by side: equal high bytes cost little."""
    return squeezed(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(restored(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


class Block:
    """Texts of one block as a row: their ids, fold and sizes, and one compressed string."""

    FIELDS = "block long, n long, ids binary, nulls binary, held_out binary, sizes binary, texts binary"
    NAMES = [f.split()[0] for f in FIELDS.split(", ")]

    def __init__(self, row: dict):
        self.ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
        self.held_out = np.frombuffer(row["held_out"], bool)
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int64)).tolist()
        joined = restored(row["texts"])
        self.texts = [joined[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def row(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids, folds, texts = zip(*held)
        values = [number, len(ids), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(),
                  np.array(folds, bool).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), squeezed(b"".join(texts), 3)]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=Block.NAMES)


def plain_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))


def parts_of(rows: DataFrame) -> int:
    """Parts of the count table, in proportion to the bytes of all texts."""
    total = rows.agg(F.sum(F.octet_length("text") + 50)).first()[0] or 0
    return parts_for(total, BLOCK_CHARS * PART_BLOCKS)


def blocks_in(batches):
    """(number, rows (id, held out, text)) of blocks of about BLOCK_CHARS bytes of text."""
    number, held, size = TaskContext.get().partitionId() << 24, [], 0
    for part in slices(batches):
        for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), bytes_of(part.column(2)), strict=True):
            held.append(row)
            size += len(row[2]) + 50
            if size >= BLOCK_CHARS:
                yield number, held
                number, held, size = number + 1, [], 0
    if held:
        yield number, held


def digest_of(keys: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1


def count_tables(rows: DataFrame, parts: int) -> DataFrame:
    """(block, part, totals, n_types, n_tokens, digest): the answers of each part to each block."""
    def ask(batches):
        for number, held in blocks_in(batches):
            keys, counts, *_ = block_keys([t for *_, t in held], ~np.array([h for _, h, _ in held], dtype=bool))
            digest = digest_of(keys)
            part = part_of(keys, parts)
            at = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[at], np.arange(parts + 1))
            groups = [(p, at[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in groups], pa.int32()), pa.array([number] * len(groups), pa.int64()),
                # 48 bits tell the keys of one part apart, whose number is bounded
                pa.array([packed(keys[g] >> np.uint64(16)) for _, g in groups], pa.binary()),
                pa.array([packed(counts[g]) for _, g in groups], pa.binary()), pa.array([digest] * len(groups), pa.int64())],
                names=["part", "block", "keys", "counts", "digest"])

    start = word_key(np.array([START]))[0] >> np.uint64(16)

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpacked(k, np.uint64) for k in table.column("keys").to_pylist()]
        given = [unpacked(c, np.uint32) for c in table.column("counts").to_pylist()]
        every, where = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(given)).astype(np.int64)
        words = (every >> np.uint64(47) == 0) & (every != start)
        ends = np.cumsum([len(a) for a in asked])
        n = len(asked)
        totals = [packed(total[where[e - len(a): e]]) for a, e in zip(asked, ends)]
        first = [True] + [False] * (n - 1)
        return pa.table({
            "block": table.column("block").cast(pa.int64()), "part": table.column("part").cast(pa.int32()), "totals": pa.array(totals, pa.binary()),
            "n_types": pa.array([int((total[words] > 0).sum()) * f for f in first], pa.int64()),
            "n_tokens": pa.array([int(total[words].sum()) * f for f in first], pa.int64()), "digest": table.column("digest").cast(pa.int64())})

    asked = rows.mapInArrow(ask, "part int, block long, keys binary, counts binary, digest long")
    return asked.groupBy("part").applyInArrow(answer, "block long, part int, totals binary, n_types long, n_tokens long, digest long")


def answered_blocks(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with the answers of all parts in one row, written once: two passes read it."""
    fields = Block.FIELDS + ", part array<int>, totals array<binary>, n_types long, n_tokens long, digest long"
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        for row in rows:
            row["part"], row["totals"] = right.column("part").to_pylist(), right.column("totals").to_pylist()
            row["n_types"], row["n_tokens"] = (sum(right.column(n).to_pylist()) for n in ("n_types", "n_tokens"))
            row["digest"] = right.column("digest")[0].as_py() if right.num_rows else None
        return pa.Table.from_pylist(rows, schema=schema)

    blocks = rows.mapInArrow(lambda batches: (Block.row(n, held) for n, held in blocks_in(batches)), Block.FIELDS)
    return settled(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, fields))


def estimates(texts: list[bytes], trained: np.ndarray, parts: int, answers: dict[int, bytes], digest: int, deleted: bool):
    """Counts (bigram, context, word) of each token, and tokens per text.

    With `deleted`, each text's own counts are taken out of the totals.
    """
    keys, _, w, v, b, sizes = block_keys(texts, trained)
    if digest_of(keys) != digest:
        raise ValueError("the table gave its rows in another order when it was read again; write it first")
    part = part_of(keys, parts)
    total = np.empty(len(keys), dtype=np.int64)
    at = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[at], np.arange(parts + 1))
    for p, (a, e) in enumerate(zip(cuts, cuts[1:])):
        if e > a:
            total[at[a:e]] = unpacked(answers[p], np.int64)
    if not deleted:
        return total[b], total[v], total[w], sizes
    own = [np.empty(len(b), dtype=np.int64) for _ in range(3)]
    held = np.zeros(len(keys), dtype=np.int64)
    for end, n in zip(np.cumsum(sizes), sizes):
        for out, x in zip(own, (b, v, w)):
            mine = x[end - n: end]
            np.add.at(held, mine, 1)
            out[end - n: end] = held[mine]
            held[mine] = 0
    return (*(total[x] - n for x, n in zip((b, v, w), own)), sizes)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 0) + 1).astype(np.int64), BUCKETS - 1)


def _level(p: np.ndarray) -> np.ndarray:
    """Bin of a probability; the last bin is zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(-np.log2(np.maximum(p, 1e-300)) * FINE, LEVELS - 2).astype(np.int64), LEVELS - 1)


def learn_weights(cells: np.ndarray, counts: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, word, uniform) per bucket by expectation-maximisation.

    A cell is bucket * LEVELS**2 + bigram level * LEVELS + word level. A bucket
    without held-out counts takes the weights of all buckets together.
    """
    def back(level):
        return np.where(level == LEVELS - 1, 0.0, 2.0 ** (-(level + 0.5) / FINE))

    bucket, pair, word = cells // LEVELS ** 2, back(cells // LEVELS % LEVELS), back(cells % LEVELS)
    terms = np.stack([pair, word, np.full(len(cells), uniform)], axis=1)

    def run(mask):
        x, n, weight = terms[mask], counts[mask], np.array([0.4, 0.5, 0.1])
        for _ in range(rounds):
            share = x * weight
            share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            weight = (share.sum(axis=0) + 1e-3) / (share.sum() + 3e-3)
        return weight

    out = np.tile(run(np.ones(len(cells), dtype=bool)) if len(cells) else np.array([0.0, 0.9, 0.1]), (BUCKETS, 1))
    for k in np.unique(bucket):
        out[k] = run(bucket == k)
    return out


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = plain_texts(docs, id_col, text_col)
    parts = parts_of(rows)
    answered = answered_blocks(rows, count_tables(rows, parts))
    n_types, n_tokens = (int(x or 0) for x in answered.agg(F.sum("n_types"), F.sum("n_tokens")).first())
    uniform = 1.0 / (n_types + 1)

    def unpacked_blocks(batches, deleted: bool):
        for batch in slices(batches, 1):
            row = {n: batch.column(n)[0].as_py() for n in [*Block.NAMES, "part", "totals", "digest"]}
            block = Block(row)
            yield block, *estimates(block.texts, ~block.held_out, parts, dict(zip(row["part"], row["totals"])), row["digest"], deleted)

    def tally(batches):
        for block, pair, context, word, sizes in unpacked_blocks(batches, True):
            use = np.repeat(~block.held_out, sizes)
            pair, context, word = pair[use], context[use], word[use]
            others = np.maximum(n_tokens - np.repeat(sizes, sizes)[use], 1)
            cell = (bucket_of(context) * LEVELS + _level(pair / np.maximum(context, 1))) * LEVELS + _level(word / others)
            cells, counts = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], names=["cell", "n"])

    histogram = (answered.mapInArrow(tally, "cell long, n long")
                 .groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect())
    weights = learn_weights(np.array([r["cell"] for r in histogram], dtype=np.int64), np.array([r["n"] for r in histogram], dtype=np.float64), uniform)

    def score(batches):
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        for block, pair, context, word, sizes in unpacked_blocks(batches, False):
            weight = weights[bucket_of(context)]
            p = weight[:, 0] * (pair / np.maximum(context, 1)) + weight[:, 1] * (word / max(n_tokens, 1)) + weight[:, 2] * uniform
            starts = np.cumsum(sizes) - sizes
            base = np.log10((word + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
            columns = (block.ids, block.held_out, sizes, np.add.reduceat((word > 0).astype(np.int64), starts),
                       np.full(len(sizes), n_tokens), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for k, c in zip(kinds, columns)], names=list(names))

    return answered.mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_report(docs: DataFrame) -> DataFrame:
    return language_scores(docs)
