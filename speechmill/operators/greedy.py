"""Greedy left-to-right selection over long ordered series.

"Take the first item, then the first one at or after where it ends, ..." is
order-dependent: the result at any point depends on all choices before it. A
fold over one array per take would put a whole take in one row. Here every
block is solved for each way it can be entered (the ways merge after a few
items), which makes it a monotone map from where a path enters to where it
leaves. A parallel prefix over these maps finds the entry really used: the maps
of FAN neighbouring blocks are composed to that of one wider block, level by
level, and the entries are pushed down again. No step gathers a take. Each block
then selects its own items from its entry.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import inline_rows

# Types are built as objects, not DDL text: parsing text needs a session, and
# Python workers that import this module have none.
_LONGS = T.ArrayType(T.LongType())
_PATHS = T.StructType([T.StructField(c, _LONGS) for c in ("pos", "nxt", "entry", "leave")])
_PICKED = T.StructType([T.StructField(c, _LONGS) for c in ("pos", "nxt")])

#: Blocks whose maps are composed in one row, and how often, before the rest of a key is.
FAN_BITS = 8
LEVELS = 2
#: Before every position.
NOWHERE = -(2 ** 62)


def _hops(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Index of the item that each item's choice leads to; len(pos) behind the block."""
    return np.append(np.searchsorted(pos, nxt, side="left"), len(pos))


def _reached(succ: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Items on the paths from ``starts``, by pointer doubling: after k rounds all within 2**k hops."""
    mask = np.zeros(len(succ), dtype=bool)
    mask[starts] = True
    jump, hops = succ, 1
    while hops < len(succ):
        mask[jump[mask]] = True
        jump, hops = jump[jump], 2 * hops
    return np.flatnonzero(mask[:-1])


def _last(succ: np.ndarray) -> np.ndarray:
    """The last item of the block on each item's path."""
    n = len(succ) - 1
    end = np.where(succ[:n] == n, np.arange(n), succ[:n])
    for _ in range(max(n - 1, 1).bit_length()):
        end = end[end]
    return end


def _paths(pos: np.ndarray, nxt: np.ndarray, entries: int) -> dict[str, np.ndarray]:
    """Items reachable from the first ``entries`` items, and where each path leaves."""
    first = np.arange(min(entries, len(pos)))
    succ = _hops(pos, nxt)
    seen = _reached(succ, first)
    return {"pos": pos[seen], "nxt": nxt[seen], "entry": pos[first], "leave": nxt[_last(succ)[first]]}


def _walk(pos: np.ndarray, nxt: np.ndarray, start: int) -> np.ndarray:
    return _reached(_hops(pos, nxt), np.searchsorted(pos, start, side="left"))


@F.pandas_udf(_PATHS)
def _span_paths(pos: pd.Series, nxt: pd.Series, entries: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_paths(np.asarray(p), np.asarray(n), int(e)) for p, n, e in zip(pos, nxt, entries)],
                        columns=["pos", "nxt", "entry", "leave"])


@F.pandas_udf(_PICKED)
def _select(pos: pd.Series, nxt: pd.Series, start: pd.Series) -> pd.DataFrame:
    rows = []
    for p, n, s in zip(pos, nxt, start):
        p, n = np.asarray(p), np.asarray(n)
        keep = _walk(p, n, int(s))
        rows.append((p[keep], n[keep]))
    return pd.DataFrame(rows, columns=["pos", "nxt"])


def _through(x: Column, block: Column) -> Column:
    """Where a path that comes to ``x`` leaves a block: from the first entry at or
    after ``x``, else as ``rest`` says, and where that is null the block is passed over."""
    k = F.array_position(F.transform(block["entry"], lambda e: e >= x), True)
    return F.when(k > 0, F.get(block["leave"], (k - 1).cast("int"))).otherwise(F.coalesce(block["rest"], x))


def _pushed(keep: Sequence[str], rows: DataFrame, enter: Column, before: Column) -> DataFrame:
    """Per block of the array ``_b``: its number, its entry and the tail before it."""
    out = F.array().cast("array<struct<_blk:bigint,enter:bigint,before:bigint>>")
    start = F.struct(enter.alias("x"), before.alias("tail"), out.alias("out"))

    def step(acc: Column, b: Column) -> Column:
        here = F.struct(b["_blk"].alias("_blk"), acc["x"].alias("enter"), acc["tail"].alias("before"))
        return F.struct(_through(acc["x"], b).alias("x"), b["tail"].alias("tail"), F.array_append(acc["out"], here).alias("out"))

    return inline_rows(rows, keep, F.aggregate("_b", start, step)["out"])


def block_entries(blocks: DataFrame, keys: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """The position at which the greedy path enters each block (keys, _blk, ``enter``), and ``tail`` of the block ``before``.

    ``blocks``: keys, _blk, entry, leave, rest, tail. A path that passes a block's
    last entry reaches at most to the next block. At most FAN maps meet in one
    row on each level; FAN ** (levels + 1) blocks of a key are covered (some 10**11 words).
    """
    keys = list(keys)
    nothing = F.lit(NOWHERE).cast("bigint")
    member = F.struct("_blk", "entry", "leave", "rest", "tail")
    if levels == 0:
        whole = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("_b"))
        return _pushed(keys, whole, nothing, F.lit(None).cast("bigint"))
    grouped = blocks.groupBy(*keys, F.shiftright("_blk", FAN_BITS).alias("_wide")).agg(F.sort_array(F.collect_list(member)).alias("_b"))
    head = F.get("_b", F.lit(0))
    # where the head's entries, and last a path beyond them, leave the group
    first = F.concat(head["leave"], F.array(F.coalesce(head["rest"], nothing)))
    ends = F.aggregate(F.slice("_b", 2, F.size("_b")), first, lambda xs, b: F.transform(xs, lambda x: _through(x, b)))
    composed = grouped.select(*keys, F.col("_wide").alias("_blk"), head["entry"].alias("entry"), ends.alias("_e"), F.element_at("_b", -1)["tail"].alias("tail"))
    composed = composed.select(*keys, "_blk", "entry", F.slice("_e", 1, F.size("entry")).alias("leave"),
                               F.nullif(F.element_at("_e", -1), nothing).alias("rest"), "tail")
    above = block_entries(composed, keys, levels - 1).withColumnRenamed("_blk", "_wide")
    return _pushed(keys, grouped.join(above, [*keys, "_wide"]), F.col("enter"), F.col("before"))


def _finish(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    none = F.lit(None).cast("bigint")
    enter = block_entries(blocks.select(*keys, "_blk", "entry", "leave", none.alias("rest"), none.alias("tail")), keys)
    picked = blocks.select(*keys, "_blk", "pos", "nxt").join(enter, [*keys, "_blk"]).select(
        *keys, _select("pos", "nxt", "enter").alias("_sel"))
    return inline_rows(picked, keys, F.arrays_zip(F.col("_sel.pos").alias("pos"), F.col("_sel.nxt").alias("nxt")))


def greedy_select(df: DataFrame, keys: Sequence[str], pos: str, nxt: str, reach: int, block: int) -> DataFrame:
    """Greedy non-overlapping items: keys, ``pos``, ``nxt``.

    An item at ``pos`` blocks everything before ``nxt``; ``nxt - pos`` is at
    most ``reach``, which must not exceed ``block``.
    """
    keys = list(keys)
    items = df.select(*keys, F.col(pos).cast("bigint").alias("_pos"), F.col(nxt).cast("bigint").alias("_nxt"))
    grouped = items.groupBy(*keys, F.floor(F.col("_pos") / block).cast("bigint").alias("_blk")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_nxt"))).alias("_i"))
    limit = F.col("_blk") * block + reach
    entries = F.size(F.filter("_i", lambda x: x["_pos"] < limit)) + 1
    paths = grouped.select(*keys, "_blk", _span_paths(
        F.col("_i._pos"), F.col("_i._nxt"), entries).alias("_p")).select(*keys, "_blk", "_p.*")
    return _finish(paths, keys)


def _free(start: np.ndarray, end: np.ndarray, span_start: np.ndarray, span_end: np.ndarray) -> np.ndarray:
    """Mask of the words that overlap no span."""
    if len(span_start) == 0:
        return np.ones(len(start), dtype=bool)
    order = np.argsort(span_start, kind="stable")
    furthest = np.maximum.accumulate(span_end[order])
    before = np.searchsorted(span_start[order], end, side="left")
    return (before == 0) | (furthest[np.maximum(before - 1, 0)] <= start)


def _chunk_ends(ordinal: np.ndarray, start: np.ndarray, end: np.ndarray, core: int, limit: int) -> np.ndarray:
    """For each of the first ``core`` words the ordinal after the longest chunk that starts there."""
    n = len(ordinal)
    gap_at = np.append(np.flatnonzero(np.diff(ordinal) != 1) + 1, n)
    run_end = gap_at[np.searchsorted(gap_at, np.arange(core), side="right")]
    if n < 2 or bool(np.all(np.diff(end) >= 0)):
        last = np.minimum(np.searchsorted(end, start[:core] + limit, side="right"), run_end)
    elif bool(np.all(np.diff(start) >= 0)):
        # words before the i-th end too early to stop its chunk, so the furthest end so far decides
        last = np.minimum(np.searchsorted(np.maximum.accumulate(end), start[:core] + limit, side="right"), run_end)
    else:
        last = np.empty(core, dtype=np.int64)
        for i in range(core):
            j = i + 1
            while j < run_end[i] and end[j] - start[i] <= limit:
                j += 1
            last[i] = j
    return ordinal[last - 1] + 1


@F.pandas_udf(_PATHS)
def _chunk_paths(ordinal: pd.Series, start: pd.Series, end: pd.Series, core: pd.Series, near: pd.Series, limit: pd.Series,
                 span_start: pd.Series, span_end: pd.Series) -> pd.DataFrame:
    rows = []
    none = np.empty(0, dtype=np.int64)
    for o, s, e, c, x, m, a, z in zip(ordinal, start, end, core, near, limit, span_start, span_end):
        o, s, e = np.asarray(o), np.asarray(s), np.asarray(e)
        keep = _free(s, e, none if a is None else np.asarray(a), none if z is None else np.asarray(z)) & (e - s <= int(m))
        c = int(np.count_nonzero(keep[:int(c)]))
        o, s, e = o[keep], s[keep], e[keep]
        entries = int(np.count_nonzero(s[:c] <= x)) + 1
        rows.append(_paths(o[:c], _chunk_ends(o, s, e, c, int(m)), entries))
    return pd.DataFrame(rows, columns=["pos", "nxt", "entry", "leave"])


@F.pandas_udf(_PICKED)
def _select_at(ordinal: pd.Series, pos: pd.Series, nxt: pd.Series, start: pd.Series) -> pd.DataFrame:
    """Index of each selected chunk in the block's words, and its word count."""
    rows = []
    for o, p, n, s in zip(ordinal, pos, nxt, start):
        p, n = np.asarray(p), np.asarray(n)
        keep = _walk(p, n, int(s))
        rows.append((np.searchsorted(np.asarray(o), p[keep], side="left"), n[keep] - p[keep]))
    return pd.DataFrame(rows, columns=["pos", "nxt"])


def greedy_chunks(words: DataFrame, spans: DataFrame, keys: Sequence[str], carry: Sequence[str], group: Sequence[str],
                  limit_ms: int, margin_ms: int = 0, block_ms: int = 300_000) -> DataFrame:
    """Greedy chunks of at most ``limit_ms`` of the words that overlap no span.

    ``words``: keys, ordinal (dense), start_ms, end_ms, the ``carry`` columns of
    each word and the ``group`` columns, constant per key. ``spans``: keys,
    span_start, span_end. A word longer than the limit or under a span ends a
    chunk and belongs to none. Returns keys, group, ``chunk`` (array of the
    chunk's words), ``prev_end`` of the word before it and ``next_start`` of the
    word after it; the latter is null where that word is over ``margin_ms`` away.

    Words are gathered into time blocks once (a block is bounded, however long
    the take); words that start within limit and margin after a block are copied
    to it, so a chunk can cross the edge.
    """
    keys, group = list(keys), list(group)
    own = F.floor(F.col("start_ms") / block_ms).cast("bigint")
    copies = F.array_compact(F.array(own, F.when(F.col("start_ms") - own * block_ms <= limit_ms + margin_ms, own - 1)))
    item = F.struct("ordinal", "start_ms", "end_ms", *carry)
    spread = words.select(*keys, *group, item.alias("_w"), own.alias("_own"), F.explode(copies).alias("_blk"))
    grouped = spread.groupBy(*keys, *group, "_blk").agg(
        F.sort_array(F.collect_list("_w")).alias("_i"), F.count_if(F.col("_own") == F.col("_blk")).alias("_core")).filter("_core > 0")
    reach = F.sequence(F.floor((F.col("span_start") - 2 * limit_ms) / block_ms).cast("bigint"), F.floor(F.col("span_end") / block_ms).cast("bigint"))
    taken = spans.select(*keys, "span_start", "span_end", F.explode(reach).alias("_blk")).groupBy(*keys, "_blk").agg(
        F.collect_list(F.struct("span_start", "span_end")).alias("_s"))
    paths = grouped.join(taken, [*keys, "_blk"], "left").withColumn("_p", _chunk_paths(
        F.col("_i.ordinal"), F.col("_i.start_ms"), F.col("_i.end_ms"), "_core", F.col("_blk") * block_ms + limit_ms, F.lit(limit_ms),
        F.col("_s.span_start"), F.col("_s.span_end")))
    tail = F.get("_i", (F.col("_core") - 1).cast("int"))["end_ms"]
    enter = block_entries(paths.select(*keys, "_blk", "_p.entry", "_p.leave", F.lit(None).cast("bigint").alias("rest"), tail.alias("tail")), keys)
    picked = paths.select(*keys, *group, "_blk", "_i", "_p").join(enter, [*keys, "_blk"]).select(
        *keys, *group, "_i", "before", _select_at(F.col("_i.ordinal"), F.col("_p.pos"), F.col("_p.nxt"), F.col("enter")).alias("_sel"))

    def cut(z):
        at, n = z["pos"].cast("int"), z["nxt"].cast("int")
        return F.struct(F.slice("_i", at + 1, n).alias("chunk"),
                        F.when(at > 0, F.get("_i", at - 1)["end_ms"]).otherwise(F.col("before")).alias("prev_end"),
                        F.get("_i", at + n)["start_ms"].alias("next_start"))

    return inline_rows(picked, [*keys, *group], F.transform(F.arrays_zip("_sel.pos", "_sel.nxt"), cut))
