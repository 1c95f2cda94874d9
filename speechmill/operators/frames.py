"""Energy cutting of takes that span many rows.

A take comes as chunks of samples of any length. Everything after the chunks
works on rows of frames or of spans in position blocks, so no row and no task
holds a whole take: the level floor is an exact order statistic found by
histograms, open and closed frames are runs over blocks, and spans are merged
block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import signal as sg
from ..session import settled
from .islands import runs
from .joins import block_of

BLOCK_FRAMES = 4096
#: Cells of a unit in the second histogram of an order statistic.
FINE_CELLS = 1 << 15


def frame_rows(chunks: DataFrame, keys: Sequence[str], offset: str, samples: str, frame: int) -> DataFrame:
    """One row per frame: keys, ``frame``, ``rms`` and ``n``, its samples.

    ``offset`` is the place of a chunk's first sample in its take. A chunk gives
    each frame that it touches the energy of its part; the parts are added up.
    """
    whole = chunks.filter(F.size(samples) > 0)
    first, last = F.floor(F.col(offset) / frame), F.floor((F.col(offset) + F.size(samples) - 1) / frame)
    touched = whole.select(*keys, offset, samples, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("frame"))
    skip = F.greatest(F.col("frame") * frame - F.col(offset), F.lit(0))
    size = F.least((F.col("frame") + 1) * frame - F.col(offset), F.size(samples)) - skip
    part = F.slice(samples, (skip + 1).cast("int"), size.cast("int"))
    pieces = touched.select(*keys, "frame", sg.energy(part).alias("_e"), size.cast("bigint").alias("_n"))
    return pieces.groupBy(*keys, "frame").agg(F.sum("_e").alias("_e"), F.sum("_n").alias("n")).select(
        *keys, "frame", F.sqrt(F.col("_e").cast("double") / F.col("n")).alias("rms"), "n")


def _picked(cells: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """The cell that holds the ``_k``-th smallest row of each key, and ``_k`` within it; cells carry their count ``_c``."""
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    return cells.withColumn("_before", before).filter((F.col("_before") <= F.col("_k")) & (F.col("_k") < F.col("_before") + F.col("_c"))).select(
        *keys, F.col(cell), (F.col("_k") - F.col("_before")).alias("_k"))


def kth_smallest(rows: DataFrame, keys: Sequence[str], value: str, rank: DataFrame) -> DataFrame:
    """Exact order statistic of values from 0 to 2**16 per key: keys and ``kth``.

    ``rank`` has keys and ``_k`` (0-based). Two histograms, by whole units and by
    ``FINE_CELLS`` parts of the unit found, leave few distinct values; their
    counts give the value. A key never has more than 65,536 cells, and equal
    values are counted before they meet.
    """
    keys = list(keys)
    unit = F.floor(value).cast("bigint")
    part = F.floor((F.col(value) - F.floor(value)) * FINE_CELLS).cast("bigint")
    now = rows.select(*keys, value, unit.alias("_unit"), part.alias("_part"))
    for cell in ("_unit", "_part"):
        cells = now.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_c")).join(rank, keys)
        rank = settled(_picked(cells, keys, cell), "ranks")
        now = now.join(rank.drop("_k"), [*keys, cell], "left_semi")
        rank = rank.drop(cell)
    cells = now.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).join(rank, keys)
    return _picked(cells, keys, value).select(*keys, F.col(value).alias("kth"))


def take_levels(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, ``open``, ``close``, ``frames`` and ``samples`` of takes that are not flat."""
    keys = list(keys)
    totals = settled(frames.groupBy(*keys).agg(F.max("rms").alias("top"), F.count(F.lit(1)).alias("frames"), F.sum("n").alias("samples")), "takes")
    rank = totals.select(*keys, F.floor(F.col("frames") * sg.FLOOR_FRACTION).cast("bigint").alias("_k"))
    floor = kth_smallest(frames, keys, "rms", rank).withColumnRenamed("kth", "floor")
    range_of = F.col("top") - F.col("floor")
    return totals.join(floor, keys).filter(range_of >= 1.0).select(
        *keys, (F.col("floor") + F.lit(sg.OPEN_FRACTION) * range_of).alias("open"), (F.col("floor") + F.lit(sg.CLOSE_FRACTION) * range_of).alias("close"),
        "frames", "samples")


def open_runs(frames: DataFrame, levels: DataFrame, keys: Sequence[str], block: int = BLOCK_FRAMES) -> DataFrame:
    """Half-open frame spans (``start``, ``end``) that open and close at the take's levels."""
    keys = list(keys)
    state = F.when(F.col("rms") >= F.col("open"), True).when(F.col("rms") < F.col("close"), False)
    decided = frames.select(*keys, "frame", "rms").join(levels, keys).select(*keys, "frame", state.alias("_open")).filter("_open IS NOT NULL")
    found = runs(decided, keys, "frame", "frame", block, value=F.col("_open")).filter("value")
    return found.join(levels.select(*keys, "frames", "samples"), keys).select(
        *keys, "start", F.coalesce("next_start", "frames").alias("end"), "samples")


def merged_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, block: float) -> DataFrame:
    """Disjoint spans merged where the next one starts less than ``gap`` after the one before ends: keys, ``start``, ``end``.

    A group is named by where it starts. Inside a block that is the last fresh
    start so far; blocks hand on their last end and last fresh start.
    """
    keys = list(keys)
    cut = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), block_of(F.col(start), block).alias("_blk"))
    inside, over = W.partitionBy(*keys, "_blk").orderBy("_s"), W.partitionBy(*keys).orderBy("_blk")
    ends = cut.groupBy(*keys, "_blk").agg(F.max("_e").alias("_last")).select(*keys, "_blk", F.lag("_last").over(over).alias("_before"))
    fresh = ~F.coalesce(F.col("_s") - F.coalesce(F.lag("_e").over(inside), F.col("_before")) < gap, F.lit(False))
    marked = cut.join(ends, [*keys, "_blk"]).withColumn("_head", F.when(fresh, F.col("_s")))
    heads = marked.groupBy(*keys, "_blk").agg(F.max("_head").alias("_h")).select(
        *keys, "_blk", F.last("_h", True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    so_far = F.last("_head", True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    named = marked.withColumn("_here", so_far).join(heads, [*keys, "_blk"]).withColumn("_group", F.coalesce("_here", "_carried"))
    return named.groupBy(*keys, "_group").agg(F.min("_s").alias("start"), F.max("_e").alias("end")).drop("_group")


def energy_bursts(chunks: DataFrame, keys: Sequence[str], offset: str, samples: str, rate: int, block: int = BLOCK_FRAMES) -> DataFrame:
    """Sound bursts of takes given as chunks: keys, ``start_ms``, ``end_ms``; equal to cutting each take in one row."""
    keys = list(keys)
    frame = max(round(sg.FRAME_SECONDS * rate), 1)
    frames = settled(frame_rows(chunks, keys, offset, samples, frame), "frames")
    levels = settled(take_levels(frames, keys), "levels")
    frame_ms, total = frame * 1000.0 / rate, F.col("samples") * 1000.0 / rate
    spans = open_runs(frames, levels, keys, block).select(
        *keys, (F.col("start") * frame_ms).alias("_from"), F.least(F.col("end") * frame_ms, total).alias("_to"))
    bursts = merged_spans(spans, keys, "_from", "_to", sg.MERGE_GAP_MS, block * frame_ms).filter(F.col("end") - F.col("start") >= sg.MIN_BURST_MS)
    return bursts.join(levels.select(*keys, "samples"), keys).select(
        *keys, F.greatest(F.col("start") - sg.LEAD_PAD_MS, F.lit(0.0)).alias("start_ms"), F.least(F.col("end") + sg.TAIL_PAD_MS, total).alias("end_ms"))
