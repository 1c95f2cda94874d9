"""Gaps and islands over long series, in two levels.

Rows are cut into position blocks. Runs are found inside each block first; only
the runs at block edges (at most two per block) meet again in a second step.
Inner runs keep their block as window key, so no task sees a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .joins import block_of


def runs(df: DataFrame, keys: Sequence[str], pos: str, seq: str, block: int, value: Column | None = None,
         gap: float | Column | None = None, score: str | None = None) -> DataFrame:
    """Maximal runs in (pos, seq) order per key.

    A run ends where ``value`` changes and, with ``gap``, where the next
    position is more than ``gap`` away. Returns the keys with ``start``,
    ``end``, ``n``, ``value``, ``next_start`` (position of the following row,
    null at the end of the series) and, for ``score``, the first highest row as
    ``peak`` and ``peak_at``.
    """
    keys = list(keys)
    val = value if value is not None else F.lit(0)
    if "_blk" not in df.columns:
        df = df.withColumn("_blk", block_of(F.col(pos), block))
    cols = [*keys, "_blk", F.col(pos).alias("_p"), F.col(seq).alias("_s"), val.alias("_v")]
    cols += [F.col(score).alias("_score")] if score else []
    gap_col = gap if isinstance(gap, Column) else (None if gap is None else F.lit(gap))
    if gap_col is not None:
        cols.append(gap_col.alias("_gap"))
    w = W.partitionBy(*keys, "_blk").orderBy("_p", "_s")
    broken = ~F.lag("_v").over(w).eqNullSafe(F.col("_v"))
    if gap_col is not None:
        broken = broken | (F.col("_p") - F.lag("_p").over(w) > F.col("_gap"))
    broken = broken | F.lag("_p").over(w).isNull()
    marked = df.select(*cols).select(
        "*", broken.cast("int").alias("_new"), F.lead("_p").over(w).alias("_next"))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    peak = [F.max(F.struct("_score", (-F.col("_p")).alias("np"), (-F.col("_s")).alias("ns"))).alias("_peak")] if score else []
    extra = [F.max("_gap").alias("_gap")] if gap_col is not None else []
    local = numbered.groupBy(*keys, "_blk", "_run").agg(
        F.first("_v").alias("_v"), F.min("_p").alias("_start"), F.max("_p").alias("_end"),
        F.count(F.lit(1)).alias("_n"),
        F.max_by("_next", F.struct("_p", "_s")).alias("_next"), *peak, *extra,
    )
    # The last run of a block has no next row; the first is run number 1.
    edge = (F.col("_run") == 1) | F.col("_next").isNull()
    local = local.withColumn("_part", F.when(edge, F.lit(None).cast("bigint")).otherwise(F.col("_blk")))
    w2 = W.partitionBy(*keys, "_part").orderBy("_blk", "_run")
    joins = F.lag("_v").over(w2).eqNullSafe(F.col("_v")) & (F.lag("_blk").over(w2) < F.col("_blk"))
    if gap_col is not None:
        joins = joins & (F.col("_start") - F.lag("_end").over(w2) <= F.col("_gap"))
    fresh = F.when(F.lag("_blk").over(w2).isNull(), 1).otherwise((~joins).cast("int"))
    local = local.select("*", fresh.alias("_fresh"), F.lead("_start").over(w2).alias("_after")).withColumn(
        "_group", F.sum("_fresh").over(w2.rowsBetween(W.unboundedPreceding, 0)))
    merged = local.groupBy(*keys, "_part", "_group").agg(
        F.first("_v").alias("value"), F.min("_start").alias("start"), F.max("_end").alias("end"),
        F.sum("_n").alias("n"), F.max_by(F.coalesce("_next", "_after"), F.struct("_blk", "_run")).alias("next_start"),
        *([F.max("_peak").alias("_peak")] if score else []),
    )
    out = [*keys, "start", "end", "n", "value", "next_start"]
    if score:
        out += [F.col("_peak._score").alias("peak"), (-F.col("_peak.np")).alias("peak_at")]
    return merged.select(*out)


def hysteresis(df: DataFrame, keys: Sequence[str], pos: str, seq: str, score: str, open_at: float,
               close_below: float, block: int) -> DataFrame:
    """Runs that open at ``score >= open_at`` and close at ``score < close_below``.

    Rows between the two levels never change the state, so they drop out and
    the rest are plain runs of open / closed rows. ``end`` is the closing
    position, or the last position of the series for a run still open there.
    """
    keys = list(keys)
    state = F.when(F.col(score) >= open_at, True).when(F.col(score) < close_below, False)
    decided = df.filter(state.isNotNull())
    last = df.groupBy(*keys).agg(F.max(pos).alias("_last"))
    found = runs(decided, keys, pos, seq, block, value=state).filter("value")
    return found.join(last, keys).select(
        *keys, "start", F.coalesce("next_start", "_last").alias("end"))
