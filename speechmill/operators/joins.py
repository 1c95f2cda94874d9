"""Interval and as-of joins as equi-joins or running windows over time blocks.

Spark plans a bare interval predicate as a nested loop. Here time is cut into
blocks and (keys, block) is the shuffle key, so one take that holds a third of
all rows still spreads over many tasks, and no step pairs all rows of a take.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def block_of(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def _cover(lo: Column, hi: Column, width: int) -> Column:
    first = block_of(lo, width)
    return F.explode(F.sequence(first, F.greatest(block_of(hi, width), first)))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str],
              right_span: tuple[str, str], bucket: int, strict: bool = False) -> DataFrame:
    """All pairs with equal ``keys`` whose spans overlap.

    For sides whose spans meet only a few partners each (words, slices, bands).
    Both sides are spread over the buckets they cover; a pair that shares
    several buckets is kept in the first one only. Column names other than the
    keys must differ between the sides.
    """
    (llo, lhi), (rlo, rhi) = left_span, right_span
    a = left.select("*", _cover(F.col(llo), F.col(lhi), bucket).alias("_bk"))
    b = right.select("*", _cover(F.col(rlo), F.col(rhi), bucket).alias("_bk"))
    touch = (F.col(llo) < F.col(rhi)) & (F.col(rlo) < F.col(lhi)) if strict else (
        (F.col(llo) <= F.col(rhi)) & (F.col(rlo) <= F.col(lhi)))
    first_shared = F.col("_bk") == F.greatest(block_of(F.col(llo), bucket), block_of(F.col(rlo), bucket))
    return a.join(b, [*keys, "_bk"]).filter(touch & first_shared).drop("_bk")


def overlap_anti(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: Sequence[str],
                 left_span: tuple[str, str], right_span: tuple[str, str], bucket: int) -> DataFrame:
    """Rows of ``left`` that strictly overlap no span of ``right``."""
    (llo, lhi), (rlo, rhi) = left_span, right_span
    a = left.select(*dict.fromkeys([*keys, *row_id, llo, lhi]), _cover(F.col(llo), F.col(lhi), bucket).alias("_bk"))
    b = right.select(*keys, F.col(rlo).alias("_rlo"), F.col(rhi).alias("_rhi"),
                     _cover(F.col(rlo), F.col(rhi), bucket).alias("_bk"))
    same = [a[k] == b[k] for k in [*keys, "_bk"]]
    hit = a.join(b, [*same, a[llo] < b["_rhi"], a[lhi] > b["_rlo"]], "left_semi").select(*row_id).distinct()
    return left.join(hit, list(row_id), "left_anti")


def last_refs(points: DataFrame, refs: DataFrame, keys: Sequence[str], p_pos: str, r_pos: str, r_until: str,
              carry: Sequence[str], block: int, n: int = 1, tie: Sequence[str] = ()) -> DataFrame:
    """For every point the last ``n`` refs at or before it, newest first, in ``_refs``.

    One sort per (keys, block) in place of pairs: linear however dense both
    sides are. A ref is visible to the points of every block that
    ``[r_pos, r_until]`` touches, so ``r_until`` states how far it matters;
    callers test the returned refs themselves. ``_blk`` is kept, so a following
    window over (keys, _blk) needs no further shuffle.
    """
    keys = list(keys)
    r = refs.select(
        *keys, F.col(r_pos).cast("double").alias("_pos"),
        F.struct(*[F.col(c).cast("double") for c in tie] or [F.lit(0.0)]).alias("_tie"),
        F.struct(*carry).alias("_ref"), _cover(F.col(r_pos), F.col(r_until), block).alias("_blk"),
    )
    w_ref = W.partitionBy(*keys, "_blk").orderBy("_pos", "_tie")
    recent = [F.col("_ref"), *[F.lag("_ref", i).over(w_ref) for i in range(1, n)]]
    r = r.withColumn("_refs", F.array_compact(F.array(*recent)))
    p = points.select(
        *keys, F.col(p_pos).cast("double").alias("_pos"), block_of(F.col(p_pos), block).alias("_blk"),
        F.struct(*points.columns).alias("_point"),
    )
    both = r.select(*keys, "_blk", "_pos", "_tie", "_refs", F.lit(0).alias("_kind")).unionByName(
        p.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys, "_blk").orderBy("_pos", "_kind", "_tie").rowsBetween(W.unboundedPreceding, 0)
    return (
        both.withColumn("_refs", F.last("_refs", ignorenulls=True).over(w))
        .filter(F.col("_kind") == 1).select("_point.*", "_refs", "_blk")
    )


def containing_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str], pos: str, lo: str, hi: str,
                     block: int) -> DataFrame:
    """Every point with the spans that contain it (``_spans``), ends included.

    The spans of one key must not overlap except at their end points; repeated
    spans collapse. At most three distinct spans then meet in one point: one
    that ends there, an empty one, and one that starts there.
    """
    distinct = spans.select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi")).distinct()
    found = last_refs(points, distinct, keys, pos, "lo", "hi", ["lo", "hi"], block, n=3, tie=["hi"])
    return found.withColumn(
        "_spans", F.coalesce(F.filter("_refs", lambda s: s["hi"] >= F.col(pos)), F.array())).drop("_refs")


def nearest_distance(points: DataFrame, refs: DataFrame, keys: Sequence[str], p_pos: str, r_pos: str, reach: int,
                     block: int) -> DataFrame:
    """Distance of every point to its nearest ref (``_dist``), null beyond ``reach``."""
    spread = refs.select(*keys, (F.col(r_pos) - reach).alias("_rlo"), (F.col(r_pos) + reach).alias("_rhi"),
                         F.col(r_pos).alias("_rpos")).distinct()
    keys = list(keys)
    r = spread.select(*keys, F.col("_rpos").cast("double").alias("_pos"), F.col("_rpos").cast("double").alias("_ref"),
                      _cover(F.col("_rlo"), F.col("_rhi"), block).alias("_blk"), F.lit(0).alias("_kind"))
    p = points.select(*keys, F.col(p_pos).cast("double").alias("_pos"), block_of(F.col(p_pos), block).alias("_blk"),
                      F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"))
    both = r.unionByName(p, allowMissingColumns=True)
    base = W.partitionBy(*keys, "_blk")
    before = base.orderBy("_pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    after = base.orderBy(F.desc("_pos"), F.asc("_kind")).rowsBetween(W.unboundedPreceding, 0)
    dist = F.least(F.col("_pos") - F.last("_ref", True).over(before), F.last("_ref", True).over(after) - F.col("_pos"))
    return (
        both.withColumn("_dist", dist).filter(F.col("_kind") == 1)
        .select("_point.*", F.when(F.col("_dist") <= reach, F.col("_dist")).alias("_dist"))
    )


def sliding_max(points: DataFrame, probes: DataFrame, keys: Sequence[str], pos: str, value: str, lo: str,
                width: int) -> DataFrame:
    """``probes`` with ``_max``: the largest value at lo <= pos <= lo + width.

    Positions are whole numbers. Blocks are exactly ``width + 1`` long, so each
    probe spans the end of one block and the start of the next, and the maximum
    is that of a running maximum from each side: no pairs, one pass, whatever
    the density.
    """
    keys = list(keys)
    size = width + 1
    v = points.select(*keys, block_of(F.col(pos), size).alias("_blk"), F.col(pos).cast("bigint").alias("_pos"),
                      F.col(value).alias("_v"))
    ends = probes.select(*keys, F.struct(*probes.columns).alias("_probe"), F.explode(
        F.array(F.struct(F.col(lo).cast("bigint").alias("_pos"), F.lit(True).alias("_is_lo")),
                F.struct((F.col(lo) + width).cast("bigint").alias("_pos"), F.lit(False).alias("_is_lo")))).alias("_e"))
    e = ends.select(*keys, "_probe", "_e.*").withColumn("_blk", block_of(F.col("_pos"), size))
    both = v.unionByName(e, allowMissingColumns=True)
    base = W.partitionBy(*keys, "_blk")
    is_probe = F.col("_is_lo").isNotNull().cast("int")
    upto = base.orderBy(F.asc("_pos"), F.asc(is_probe)).rowsBetween(W.unboundedPreceding, 0)
    onward = base.orderBy(F.desc("_pos"), F.asc(is_probe)).rowsBetween(W.unboundedPreceding, 0)
    side = F.when(F.col("_is_lo"), F.max("_v").over(onward)).otherwise(F.max("_v").over(upto))
    return (
        both.withColumn("_side", side).filter(F.col("_is_lo").isNotNull())
        .groupBy(*keys, "_probe").agg(F.max("_side").alias("_max")).select("_probe.*", "_max")
    )


def sliding_counts(points: DataFrame, probes: DataFrame, keys: Sequence[str], pos: str, count: str, value: str, lo: str,
                   width: int) -> DataFrame:
    """Distinct ``probes`` (keys, ``lo``) with ``_n`` and ``_max``: summed counts and largest value at lo <= pos <= lo + width.

    Blocks as in :func:`sliding_max`; where points of one position are added up
    beforehand, a block has ``width`` + 1 of them at most. ``_n`` is 0 where no
    point lies.
    """
    keys = list(keys)
    size = width + 1
    v = points.filter(F.col(pos).isNotNull()).select(*keys, block_of(F.col(pos), size).alias("_blk"), F.col(pos).cast("bigint").alias("_pos"),
                                                     F.col(count).alias("_c"), F.col(value).alias("_v"))
    at = F.col(lo).cast("bigint")
    # a probe that fills its block has one end only
    ends = F.array_compact(F.array(
        F.struct(at.alias("_pos"), F.lit(True).alias("_is_lo")),
        F.when(block_of(at, size) < block_of(at + width, size), F.struct((at + width).alias("_pos"), F.lit(False).alias("_is_lo")))))
    e = probes.filter(F.col(lo).isNotNull()).select(*keys, lo).distinct().select(*keys, lo, F.inline(ends)).withColumn("_blk", block_of(F.col("_pos"), size))
    both = v.unionByName(e, allowMissingColumns=True)
    base = W.partitionBy(*keys, "_blk")
    is_probe = F.col("_is_lo").isNotNull().cast("int")
    upto = base.orderBy(F.asc("_pos"), F.asc(is_probe)).rowsBetween(W.unboundedPreceding, 0)
    onward = base.orderBy(F.desc("_pos"), F.asc(is_probe)).rowsBetween(W.unboundedPreceding, 0)

    def side(of):
        return F.when(F.col("_is_lo"), of.over(onward)).otherwise(of.over(upto))

    return (
        both.select("*", side(F.sum("_c")).alias("_n"), side(F.max("_v")).alias("_max")).filter(F.col("_is_lo").isNotNull())
        .groupBy(*keys, lo).agg(F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("_n"), F.max("_max").alias("_max"))
    )


def halo(df: DataFrame, pos: str, block: int, before: int, after: int) -> DataFrame:
    """Assign rows to position blocks and copy those near an edge to the neighbour.

    Windows over (keys, ``_blk``) then see ``before`` positions back and
    ``after`` ahead of every core row without one task per key. Keep only rows
    with ``_core`` afterwards. ``block`` must be at least as wide as the reach.
    """
    p, own = F.col(pos), block_of(F.col(pos), block)
    copies = F.array_compact(F.array(
        F.struct(own.alias("_blk"), F.lit(True).alias("_core")),
        F.when(block_of(p - after, block) < own, F.struct((own - 1).alias("_blk"), F.lit(False).alias("_core"))),
        F.when(block_of(p + before, block) > own, F.struct((own + 1).alias("_blk"), F.lit(False).alias("_core"))),
    ))
    return df.select("*", F.inline(copies))
