"""Numbering, top-n and latest-row operators that do not need one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text

ORDER_BLOCK = 10_000


def ordered_index(df: DataFrame, keys: Sequence[str], order: str, block: int = ORDER_BLOCK) -> DataFrame:
    """Add ``rn`` (0-based rank by the whole-number ``order``) and group size ``n``.

    Rows are numbered inside order blocks; a running sum over the block counts
    gives the offsets. Only counts meet per group.
    """
    keys = list(keys)
    blocked = df.withColumn("_ob", F.floor(F.col(order) / block).cast("bigint"))
    inner = blocked.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_ob").orderBy(order)))
    counts = blocked.groupBy(*keys, "_ob").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy(*keys).orderBy("_ob")
    offsets = counts.select(
        *keys, "_ob", (F.sum("_c").over(upto.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_off"),
        F.sum("_c").over(W.partitionBy(*keys)).alias("n"))
    return inner.join(offsets, [*keys, "_ob"]).withColumn("rn", F.col("_off") + F.col("_in") - 1).drop("_ob", "_in", "_off")


def hashed_index(df: DataFrame, row_id: str, buckets: int = 1024) -> DataFrame:
    """Add a dense ``rn`` over all rows, in hash order of ``row_id``, and the total ``n``.

    Two levels of hash buckets: rows are numbered inside a small bucket, small
    buckets inside one of ``buckets`` large ones, and those over all. No step
    sorts more than ``buckets`` counts or one in ``buckets`` squared of the rows.
    """
    hashed = F.xxhash64(row_id)
    blocked = df.withColumn("_hb", F.pmod(hashed, F.lit(buckets))).withColumn("_hs", F.pmod(F.xxhash64(hashed), F.lit(buckets)))
    inner = blocked.withColumn("_in", F.row_number().over(W.partitionBy("_hb", "_hs").orderBy(row_id)))
    counts = blocked.groupBy("_hb", "_hs").agg(F.count(F.lit(1)).alias("_c"))

    def before(w):
        return F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")

    small = counts.withColumn("_so", before(W.partitionBy("_hb").orderBy("_hs"))).select("_hb", "_hs", "_so")
    # At most `buckets` rows reach this unpartitioned window.
    large = counts.groupBy("_hb").agg(F.sum("_c").alias("_c")).select(
        "_hb", before(W.orderBy("_hb")).alias("_off"), F.sum("_c").over(W.partitionBy()).alias("n"))
    return (inner.join(small, ["_hb", "_hs"]).join(large, "_hb")
            .withColumn("rn", F.col("_off") + F.col("_so") + F.col("_in") - 1).drop("_hb", "_hs", "_in", "_off", "_so"))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, salt_on: str, salts: int = 64) -> DataFrame:
    """The first ``n`` rows per group: cut to ``n`` per salted part, then per group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    part = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_r") <= n)
    whole = part.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n)
    return whole.withColumnRenamed("_r", "rank").drop("_salt")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per group by ``order``, as an aggregate with a map-side part."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def even_sample(df: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """At most ``size`` rows per group, evenly spaced: indices floor(i * total / size)."""
    indexed = ordered_index(df, keys, order)
    # rn is wanted iff some i < size has floor(i * n / size) = rn.
    i = F.ceil(F.col("rn") * size / F.col("n"))
    wanted = (i < size) & (F.floor(i * (F.col("n") / F.lit(float(size)))) == F.col("rn"))
    return indexed.filter((F.col("n") <= size) | wanted)


def rotating_references(refs: DataFrame, key: str, order: str, sets: int, per_set: int) -> DataFrame:
    """Reference windows: set i takes the references (i * per_set + j) mod n."""
    indexed = ordered_index(refs, [key], order)
    plan = indexed.select(key, "n").distinct().select(
        key, "n", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set_idx"))
    plan = plan.select(key, "set_idx", "n", F.explode(F.sequence(F.lit(0), F.lit(per_set - 1))).alias("slot"))
    plan = plan.withColumn("rn", F.pmod(F.col("set_idx") * per_set + F.col("slot"), F.col("n")))
    return plan.drop("n").join(indexed, [key, "rn"])


def take_until(refs: DataFrame, key: str, order: str, seconds: str, start: int, target: float) -> DataFrame:
    """Consecutive references from ``start`` (wrapping) until their time reaches ``target``.

    At least one is taken (with a positive target) and none twice. Whole blocks
    are decided by their running total first, so only block sums meet per key.
    """
    indexed = ordered_index(refs, [key], order)
    turned = indexed.withColumn("_at", F.pmod(F.col("rn") - start, F.col("n"))).withColumn(
        "_tb", F.floor(F.col("_at") / ORDER_BLOCK))
    w = W.partitionBy(key, "_tb").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    inner = turned.withColumn("_before", F.coalesce(F.sum(seconds).over(w), F.lit(0.0)))
    sums = turned.groupBy(key, "_tb").agg(F.sum(seconds).alias("_s"))
    wb = W.partitionBy(key).orderBy("_tb").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(key, "_tb", F.coalesce(F.sum("_s").over(wb), F.lit(0.0)).alias("_off"))
    taken = inner.join(offsets, [key, "_tb"]).filter(F.col("_off") + F.col("_before") < target)
    return taken.withColumn("slot", F.col("_at")).drop("_at", "_tb", "_before", "_off", "rn", "n")


def interleave(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Alternate two slotted lists per key; the longer one's tail follows.

    Ordering positions are computed from the slots, no list is collected.
    """
    sizes = [d.groupBy(key).agg(F.count(F.lit(1)).alias(c)) for d, c in ((first, "_na"), (second, "_nb"))]
    n = sizes[0].join(sizes[1], key, "full").select(
        key, F.least(F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))).alias("_m"))
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    slot = F.col("slot")
    pos = F.when(slot < F.col("_m"), slot * 2 + F.col("_side")).otherwise(F.col("_m") + slot)
    return both.join(n, key).withColumn("position", pos).drop("_m", "_side", "slot")


def progress(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Stage, percent and label a training log has reached, per run.

    The stage only moves forward: the final one is the highest stage seen, and
    its percent and label are the last ones given on lines of that stage. Two
    aggregates, no ordered scan of the log.
    """
    parsed = lines.select(
        key, F.col(pos).alias("_p"), text.line_step(F.col(line)).alias("step"),
        text.last_percent(F.col(line)).alias("_pct"), text.progress_label(F.col(line)).alias("_lab"))
    staged = parsed.filter("step IS NOT NULL").groupBy(key, "step").agg(
        F.max_by("_pct", F.when(F.col("_pct").isNotNull(), F.col("_p"))).alias("_pct"),
        F.max_by("_lab", F.when(F.col("_lab") != "", F.col("_p"))).alias("_lab"))
    last = staged.groupBy(key).agg(F.max(F.struct("step", "_pct", "_lab")).alias("_m"))
    return lines.select(key).distinct().join(last, key, "left").select(
        key, F.coalesce("_m.step", F.lit(0)).alias("step"), F.coalesce("_m._pct", F.lit(0)).cast("bigint").alias("percent"),
        F.coalesce("_m._lab", F.lit("")).alias("label"))
