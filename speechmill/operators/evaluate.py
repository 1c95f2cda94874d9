"""Grading of score curves against phrase targets.

Ticks are (recording_id, model, t_ms, seq, score); targets are phrase tails
(recording_id, target_id, end_ms). Every step shuffles ticks by (recording,
time block) at most once and never pairs ticks with targets beyond those a
tick really touches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import rules
from ..functions.arrow import whole_groups
from .islands import runs
from .joins import _cover, block_of, containing_spans, halo, last_refs, nearest_distance, sliding_max

REC = "recording_id"
KEYS = [REC, "model"]
# Drift of a detection against its word time, in milliseconds.
MAX_DRIFT_MS = 1200
# The model comparison's hit window and false-fire distance.
PRE_MS, POST_MS, FALSE_GAP_MS = 600, 500, 700
MODEL_ONLY_PEAK = 0.90
# Fixed value: a batch with a larger share of failed checks is kept whole.
GATE_MAX_REJECT = 0.8

BLOCK = 20_000


def target_bands(targets: DataFrame) -> DataFrame:
    """Search band of each target: end +- 1200 ms, clamped to neighbour midpoints.

    A neighbour more than twice the drift away cannot clamp, so a halo of
    2400 ms is enough and no take is ordered as a whole.
    """
    reach = 2 * MAX_DRIFT_MS
    w = W.partitionBy(REC, "_blk").orderBy("end_ms", "target_id")
    end = F.col("end_ms").cast("double")
    lo = F.greatest(end - MAX_DRIFT_MS, F.coalesce((F.lag(end).over(w) + end) / 2.0, end - MAX_DRIFT_MS), F.lit(0.0))
    hi = F.least(end + MAX_DRIFT_MS, F.coalesce((end + F.lead(end).over(w)) / 2.0, end + MAX_DRIFT_MS))
    return (
        halo(targets, "end_ms", BLOCK, reach, reach).withColumn("lo", lo).withColumn("hi", hi)
        .filter("_core").drop("_core", "_blk")
    )


def mark_bands(ticks: DataFrame, bands: DataFrame) -> DataFrame:
    """Ticks with the bands they lie in (``_spans``)."""
    return containing_spans(ticks, bands, [REC], "t_ms", "lo", "hi", BLOCK)


def with_models(bands: DataFrame, ticks: DataFrame) -> DataFrame:
    """Each band once per model that scored its take."""
    return bands.join(ticks.select(REC, "model").distinct(), REC)


def target_peaks(ticks: DataFrame, bands: DataFrame, threshold: float) -> DataFrame:
    """Peak score, its time and the detected flag of every target and model.

    The last of equal scores wins. An empty band peaks at 0, at its start.
    """
    best = (
        mark_bands(ticks, bands).select(*KEYS, "t_ms", "seq", "score", F.explode("_spans").alias("_s"))
        .groupBy(*KEYS, F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi"))
        .agg(F.max(F.struct("score", "t_ms", "seq")).alias("_best"))
    )
    joined = with_models(bands, ticks).join(best, [*KEYS, "lo", "hi"], "left")
    return joined.withColumn("peak_score", F.greatest(F.coalesce("_best.score", F.lit(0.0)), F.lit(0.0))).withColumn(
        "peak_ms", F.coalesce(F.col("_best.t_ms").cast("double"), F.greatest("lo", F.lit(0.0)))).withColumn(
        "detected", F.col("peak_score") >= threshold).drop("_best")


def false_positive_runs(ticks: DataFrame, bands: DataFrame, threshold: float) -> DataFrame:
    """Hot runs outside all bands; a tick inside a band ends the run."""
    marked = mark_bands(ticks, bands)
    stray = (F.col("score") >= threshold) & (F.size("_spans") == 0)
    return runs(marked, KEYS, "t_ms", "seq", BLOCK, value=stray, score="score").filter("value").drop("value", "next_start")


def take_grades(ticks: DataFrame, bands: DataFrame, threshold: float) -> DataFrame:
    """One grade per take and model: peak, hits, misses and false positives."""
    curve = ticks.groupBy(*KEYS).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("max_score"))
    located = target_peaks(ticks, bands, threshold).groupBy(*KEYS).agg(
        F.max("peak_score").alias("_peak"), F.count(F.lit(1)).alias("target_count"),
        F.count_if("detected").alias("true_positives"))
    stray = false_positive_runs(ticks, bands, threshold).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("false_positives"))
    zero = F.lit(0).cast("bigint")
    out = curve.join(located, KEYS, "left").join(stray, KEYS, "left")
    peak = F.when(F.col("target_count").isNotNull(), F.greatest("_peak", F.lit(0.0))).otherwise(F.col("max_score"))
    return out.select(
        *KEYS, "max_score", peak.alias("peak_score"), F.col("target_count").isNotNull().alias("has_target"),
        F.coalesce("target_count", zero).alias("target_count"), F.coalesce("true_positives", zero).alias("true_positives"),
        (F.coalesce("target_count", zero) - F.coalesce("true_positives", zero)).alias("false_negatives"),
        F.coalesce("false_positives", zero).alias("false_positives"), (peak >= threshold).alias("detected"),
    ).withColumn("outcome", rules.take_outcome(F.col("has_target"), F.col("detected")))


def grade_totals(grades: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return grades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("graded"), F.sum("target_count").alias("targets"), F.sum("true_positives").alias("true_positives"),
        F.sum("false_negatives").alias("false_negatives"), F.sum("false_positives").alias("false_positives"),
        F.count_if("detected").alias("detections"))


def fire_events(ticks: DataFrame, threshold: float, window_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Detection events: hot ticks widened by half a window, touching ones merged.

    The first of equal peaks wins; an event does not start before 0.
    """
    half = window_ms / 2.0
    found = runs(ticks.filter(F.col("score") >= threshold), keys, "t_ms", "seq", BLOCK, gap=window_ms, score="score")
    return found.select(*keys, F.greatest(F.col("start") - half, F.lit(0.0)).alias("start_ms"),
                        (F.col("end") + half).alias("end_ms"), F.col("peak_at").alias("peak_ms"), "peak", "n")


def detected_flags(events: DataFrame, bands: DataFrame) -> DataFrame:
    """Bands (already per model) with ``detected``: an event touches the band.

    Events of one curve are disjoint, so the last one that starts by the band's
    end reaches furthest and decides.
    """
    refs = events.withColumn("_until", F.col("end_ms") + 2 * MAX_DRIFT_MS)
    found = last_refs(bands, refs.withColumnRenamed("end_ms", "_event_end"), KEYS, "hi", "start_ms", "_until", ["_event_end"], BLOCK)
    return found.withColumn("detected", F.coalesce(F.get("_refs", F.lit(0))["_event_end"] >= F.col("lo"), F.lit(False))).drop(
        "_refs", "_blk")


def stray_events(events: DataFrame, bands: DataFrame) -> DataFrame:
    """Events with ``near_target``: some band touches the event.

    A long event is tested block by block, so bands reach one block ahead only.
    """
    pieces = events.select("*", _cover(F.col("start_ms"), F.col("end_ms"), BLOCK).alias("_b")).withColumn(
        "_ps", F.greatest("start_ms", F.col("_b").cast("double") * BLOCK)).withColumn(
        "_pe", F.least("end_ms", (F.col("_b").cast("double") + 1) * BLOCK)).drop("_b")
    spans = bands.select(REC, "lo", "hi").distinct().withColumn("_until", F.col("hi") + BLOCK)
    found = last_refs(pieces, spans, [REC], "_pe", "lo", "_until", ["hi"], BLOCK, tie=["hi"])
    touch = F.coalesce(F.get("_refs", F.lit(0))["hi"] >= F.col("_ps"), F.lit(False))
    return found.groupBy(*events.columns).agg(F.max(touch).alias("near_target"))


def tally(ticks: DataFrame, bands: DataFrame, threshold: float, window_ms: int) -> DataFrame:
    """Detected and missed targets; stray events split into model-only and false alarms."""
    events = fire_events(ticks, threshold, window_ms)
    hit = detected_flags(events, with_models(bands, ticks)).groupBy(*KEYS).agg(
        F.count_if("detected").alias("detected"), F.count_if(~F.col("detected")).alias("missed"))
    stray = stray_events(events, bands).filter(~F.col("near_target")).groupBy(*KEYS).agg(
        F.count_if(F.col("peak") >= MODEL_ONLY_PEAK).alias("model_only"), F.count_if(F.col("peak") < MODEL_ONLY_PEAK).alias("false_alarms"))
    base = ticks.select(*KEYS).distinct().join(hit, KEYS, "left").join(stray, KEYS, "left")
    zero = F.lit(0).cast("bigint")
    return base.select(*KEYS, *[F.coalesce(c, zero).alias(c) for c in ("detected", "missed", "model_only", "false_alarms")])


def threshold_sweep(ticks: DataFrame, bands: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Hits and false-positive runs of a stored curve at many thresholds in one pass.

    A run starts where a stray hot tick follows one that is not. Inside a block
    that is a lag; the first tick of a block is settled against the last one of
    the block before, in a window over block summaries.
    """
    marked = mark_bands(ticks, bands).withColumn("_far", F.size("_spans") == 0)
    w = W.partitionBy(*KEYS, "_blk").orderBy("t_ms", "seq")
    here = F.struct("score", F.col("_far").alias("far"))
    lagged = marked.select(*KEYS, "_blk", "t_ms", "seq", here.alias("_c"), F.lag(here).over(w).alias("_p"))

    def hot(c, tau):
        return c["score"] >= F.lit(tau), c["far"]

    def starts(prev, cur, tau):
        a, b = hot(cur, tau)
        pa, pb = hot(prev, tau)
        return a & b & ~F.coalesce(pa & pb, F.lit(False))

    inner = [F.count_if(F.col("_p").isNotNull() & starts(F.col("_p"), F.col("_c"), t)).alias(f"_n{i}") for i, t in enumerate(thresholds)]
    blocks = lagged.groupBy(*KEYS, "_blk").agg(
        F.min_by("_c", F.struct("t_ms", "seq")).alias("_first"), F.max_by("_c", F.struct("t_ms", "seq")).alias("_last"), *inner)
    before = F.lag("_last").over(W.partitionBy(*KEYS).orderBy("_blk"))
    blocks = blocks.withColumn("_before", before)
    sums = [F.sum(F.col(f"_n{i}") + starts(F.col("_before"), F.col("_first"), t).cast("bigint")).alias(f"_f{i}") for i, t in enumerate(thresholds)]
    fires = blocks.groupBy(*KEYS).agg(*sums)
    peaks = target_peaks(ticks, bands, 0.0).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_t"), *[F.count_if(F.col("peak_score") >= t).alias(f"_h{i}") for i, t in enumerate(thresholds)])
    zero = F.lit(0).cast("bigint")
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce("_t", zero).alias("targets"),
                              F.coalesce(f"_h{i}", zero).alias("hits"), F.col(f"_f{i}").alias("false_positives"))
                     for i, t in enumerate(thresholds)])
    return fires.join(peaks, KEYS, "left").select(*KEYS, F.inline(rows))


def window_sweep(ticks: DataFrame, threshold: float, windows: Sequence[int]) -> DataFrame:
    """Event count and fired time for several pooling windows of one curve."""
    return sweep_grid(ticks, [threshold], windows).drop("threshold")


def sweep_grid(ticks: DataFrame, thresholds: Sequence[float], windows: Sequence[int]) -> DataFrame:
    """Event count and fired time for every threshold with every pooling window.

    An event ends at a gap wider than the window, so all cells follow from the
    gaps between neighbouring hot ticks. Inside a block of a curve, sorted once,
    the thresholds are taken in rising order: the ticks that the next one drops
    leave the list and the gaps around them merge. Each threshold leaves one row
    per block: its first and last tick and, per window, number and sum of the gaps
    that the window bridges. The gaps between blocks are added from these rows.
    """
    levels, widths = sorted(set(map(float, thresholds))), sorted(set(windows))
    cleared = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda t: F.col("score") >= t))
    hot = ticks.select(*KEYS, block_of(F.col("t_ms"), BLOCK).alias("_blk"), F.col("t_ms").cast("double").alias("t_ms"), "seq", cleared.alias("_level")).filter("_level > 0")
    placed = hot.repartition(*KEYS, "_blk").sortWithinPartitions(*KEYS, "_blk", "t_ms", "seq").drop("seq")
    keys = [*KEYS, "_blk"]
    schema = T.StructType([*hot.select(*keys).schema.fields, T.StructField("_level", T.IntegerType()), T.StructField("_first", T.DoubleType()),
                           T.StructField("_last", T.DoubleType()), T.StructField("_n", T.LongType()),
                           T.StructField("_joined", T.ArrayType(T.LongType())), T.StructField("_span", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    edges = np.array(widths, dtype=np.float64)

    def merged(batches):
        for group in whole_groups(batches, keys):
            t, level = group.column("t_ms").to_numpy(), group.column("_level").to_numpy()
            rows = []
            for k in range(1, int(level.max()) + 1):
                t, level = t[level >= k], level[level >= k]
                gap = np.diff(t)
                at = np.searchsorted(edges, gap)  # the narrowest window that bridges the gap
                joined = np.cumsum(np.bincount(at, minlength=len(edges) + 1)[:-1])
                span = np.cumsum(np.bincount(at, weights=gap, minlength=len(edges) + 1)[:-1])
                rows.append((k, t[0], t[-1], len(t), joined.tolist(), span.tolist()))
            names = [pa.array([group.column(c)[0].as_py()] * len(rows), f.type) for c, f in zip(keys, arrow)]
            yield pa.RecordBatch.from_arrays([*names, *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[len(keys):])]], schema=arrow)

    blocks = placed.mapInArrow(merged, schema)
    w = W.partitionBy(*KEYS, "_level").orderBy("_blk")
    gap = F.col("_first") - F.lag("_last").over(w)
    cells = blocks.withColumn("_gap", gap).select(*KEYS, "_level", "_n", "_gap", F.posexplode(F.arrays_zip("_joined", "_span")).alias("_w", "_c")).withColumn(
        "window_ms", F.element_at(F.array(*[F.lit(x) for x in widths]), F.col("_w") + 1))
    bridged = F.coalesce(F.col("_gap") <= F.col("window_ms"), F.lit(False))
    sums = cells.groupBy(*KEYS, "_level", "window_ms").agg(
        (F.sum("_n") - F.sum(F.col("_c._joined") + bridged.cast("bigint"))).alias("events"),
        F.sum(F.col("_c._span") + F.when(bridged, F.col("_gap")).otherwise(0.0)).alias("_spans"))
    return sums.select(*KEYS, F.element_at(F.array(*[F.lit(x) for x in levels]), F.col("_level")).alias("threshold"), "window_ms", "events",
                       (F.col("_spans") + F.col("events") * F.col("window_ms")).cast(ticks.schema["t_ms"].dataType).alias("fired_ms"))


def account(ticks: DataFrame, targets: DataFrame, threshold: float, pre: int = PRE_MS, post: int = POST_MS,
            gap: int = FALSE_GAP_MS) -> DataFrame:
    """The comparison script's counting per take and model.

    A target is hit when the best score from ``pre`` before to ``post`` after
    its end clears the threshold. A hot run is a false fire when its (first)
    peak is at least ``gap`` from every target end; runs count whole, bands do
    not end them. Windows may overlap here, hence the running-maximum form.
    """
    models = ticks.select(*KEYS).distinct()
    probes = targets.select(REC, "target_id", (F.col("end_ms") - pre).alias("_lo")).join(models, REC)
    peaks = sliding_max(ticks, probes, KEYS, "t_ms", "score", "_lo", pre + post).withColumn(
        "peak", F.coalesce("_max", F.lit(0.0)))
    hits = peaks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("peak") >= threshold).alias("hits"),
                                    F.sum("peak").alias("peak_sum"))
    fired = runs(ticks, KEYS, "t_ms", "seq", BLOCK, value=F.col("score") >= threshold, score="score").filter("value")
    far = nearest_distance(fired, targets.select(REC, F.col("end_ms").alias("_te")), [REC], "peak_at", "_te", gap, BLOCK)
    false = far.groupBy(*KEYS).agg(F.count_if(F.coalesce(F.col("_dist") >= gap, F.lit(True))).alias("false_fires"))
    zero = F.lit(0).cast("bigint")
    out = models.join(hits, KEYS, "left").join(false, KEYS, "left")
    return out.select(*KEYS, F.coalesce("targets", zero).alias("targets"), F.coalesce("hits", zero).alias("hits"),
                      F.coalesce("false_fires", zero).alias("false_fires"), F.coalesce("peak_sum", F.lit(0.0)).alias("peak_sum"))


def model_comparison(accounts: DataFrame) -> DataFrame:
    """Per model and per (model, take): recall, false fires, mean peak; 0 without targets."""
    rolled = accounts.rollup("model", REC).agg(
        F.sum("targets").alias("targets"), F.sum("hits").alias("hits"), F.sum("false_fires").alias("false_fires"),
        F.sum("peak_sum").alias("_p")).filter("model IS NOT NULL")
    return rolled.select(
        "model", F.coalesce(REC, F.lit("(all)")).alias(REC), "targets", "hits", "false_fires",
        F.coalesce(F.try_divide(F.col("hits") * 100.0, F.col("targets")), F.lit(0.0)).alias("recall_pct"),
        F.coalesce(F.try_divide(F.col("_p"), F.col("targets")), F.lit(0.0)).alias("mean_peak"))


def corrections(scored: DataFrame, threshold: float | None, coarse: bool = True) -> DataFrame:
    """Mistakes as correction records; right decisions drop out.

    An explicit ``threshold`` wins over the batch's own; having neither fails.
    """
    own = F.col("threshold") if "threshold" in scored.columns else F.lit(None).cast("double")
    used = F.coalesce(F.lit(threshold).cast("double"), own)
    used = F.when(used.isNotNull(), used).otherwise(F.raise_error(F.lit("no threshold given")).cast("double"))
    out = scored.withColumn("threshold", used)
    out = out.withColumn("mistake_label", rules.classify_mistake(F.col("label"), F.col("score"), F.col("threshold"), F.col("mistake")))
    return out.filter("mistake_label IS NOT NULL").withColumn("category", rules.category(F.col("mistake_label"), coarse))


def batch_gate(clips: DataFrame, batch: str) -> DataFrame:
    """Drop clips whose check failed, unless over 80 % of their batch failed.

    ``passed`` null means the check did not run; such clips stay. The batch
    share is an aggregate joined back, not a window over the batch.
    """
    share = clips.groupBy(batch).agg(
        F.try_divide(F.count_if(~F.col("passed")), F.count("passed")).alias("_fail"))
    trusted = F.coalesce(F.col("_fail"), F.lit(0.0)) <= GATE_MAX_REJECT
    return clips.join(share, batch).filter(~(trusted & F.coalesce(~F.col("passed"), F.lit(False)))).drop("_fail")


def locate_targets(occurrences: DataFrame, ticks: DataFrame, threshold: float) -> DataFrame:
    """Phrase occurrences of the transcripts with their peak in each model's curve.

    ``occurrences`` are the non-overlapping phrase hits (recording_id, first,
    start_ms, end_ms); the first word's ordinal identifies a target in its take.
    """
    targets = occurrences.select(REC, F.col("first").alias("target_id"), "start_ms", "end_ms")
    return target_peaks(ticks, target_bands(targets), threshold)


def locate_near(occurrences: DataFrame, threshold: float) -> DataFrame:
    """:func:`locate_targets` for one curve whose ticks near each occurrence came with it.

    ``ticks`` holds (score, t_ms, seq) of all ticks within the drift of ``end_ms``, so
    only occurrences are moved, to meet their neighbours.
    """
    bands = target_bands(occurrences.withColumnRenamed("first", "target_id"))
    best = F.array_max(F.filter("ticks", lambda t: (t["t_ms"] >= F.col("lo")) & (t["t_ms"] <= F.col("hi"))))
    rows = bands.withColumn("_best", best)
    peak = F.greatest(F.coalesce("_best.score", F.lit(0.0)), F.lit(0.0))
    at = F.coalesce(F.col("_best.t_ms").cast("double"), F.greatest("lo", F.lit(0.0)))
    return rows.select(REC, "target_id", peak.alias("peak_score"), at.alias("peak_ms"), (peak >= threshold).alias("detected"))
