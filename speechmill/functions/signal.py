"""Sample-array expressions. One clip is one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import let

# Burst segmentation.
FRAME_SECONDS = 0.02
FLOOR_FRACTION = 0.10
OPEN_FRACTION = 0.22
CLOSE_FRACTION = 0.12
MERGE_GAP_MS = 350.0
MIN_BURST_MS = 80.0
LEAD_PAD_MS = 100.0
TAIL_PAD_MS = 180.0
# Levels.
FULL_SCALE = 32768.0
CLIP_GUARD = 0.99
EPSILON = 1e-8

_RUNS = "array<struct<start:double,end:double>>"


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0))


def energy(samples: Column) -> Column:
    """Sum of squares of whole-number samples."""
    return F.aggregate(samples, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x.cast("bigint"))


def rms(samples: Column) -> Column:
    return let(samples, lambda a: F.coalesce(F.sqrt(F.try_divide(energy(a).cast("double"), F.size(a))), F.lit(0.0)))


def power(samples: Column) -> Column:
    """Mean square of float samples."""
    def mean(a: Column) -> Column:
        return F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x), F.size(a)), F.lit(0.0))

    return let(samples, mean)


def frame_length(rate: Column) -> Column:
    return F.greatest(F.round(F.lit(FRAME_SECONDS) * rate).cast("int"), F.lit(1))


def rms_envelope(samples: Column, frame: Column) -> Column:
    """RMS of consecutive frames; the last one may be short."""
    frames = F.ceil(F.size(samples) / frame).cast("int")
    at = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: rms(F.slice(samples, i * frame + 1, frame)))


def open_close(envelope: Column) -> Column:
    """Struct of the open and close level; null for a flat or empty envelope.

    The floor is the element at index floor(0.1 n) of the sorted frames, not an
    interpolated percentile.
    """
    def edges(e: Column) -> Column:
        at = F.floor(F.size(e) * FLOOR_FRACTION).cast("int")
        return F.struct(F.get(F.sort_array(e), at).alias("floor"), F.array_max(e).alias("top"))

    def levels(x: Column) -> Column:
        floor, top = x["floor"], x["top"]
        return F.when(top - floor >= 1.0, F.struct(
            (floor + F.lit(OPEN_FRACTION) * (top - floor)).alias("open"),
            (floor + F.lit(CLOSE_FRACTION) * (top - floor)).alias("close")))

    return let(let(envelope, edges), levels)


def hysteresis_runs(envelope: Column, open_at: Column, close_below: Column) -> Column:
    """Half-open frame spans that open at ``open_at`` and close below ``close_below``."""
    indexed = F.transform(envelope, lambda e, i: F.struct(e.alias("e"), i.cast("double").alias("i")))
    zero = F.struct(F.lit(-1.0).alias("since"), F.array().cast(_RUNS).alias("out"))

    def step(acc, x):
        closing = (acc["since"] >= 0) & (x["e"] < close_below)
        opening = (acc["since"] < 0) & (x["e"] >= open_at)
        return F.struct(
            F.when(closing, F.lit(-1.0)).when(opening, x["i"]).otherwise(acc["since"]).alias("since"),
            F.when(closing, F.array_append(acc["out"], F.struct(acc["since"].alias("start"), x["i"].alias("end"))))
            .otherwise(acc["out"]).alias("out"))

    def finish(acc):
        tail = F.struct(acc["since"].alias("start"), F.size(envelope).cast("double").alias("end"))
        return F.when(acc["since"] >= 0, F.array_append(acc["out"], tail)).otherwise(acc["out"])

    return F.aggregate(indexed, zero, step, finish)


def merge_and_pad(runs: Column, frame_ms: Column, total_ms: Column) -> Column:
    """Frame runs to padded millisecond spans: merge short gaps, drop short bursts."""
    return let(total_ms, lambda total: _merge_and_pad(runs, frame_ms, total))


def _merge_and_pad(runs: Column, frame_ms: Column, total_ms: Column) -> Column:
    spans = F.transform(runs, lambda r: F.struct(
        (r["start"] * frame_ms).alias("start"), F.least(r["end"] * frame_ms, total_ms).alias("end")))

    def step(out, s):
        last = F.element_at(out, -1)
        joined = F.array_append(F.slice(out, 1, F.size(out) - 1),
                                F.struct(last["start"].alias("start"), s["end"].alias("end")))
        near = (F.size(out) > 0) & (s["start"] - F.try_element_at(out, F.lit(-1))["end"] < MERGE_GAP_MS)
        return F.when(near, joined).otherwise(F.array_append(out, s))

    merged = F.aggregate(spans, F.array().cast(_RUNS), step)
    kept = F.filter(merged, lambda s: s["end"] - s["start"] >= MIN_BURST_MS)
    return F.transform(kept, lambda s: F.struct(
        F.greatest(s["start"] - LEAD_PAD_MS, F.lit(0.0)).alias("start"),
        F.least(s["end"] + TAIL_PAD_MS, total_ms).alias("end")))


def total_ms(samples: Column, rate: Column) -> Column:
    return F.size(samples) * 1000.0 / rate


def cut(samples: Column, rate: Column, start_ms: Column, end_ms: Column) -> Column:
    """Samples of a span: start floored, end ceiled; null where none remain."""
    first = F.greatest(F.floor(start_ms * rate / 1000.0), F.lit(0)).cast("int")
    last = F.greatest(F.ceil(end_ms * rate / 1000.0), first).cast("int")
    return F.when(last > first, F.slice(samples, first + 1, last - first))


def to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / F.lit(FULL_SCALE))


def scale_to_peak(samples: Column, target: float) -> Column:
    """Scale so that the highest magnitude is ``target``; silence stays as it is."""
    def scaled(a: Column) -> Column:
        return let(peak(a), lambda top: F.when(top < EPSILON, a).otherwise(F.transform(a, lambda x: x * (F.lit(target) / top))))

    return let(samples, scaled)


def guard_clipping(samples: Column) -> Column:
    def guarded(a: Column) -> Column:
        return let(peak(a), lambda top: F.when(top > CLIP_GUARD, F.transform(a, lambda x: x * (F.lit(CLIP_GUARD) / top))).otherwise(a))

    return let(samples, guarded)


def fade_edges(samples: Column, fade: int) -> Column:
    """Raised-cosine fade in and out; clips shorter than two fades are left alone."""
    if fade <= 0:
        return samples
    step = 3.141592653589793 / max(fade - 1, 1)

    def ramp(i: Column) -> Column:
        return F.lit(0.5) * (F.lit(1.0) - F.cos(i * step))

    def faded(a: Column) -> Column:
        n = F.size(a)
        return F.when(n < 2 * fade, a).otherwise(
            F.transform(a, lambda x, i: x * F.when(i < fade, ramp(i)).when(i >= n - fade, ramp(n - 1 - i)).otherwise(1.0)))

    return let(samples, faded)


def loop_to(samples: Column, length: Column, start: Column) -> Column:
    """A bed of exactly ``length`` samples: repeated while short, cut at ``start``."""
    def looped(a: Column) -> Column:
        reps = F.when(F.size(a) < length, F.floor(length / F.size(a)).cast("int") + 1).otherwise(1)
        return F.slice(F.flatten(F.array_repeat(a, reps)), start + 1, length)

    return let(samples, looped)


def snr_scale(voice_power: Column, bed_power: Column, snr_db: Column) -> Column:
    return F.sqrt((voice_power + EPSILON) / ((bed_power + EPSILON) * F.pow(F.lit(10.0), snr_db / 10.0)))


def mix(samples: Column, bed: Column, scale: Column) -> Column:
    return let(scale, lambda s: F.zip_with(samples, bed, lambda x, y: x + s * y))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))


def align_to_end(samples: Column, length: int, jitter: Column) -> Column:
    """Tail-aligned in a window of ``length``, ending ``jitter`` samples early."""
    def aligned(a: Column) -> Column:
        end = F.lit(length) - jitter
        kept = F.least(F.size(a), end)
        return F.concat(zeros(end - kept), F.slice(a, F.size(a) - kept + 1, kept), zeros(jitter))

    return let(samples, aligned)


def center_fit(samples: Column, length: int) -> Column:
    """Centre-padded or centre-cropped to ``length``."""
    def fitted(a: Column) -> Column:
        n = F.size(a)
        left = F.floor((F.lit(length) - n) / 2).cast("int")
        padded = F.concat(zeros(left), a, zeros(F.lit(length) - n - left))
        cropped = F.slice(a, F.floor((n - length) / 2).cast("int") + 1, length)
        return F.when(n < length, padded).when(n > length, cropped).otherwise(a)

    return let(samples, fitted)


def head_fit(samples: Column, length: int) -> Column:
    """Cut or zero-padded at the end to ``length``."""
    return let(samples, lambda a: F.concat(F.slice(a, 1, length), zeros(F.lit(length) - F.size(a))))


def scan_ends(n: Column, step: int) -> Column:
    """End positions of a scan: every ``step`` samples, the last one clamped to ``n``."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(step), n + step - 1, F.lit(step)), lambda e: F.least(e, n))).otherwise(
        F.array().cast("array<int>"))


def reset_window(samples: Column, end: Column, keep: int, width: int) -> Column:
    """The last ``keep`` samples before ``end``, left-padded with silence to ``width``."""
    first = F.greatest(end - min(keep, width), F.lit(0))
    part = F.slice(samples, first + 1, end - first)
    return F.concat(zeros(F.lit(width) - F.size(part)), part)
