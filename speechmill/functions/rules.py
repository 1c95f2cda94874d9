"""Labels, categories, routing and validation rules as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label -> training category, with hard negatives in their own bucket.
CATEGORY_BY_LABEL = {
    "positive": "positive",
    "false_negative": "positive",
    "negative": "negative",
    "false_positive": "negative",
    "hard_negative": "hard_negative",
    "background": "background",
}
# The coarse map, where hard negatives pool with the negatives.
CATEGORY_BY_LABEL_COARSE = {**CATEGORY_BY_LABEL, "hard_negative": "negative"}

# Script markers of takes that are not read from a script.
BACKGROUND_MARKER = "__background_noise__"
ENERGY_MARKER = "__energy_positive__"

# Capture dimensions of the provenance report.
CAPTURE_TEXT = ["device_manufacturer", "device_model", "os_version", "app_version", "input_route", "session_id"]
CAPTURE_NUMBER = ["source_sample_rate_hz", "source_channels"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, key)


def category(label: Column, coarse: bool = False) -> Column:
    """Training category of a label; null for unknown labels."""
    return _lookup(CATEGORY_BY_LABEL_COARSE if coarse else CATEGORY_BY_LABEL, label)


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def is_safe_slug(value: Column) -> Column:
    return F.coalesce(value.rlike("\\A[a-z0-9][a-z0-9_]*\\z"), F.lit(False))


def is_safe_recording_id(value: Column) -> Column:
    return F.coalesce(value.rlike("\\A[A-Za-z0-9_-]+\\z"), F.lit(False))


def is_safe_run_id(value: Column) -> Column:
    return F.coalesce(value.rlike("\\A[A-Za-z0-9]+\\z"), F.lit(False))


def path_escapes(path: Column) -> Column:
    """True for an absolute path or one with a ``..`` component."""
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def resolved_kind(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("mixed"))


def is_test(recording_id: Column) -> Column:
    # A prefix test, not LIKE: "_" in a LIKE pattern would match any character.
    return F.startswith(recording_id, F.lit("test_"))


def is_background(recording_id: Column) -> Column:
    return F.startswith(recording_id, F.lit("background_"))


def review_bucket(kind: Column) -> Column:
    known = kind.isin("positive", "negative", "hard_negative", "enrollment")
    return F.when(known, kind).otherwise("other")


def expects_positive(kind: Column) -> Column:
    return ~F.trim(kind).isin("negative", "hard_negative")


def runs_negative_pass(kind: Column) -> Column:
    return F.trim(kind) != "positive"


def negative_pass_label(kind: Column) -> Column:
    return F.when(F.trim(kind) == "hard_negative", "hard_negative").otherwise("negative")


def cut_strategy(recording_id: Column, kind: Column, script: Column, word_count: Column,
                 phrase_words: Column) -> Column:
    """How a take is cut. ``word_count`` null means recognition failed."""
    kind = F.trim(kind)
    return (
        F.when(is_test(recording_id), "test")
        .when(kind == "enrollment", "enrollment")
        .when(script == BACKGROUND_MARKER, "background")
        .when((kind == "positive") & (script == ENERGY_MARKER), "energy_forced")
        .when(word_count.isNull(), "warn_recogniser")
        .when((word_count == 0) & (kind == "positive"), "energy_fallback")
        .when(word_count == 0, "warn_no_words")
        .when(phrase_words == 0, "warn_no_phrase")
        .otherwise("lexical")
    )


def capture_text(capture: Column, field: str) -> Column:
    return blank_to_null(capture[field])


def capture_number(capture: Column, field: str) -> Column:
    value = capture[field].cast("bigint")
    return F.when(value > 0, value)


def reasons(*checks: tuple[Column, Column | str]) -> Column:
    """Array with the message of every check that holds."""
    return F.array_compact(
        F.array(*[F.when(hit, msg if isinstance(msg, Column) else F.lit(msg)) for hit, msg in checks])
    )


def spec_warnings(noun: str, channels: Column, bits: Column, rate: Column) -> Column:
    return reasons(
        (channels != 1, F.concat(F.lit(f"expected mono{noun}, got "), channels.cast("string"), F.lit(" channels"))),
        (bits != 16, F.concat(F.lit(f"expected 16-bit PCM{noun}, got "), bits.cast("string"), F.lit(" bits"))),
        (rate != 16000, F.concat(F.lit(f"expected 16000 Hz{noun}, got "), rate.cast("string"))),
    )


def amplitude_warnings(peak: Column, rms: Column, duration_ms: Column) -> Column:
    return reasons(
        (peak >= 32760, F.concat(F.lit("possible clipping, peak="), peak.cast("string"))),
        ((rms < 50.0) & (duration_ms > 0), "very quiet audio"),
    )


def duration_warnings(duration_ms: Column) -> Column:
    return reasons((duration_ms <= 0, "zero duration"), (duration_ms > 5000, "long clip"))


def classify_mistake(label: Column, score: Column, threshold: Column, explicit: Column) -> Column:
    """``false_negative``, ``false_positive`` or null for a right decision.

    An explicit triage wins. A label or score that cannot be judged fails the
    job, as a silently dropped correction would.
    """
    should_fire = F.when(label.isin("positive", "false_negative"), True).when(
        label.isin("negative", "hard_negative", "false_positive", "background"), False)
    fired = score >= threshold
    given = F.nullif(explicit, F.lit(""))
    return (
        F.when(given.isin("false_positive", "false_negative"), given)
        .when(given.isNotNull(), F.raise_error(F.concat(F.lit("unknown mistake "), given)))
        .when(should_fire.isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null")))))
        .when(score.isNull(), F.raise_error(F.lit("missing numeric score")))
        .when(should_fire & ~fired, "false_negative")
        .when(~should_fire & fired, "false_positive")
    )


def take_outcome(has_target: Column, detected: Column) -> Column:
    return (
        F.when(has_target & detected, "caught").when(has_target, "missed")
        .when(detected, "false_alarm").otherwise("quiet")
    )
