"""Clip compositing as joins of clips with hash-drawn beds and fillers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal as sg
from ..functions.draws import pick, uniform
from ..session import settled
from .ranking import hashed_index


@dataclass(frozen=True)
class CompositeSettings:
    """Knobs of a composited window. The defaults are fixed values."""

    rate: int = 16000
    window_ms: int = 2000
    token_at_end: bool = True
    lead_probability: float = 0.7
    real_lead_fraction: float = 0.5
    synthetic_lead: bool = True
    max_lead_ms: int = 900
    lead_gap_ms: tuple[int, int] = (40, 300)
    margin_ms: tuple[int, int] = (100, 700)
    snr_db: tuple[float, float] = (0.0, 18.0)
    voice_peak: float = 0.7
    fade_ms: float = 6.0
    seed: int = 0

    def samples(self, ms: float) -> int:
        return int(ms / 1000.0 * self.rate)


def pair_drawn(clips: DataFrame, pool: DataFrame, clip_id: str, pool_id: str, seed: int, purpose: str,
               only: Column | None = None) -> DataFrame:
    """Join each clip with one row of ``pool``, drawn by hash; left join.

    Ids are paired first: the pool's ids get a dense number through bucket
    counts, so the pairing is an equi-join on it, evenly spread however the ids
    look. The samples then follow once, and a clip that draws nothing meets no
    empty key.
    """
    numbered = settled(hashed_index(pool.select(pool_id), pool_id), "pool")  # numbered once, read twice
    total = numbered.agg(F.max("n")).scalar()  # scalar subquery, one value
    wanted = clips.filter(only) if only is not None else clips
    drawn = wanted.select(clip_id, pick(F.col(clip_id), seed, purpose, total).alias("_rn")).distinct().filter("_rn IS NOT NULL")
    pairs = drawn.join(numbered.select(F.col("rn").alias("_rn"), pool_id), "_rn").drop("_rn")
    return clips.join(pairs.join(pool, pool_id), clip_id, "left")


def _jitter(key: Column, cfg: CompositeSettings, purpose: str, low_ms: float, high_ms: float) -> Column:
    low, high = cfg.samples(low_ms), cfg.samples(high_ms)
    return (F.lit(low) + pick(key, cfg.seed, purpose, F.lit(high - low + 1))).cast("int")


def crop_filler(samples: Column, key: Column, cfg: CompositeSettings) -> Column:
    limit = cfg.samples(cfg.max_lead_ms)
    start = pick(key, cfg.seed, "filler_at", F.greatest(F.size(samples) - limit, F.lit(0)) + 1).cast("int")
    return sg.fade_edges(F.slice(samples, start + 1, limit), cfg.samples(cfg.fade_ms))


def compose(clips: DataFrame, beds: DataFrame, real_fillers: DataFrame, synth_fillers: DataFrame,
            cfg: CompositeSettings) -> DataFrame:
    """Composite windows: filler, gap and phrase on one continuous bed.

    ``clips(clip_id, samples)``, ``beds(bed_id, bed)``, ``*_fillers(filler_id,
    filler)``; samples are floats. The phrase lies at the window's end (or
    start), an overlong voice keeps the phrase side, and the bed level is set
    against the placed voice only. Returns clip_id, window and the draws used.
    """
    key, length = F.col("clip_id"), cfg.samples(cfg.window_ms)
    fade = cfg.samples(cfg.fade_ms)
    with_lead = uniform(key, cfg.seed, "lead") < cfg.lead_probability
    real = uniform(key, cfg.seed, "real") < cfg.real_lead_fraction
    if not cfg.synthetic_lead:
        real = F.lit(True)
    c = clips.withColumn("_lead", with_lead).withColumn("_real", real)
    c = pair_drawn(c, real_fillers.select("filler_id", F.col("filler").alias("_fr")), "clip_id", "filler_id", cfg.seed,
                   "real_filler", F.col("_lead")).drop("filler_id")
    c = pair_drawn(c, synth_fillers.select("filler_id", F.col("filler").alias("_fs")), "clip_id", "filler_id", cfg.seed,
                   "synth_filler", F.col("_lead")).drop("filler_id")
    # The other source stands in where the preferred one is empty.
    chosen = F.when(F.col("_real"), F.coalesce("_fr", "_fs")).otherwise(F.coalesce("_fs", "_fr"))
    c = c.withColumn("_filler", crop_filler(chosen, key, cfg)).drop("_fr", "_fs")
    c = pair_drawn(c, beds, "clip_id", "bed_id", cfg.seed, "bed")
    phrase = sg.fade_edges(F.col("samples"), fade)
    gap = sg.zeros(_jitter(key, cfg, "gap", *cfg.lead_gap_ms))
    joined = F.concat(F.col("_filler"), gap, phrase) if cfg.token_at_end else F.concat(phrase, gap, F.col("_filler"))
    voice = F.when(F.col("_filler").isNotNull(), joined).otherwise(phrase)
    c = c.withColumn("_voice", sg.scale_to_peak(voice, cfg.voice_peak))
    n = F.size("_voice")
    margin = F.least(_jitter(key, cfg, "margin", *cfg.margin_ms), F.greatest(F.lit(length) - n, F.lit(0)))
    c = c.withColumn("margin", margin)
    room = F.lit(length) - F.col("margin")
    kept = F.least(n, room)
    side = F.slice("_voice", n - kept + 1, kept) if cfg.token_at_end else F.slice("_voice", 1, kept)
    c = c.withColumn("_placed", side)
    lead = room - F.size("_placed")
    window = (F.concat(sg.zeros(lead), F.col("_placed"), sg.zeros(F.col("margin"))) if cfg.token_at_end
              else F.concat(sg.zeros(F.col("margin")), F.col("_placed"), sg.zeros(lead)))
    c = c.withColumn("_window", window).withColumn("snr_db", uniform(key, cfg.seed, "snr", *cfg.snr_db))
    slack = F.greatest(F.size("bed") - length, F.lit(0))
    c = c.withColumn("_bed", sg.loop_to(F.col("bed"), F.lit(length), pick(key, cfg.seed, "bed_at", slack + 1).cast("int")))
    scale = sg.snr_scale(sg.power(F.col("_placed")), sg.power(F.col("_bed")), F.col("snr_db"))
    c = c.withColumn("_mixed", F.when(F.col("_bed").isNull(), F.col("_window")).otherwise(
        sg.mix(F.col("_window"), F.col("_bed"), scale)))
    return c.select("clip_id", sg.guard_clipping(F.col("_mixed")).alias("window"), "margin", "snr_db", "bed_id",
                    F.col("_filler").isNotNull().alias("has_filler"))


def whole_clip_mix(clips: DataFrame, beds: DataFrame, cfg: CompositeSettings) -> DataFrame:
    """Negatives and backgrounds: centred in the window, mixed with a bed at a drawn SNR."""
    key, length = F.col("clip_id"), cfg.samples(cfg.window_ms)
    c = pair_drawn(clips.withColumn("_fit", sg.center_fit(F.col("samples"), length)), beds, "clip_id", "bed_id", cfg.seed, "bed")
    slack = F.greatest(F.size("bed") - length, F.lit(0))
    c = c.withColumn("_bed", sg.loop_to(F.col("bed"), F.lit(length), pick(key, cfg.seed, "bed_at", slack + 1).cast("int")))
    scale = sg.snr_scale(sg.power(F.col("_fit")), sg.power(F.col("_bed")), uniform(key, cfg.seed, "snr", *cfg.snr_db))
    return c.select("clip_id", F.when(F.col("_bed").isNull(), F.col("_fit")).otherwise(
        sg.mix(F.col("_fit"), F.col("_bed"), scale)).alias("window"))


def augmentation_round(clips: DataFrame, beds: DataFrame, real_fillers: DataFrame, synth_fillers: DataFrame,
                       round_idx: int, cfg: CompositeSettings) -> DataFrame:
    """One round over all splits: ``clips(clip_id, split, samples)`` to named windows.

    Round 0 composes positives and mixes the rest; later rounds keep the window
    of the round before and only fix its length.
    """
    if round_idx == 0:
        positive = F.contains("split", F.lit("positive"))
        done = compose(clips.filter(positive).select("clip_id", "samples"), beds, real_fillers, synth_fillers, cfg).select(
            "clip_id", "window")
        rest = whole_clip_mix(clips.filter(~positive).select("clip_id", "samples"), beds, cfg)
        windows = done.unionByName(rest)
    else:
        windows = clips.select("clip_id", sg.head_fit(F.col("samples"), cfg.samples(cfg.window_ms)).alias("window"))
    stem = F.regexp_replace("clip_id", "_r[0-9]+$", "")
    return clips.select("clip_id", "split").join(windows, "clip_id").select(
        F.concat(stem, F.lit(f"_r{round_idx}")).alias("clip_id"), "split", F.lit(round_idx).alias("round"),
        F.col("window").alias("samples"))


def run_rounds(clips: DataFrame, beds: DataFrame, real_fillers: DataFrame, synth_fillers: DataFrame, rounds: int, path: str,
               cfg: CompositeSettings) -> None:
    """Write every round under ``path`` partitioned by (split, round), replacing old output.

    Each round reads the files the round before wrote, so lineage stays one
    round long. A job may call this twice: only the partitions it writes change.
    """
    spark = clips.sparkSession
    current = clips
    for round_idx in range(rounds):
        out = augmentation_round(current, beds, real_fillers, synth_fillers, round_idx, cfg)
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("split", "round").parquet(path))
        current = spark.read.schema(out.schema).parquet(path).filter(F.col("round") == round_idx).select("clip_id", "split", "samples")
