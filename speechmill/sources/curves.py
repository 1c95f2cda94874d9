"""Stored score curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_curves(stored: DataFrame) -> DataFrame:
    """JSON text arrays to double arrays; text that does not parse becomes null."""
    return stored.withColumn("times_ms", F.from_json("times_ms", "array<double>")).withColumn("scores", F.from_json("scores", "array<double>"))


def curves_to_ticks(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per curve point. A curve with a broken array counts as not cached."""
    parsed = parse_curves(stored).filter("times_ms IS NOT NULL AND scores IS NOT NULL")
    n = F.least(F.size("times_ms"), F.size("scores"))
    zipped = F.arrays_zip(F.slice("times_ms", F.lit(1), n).alias("t_ms"), F.slice("scores", F.lit(1), n).alias("score"))
    return parsed.select(*keys, F.inline(zipped).alias("t_ms", "score"))


def ticks_to_curves(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ticks of one take, model and mode back to the stored array form."""
    points = F.sort_array(F.collect_list(F.struct("t_ms", "score")))
    grouped = ticks.groupBy(*keys).agg(points.alias("_p"))
    return grouped.select(*keys, F.col("_p.t_ms").alias("times_ms"), F.col("_p.score").alias("scores"))
