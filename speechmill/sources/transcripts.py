"""Recogniser responses to word rows, inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.rows import inline_rows

# Fixed value: lag in seconds past which word times count as segment-relative.
SEGMENT_LAG = 0.5


def segment_offset(segment: Column) -> Column:
    """Seconds to add to a segment's words; 0 unless both edges lag."""
    words = segment["words"]
    lag_start = segment["start"] - F.get(words, F.lit(0))["start"]
    lag_end = segment["end"] - F.try_element_at(words, F.lit(-1))["end"]
    return F.when((lag_start > SEGMENT_LAG) & (lag_end > SEGMENT_LAG), lag_start).otherwise(0.0)


def flatten_words(segments: Column) -> Column:
    """One array of words over all segments: offsets applied, inverted words dropped."""
    def shifted(s: Column) -> Column:
        offset = segment_offset(s)
        return F.transform(F.coalesce(s["words"], F.array()), lambda w: F.struct(
            w["word"].alias("word"), (w["start"] + offset).alias("start"), (w["end"] + offset).alias("end"), w["probability"].alias("prob")))

    return F.filter(F.flatten(F.transform(segments, shifted)), lambda w: w["end"] >= w["start"])


def transcripts(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Parsed responses with ``words``, the words of all segments as one array; times as rounded milliseconds, words trimmed."""
    return responses.select(*keys, F.transform(flatten_words(F.col("segments")), lambda w, i: F.struct(
        i.cast("bigint").alias("ordinal"), F.trim(w["word"]).alias("word"), F.round(w["start"] * 1000).cast("bigint").alias("start_ms"),
        F.round(w["end"] * 1000).cast("bigint").alias("end_ms"), w["prob"].alias("prob"))).alias("words"))


def transcript_words(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Word rows of parsed responses."""
    return inline_rows(transcripts(responses, keys), keys, F.col("words"))


def parse_transcripts(raw: DataFrame, column: str = "response") -> DataFrame:
    parsed = raw.withColumn("_r", F.from_json(column, schemas.TRANSCRIPT))
    return parsed.select("*", "_r.text", "_r.segments").drop("_r")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRANSCRIPT).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())
