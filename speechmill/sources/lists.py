"""Word lists, pronunciation tables and commented line lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ordered_index


def keep_lines(lines: DataFrame) -> DataFrame:
    """Trimmed ``value`` lines without blanks and ``#`` comments."""
    trimmed = lines.withColumn("value", F.trim("value"))
    return trimmed.filter((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    return keep_lines(spark.read.text(path))


def rank_lines(lines: DataFrame) -> DataFrame:
    """Lines (pos, value) of a ranked list as lower-case words with their rank, from 0.

    Comments and blank lines have no rank. Lines are numbered by block counts, so
    a list of any length spreads over tasks.
    """
    kept = keep_lines(lines).select(F.lower("value").alias("word"), F.col("pos").cast("bigint").alias("pos"))
    return ordered_index(kept, [], "pos").select("word", F.col("rn").cast("bigint").alias("rank"))


def read_ranked_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a ranked list with their rank (position in the file).

    The file is read whole, which keeps the order of its lines.
    """
    return rank_lines(spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "value")))


def parse_phones(lines: DataFrame) -> DataFrame:
    """``word<TAB>PH ON ES`` lines to word and phones, stress digits stripped.

    Lines without exactly two fields are skipped; other columns are kept.
    """
    parts = keep_lines(lines).select(F.split("value", "\t").alias("p"), *[c for c in lines.columns if c != "value"])
    good = parts.filter(F.size("p") == 2)
    phones = F.transform(F.split(F.col("p")[1], " "), lambda x: F.regexp_replace(x, "[0-9]", ""))
    return good.select(F.col("p")[0].alias("word"), phones.alias("phones"), *[c for c in parts.columns if c != "p"])


def first_phones(entries: DataFrame, order: str) -> DataFrame:
    """The first pronunciation of each word, by line position ``order``."""
    return entries.groupBy("word").agg(F.min_by("phones", order).alias("phones"))


def read_phones(spark: SparkSession, path: str) -> DataFrame:
    """The first pronunciation of each word, by file and place in the file."""
    lines = spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    return first_phones(parse_phones(lines), "_at")
