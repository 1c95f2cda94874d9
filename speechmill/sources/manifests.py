"""Upload manifests and correction batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

SECTIONS = {"bulk": "bulk_recordings", "background": "background_recordings", "test": "test_recordings"}


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file; the schema is declared, so nothing is inferred."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())


def parse_manifests(texts: DataFrame, column: str = "value") -> DataFrame:
    """Manifests that lie in a text column, with the declared schema."""
    rest = [c for c in texts.columns if c != column]
    return texts.select(*rest, F.from_json(column, schemas.MANIFEST).alias("_m")).select(*rest, "_m.*")


def flatten_takes(manifests: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """All takes of all sections in one table, with their ``section`` and ``position``."""
    parts = []
    for section, column in SECTIONS.items():
        if column in manifests.columns:
            row = manifests.select(*(carry or []), F.posexplode(column).alias("position", "_t"))
            parts.append(row.select(*(carry or []), F.lit(section).alias("section"), "position", "_t.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def flatten_clips(manifests: DataFrame, carry: list[str] | None = None) -> DataFrame:
    return manifests.select(*(carry or []), F.inline("clips"))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """One row per correction with its batch's model threshold."""
    batches = spark.read.schema(schemas.CORRECTIONS).option("multiLine", True).json(path)
    return batches.select(F.col("wake_word.slug").alias("slug"), F.col("model.name").alias("model"), F.col("model.threshold").alias("threshold"), F.inline("corrections"))
