"""Writers. Each is safe to run again after a lost executor or a retried job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.tables import new_rows


def write_clips(clips: DataFrame, path: str) -> None:
    """Clips partitioned by project and category; only the touched partitions change."""
    (clips.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_slug", "category").parquet(path))


def rebuild_pool(pool: DataFrame, path: str) -> None:
    """Replace the pools of the targets in ``pool``, leaving other targets alone."""
    (pool.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target", "category").parquet(path))


class TakeStore:
    """A table of rows per take, kept in buckets of takes and changed bucket by bucket.

    A swap replaces all rows of the touched takes. The new content of their buckets
    is first written aside, then put in place by a dynamic overwrite of just these
    buckets, and a mark of the run comes last. Run again after a failure at any
    point, a swap goes on from what is ready and gives the same rows. A bucket that
    loses all its rows keeps one row that is not live, so that it is overwritten too.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "recording_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_live", F.lit(True)).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _put(self, rows: DataFrame, name: str) -> None:
        (rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket")
         .parquet(f"{self.path}/{name}"))

    def _ready(self, name: str) -> bool:
        try:
            return not self.spark.read.schema("run string").parquet(f"{self.path}/marks/{name}").isEmpty()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def _mark(self, name: str) -> None:
        self.spark.range(1).select(F.lit(name).alias("run")).write.mode("overwrite").parquet(f"{self.path}/marks/{name}")

    def create(self, rows: DataFrame) -> None:
        self._put(self._bucketed(rows), "data")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data").filter("_live").drop("_live", "_bucket")

    def swap(self, touched: DataFrame, fresh: DataFrame, run: str) -> None:
        """Replace the rows of the ``touched`` takes by their rows in ``fresh``."""
        if self._ready(f"{run}-done"):
            return
        if not self._ready(f"{run}-staged"):
            gone = self._bucketed(touched.select(self.key).distinct())
            hit = gone.select("_bucket").distinct()
            stored = self.spark.read.parquet(f"{self.path}/data")
            kept = stored.filter("_live").join(hit, "_bucket", "left_semi").join(gone.select(self.key), self.key, "left_anti")
            new = self._bucketed(fresh.join(gone.select(self.key), self.key, "left_semi")).select(*stored.columns)
            empty = hit.select(*[F.col(c) if c == "_bucket" else F.lit(False).alias(c) if c == "_live" else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])
            self._put(kept.select(*stored.columns).unionByName(new).unionByName(empty), f"staged/{run}")
            self._mark(f"{run}-staged")
        self._put(self.spark.read.parquet(f"{self.path}/staged/{run}"), "data")
        self._mark(f"{run}-done")


def reprocess(store: TakeStore, listed: DataFrame, recut: Callable[[DataFrame], DataFrame], run: str) -> DataFrame:
    """Cut the takes of a reprocess list anew and swap their rows in one job; returns the takes left out, with the reason.

    ``listed`` comes from :func:`~speechmill.operators.tables.reprocess_list`; ``recut``
    gives the new rows of takes. Takes without a source or a recogniser keep their rows.
    """
    takes = listed.filter("action = 'recut'")
    store.swap(takes, recut(takes), run)
    return listed.filter("action <> 'recut'").select(store.key, "action")


def clip_file_name(clip_id: str = "id", phrase: str = "spoken_phrase", label: str = "label"):
    spoken = F.coalesce(F.nullif(F.trim(phrase), F.lit("")), F.col(label))
    return F.concat(F.col(clip_id), F.lit("_"), text.safe_filename(spoken), F.lit(".wav"))


def append_metadata(records: DataFrame, path: str, keys: list[str]) -> None:
    """Append JSON records whose key is not written yet."""
    spark = records.sparkSession
    try:
        stored = spark.read.schema(records.schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = records.limit(0)  # first write
    new_rows(stored, records, keys).write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A nested report as JSON; one file per partition of the report itself."""
    report.write.mode("overwrite").json(path)


def nested_report(projects: DataFrame, categories: DataFrame, labels: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """One row per project with its counts as maps.

    Inputs are aggregated already, so the maps hold a few entries each.
    """
    def as_map(counts: DataFrame, key: str, name: str) -> DataFrame:
        return counts.groupBy(F.col("project_slug").alias("slug")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))

    out = projects.join(as_map(categories, "category", "categories"), "slug", "left").join(as_map(labels, "label", "labels"), "slug", "left")
    if provenance is not None:
        dims = provenance.groupBy(F.col("project_slug").alias("slug"), "dimension").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias("m"))
        out = out.join(dims.groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "m"))).alias("provenance")), "slug", "left")
    return out
