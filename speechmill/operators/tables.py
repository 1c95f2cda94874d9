"""Table maintenance as pure functions (stored, incoming) -> new table.

Open-source Parquet has no MERGE; callers write the result to a new path or
overwrite the touched partitions, and a MERGE-capable format can reuse the
same rules. All joins are equi-joins on the table key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import latest


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the given schema; columns it lacks become null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), frozen: Sequence[str] = ()) -> DataFrame:
    """Insert or update by key.

    Columns in ``keep`` hold the stored value where the incoming one is null,
    those in ``frozen`` never change once stored, all others are overwritten.
    """
    keys = list(keys)
    s = stored.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("_s"))
    i = incoming.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("_i"))
    both = s.join(i, keys, "full")
    is_new, is_old = F.col("_i").isNotNull(), F.col("_s").isNotNull()

    def value(c: str) -> Column:
        old, new = F.col(f"_s.{c}"), F.col(f"_i.{c}")
        if c in frozen:
            return F.when(is_old, old).otherwise(new)
        if c in keep:
            return F.coalesce(new, old)
        return F.when(is_new, new).otherwise(old)

    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in stored.columns])


def replace_groups(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """Drop all stored rows of the touched keys and add the incoming rows.

    ``touched`` lists keys whose rows go away even without a replacement.
    """
    ids = (touched if touched is not None else incoming).select(*keys).distinct()
    return stored.join(ids, list(keys), "left_anti").unionByName(incoming.select(*stored.columns))


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Add incoming rows whose key is not stored; the first of repeated keys wins."""
    return stored.unionByName(new_rows(stored, incoming, keys, order).select(*stored.columns))


def new_rows(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    fresh = incoming.join(stored.select(*keys).distinct(), keys, "left_anti")
    if not order:
        return fresh.dropDuplicates(keys)
    rest = [c for c in fresh.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*").select(*incoming.columns)


def append_version(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Retire the stored versions of each incoming key and append the next one.

    ``stored``: key, version, is_current and payload; ``incoming``: one row per key.
    """
    top = stored.groupBy(key).agg(F.max("version").alias("_v"))
    fresh = incoming.join(top, key, "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).withColumn("is_current", F.lit(True)).drop("_v")
    hit = incoming.select(key).distinct().withColumn("_hit", F.lit(True))
    retired = stored.join(hit, key, "left").withColumn("is_current", F.col("is_current") & F.col("_hit").isNull()).drop("_hit")
    return retired.unionByName(fresh.select(*stored.columns))


def current_version(transcripts: DataFrame, key: str) -> DataFrame:
    return latest(transcripts.filter("is_current"), [key], ["version"])


def mark_current(models: DataFrame, key: str, run: str, order: Sequence[str]) -> DataFrame:
    """Exactly one current row per key: the latest by ``order``."""
    newest = models.groupBy(key).agg(F.max_by(run, F.struct(*order)).alias("_run"))
    return models.join(newest, key).withColumn("is_current", F.col(run) == F.col("_run")).drop("_run")


def soft_delete(slices: DataFrame, deletions: DataFrame, keys: Sequence[str] = ("project_slug", "category", "file_name")) -> DataFrame:
    """Mark active slices named by key as deleted."""
    hit = deletions.select(*keys).distinct().withColumn("_hit", F.lit(True))
    joined = slices.join(hit, list(keys), "left")
    gone = F.col("_hit").isNotNull() & (F.col("status") == "active")
    return joined.withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).select(*slices.columns)


def cascade_delete(tables: Mapping[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given keys."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


CURVE_KEY = ["recording_id", "mode", "step_ms", "keep_ms", "model_fp"]


def cached_curves(wanted: DataFrame, curves: DataFrame) -> DataFrame:
    """Stored curves that answer a request, fingerprint included."""
    return curves.join(wanted.select(*CURVE_KEY).distinct(), CURVE_KEY, "left_semi")


def curves_to_score(wanted: DataFrame, curves: DataFrame) -> DataFrame:
    """Requests without a stored curve, or with one that did not parse."""
    valid = curves.filter("times_ms IS NOT NULL AND scores IS NOT NULL") if "times_ms" in curves.columns else curves
    return wanted.join(valid.select(*CURVE_KEY).distinct(), CURVE_KEY, "left_anti")


def model_fingerprint(run: Column, length: Column, modified_ns: Column) -> Column:
    """``run-<id>`` for an archived run, size and time for a live file, else ``nomodel``."""
    return F.when(run.isNotNull(), F.concat(F.lit("run-"), run)).when(
        length.isNotNull(), F.concat_ws("-", length.cast("string"), F.coalesce(modified_ns, F.lit(0)).cast("string"))).otherwise("nomodel")


def upload_delta(local: DataFrame, server: DataFrame, key: str = "recording_id", sha: str = "sha") -> DataFrame:
    """Local takes to upload: unknown id, or a checksum the server holds differently.

    A stored take without a checksum is trusted by id; a local one without is sent.
    """
    s = server.select(key, F.col(sha).alias("_server"), F.lit(True).alias("_known"))
    joined = local.join(s, key, "left")
    differs = F.col("_server").isNotNull() & F.coalesce(F.lower(F.col("_server")) != F.lower(F.col(sha)), F.lit(True))
    return joined.filter(F.col("_known").isNull() | differs).withColumn(
        "reason", F.when(F.col("_known").isNull(), "new").otherwise("changed")).drop("_server", "_known")


def two_way_sync(local: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the direction to copy them."""
    a = local.select(key).distinct().withColumn("_l", F.lit(True))
    s = server.select(key).distinct().withColumn("_s", F.lit(True))
    both = a.join(s, key, "full").filter(F.col("_l").isNull() | F.col("_s").isNull())
    return both.select(key, F.when(F.col("_s").isNull(), "push").otherwise("pull").alias("direction"))


def reprocess_list(takes: DataFrame, sources: DataFrame, recogniser: bool = True) -> DataFrame:
    """Stored takes to cut again, with the reason where one cannot be.

    Background takes need no recogniser; a take without a stored source warns.
    """
    held = sources.select("recording_id").distinct().withColumn("_have", F.lit(True))
    joined = takes.join(held, "recording_id", "left")
    background = F.col("strategy") == "background"
    action = (
        F.when(F.col("_have").isNull(), "source missing").when(background, "recut")
        .when(F.lit(recogniser), "recut").otherwise("no recogniser")
    )
    return joined.withColumn("action", action).drop("_have")
