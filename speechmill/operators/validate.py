"""Hard rejects of manifests, takes and clips, and their split from good rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def take_rejects() -> Column:
    """Reasons to reject a flattened take row (schema_version, section, id, file, kind, script).

    Only an unscripted mixed or legacy take lacks something; test ids carry
    their prefix.
    """
    scripted = F.trim(F.coalesce(F.col("kind"), F.lit(""))).isin("", "mixed") & (F.col("section") == "bulk")
    return rules.reasons(
        (F.col("schema_version") != 1, "unsupported schema_version"), (_blank("id"), "missing id"), (_blank("file"), "missing file"),
        (scripted & (F.trim(F.coalesce(F.col("script"), F.lit(""))) == ""), "missing script"),
        ((F.col("section") == "test") & ~rules.is_test(F.coalesce(F.col("id"), F.lit(""))), "id must start with test_"),
    )


def clip_rejects() -> Column:
    return rules.reasons(
        (_blank("id"), "missing id"), (_blank("file"), "missing file"),
        (rules.category(F.coalesce(F.col("label"), F.lit(""))).isNull(), F.concat(F.lit("unknown label "), F.coalesce(F.col("label"), F.lit("")))),
    )


def manifest_rejects() -> Column:
    """Reasons to reject a whole manifest, its nested rows included."""
    def any_of(items: str, test) -> Column:
        return F.exists(F.coalesce(F.col(items), F.array()), test)

    def missing(x: Column, field: str) -> Column:
        return F.coalesce(x[field], F.lit("")) == ""

    sections = ("clips", "bulk_recordings", "background_recordings", "test_recordings")
    checks = [(F.coalesce(F.col("schema_version"), F.lit(0)) != 1, "unsupported schema_version"),
              (~rules.is_safe_slug(F.col("wake_word.slug")), "unsafe slug")]
    for s in sections:
        checks += [(any_of(s, lambda x: missing(x, "id")), f"{s}: missing id"), (any_of(s, lambda x: missing(x, "file")), f"{s}: missing file")]
    checks += [
        (any_of("clips", lambda x: rules.category(F.coalesce(x["label"], F.lit(""))).isNull()), "clips: unknown label"),
        (any_of("bulk_recordings", lambda x: F.trim(F.coalesce(x["kind"], F.lit(""))).isin("", "mixed") & (F.trim(F.coalesce(x["script"], F.lit(""))) == "")),
         "bulk_recordings: missing script"),
        (any_of("test_recordings", lambda x: ~rules.is_test(F.coalesce(x["id"], F.lit("")))), "test_recordings: id must start with test_"),
    ]
    return rules.reasons(*checks)


def split_rejects(rows: DataFrame, reject: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their ``reasons``."""
    judged = rows.withColumn("reasons", reject)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)
