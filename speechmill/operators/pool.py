"""Training pools: which clip feeds which target, by what branch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_n

# Name parts of pooled clips.
HARD_TAG = "hardneg"
SYNTH_TAGS = {"synth_a": "f5synth", "synth_b": "zonossynth", "impostor": "impostorneg"}
BRANCHES = ["own_positive", "synth_a_positive", "synth_b_positive", "own_negative", "own_hard_negative",
            "borrowed_negative", "borrowed_positive", "synth_impostor_negative", "own_background", "borrowed_background"]
# The pool category each branch ends in.
BRANCH_CATEGORY = {name: name.rsplit("_", 1)[1] for name in BRANCHES} | {"borrowed_positive": "negative"}


@dataclass(frozen=True)
class PoolSettings:
    positive_boost: int = 1
    borrow_positives: bool = True
    borrow_background: bool = True
    synth_a_count: int = 0
    synth_b_count: int = 0
    impostor_count: int = 0


def _real_branch(own: Column, category: Column, cfg: PoolSettings) -> Column:
    """Branch of a recorded clip for a target; null where the clip is not used.

    Hard negatives belong to their project alone and are never lent.
    """
    return (
        F.when(own & category.isin("positive", "negative", "hard_negative", "background"), F.concat(F.lit("own_"), category))
        .when(~own & (category == "negative"), "borrowed_negative")
        .when(~own & (category == "positive") & F.lit(cfg.borrow_positives), "borrowed_positive")
        .when(~own & (category == "background") & F.lit(cfg.borrow_background), "borrowed_background")
    )


def replicate(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Rows repeated with a ``__xN`` suffix on ``name``; one copy keeps its name."""
    copies = F.explode(F.sequence(F.lit(0), times - 1))
    return rows.withColumn("_times", times).withColumn("_copy", copies).withColumn(
        name, F.when(F.col("_times") > 1, F.concat(name, F.lit("__x"), F.col("_copy").cast("string"))).otherwise(F.col(name))
    ).drop("_times", "_copy")


def training_pool(clips: DataFrame, targets: Sequence[str], cfg: PoolSettings, synthetic: DataFrame | None = None) -> DataFrame:
    """Pool rows of the given targets: target, category, branch, source_slug, stem, name.

    ``clips(project_slug, category, stem)``; ``synthetic(project_slug, source,
    stem)`` with source synth_a, synth_b or impostor. Every recorded clip is
    judged where it lies: one narrow pass, no join and no shuffle. Only the
    capped synthetic sources are ranked, by name.
    """
    wanted = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    slug, target = F.col("project_slug"), F.col("target")
    real = clips.select(slug, "category", "stem", wanted).withColumn(
        "branch", _real_branch(slug == target, F.col("category"), cfg)).filter("branch IS NOT NULL")
    prefix = F.when(F.col("branch") == "own_hard_negative", F.concat(slug, F.lit("_" + HARD_TAG))).otherwise(slug)
    real = real.withColumn("name", F.concat(prefix, F.lit("__"), "stem"))
    times = F.when(F.col("branch") == "own_positive", F.lit(cfg.positive_boost)).otherwise(F.lit(1))
    rows = replicate(real, times, "name")
    parts = [rows.select("target", "branch", slug.alias("source_slug"), "stem", "name")]
    counts = {"synth_a": cfg.synth_a_count, "synth_b": cfg.synth_b_count, "impostor": cfg.impostor_count}
    branch_of = {"synth_a": "synth_a_positive", "synth_b": "synth_b_positive", "impostor": "synth_impostor_negative"}
    if synthetic is not None:
        own = synthetic.filter(slug.isin(list(targets)))
        for source, count in counts.items():
            if count > 0:
                first = top_n(own.filter(F.col("source") == source), ["project_slug"], [F.asc("stem")], count, "stem")
                parts.append(first.select(
                    slug.alias("target"), F.lit(branch_of[source]).alias("branch"), slug.alias("source_slug"), "stem",
                    F.concat(slug, F.lit(f"_{SYNTH_TAGS[source]}__"), "stem").alias("name")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    category = F.when(F.col("branch") == "borrowed_positive", "negative").otherwise(
        F.regexp_extract("branch", "_(positive|negative|background)$", 1))
    return out.withColumn("category", category)


def pool_counts(clips: DataFrame, cfg: PoolSettings, synthetic: DataFrame | None = None,
                projects: DataFrame | None = None) -> DataFrame:
    """Pool size of every project at once, by branch, without building any pool.

    ``projects(slug)`` adds projects that have no clips of their own yet; they
    still borrow.

    A pool holds nearly all clips, so all pools together would be projects x
    clips rows. Their sizes follow from one count per project and category and
    the grand totals: own, and total minus own for what is borrowed.
    """
    per = clips.groupBy(F.col("project_slug").alias("target")).agg(*[
        F.count_if(F.col("category") == c).alias(f"_{c}") for c in ("positive", "negative", "hard_negative", "background")])
    if projects is not None:
        named = projects.select(F.col("slug").alias("target")).distinct()
        per = named.join(per, "target", "full").na.fill(0)
    lent = ("positive", "negative", "background")
    totals = per.agg(F.struct(*[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(c) for c in lent])).scalar()
    zero = F.lit(0).cast("bigint")
    out = per.select(
        "target", (F.col("_positive") * cfg.positive_boost).alias("own_positive"), F.col("_positive").alias("positive_unique"),
        F.col("_negative").alias("own_negative"), F.col("_hard_negative").alias("own_hard_negative"),
        (totals["negative"] - F.col("_negative")).alias("borrowed_negative"),
        (totals["positive"] - F.col("_positive") if cfg.borrow_positives else zero).alias("borrowed_positive"),
        F.col("_background").alias("own_background"),
        (totals["background"] - F.col("_background") if cfg.borrow_background else zero).alias("borrowed_background"))
    caps = {"synth_a_positive": ("synth_a", cfg.synth_a_count), "synth_b_positive": ("synth_b", cfg.synth_b_count),
            "synth_impostor_negative": ("impostor", cfg.impostor_count)}
    if synthetic is not None:
        held = synthetic.groupBy(F.col("project_slug").alias("target")).agg(*[
            F.count_if(F.col("source") == s).alias(name) for name, (s, _) in caps.items()])
        out = out.join(held, "target", "left").select(*out.columns, *[
            F.least(F.coalesce(name, zero), F.lit(cap)).cast("bigint").alias(name) for name, (_, cap) in caps.items()])
    else:
        out = out.select("*", *[zero.alias(name) for name in caps])
    return out.withColumn("positive", F.col("own_positive") + F.col("synth_a_positive") + F.col("synth_b_positive")).withColumn(
        "negative", F.col("own_negative") + F.col("own_hard_negative") + F.col("borrowed_negative") + F.col("borrowed_positive")
        + F.col("synth_impostor_negative")).withColumn("background", F.col("own_background") + F.col("borrowed_background"))


def contributors(clips: DataFrame, cfg: PoolSettings) -> DataFrame:
    """Per target the sorted other projects that lend it anything.

    Works on the distinct (project, category) pairs, which are few.
    """
    lent = ["negative"] + (["positive"] if cfg.borrow_positives else []) + (["background"] if cfg.borrow_background else [])
    pairs = clips.groupBy("project_slug").agg(F.max(F.col("category").isin(lent)).alias("lends"))
    lenders = pairs.agg(F.sort_array(F.collect_set(F.when(F.col("lends"), F.col("project_slug"))))).scalar()
    return pairs.select(F.col("project_slug").alias("target"), F.array_except(lenders, F.array("project_slug")).alias("others"))


def shortfall(targets: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """How many clips each project still needs: max(0, wanted - existing)."""
    have = existing.groupBy(key).agg(F.count(F.lit(1)).alias("existing"))
    joined = targets.join(have, key, "left").withColumn("existing", F.coalesce("existing", F.lit(0).cast("bigint")))
    return joined.withColumn("missing", F.greatest(F.col("wanted") - F.col("existing"), F.lit(0)).cast("bigint"))
