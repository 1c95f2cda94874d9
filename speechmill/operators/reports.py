"""Dataset reports. Facts are pre-aggregated before any join with dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Report dimensions and the take column each reads.
PROVENANCE = {"device": "device", "input route": "route", "session": "session_id"}
# The categories of the script's totals; hard negatives drop out of them.
STRICT_CATEGORIES = ["positive", "negative", "background"]
# Wall-clock weight of each training stage.
STEP_WEIGHTS = [10, 12, 10, 53, 5, 10]

# Counters of a take summary.
SUMMARY_FIELDS = ["positives", "hard_negatives", "negatives", "dropped_positives", "background"]

ACTIVE = "status = 'active'"


def category_counts(slices: DataFrame, by: str = "category") -> DataFrame:
    return slices.filter(ACTIVE).groupBy("project_slug", by).agg(F.count(F.lit(1)).alias("n"))


def provenance_counts(slices: DataFrame, takes: DataFrame, dims: dict[str, str] = PROVENANCE) -> DataFrame:
    """Active slices per project and capture dimension; blanks as ``(unknown)``.

    Slices are counted per take first, so the join moves one row per take and
    the unpivot runs over takes. A missing capture column counts as unknown.
    """
    per_take = slices.filter(ACTIVE).groupBy("project_slug", "recording_id").agg(F.count(F.lit(1)).alias("_n"))
    cols = {c: (F.col(c) if c in takes.columns else F.lit(None).cast("string")) for c in dims.values()}
    t = takes.select("recording_id", *[v.cast("string").alias(k) for k, v in cols.items()])
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(unknown)")).alias("key"))
                      for d, c in dims.items()])
    return (
        per_take.join(t, "recording_id").select("project_slug", "_n", F.inline(pairs))
        .groupBy("project_slug", "dimension", "key").agg(F.sum("_n").alias("n"))
        .orderBy("project_slug", "dimension", F.desc("n"), "key")
    )


def category_rollup(slices: DataFrame) -> DataFrame:
    """Counts per project and category with subtotals; ``strict3`` as the script counts."""
    return slices.filter(ACTIVE).rollup("project_slug", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("category").isin(STRICT_CATEGORIES)).alias("strict3"))


def _category_aggregates() -> list[Column]:
    c = F.col("category")
    return [
        F.count(F.lit(1)).alias("slices"), F.count_if(c == "positive").alias("positive"),
        F.count_if(c.isin("negative", "hard_negative")).alias("negative"), F.count_if(c == "background").alias("background"),
        F.count_if(c == "negative").alias("poolable_negative"),
    ]


_COUNTS = ["slices", "positive", "negative", "background", "poolable_negative"]


def recording_details(takes: DataFrame, slices: DataFrame) -> DataFrame:
    """Every take with its active slice counts, zero where it has none."""
    counts = slices.filter(ACTIVE).groupBy("recording_id").agg(*_category_aggregates())
    joined = takes.join(counts, "recording_id", "left")
    return joined.select(*takes.columns, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(f"{c}_count") for c in _COUNTS[1:4]])


def project_summaries(projects: DataFrame, slices: DataFrame) -> DataFrame:
    counts = slices.filter(ACTIVE).groupBy(F.col("project_slug").alias("slug")).agg(*_category_aggregates())
    joined = projects.join(counts, "slug", "left")
    return joined.select(*projects.columns, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _COUNTS])


def pool_availability(summaries: DataFrame) -> DataFrame:
    """Clips each project can borrow: all others' negatives and positives.

    The two grand totals are scalar subqueries over the project rows.
    """
    total = summaries.agg(F.sum(F.col("poolable_negative") + F.col("positive"))).scalar()
    own = F.col("poolable_negative") + F.col("positive")
    return summaries.withColumn("pooled_negative", F.greatest(total - own, F.lit(0)).cast("bigint"))


def imbalance(pools: DataFrame) -> DataFrame:
    """Flag projects whose negatives are at least five times their positives."""
    negatives = F.col("negative") + F.col("pooled_negative")
    heavy = (F.col("positive") > 0) & (negatives >= F.col("positive") * 5)
    return pools.withColumn("total_negative", negatives).withColumn("imbalanced", heavy).withColumn(
        "ratio", F.when(heavy, F.expr("(negative + pooled_negative) div positive"))).withColumn(
        "no_positives", F.col("positive") == 0)


def ms_per_step(runs: DataFrame) -> DataFrame:
    """Mean ms per step of succeeded runs, per model size and over all (null size)."""
    done = runs.filter("state = 'succeeded' AND duration_ms IS NOT NULL AND steps > 0")
    return done.rollup("model_size").agg(
        F.avg(F.col("duration_ms").cast("double") / F.col("steps")).alias("avg_ms"), F.count(F.lit(1)).alias("runs"))


def run_estimates(runs: DataFrame, averages: DataFrame, now_ms: Column) -> DataFrame:
    """Projected total and remaining time; the same size's mean, else the mean of all."""
    by_size = averages.filter("model_size IS NOT NULL").select("model_size", F.col("avg_ms").alias("_own"))
    overall = averages.filter("model_size IS NULL").select("avg_ms").scalar()
    joined = runs.join(by_size, "model_size", "left").withColumn("avg_ms", F.coalesce("_own", overall)).drop("_own")
    total = F.when(F.col("steps") > 0, F.floor(F.col("avg_ms") * F.col("steps")).cast("bigint"))
    elapsed = F.greatest(now_ms - F.col("created_at_ms"), F.lit(0))
    return joined.withColumn("estimated_total_ms", total).withColumn(
        "remaining_ms", F.when(F.col("state") == "running", F.greatest(F.col("estimated_total_ms") - elapsed, F.lit(0))))


def run_duration(started_ms: Column, finished_ms: Column) -> Column:
    return F.when(finished_ms >= started_ms, finished_ms - started_ms)


def overall_percent(step: Column, percent: Column, done: Column) -> Column:
    """Weighted progress over the six stages, in whole-number arithmetic."""
    share = F.lit(0)
    for i, weight in enumerate(STEP_WEIGHTS, start=1):
        share = share + F.when(done | (step > i), weight).when(
            step == i, F.floor(F.lit(weight) * percent / 100).cast("int")).otherwise(0)
    return F.least(F.floor(share * 100 / sum(STEP_WEIGHTS)), F.lit(100)).cast("bigint")


def fold_summaries(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum per-take counters and count warnings by text.

    Warnings stay rows (one per distinct text) in place of one list per group,
    which could hold a third of all takes.
    """
    return summaries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("recordings"), *[F.sum(c).alias(c) for c in SUMMARY_FIELDS], F.sum(F.size("warnings")).alias("warnings"))


def warning_counts(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    return summaries.select(*by, F.explode("warnings").alias("warning")).groupBy(*by, "warning").agg(F.count(F.lit(1)).alias("n"))


def total_positive_input(rows: DataFrame, legacy: bool = False) -> DataFrame:
    """Built-in, own and cloned positives summed; null while the built-in count is unknown.

    The manifest writer leaves the second cloned source out; ``legacy`` does too.
    """
    zero = F.lit(0).cast("bigint")
    own = F.coalesce(F.nullif(F.col("own_positive"), zero), F.nullif(F.col("positive"), zero), zero)
    parts = F.col("n_samples") + own + F.coalesce("synth_a_positive", zero)
    return rows.withColumn("total_positive_input", parts if legacy else parts + F.coalesce("synth_b_positive", zero))


def coverage(prompts: DataFrame) -> DataFrame:
    """Prompts per label and condition with all subtotals; ``n`` counts per input row."""
    return prompts.cube("label", "condition").agg(F.sum("n").alias("n"))
