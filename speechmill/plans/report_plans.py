"""Report, ranking and pool queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import pool as pl
from ..operators import ranking as rk
from ..operators import reports as rp
from ..operators import tables as tb
from . import bindings as b
from .registry import query


@query("category_counts", "SELECT project_slug, category, COUNT(*) AS n FROM v_slices WHERE status = 'active' GROUP BY ALL")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return rp.category_counts(b.slices(spark, d))


@query("label_counts", "SELECT project_slug, label, COUNT(*) AS n FROM v_slices WHERE status = 'active' GROUP BY ALL")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return rp.category_counts(b.slices(spark, d), "label")


@query("recordings_per_project", "SELECT project_slug, COUNT(*) AS recordings FROM v_takes GROUP BY project_slug")
def recordings_per_project(spark: SparkSession, d: str) -> DataFrame:
    return b.takes(spark, d).groupBy("project_slug").agg(F.count(F.lit(1)).alias("recordings"))


@query("provenance_counts", """
WITH s AS (SELECT s.project_slug, t.device, t.route, t.session_id FROM v_slices s JOIN v_takes t ON t.recording_id = s.recording_id WHERE s.status = 'active'),
u AS (SELECT project_slug, 'device' AS dimension, device AS k FROM s UNION ALL SELECT project_slug, 'input route', route FROM s
  UNION ALL SELECT project_slug, 'session', session_id FROM s)
SELECT project_slug, dimension, COALESCE(NULLIF(k, ''), '(unknown)') AS "key", COUNT(*) AS n FROM u GROUP BY ALL""")
def provenance_counts(spark: SparkSession, d: str) -> DataFrame:
    return rp.provenance_counts(b.slices(spark, d), b.takes(spark, d))


@query("category_rollup", """
SELECT project_slug, category, COUNT(*) AS n, COUNT(*) FILTER (category IN ('positive', 'negative', 'background')) AS strict3
FROM v_slices WHERE status = 'active' GROUP BY ROLLUP (project_slug, category)""")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rp.category_rollup(b.slices(spark, d))


_CATS = """COUNT(*) FILTER (category = 'positive') AS positive, COUNT(*) FILTER (category IN ('negative', 'hard_negative')) AS negative,
  COUNT(*) FILTER (category = 'background') AS background"""


@query("recording_details", f"""
WITH c AS (SELECT recording_id, {_CATS} FROM v_slices WHERE status = 'active' GROUP BY recording_id)
SELECT t.recording_id, t.duration_ms, t.device, COALESCE(NULLIF(t.kind, ''), 'mixed') AS kind, COALESCE(positive, 0) AS positive_count,
  COALESCE(negative, 0) AS negative_count, COALESCE(background, 0) AS background_count FROM v_takes t LEFT JOIN c ON c.recording_id = t.recording_id""")
def recording_details(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import rules

    t = b.takes(spark, d).select("recording_id", "duration_ms", "device", rules.resolved_kind(F.col("kind")).alias("kind"))
    return rp.recording_details(t, b.slices(spark, d)).orderBy(F.desc("recording_id"))


_SUMMARY_SQL = f"""
c AS (SELECT project_slug, COUNT(*) AS slices, {_CATS}, COUNT(*) FILTER (category = 'negative') AS poolable_negative
  FROM v_slices WHERE status = 'active' GROUP BY project_slug),
sm AS (SELECT slug, created_at_ms, phrase, COALESCE(slices, 0) AS slices, COALESCE(positive, 0) AS positive, COALESCE(negative, 0) AS negative,
    COALESCE(background, 0) AS background, COALESCE(poolable_negative, 0) AS poolable_negative FROM v_projects LEFT JOIN c ON project_slug = slug),
pa AS (SELECT *, CAST(GREATEST((SELECT SUM(poolable_negative + positive) FROM sm) - poolable_negative - positive, 0) AS BIGINT) AS pooled_negative FROM sm)"""


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return rp.project_summaries(b.projects(spark, d), b.slices(spark, d))


@query("project_summaries", f"WITH {_SUMMARY_SQL} SELECT * FROM sm")
def project_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d)


@query("pool_availability", f"WITH {_SUMMARY_SQL} SELECT slug, poolable_negative, positive, pooled_negative FROM pa")
def pool_availability(spark: SparkSession, d: str) -> DataFrame:
    return rp.pool_availability(_summaries(spark, d)).select("slug", "poolable_negative", "positive", "pooled_negative")


@query("imbalance_flags", f"""
WITH {_SUMMARY_SQL}
SELECT slug, positive, negative + pooled_negative AS total_negative, positive > 0 AND negative + pooled_negative >= positive * 5 AS imbalanced,
  CASE WHEN positive > 0 AND negative + pooled_negative >= positive * 5 THEN (negative + pooled_negative) // positive END AS ratio,
  positive = 0 AS no_positives FROM pa""")
def imbalance_flags(spark: SparkSession, d: str) -> DataFrame:
    return rp.imbalance(rp.pool_availability(_summaries(spark, d))).select(
        "slug", "positive", "total_negative", "imbalanced", "ratio", "no_positives")


@query("ms_per_step", """
SELECT model_size, round(AVG(duration_ms / steps), 6) AS avg_ms, COUNT(*) AS runs FROM v_runs
WHERE state = 'succeeded' AND duration_ms IS NOT NULL AND steps > 0 GROUP BY ROLLUP (model_size)""")
def ms_per_step(spark: SparkSession, d: str) -> DataFrame:
    return rp.ms_per_step(b.runs(spark, d)).withColumn("avg_ms", F.round("avg_ms", 6))


_NOW = 915_148_800_000  # fixed clock of the estimate query: 1999-01-01


@query("run_estimates", f"""
WITH s AS (SELECT model_size, AVG(duration_ms / steps) AS a FROM v_runs WHERE state = 'succeeded' AND duration_ms IS NOT NULL AND steps > 0 GROUP BY model_size),
o AS (SELECT AVG(duration_ms / steps) AS a FROM v_runs WHERE state = 'succeeded' AND duration_ms IS NOT NULL AND steps > 0),
e AS (SELECT r.*, CAST(floor(COALESCE(s.a, o.a) * r.steps) AS BIGINT) AS est FROM v_runs r CROSS JOIN o LEFT JOIN s ON s.model_size = r.model_size)
SELECT slug, state, COUNT(*) AS runs, CAST(SUM(est) AS BIGINT) AS estimated_ms,
  CAST(SUM(CASE WHEN state = 'running' THEN GREATEST(est - GREATEST({_NOW} - created_at_ms, 0), 0) END) AS BIGINT) AS remaining_ms
FROM e WHERE steps > 0 GROUP BY slug, state""")
def run_estimates(spark: SparkSession, d: str) -> DataFrame:
    runs = b.runs(spark, d)
    est = rp.run_estimates(runs, rp.ms_per_step(runs), F.lit(_NOW))
    return est.filter("steps > 0").groupBy("slug", "state").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("estimated_total_ms").alias("estimated_ms"), F.sum("remaining_ms").alias("remaining_ms"))


@query("summary_fold", """
SELECT project_slug, COUNT(*) AS recordings, CAST(SUM(CASE WHEN kind = 'positive' THEN word_count ELSE 0 END) AS BIGINT) AS positives,
  CAST(SUM(CASE WHEN kind = 'hard_negative' THEN word_count ELSE 0 END) AS BIGINT) AS hard_negatives,
  CAST(SUM(CASE WHEN kind = 'positive' THEN word_count // 7 ELSE 0 END) AS BIGINT) AS dropped_positives,
  CAST(SUM(CASE WHEN kind = 'negative' THEN word_count ELSE 0 END) AS BIGINT) AS negatives, CAST(SUM(duration_ms // 2000) AS BIGINT) AS background,
  CAST(SUM(CASE WHEN duration_ms > 5000 THEN 1 ELSE 0 END + CASE WHEN word_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS warnings
FROM v_takes GROUP BY project_slug""")
def summary_fold(spark: SparkSession, d: str) -> DataFrame:
    return rp.fold_summaries(summaries(spark, d), ["project_slug"])


@query("summary_warnings", """
SELECT project_slug, warning, COUNT(*) AS n FROM (SELECT project_slug, unnest(list_filter([CASE WHEN duration_ms > 5000 THEN 'long' END,
  CASE WHEN word_count = 0 THEN 'no words' END], lambda x: x IS NOT NULL)) AS warning FROM v_takes) GROUP BY ALL""")
def summary_warnings(spark: SparkSession, d: str) -> DataFrame:
    return rp.warning_counts(summaries(spark, d), ["project_slug"])


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """A summary per take: words by kind, windows of 2 s and warning texts."""
    from ..functions import rules

    k, zero = F.col("kind"), F.lit(0).cast("bigint")
    return b.takes(spark, d).select(
        "project_slug", F.when(k == "positive", F.col("word_count")).otherwise(zero).alias("positives"),
        F.when(k == "hard_negative", F.col("word_count")).otherwise(zero).alias("hard_negatives"),
        F.when(k == "positive", F.expr("word_count div 7")).otherwise(zero).alias("dropped_positives"),
        F.when(k == "negative", F.col("word_count")).otherwise(zero).alias("negatives"), F.expr("duration_ms div 2000").alias("background"),
        rules.reasons((F.col("duration_ms") > 5000, "long"), (F.col("word_count") == 0, "no words")).alias("warnings"))


@query("total_positive_input", """
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 100 END + COALESCE(NULLIF(quality, 0), NULLIF(toxic, 0), 0)
  + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 7 END + doc_id % 3 AS total,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 100 END + COALESCE(NULLIF(quality, 0), NULLIF(toxic, 0), 0)
  + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 7 END AS legacy_total FROM labels""")
def total_positive_input(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = b.table(spark, d, "labels").select(
        i, F.when(i % 6 != 0, i % 100).alias("n_samples"), F.col("quality").cast("bigint").alias("own_positive"),
        F.col("toxic").cast("bigint").alias("positive"), F.when(i % 4 != 0, i % 7).alias("synth_a_positive"), (i % 3).alias("synth_b_positive"))
    full = rp.total_positive_input(rows).withColumnRenamed("total_positive_input", "total")
    return rp.total_positive_input(full, legacy=True).select("doc_id", "total", F.col("total_positive_input").alias("legacy_total"))


@query("overall_percent", """
WITH p AS (SELECT run_id, line, state = 'succeeded' AS done, CAST(run_id % 7 AS INT) AS step, steps % 101 AS pct FROM v_runs)
SELECT run_id, line, CAST(LEAST((SELECT CAST(SUM(CASE WHEN done OR step > i THEN w WHEN step = i THEN w * pct // 100 ELSE 0 END) AS BIGINT)
  FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i, unnest([10, 12, 10, 53, 5, 10]) AS w)), 100) AS BIGINT) AS percent FROM p""")
def overall_percent(spark: SparkSession, d: str) -> DataFrame:
    r = b.runs(spark, d)
    return r.select("run_id", "line", rp.overall_percent(
        (F.col("run_id") % 7).cast("int"), F.col("steps") % 101, F.col("state") == "succeeded").alias("percent"))


@query("take_seconds", """
SELECT COALESCE(NULLIF(kind, ''), 'mixed') AS kind, COUNT(*) AS takes, CAST(SUM(duration_ms) // 1000 AS BIGINT) AS seconds FROM v_takes GROUP BY 1""")
def take_seconds(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import rules

    return b.takes(spark, d).groupBy(rules.resolved_kind(F.col("kind")).alias("kind")).agg(
        F.count(F.lit(1)).alias("takes"), F.expr("sum(duration_ms) div 1000").alias("seconds"))


@query("take_label_counts", "SELECT recording_id, label, COUNT(*) AS n FROM v_slices GROUP BY ALL")
def take_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return b.slices(spark, d).groupBy("recording_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_cube", """
SELECT label, route AS condition, COUNT(*) AS n FROM (SELECT s.label, t.route FROM v_slices s JOIN v_takes t ON t.recording_id = s.recording_id)
GROUP BY CUBE (label, route)""")
def coverage_cube(spark: SparkSession, d: str) -> DataFrame:
    per_take = b.slices(spark, d).groupBy("recording_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return rp.coverage(per_take.join(b.takes(spark, d).select("recording_id", F.col("route").alias("condition")), "recording_id"))


# --- ranking -----------------------------------------------------------------------


@query("current_transcript", """
SELECT custkey, version, status FROM (SELECT o_custkey AS custkey, o_orderkey AS version, o_orderstatus AS status,
  ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def current_transcript(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") != "P").alias("is_current"))
    return tb.current_version(o, "custkey").select("custkey", "version", "status")


@query("next_version", "SELECT c_custkey AS custkey, COALESCE(MAX(o_orderkey), 0) + 1 AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    top = b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_orderkey").alias("v"))
    return b.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).join(top, "custkey", "left").select(
        "custkey", (F.coalesce("v", F.lit(0)) + 1).alias("version"))


@query("current_model", """
SELECT slug, run_id, run_id = first_value(run_id) OVER (PARTITION BY slug ORDER BY created_at_ms DESC, run_id DESC) AS is_current FROM v_models""")
def current_model(spark: SparkSession, d: str) -> DataFrame:
    return tb.mark_current(b.models(spark, d), "slug", "run_id", ["created_at_ms", "run_id"]).select("slug", "run_id", "is_current")


@query("review_order", "SELECT recording_id, start_ms, slice_id FROM v_slices WHERE status = 'active'")
def review_order(spark: SparkSession, d: str) -> DataFrame:
    """Newest take first, cuts in time order: a range-partitioned sort."""
    return b.slices(spark, d).filter("status = 'active'").select("recording_id", "start_ms", "slice_id").orderBy(
        F.desc("recording_id"), "start_ms")


@query("first_clips", """
SELECT project_slug, category, slice_id, rn AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_slug, category ORDER BY slice_id) AS rn FROM v_slices) WHERE rn <= 25""")
def first_clips(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 clips by name of each source."""
    out = rk.top_n(b.slices(spark, d), ["project_slug", "category"], [F.asc("slice_id")], 25, "slice_id")
    return out.select("project_slug", "category", "slice_id", F.col("rank").cast("bigint").alias("rank"))


@query("even_sample", """
WITH r AS (SELECT project_slug, doc_id, ROW_NUMBER() OVER (PARTITION BY project_slug ORDER BY doc_id) - 1 AS rn, COUNT(*) OVER (PARTITION BY project_slug) AS n FROM v_takes),
w AS (SELECT project_slug, CAST(floor(i * (n / 60.0::DOUBLE)) AS BIGINT) AS rn FROM (SELECT DISTINCT project_slug, n FROM r), (SELECT unnest(range(0, 60)) AS i) WHERE n > 60)
SELECT r.project_slug, r.doc_id FROM r WHERE n <= 60 OR EXISTS (SELECT 1 FROM w WHERE w.project_slug = r.project_slug AND w.rn = r.rn)""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 60 evenly spaced takes per project."""
    return rk.even_sample(b.takes(spark, d).select("project_slug", "doc_id"), ["project_slug"], "doc_id", 60).select("project_slug", "doc_id")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as training-log lines of the document's run: two of three behind a marker."""
    docs = b.table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "[\\r\\n]")).alias("pos", "raw"))
    step = (F.col("doc_id") + F.expr("pos div 3")) % 8
    pct = (F.col("doc_id") * 7 + F.col("pos") * 13) % 140
    line = (
        F.when(F.col("pos") % 3 == 0, F.concat(F.lit("=== Step "), step.cast("string"), F.lit("/6 === "), F.col("raw")))
        .when(F.col("pos") % 3 == 1, F.concat(F.lit("Augmenting r"), (F.col("pos") % 5).cast("string"), F.lit(": "), pct.cast("string"), F.lit("%|##| "), F.col("raw")))
        .otherwise(F.col("raw"))
    )
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), line.alias("line"))


LOG_SQL = r"""
ln AS (SELECT doc_id, unnest(string_split_regex(text, '[\r\n]')) AS raw, generate_subscripts(string_split_regex(text, '[\r\n]'), 1) - 1 AS pos FROM documents),
lg AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE pos % 3 WHEN 0 THEN '=== Step ' || ((doc_id + pos // 3) % 8) || '/6 === ' || raw
    WHEN 1 THEN 'Augmenting r' || (pos % 5) || ': ' || ((doc_id * 7 + pos * 13) % 140) || '%|##| ' || raw ELSE raw END AS line FROM ln),
px AS (SELECT doc_id, pos, line,
    CASE WHEN regexp_matches(line, 'Step [^/]*/6') AND TRY_CAST(trim(regexp_extract(line, 'Step (.*?)/6', 1)) AS INT) BETWEEN 1 AND 6
      THEN CAST(trim(regexp_extract(line, 'Step (.*?)/6', 1)) AS INT)
      WHEN contains(line, 'Synthesizing clips') OR contains(line, 'VoxCPM clips') OR contains(line, 'Background (') THEN 1
      WHEN contains(line, 'Augmenting ') THEN 2 WHEN contains(line, 'Features ') THEN 3 WHEN contains(line, 'Phase ') THEN 4 END AS step,
    list_filter(regexp_extract_all(line, '([0-9]+)%', 1), lambda x: length(ltrim(x, '0')) <= 5 AND CAST('0' || right(x, 6) AS BIGINT) <= 65535) AS pcs,
    CASE WHEN instr(line, '%|') = 0 THEN '' ELSE trim(regexp_replace(rtrim(regexp_replace(rtrim(substr(line, 1, CAST(instr(line, '%|') - 1 AS BIGINT))), '[0-9]+$', '')), ':[^:]*$', '')) END AS label
  FROM lg),
pr AS (SELECT doc_id, pos, step, CASE WHEN len(pcs) > 0 THEN CAST(LEAST(CAST(pcs[-1] AS BIGINT), 100) AS BIGINT) END AS pct, label FROM px)"""


@query("log_lines", f"WITH {LOG_SQL} SELECT doc_id, pos, step, pct, label FROM pr WHERE step IS NOT NULL OR pct IS NOT NULL")
def log_line_parse(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return log_lines(spark, d).select(
        "doc_id", "pos", text.line_step(line).alias("step"), text.last_percent(line).alias("pct"), text.progress_label(line).alias("label")
    ).filter("step IS NOT NULL OR pct IS NOT NULL")


@query("run_progress", f"""
WITH {LOG_SQL},
mx AS (SELECT doc_id, MAX(step) AS step FROM pr GROUP BY doc_id)
SELECT m.doc_id, COALESCE(m.step, 0) AS step, COALESCE(arg_max(p.pct, p.pos) FILTER (p.pct IS NOT NULL), 0) AS percent,
  COALESCE(arg_max(p.label, p.pos) FILTER (p.label <> ''), '') AS label
FROM mx m LEFT JOIN pr p ON p.doc_id = m.doc_id AND p.step = m.step GROUP BY m.doc_id, m.step""")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    return rk.progress(log_lines(spark, d), "doc_id", "pos", "line")


# --- pools -------------------------------------------------------------------------

POOL = pl.PoolSettings(positive_boost=4, synth_a_count=40, synth_b_count=30, impostor_count=20)


def synthetic(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic clips: one per conversation turn, by language of its number."""
    c = b.table(spark, d, "conversations")
    i = F.col("conv_id") * 7 + F.col("turn")
    slugs, sources = F.array(*[F.lit(x) for x in ("en", "es", "de", "fr")]), F.array(*[F.lit(x) for x in ("synth_a", "synth_b", "impostor")])
    return c.select(F.element_at(slugs, (i % 4 + 1).cast("int")).alias("project_slug"), F.element_at(sources, (i % 3 + 1).cast("int")).alias("source"),
                    F.concat_ws("_", F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.col("turn").cast("string")).alias("stem"))


_SYNTH_SQL = """
sy AS (SELECT (['en', 'es', 'de', 'fr'])[(conv_id * 7 + turn) % 4 + 1] AS project_slug, (['synth_a', 'synth_b', 'impostor'])[(conv_id * 7 + turn) % 3 + 1] AS source,
  'c_' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '_' || turn AS stem FROM conversations)"""


@query("training_pool", f"""
WITH {_SYNTH_SQL},
t AS (SELECT unnest(['en', 'fr']) AS target),
re AS (SELECT t.target, s.project_slug, s.slice_id AS stem, CASE WHEN s.project_slug = t.target THEN 'own_' || category
    WHEN category IN ('negative', 'positive', 'background') THEN 'borrowed_' || category END AS branch FROM v_slices s CROSS JOIN t WHERE s.status = 'active'),
rr AS (SELECT target, branch, project_slug, stem, project_slug || CASE WHEN branch = 'own_hard_negative' THEN '_hardneg' ELSE '' END || '__' || stem
    || CASE WHEN branch = 'own_positive' THEN '__x' || c ELSE '' END AS name
  FROM (SELECT *, unnest(range(0, CASE WHEN branch = 'own_positive' THEN 4 ELSE 1 END)) AS c FROM re WHERE branch IS NOT NULL)),
sk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_slug, source ORDER BY stem) AS rn FROM sy WHERE project_slug IN ('en', 'fr')),
sn AS (SELECT project_slug AS target, CASE source WHEN 'synth_a' THEN 'synth_a_positive' WHEN 'synth_b' THEN 'synth_b_positive' ELSE 'synth_impostor_negative' END AS branch,
    project_slug, stem, project_slug || CASE source WHEN 'synth_a' THEN '_f5synth__' WHEN 'synth_b' THEN '_zonossynth__' ELSE '_impostorneg__' END || stem AS name
  FROM sk WHERE rn <= CASE source WHEN 'synth_a' THEN 40 WHEN 'synth_b' THEN 30 ELSE 20 END),
al AS (SELECT * FROM rr UNION ALL SELECT * FROM sn)
SELECT target, branch, project_slug AS source_slug, stem, name, CASE WHEN branch LIKE '%background' THEN 'background' WHEN branch = 'borrowed_positive' THEN 'negative'
  WHEN branch LIKE '%positive' THEN 'positive' ELSE 'negative' END AS category FROM al""")
def training_pool(spark: SparkSession, d: str) -> DataFrame:
    clips = b.slices(spark, d).filter("status = 'active'").select("project_slug", "category", F.col("slice_id").alias("stem"))
    return pl.training_pool(clips, ["en", "fr"], POOL, synthetic(spark, d))


@query("pool_counts", f"""
WITH {_SYNTH_SQL},
p AS (SELECT project_slug AS target, COUNT(*) FILTER (category = 'positive') AS po, COUNT(*) FILTER (category = 'negative') AS ne,
    COUNT(*) FILTER (category = 'hard_negative') AS hn, COUNT(*) FILTER (category = 'background') AS bg FROM v_slices WHERE status = 'active' GROUP BY 1),
s AS (SELECT project_slug, COUNT(*) FILTER (source = 'synth_a') AS a, COUNT(*) FILTER (source = 'synth_b') AS z, COUNT(*) FILTER (source = 'impostor') AS i FROM sy GROUP BY 1),
x AS (SELECT p.*, LEAST(COALESCE(a, 0), 40) AS a, LEAST(COALESCE(z, 0), 30) AS z, LEAST(COALESCE(i, 0), 20) AS i,
    CAST((SELECT SUM(po) FROM p) - po AS BIGINT) AS bp, CAST((SELECT SUM(ne) FROM p) - ne AS BIGINT) AS bn, CAST((SELECT SUM(bg) FROM p) - bg AS BIGINT) AS bb
  FROM p LEFT JOIN s ON s.project_slug = p.target)
SELECT target, po * 4 AS own_positive, po AS positive_unique, ne AS own_negative, hn AS own_hard_negative, bn AS borrowed_negative, bp AS borrowed_positive,
  bg AS own_background, bb AS borrowed_background, a AS synth_a_positive, z AS synth_b_positive, i AS synth_impostor_negative,
  po * 4 + a + z AS positive, ne + hn + bn + bp + i AS negative, bg + bb AS background FROM x""")
def pool_counts(spark: SparkSession, d: str) -> DataFrame:
    clips = b.slices(spark, d).filter("status = 'active'")
    return pl.pool_counts(clips, POOL, synthetic(spark, d))


@query("pool_contributors", """
WITH l AS (SELECT DISTINCT project_slug FROM v_slices WHERE status = 'active' AND category IN ('negative', 'positive', 'background')),
t AS (SELECT DISTINCT project_slug AS target FROM v_slices WHERE status = 'active')
SELECT target, COALESCE(string_agg(project_slug, ',' ORDER BY project_slug), '') AS others FROM t LEFT JOIN l ON project_slug <> target GROUP BY target""")
def pool_contributors(spark: SparkSession, d: str) -> DataFrame:
    c = pl.contributors(b.slices(spark, d).filter("status = 'active'"), POOL)
    return c.select("target", F.array_join("others", ",").alias("others"))


@query("pool_replicas", """
SELECT slice_id, slice_id || CASE WHEN 1 + k % 3 > 1 THEN '__x' || c ELSE '' END AS name
FROM (SELECT slice_id, k, unnest(range(0, 1 + k % 3)) AS c FROM v_slices WHERE category = 'positive')""")
def pool_replicas(spark: SparkSession, d: str) -> DataFrame:
    s = b.slices(spark, d).filter("category = 'positive'").select("slice_id", F.col("slice_id").alias("name"), "k")
    return pl.replicate(s, (1 + F.col("k") % 3).cast("int"), "name").select("slice_id", "name")


@query("synth_shortfall", """
SELECT slug, 400 AS wanted, COUNT(s.slice_id) AS existing, CAST(GREATEST(400 - COUNT(s.slice_id), 0) AS BIGINT) AS missing
FROM v_projects LEFT JOIN v_slices s ON s.project_slug = slug AND s.category = 'positive' GROUP BY slug""")
def synth_shortfall(spark: SparkSession, d: str) -> DataFrame:
    wanted = b.projects(spark, d).select("slug", F.lit(400).alias("wanted"))
    have = b.slices(spark, d).filter("category = 'positive'").select(F.col("project_slug").alias("slug"))
    return pl.shortfall(wanted, have, "slug")


@query("phrase_union", r"""
SELECT DISTINCT phrase FROM (
  SELECT trim(x) AS phrase FROM (SELECT unnest(string_split_regex(text, '[.\n]')) AS x FROM benchmark)
  UNION ALL SELECT trim(x) FROM (SELECT unnest(string_split_regex(text, '[.\n]')) AS x FROM conversations)) WHERE phrase <> '' AND NOT starts_with(phrase, '#')""")
def phrase_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [b.table(spark, d, t).select(F.explode(F.split("text", "[.\\n]")).alias("x")) for t in ("benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).select(F.trim("x").alias("phrase")).filter((F.col("phrase") != "") & ~F.startswith("phrase", F.lit("#"))).distinct()
