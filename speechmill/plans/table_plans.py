"""Joins between takes, runs and stores, and table maintenance.

``stored`` and ``incoming`` sides are overlapping parts of the same table, so
together they cover it; the parts are roles, not samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import tables as tb
from ..operators.ranking import hashed_index
from ..operators.words import background_windows
from ..session import settled, state_dir
from ..sources import sinks
from . import bindings as b
from .registry import query

STORED, INCOMING = "doc_id % 3 <> 0", "doc_id % 2 = 0"


def stored_takes(spark: SparkSession, d: str) -> DataFrame:
    t = b.takes(spark, d).filter(STORED)
    return t.select("recording_id", "doc_id", "project_slug", F.nullif(F.col("kind"), F.lit("")).alias("kind"), "device",
                    F.nullif(F.col("route"), F.lit("")).alias("route"), F.when(F.col("doc_id") % 5 != 0, F.col("sha")).alias("sha"), "imported_at_ms")


def incoming_takes(spark: SparkSession, d: str) -> DataFrame:
    t = b.takes(spark, d).filter(INCOMING)
    i = F.col("doc_id")
    return t.select(
        "recording_id", i, F.concat("project_slug", F.lit("_new")).alias("project_slug"), F.when(i % 4 == 0, "positive").alias("kind"),
        F.concat(F.lit("dev"), (i % 9).cast("string")).alias("device"), F.when(i % 6 == 0, "usb").alias("route"),
        F.when(i % 7 == 0, F.upper("sha")).when(i % 11 == 0, F.lit("ffff")).otherwise(F.col("sha")).alias("sha"), (F.col("imported_at_ms") + 1).alias("imported_at_ms"))


_SIDES = """
st AS (SELECT recording_id, doc_id, project_slug, NULLIF(kind, '') AS kind, device, NULLIF(route, '') AS route,
    CASE WHEN doc_id % 5 <> 0 THEN sha END AS sha, imported_at_ms FROM v_takes WHERE doc_id % 3 <> 0),
nw AS (SELECT recording_id, doc_id, project_slug || '_new' AS project_slug, CASE WHEN doc_id % 4 = 0 THEN 'positive' END AS kind, 'dev' || (doc_id % 9) AS device,
    CASE WHEN doc_id % 6 = 0 THEN 'usb' END AS route, CASE WHEN doc_id % 7 = 0 THEN upper(sha) WHEN doc_id % 11 = 0 THEN 'ffff' ELSE sha END AS sha,
    imported_at_ms + 1 AS imported_at_ms FROM v_takes WHERE doc_id % 2 = 0)"""


@query("recording_upsert", f"""
WITH {_SIDES}
SELECT COALESCE(n.recording_id, s.recording_id) AS recording_id, COALESCE(n.doc_id, s.doc_id) AS doc_id, COALESCE(n.project_slug, s.project_slug) AS project_slug,
  COALESCE(n.kind, s.kind) AS kind, COALESCE(n.device, s.device) AS device, COALESCE(n.route, s.route) AS route, COALESCE(n.sha, s.sha) AS sha,
  COALESCE(s.imported_at_ms, n.imported_at_ms) AS imported_at_ms
FROM st s FULL JOIN nw n ON n.recording_id = s.recording_id""")
def recording_upsert(spark: SparkSession, d: str) -> DataFrame:
    return tb.upsert(stored_takes(spark, d), incoming_takes(spark, d), ["recording_id"], keep=["kind", "route", "sha"], frozen=["imported_at_ms"])


@query("project_upsert", """
WITH s AS (SELECT c_custkey AS id, c_name AS phrase, CASE WHEN c_custkey % 4 = 0 THEN 'x' || c_custkey END AS external_id, c_nationkey AS created FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS id, upper(c_name) AS phrase, CASE WHEN c_custkey % 5 = 0 THEN 'y' || c_custkey END AS external_id, c_nationkey + 100 AS created FROM customer WHERE c_custkey % 2 = 0)
SELECT COALESCE(n.id, s.id) AS id, COALESCE(n.phrase, s.phrase) AS phrase, COALESCE(n.external_id, s.external_id) AS external_id,
  CAST(COALESCE(s.created, n.created) AS BIGINT) AS created FROM s FULL JOIN n ON n.id = s.id""")
def project_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer")
    k = F.col("c_custkey")
    s = c.filter("c_custkey % 3 <> 0").select(k.alias("id"), F.col("c_name").alias("phrase"), F.when(k % 4 == 0, F.concat(F.lit("x"), k.cast("string"))).alias("external_id"),
                                              F.col("c_nationkey").cast("bigint").alias("created"))
    n = c.filter("c_custkey % 2 = 0").select(k.alias("id"), F.upper("c_name").alias("phrase"), F.when(k % 5 == 0, F.concat(F.lit("y"), k.cast("string"))).alias("external_id"),
                                             (F.col("c_nationkey") + 100).cast("bigint").alias("created"))
    return tb.upsert(s, n, ["id"], keep=["external_id"], frozen=["created"])


@query("slice_replace", """
WITH n AS (SELECT slice_id, recording_id, category, start_ms + 7 AS start_ms, 'active' AS status FROM v_slices WHERE doc_id % 2 = 0 AND k % 2 = 0)
SELECT slice_id, recording_id, category, start_ms, status FROM v_slices s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.recording_id = s.recording_id)
UNION ALL SELECT * FROM n""")
def slice_replace(spark: SparkSession, d: str) -> DataFrame:
    """A re-cut take loses all its rows, deleted ones too, and gets the new set."""
    s = b.slices(spark, d)
    cols = ["slice_id", "recording_id", "category", "start_ms", "status"]
    fresh = s.filter("doc_id % 2 = 0 AND k % 2 = 0").withColumn("start_ms", F.col("start_ms") + 7).withColumn("status", F.lit("active"))
    return tb.replace_groups(s.select(*cols), fresh.select(*cols), ["recording_id"])


@query("transcript_append", """
WITH s AS (SELECT o_custkey AS id, o_orderkey AS version, o_orderkey = MAX(o_orderkey) OVER (PARTITION BY o_custkey) AS is_current FROM orders),
n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0)
SELECT s.id, version, is_current AND n.id IS NULL AS is_current FROM s LEFT JOIN n ON n.id = s.id
UNION ALL SELECT n.id, COALESCE(MAX(s.version), 0) + 1, TRUE FROM n LEFT JOIN s ON s.id = n.id GROUP BY n.id""")
def transcript_append(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"))
    s = tb.mark_current(o, "id", "version", ["version"])
    n = b.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return tb.append_version(s, n, "id").select("id", "version", "is_current")


@query("insert_ignore", f"""
WITH {_SIDES}
SELECT recording_id, sha FROM st UNION ALL SELECT recording_id, sha FROM nw WHERE recording_id NOT IN (SELECT recording_id FROM st)""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    cols = ["recording_id", "sha"]
    return tb.insert_ignore(stored_takes(spark, d).select(*cols), incoming_takes(spark, d).select(*cols), ["recording_id"])


@query("model_registry", """
WITH s AS (SELECT slug, run_id, created_at_ms, metric FROM v_models WHERE run_id % 3 <> 0),
n AS (SELECT slug, run_id, MIN(created_at_ms) AS created_at_ms, MIN(metric) + 1 AS metric FROM v_models WHERE run_id % 2 = 0 GROUP BY ALL),
u AS (SELECT * FROM s UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.slug = n.slug AND s.run_id = n.run_id))
SELECT slug, run_id, round(metric, 6) AS metric, run_id = first_value(run_id) OVER (PARTITION BY slug ORDER BY created_at_ms DESC, run_id DESC) AS is_current FROM u""")
def model_registry(spark: SparkSession, d: str) -> DataFrame:
    m = b.models(spark, d).select("slug", "run_id", "created_at_ms", "metric")
    fresh = m.filter("run_id % 2 = 0").withColumn("metric", F.col("metric") + 1)
    merged = tb.insert_ignore(m.filter("run_id % 3 <> 0"), fresh, ["slug", "run_id"])
    return tb.mark_current(merged, "slug", "run_id", ["created_at_ms", "run_id"]).select("slug", "run_id", F.round("metric", 6).alias("metric"), "is_current")


@query("soft_delete", """
WITH g AS (SELECT DISTINCT project_slug, category, file_name FROM v_slices WHERE k % 3 = 1)
SELECT slice_id, CASE WHEN g.file_name IS NOT NULL AND status = 'active' THEN 'deleted' ELSE status END AS status FROM v_slices s
LEFT JOIN g ON g.project_slug = s.project_slug AND g.category = s.category AND g.file_name = s.file_name""")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    s = b.slices(spark, d)
    return tb.soft_delete(s, s.filter("k % 3 = 1")).select("slice_id", "status")


@query("cascade_delete", """
SELECT 'takes' AS "table", recording_id FROM v_takes WHERE doc_id % 4 <> 0
UNION ALL SELECT 'slices', recording_id FROM v_slices WHERE doc_id % 4 <> 0""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    takes = b.takes(spark, d)
    left = tb.cascade_delete({"takes": takes.select("recording_id"), "slices": b.slices(spark, d).select("recording_id")},
                             takes.filter("doc_id % 4 = 0"), "recording_id")
    return left["takes"].select(F.lit("takes").alias("table"), "recording_id").unionByName(
        left["slices"].select(F.lit("slices").alias("table"), "recording_id"))


_CURVES_SQL = """
cw AS (SELECT recording_id, 'full' AS mode, 10 AS step_ms, 700 AS keep_ms, 'run-' || (doc_id % 4) AS model_fp FROM v_takes),
cs AS (SELECT recording_id, 'full' AS mode, 10 AS step_ms, 700 AS keep_ms, 'run-' || (doc_id % 3) AS model_fp,
    CASE WHEN doc_id % 13 <> 0 THEN [1.0] END AS scores FROM v_takes)"""


def _curve_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = b.takes(spark, d)

    def side(mod: int) -> DataFrame:
        return t.select("doc_id", "recording_id", F.lit("full").alias("mode"), F.lit(10).alias("step_ms"), F.lit(700).alias("keep_ms"),
                        F.concat(F.lit("run-"), (F.col("doc_id") % mod).cast("string")).alias("model_fp"))

    text = F.when(F.col("doc_id") % 13 != 0, F.lit("[1.0]")).otherwise(F.lit("[1.0, oops"))
    curve = F.from_json(text, "array<double>")
    return side(4), side(3).withColumn("times_ms", curve).withColumn("scores", curve)


@query("curve_worklist", f"""
WITH {_CURVES_SQL}
SELECT recording_id, model_fp FROM cw WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.recording_id = cw.recording_id AND cs.model_fp = cw.model_fp AND scores IS NOT NULL)""")
def curve_worklist(spark: SparkSession, d: str) -> DataFrame:
    wanted, curves = _curve_sides(spark, d)
    return tb.curves_to_score(wanted, curves).select("recording_id", "model_fp")


@query("curve_cache_hits", f"""
WITH {_CURVES_SQL} SELECT recording_id, model_fp FROM cs WHERE EXISTS (SELECT 1 FROM cw WHERE cs.recording_id = cw.recording_id AND cs.model_fp = cw.model_fp)""")
def curve_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    wanted, curves = _curve_sides(spark, d)
    return tb.cached_curves(wanted, curves).select("recording_id", "model_fp")


@query("score_worklist", f"""
WITH {_CURVES_SQL}
SELECT t.recording_id, t.imported_at_ms FROM v_takes t JOIN cw ON cw.recording_id = t.recording_id WHERE starts_with(t.recording_id, 'test_')
  AND NOT EXISTS (SELECT 1 FROM cs WHERE cs.recording_id = cw.recording_id AND cs.model_fp = cw.model_fp AND scores IS NOT NULL)""")
def score_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Test takes without a usable curve for the wanted model, newest first."""
    wanted, curves = _curve_sides(spark, d)
    todo = tb.curves_to_score(wanted.filter(rules.is_test(F.col("recording_id"))), curves).select("recording_id")
    return todo.join(b.takes(spark, d).select("recording_id", "imported_at_ms"), "recording_id").orderBy(F.desc("imported_at_ms"), "recording_id")


@query("grade_replace", """
WITH s AS (SELECT slug, run_id, 'full' AS mode, metric FROM v_models), n AS (SELECT slug, run_id, 'full' AS mode, metric * 2 AS metric FROM v_models WHERE run_id % 5 = 0)
SELECT slug, run_id, round(metric, 4) AS metric FROM (SELECT * FROM s WHERE run_id % 5 <> 0 UNION ALL SELECT * FROM n)""")
def grade_replace(spark: SparkSession, d: str) -> DataFrame:
    m = b.models(spark, d).select("slug", "run_id", F.lit("full").alias("mode"), "metric")
    out = tb.replace_groups(m, m.filter("run_id % 5 = 0").withColumn("metric", F.col("metric") * 2), ["slug", "run_id", "mode"])
    return out.select("slug", "run_id", F.round("metric", 4).alias("metric"))


@query("idempotent_import", f"""
WITH {_SIDES} SELECT recording_id, device FROM nw WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.recording_id = nw.recording_id)""")
def idempotent_import(spark: SparkSession, d: str) -> DataFrame:
    return tb.new_rows(stored_takes(spark, d), incoming_takes(spark, d), ["recording_id"]).select("recording_id", "device")


@query("model_fingerprints", """
SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'run-' || run_id WHEN run_id % 3 = 1 THEN CAST(metric * 100 AS BIGINT) || '-' || created_at_ms * 1000000 ELSE 'nomodel' END AS model_fp
FROM v_models""")
def model_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("run_id")
    fp = tb.model_fingerprint(F.when(r % 3 == 0, r.cast("string")), F.when(r % 3 == 1, F.round(F.col("metric") * 100).cast("bigint")), F.col("created_at_ms") * 1000000)
    return b.models(spark, d).select("run_id", fp.alias("model_fp"))


@query("reprocess_list", """
SELECT recording_id, CASE WHEN doc_id % 6 = 0 THEN 'source missing' WHEN script = '__background_noise__' THEN 'recut' ELSE 'no recogniser' END AS action FROM v_takes""")
def reprocess_list(spark: SparkSession, d: str) -> DataFrame:
    t = b.takes(spark, d)
    routed = t.withColumn("strategy", F.when(F.col("script") == rules.BACKGROUND_MARKER, "background").otherwise("lexical"))
    return tb.reprocess_list(routed, t.filter("doc_id % 6 <> 0"), recogniser=False).select("recording_id", "action")


@query("reprocess_swap", """
WITH t AS (SELECT recording_id, duration_ms FROM v_takes WHERE script = '__background_noise__' AND doc_id % 6 <> 0)
SELECT recording_id, category, start_ms FROM v_slices WHERE recording_id NOT IN (SELECT recording_id FROM t)
UNION ALL SELECT recording_id, 'background', s FROM (SELECT recording_id, duration_ms, unnest(range(0, duration_ms, 2000)) AS s FROM t)
WHERE LEAST(s + 2000, duration_ms) - s >= 1000""")
def reprocess_swap(spark: SparkSession, d: str) -> DataFrame:
    """Background takes with a source are cut again; their rows in the stored table are swapped."""
    store = sinks.TakeStore(spark, state_dir(spark, "slices"))
    store.create(b.slices(spark, d).select("recording_id", "category", "start_ms"))
    t = b.takes(spark, d)
    routed = t.withColumn("strategy", F.when(F.col("script") == rules.BACKGROUND_MARKER, "background").otherwise("lexical"))

    def recut(takes: DataFrame) -> DataFrame:
        return background_windows(takes).select("recording_id", F.lit("background").alias("category"), F.col("cut_start_ms").alias("start_ms"))

    sinks.reprocess(store, tb.reprocess_list(routed, t.filter("doc_id % 6 <> 0"), recogniser=False), recut, "again")
    return store.read()


@query("missing_audio", "SELECT recording_id FROM v_takes WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def missing_audio(spark: SparkSession, d: str) -> DataFrame:
    """Takes without a listed source file (pages stand in for the listing)."""
    held = b.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return b.takes(spark, d).select("doc_id", "recording_id").join(held, "doc_id", "left_anti").select("recording_id")


# --- joins -------------------------------------------------------------------------


@query("upload_delta", f"""
WITH {_SIDES}
SELECT n.recording_id, CASE WHEN s.recording_id IS NULL THEN 'new' ELSE 'changed' END AS reason FROM nw n LEFT JOIN st s ON s.recording_id = n.recording_id
WHERE s.recording_id IS NULL OR (s.sha IS NOT NULL AND lower(s.sha) <> lower(n.sha))""")
def upload_delta(spark: SparkSession, d: str) -> DataFrame:
    return tb.upload_delta(incoming_takes(spark, d).select("recording_id", "sha"), stored_takes(spark, d)).select("recording_id", "reason")


@query("project_sync", f"""
WITH {_SIDES}
SELECT COALESCE(n.recording_id, s.recording_id) AS recording_id, CASE WHEN s.recording_id IS NULL THEN 'push' ELSE 'pull' END AS direction
FROM nw n FULL JOIN st s ON s.recording_id = n.recording_id WHERE n.recording_id IS NULL OR s.recording_id IS NULL""")
def project_sync(spark: SparkSession, d: str) -> DataFrame:
    return tb.two_way_sync(incoming_takes(spark, d), stored_takes(spark, d), "recording_id")


@query("pending_takes", f"WITH {_SIDES} SELECT recording_id FROM nw WHERE recording_id NOT IN (SELECT recording_id FROM st)")
def pending_takes(spark: SparkSession, d: str) -> DataFrame:
    return incoming_takes(spark, d).select("recording_id").join(stored_takes(spark, d).select("recording_id"), "recording_id", "left_anti")


@query("slice_provenance", """
SELECT s.slice_id, t.device, t.session_id FROM v_slices s JOIN v_takes t ON t.recording_id = s.recording_id WHERE s.status = 'active'""")
def slice_provenance(spark: SparkSession, d: str) -> DataFrame:
    return b.slices(spark, d).filter("status = 'active'").select("slice_id", "recording_id").join(
        b.takes(spark, d).select("recording_id", "device", "session_id"), "recording_id").select("slice_id", "device", "session_id")


@query("current_words", """
WITH v AS (SELECT doc_id, doc_id % 3 AS version, TRUE AS is_current FROM v_takes WHERE doc_id % 8 <> 0)
SELECT w.recording_id, COUNT(*) AS words, CAST(MAX(v.version) AS BIGINT) AS version FROM v_words w JOIN v ON v.doc_id = w.doc_id AND v.is_current GROUP BY w.recording_id""")
def current_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of takes that have a current transcript."""
    versions = b.takes(spark, d).select("doc_id", (F.col("doc_id") % 3).alias("version"), (F.col("doc_id") % 8 != 0).alias("is_current"))
    return b.words(spark, d, "doc_id", "recording_id").join(versions.filter("is_current"), "doc_id").groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("words"), F.max("version").alias("version"))


@query("test_grades", """
SELECT t.recording_id, l.quality, t.imported_at_ms FROM labels l JOIN v_takes t ON t.doc_id = l.doc_id WHERE t.recording_id LIKE 'test\\_%' ESCAPE '\\'""")
def test_grades(spark: SparkSession, d: str) -> DataFrame:
    t = b.takes(spark, d).filter(rules.is_test(F.col("recording_id"))).select("doc_id", "recording_id", "imported_at_ms")
    return b.table(spark, d, "labels").select("doc_id", "quality").join(t, "doc_id").select("recording_id", "quality", "imported_at_ms").orderBy(
        F.desc("imported_at_ms"), "recording_id")


@query("take_phrases", """
SELECT recording_id, COALESCE(p.phrase, replace(t.project_slug, '_', ' ')) AS phrase FROM v_takes t
LEFT JOIN (SELECT slug, phrase FROM v_projects WHERE slug <> 'fr') p ON p.slug = t.project_slug""")
def take_phrases(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import text

    p = b.projects(spark, d).filter("slug <> 'fr'").select(F.col("slug").alias("project_slug"), "phrase")
    return b.takes(spark, d).select("recording_id", "project_slug").join(p, "project_slug", "left").select(
        "recording_id", text.phrase_or_slug(F.col("phrase"), F.col("project_slug")).alias("phrase"))


@query("other_projects", "SELECT a.slug, b.slug AS other FROM v_projects a JOIN v_projects b ON a.slug <> b.slug")
def other_projects(spark: SparkSession, d: str) -> DataFrame:
    """Every project with every other one; the sorted id set is exploded per row."""
    p = b.projects(spark, d).select("slug")
    everyone = p.agg(F.sort_array(F.collect_set("slug"))).scalar()
    return p.select("slug", F.explode(F.array_except(everyone, F.array("slug"))).alias("other"))


@query("bed_pairing")
def bed_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Each clip with the bed its hash draws."""
    from ..operators.augment import pair_drawn

    # five steps read the slices; the texts behind them are split once
    s = settled(b.slices(spark, d).filter("category IN ('background', 'positive')").select("slice_id", "start_ms", "category"), "slices")
    beds = s.filter("category = 'background'").select(F.col("slice_id").alias("bed_id"), F.col("start_ms").alias("bed_start_ms"))
    clips = s.filter("category = 'positive'").select(F.col("slice_id").alias("clip_id"))
    return pair_drawn(clips, beds, "clip_id", "bed_id", 0, "bed").select("clip_id", "bed_id", "bed_start_ms")


_LEDGER_SQL = """
pm AS (SELECT slug, run_id, '{"n_samples": ' || (run_id % 500) || ', "context_fix": ' || CASE WHEN run_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS params FROM v_models WHERE run_id % 4 <> 0),
sm AS (SELECT slug, run_id, CASE WHEN run_id % 10 = 0 THEN '{"positive": ' ELSE '{"positive": ' || (run_id % 90) || ', "negative": ' || (run_id % 70) || '}' END AS summary FROM v_models WHERE run_id % 3 <> 0)"""


def ledger(models: DataFrame, params: DataFrame, summaries: DataFrame) -> DataFrame:
    """Runs with their sidecar documents; a missing or broken one gives nulls."""
    p = params.select("slug", "run_id", F.from_json("params", "n_samples bigint, context_fix boolean").alias("p"))
    s = summaries.select("slug", "run_id", F.from_json("summary", "positive bigint, negative bigint").alias("s"))
    return models.join(p, ["slug", "run_id"], "left").join(s, ["slug", "run_id"], "left")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    m = b.models(spark, d)
    r = F.col("run_id")
    params = m.filter("run_id % 4 <> 0").select("slug", r, F.to_json(F.struct((r % 500).alias("n_samples"), (r % 2 == 0).alias("context_fix"))).alias("params"))
    good = F.to_json(F.struct((r % 90).alias("positive"), (r % 70).alias("negative")))
    sums = m.filter("run_id % 3 <> 0").select("slug", r, F.when(r % 10 == 0, F.lit('{"positive": ')).otherwise(good).alias("summary"))
    return ledger(m, params, sums)


@query("run_ledger", f"""
WITH {_LEDGER_SQL}
SELECT m.slug, m.run_id, CAST(CASE WHEN pm.params IS NOT NULL THEN m.run_id % 500 END AS BIGINT) AS n_samples, CASE WHEN pm.params IS NOT NULL THEN m.run_id % 2 = 0 END AS context_fix,
  CASE WHEN sm.summary IS NOT NULL AND m.run_id % 10 <> 0 THEN m.run_id % 90 END AS positive, CASE WHEN sm.summary IS NOT NULL AND m.run_id % 10 <> 0 THEN m.run_id % 70 END AS negative
FROM v_models m LEFT JOIN pm ON pm.run_id = m.run_id LEFT JOIN sm ON sm.run_id = m.run_id""")
def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).select("slug", "run_id", "p.n_samples", "p.context_fix", "s.positive", "s.negative")


@query("ledger_documents", f"""
WITH {_LEDGER_SQL}
SELECT m.slug, m.run_id, '{{"run_id":' || m.run_id || ',"model_type":"' || m.model_type || '"' ||
  CASE WHEN pm.params IS NOT NULL THEN ',"params":{{"n_samples":' || (m.run_id % 500) || ',"context_fix":' || CASE WHEN m.run_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' ELSE '' END || '}}' AS document
FROM v_models m LEFT JOIN pm ON pm.run_id = m.run_id""")
def ledger_documents(spark: SparkSession, d: str) -> DataFrame:
    """The ledger re-nested as one JSON document per run."""
    return _ledger(spark, d).select("slug", "run_id", F.to_json(F.struct("run_id", "model_type", F.col("p").alias("params"))).alias("document"))
