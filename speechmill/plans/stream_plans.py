"""Streams over the given tables, run to the end of the input.

In append mode a window is emitted once the watermark (latest time minus ten
seconds) has passed its end; a closing row ends the input, so that all windows
are emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..streaming import live
from . import bindings as b
from .registry import query
from .score_plans import EVENT_SQL

T = 0.5


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return b.event_ticks(live.file_stream(spark, d, "events.parquet"))


def _to_the_end(spark: SparkSession, d: str, operator, name: str) -> DataFrame:
    """The operator over all ticks, with the windows still open at the end."""
    stream = ticks(spark, d)
    closing = live.Closing(spark, stream.schema)

    def close() -> None:
        closing.close(recording_id="", model="", t_ms=live.Closing.FAR_MS, seq=0, score=1.0)

    return live.drain(operator(stream.unionByName(closing.rows)), name, close=close).withColumn("peak", F.round("peak", 6))


@query("stream_fire_events", f"""
WITH {EVENT_SQL}
SELECT recording_id, model, start_ms, end_ms, peak_ms, round(peak, 6) AS peak, n FROM evt""")
def stream_fire_events(spark: SparkSession, d: str) -> DataFrame:
    return _to_the_end(spark, d, lambda t: live.fire_events(t, T, 150), "fire")


@query("stream_sliding_peak", """
WITH w AS (SELECT recording_id, model, unnest(range((t_ms // 10) * 10 - 140, (t_ms // 10) * 10 + 10, 10)) AS start_ms, score FROM v_ticks)
SELECT recording_id, model, start_ms, round(MAX(score), 6) AS peak FROM w GROUP BY ALL""")
def stream_sliding_peak(spark: SparkSession, d: str) -> DataFrame:
    return _to_the_end(spark, d, live.sliding_peak, "slide")


@query("stream_background_chunks", """
WITH c AS (SELECT recording_id, model, (t_ms // 2000) * 2000 AS start_ms, score FROM v_ticks)
SELECT recording_id, model, start_ms, COUNT(*) AS n, round(MAX(score), 6) AS peak FROM c GROUP BY ALL""")
def stream_background_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _to_the_end(spark, d, live.background_chunks, "chunks")


@query("stream_target_match", """
SELECT t.recording_id, t.model, g.target_id, COUNT(*) AS hot, round(MAX(t.score), 6) AS peak FROM v_targets g JOIN v_ticks t ON t.recording_id = g.recording_id
  AND t.score >= 0.5 AND t.t_ms BETWEEN g.end_ms - 1200 AND g.end_ms + 1200 GROUP BY ALL""")
def stream_target_match(spark: SparkSession, d: str) -> DataFrame:
    targets = b.event_targets(live.file_stream(spark, d, "events.parquet"))
    return live.target_matches(ticks(spark, d), targets, T, counted="match").withColumn("peak", F.round("peak", 6))


@query("stream_target_misses", """
SELECT g.recording_id, m.model, g.target_id, g.end_ms FROM v_targets g JOIN (SELECT DISTINCT recording_id, model FROM v_ticks) m ON m.recording_id = g.recording_id
WHERE NOT EXISTS (SELECT 1 FROM v_ticks t WHERE t.recording_id = g.recording_id AND t.model = m.model AND t.score >= 0.5
  AND t.t_ms BETWEEN g.end_ms - 1200 AND g.end_ms + 1200)""")
def stream_target_misses(spark: SparkSession, d: str) -> DataFrame:
    wanted = b.event_targets(live.file_stream(spark, d, "events.parquet"))
    curves = b.ticks(spark, d).select("recording_id", "model").distinct()
    return live.target_misses(ticks(spark, d), wanted, curves, T, counted="misses")


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    """Every document uploaded twice."""
    docs = live.file_stream(spark, d, "documents.parquet")
    return docs.select(b.recording_id_of(F.col("doc_id")).alias("recording_id"), "doc_id", F.sha2("text", 256).alias("sha256"),
                       F.timestamp_millis(F.lit(1700000000000) + F.col("doc_id") * 1000).alias("at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"))


@query("stream_unique_uploads", "SELECT recording_id, sha AS sha256 FROM v_takes")
def stream_unique_uploads(spark: SparkSession, d: str) -> DataFrame:
    return live.drain(live.unique_uploads(_uploads(spark, d), ["recording_id", "sha256"], "at"), "uploads").select("recording_id", "sha256")


@query("stream_ingest", "SELECT recording_id, sha AS sha256 FROM v_takes WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """New and changed takes against a store that holds other checksums for some."""
    stored = b.takes(spark, d).filter("doc_id % 3 <> 0").select(
        "recording_id", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("sha")).alias("sha256"))
    return live.ingest(_uploads(spark, d).select("recording_id", "sha256"), stored, ["recording_id", "sha256"])


@query("stream_run_state", """
SELECT slug, arg_max(run_id, (created_at_ms, run_id)) AS run_id, arg_max(model_type, (created_at_ms, run_id)) AS model_type FROM v_models GROUP BY slug""")
def stream_run_state(spark: SparkSession, d: str) -> DataFrame:
    o = live.file_stream(spark, d, "orders.parquet")
    log = o.select(F.concat(F.lit("slug_"), (F.col("o_custkey") % 50).cast("string")).alias("slug"), F.col("o_orderkey").alias("run_id"),
                   F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at_ms"), F.col("o_orderpriority").alias("model_type"))
    return live.latest_state(log, ["slug"], ["created_at_ms", "run_id"], ["run_id", "model_type"])


@query("stream_counters", "SELECT lang, source, COUNT(*) AS n FROM documents GROUP BY ALL")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    return live.rolling_counts(live.file_stream(spark, d, "documents.parquet").select("lang", "source"), ["lang", "source"])


@query("stream_hysteresis", """
WITH s AS (SELECT *, CASE WHEN score >= 0.7 THEN 1 WHEN score < 0.2 THEN 0 END AS st FROM v_ticks),
v AS (SELECT recording_id, model, t_ms, seq, COALESCE(last_value(st IGNORE NULLS) OVER (PARTITION BY recording_id, model ORDER BY t_ms, seq
    ROWS UNBOUNDED PRECEDING), 0) AS v FROM s),
o AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY recording_id, model ORDER BY t_ms, seq) AS pv FROM v) WHERE v <> COALESCE(pv, 0)),
l AS (SELECT recording_id, model, MAX(t_ms) AS last FROM v_ticks GROUP BY ALL),
e AS (SELECT recording_id, model, v, t_ms AS start, lead(t_ms) OVER (PARTITION BY recording_id, model ORDER BY t_ms, seq) AS nx FROM o)
SELECT e.recording_id, e.model, start, COALESCE(nx, last) AS "end", nx IS NULL AS is_open FROM e JOIN l ON l.recording_id = e.recording_id AND l.model = e.model WHERE v = 1""")
def stream_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return live.hysteresis(ticks(spark, d), 0.7, 0.2, ev.BLOCK)
