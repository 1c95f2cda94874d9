"""Queries over audio clips and embedding series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import signal as sg
from ..functions.rows import explode_rows, inline_rows
from ..operators import augment as au
from ..operators import frames as fr
from ..operators import ranking as rk
from ..operators import scoring as sc
from ..session import settled
from . import bindings as b
from .registry import query

RATE = 100
FRAME = 2  # samples of 20 ms at 100 Hz

S = "samples"


def _sum(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x)


@query("clip_levels", """
SELECT take_id, MAX(abs(x)) AS peak, round(sqrt(SUM(CAST(x AS BIGINT) * x)::DOUBLE / COUNT(*)), 6) AS rms, COUNT(*) * 10 AS duration_ms,
  MAX(abs(x)) >= 32760 AS clipping, sqrt(SUM(CAST(x AS BIGINT) * x)::DOUBLE / COUNT(*)) < 50 AS quiet, COUNT(*) * 10 > 5000 AS long
FROM v_samples GROUP BY take_id""")
def clip_levels(spark: SparkSession, d: str) -> DataFrame:
    c = b.clips(spark, d).select("take_id", sg.peak(F.col(S)).alias("peak"), sg.rms(F.col(S)).alias("r"),
                                 (F.size(S) * 10).cast("bigint").alias("duration_ms"))
    return c.select("take_id", "peak", F.round("r", 6).alias("rms"), "duration_ms", (F.col("peak") >= 32760).alias("clipping"),
                    (F.col("r") < 50).alias("quiet"), (F.col("duration_ms") > 5000).alias("long"))


@query("audio_warnings", """
WITH c AS (SELECT take_id, MAX(abs(x)) AS peak, sqrt(SUM(CAST(x AS BIGINT) * x)::DOUBLE / COUNT(*)) AS rms, COUNT(*) * 10 AS ms,
    CASE WHEN CAST(split_part(take_id, '_', 1) AS INT) % 3 = 0 THEN 2 ELSE 1 END AS ch,
    CASE WHEN CAST(split_part(take_id, '_', 1) AS INT) % 4 = 0 THEN 8000 ELSE 16000 END AS rate FROM v_samples GROUP BY take_id)
SELECT take_id, unnest(list_filter([
  CASE WHEN ch <> 1 THEN 'expected mono, got ' || ch || ' channels' END,
  CASE WHEN rate <> 16000 THEN 'expected 16000 Hz, got ' || rate END,
  CASE WHEN peak >= 32760 THEN 'possible clipping, peak=' || peak END,
  CASE WHEN rms < 50 AND ms > 0 THEN 'very quiet audio' END,
  CASE WHEN ms <= 0 THEN 'zero duration' END, CASE WHEN ms > 5000 THEN 'long clip' END], lambda x: x IS NOT NULL)) AS warning FROM c""")
def audio_warnings(spark: SparkSession, d: str) -> DataFrame:
    label = F.split_part("take_id", F.lit("_"), F.lit(1)).cast("int")
    c = b.clips(spark, d).select("take_id", label.alias("label"), sg.peak(F.col(S)).alias("peak"), sg.rms(F.col(S)).alias("rms"),
                                 (F.size(S) * 10).alias("ms"))
    found = F.concat(
        rules.spec_warnings("", F.when(F.col("label") % 3 == 0, 2).otherwise(1), F.lit(16),
                            F.when(F.col("label") % 4 == 0, 8000).otherwise(16000)),
        rules.amplitude_warnings(F.col("peak"), F.col("rms"), F.col("ms")), rules.duration_warnings(F.col("ms")))
    return c.select("take_id", F.explode(found).alias("warning"))


_ENVELOPE_SQL = """
env AS (SELECT take_id, i // 2 AS f, sqrt(SUM(CAST(x AS BIGINT) * x)::DOUBLE / COUNT(*)) AS e, ANY_VALUE(n) AS n
  FROM v_samples GROUP BY take_id, i // 2),
lev AS (SELECT take_id, ANY_VALUE(n) * 10.0::DOUBLE AS total_ms, list(e ORDER BY e)[CAST(floor(COUNT(*) * 0.1::DOUBLE) AS INT) + 1] AS fl, MAX(e) AS pk
  FROM env GROUP BY take_id),
oc AS (SELECT *, fl + 0.22::DOUBLE * (pk - fl) AS open_at, fl + 0.12::DOUBLE * (pk - fl) AS close_at FROM lev WHERE pk - fl >= 1.0)"""

_BURST_SQL = f"""
{_ENVELOPE_SQL},
st AS (SELECT e.take_id, f, CASE WHEN e >= open_at THEN 1 WHEN e < close_at THEN 0 END AS s FROM env e JOIN oc USING (take_id)),
vo AS (SELECT take_id, f, COALESCE(last_value(s IGNORE NULLS) OVER (PARTITION BY take_id ORDER BY f), 0) AS v FROM st),
ru AS (SELECT take_id, MIN(f) AS a, MAX(f) + 1 AS z FROM (
    SELECT *, f - ROW_NUMBER() OVER (PARTITION BY take_id, v ORDER BY f) AS g FROM vo) WHERE v = 1 GROUP BY take_id, g),
sp AS (SELECT r.take_id, a * 20.0::DOUBLE AS s, LEAST(z * 20.0::DOUBLE, total_ms) AS t, total_ms FROM ru r JOIN oc USING (take_id)),
mg AS (SELECT *, SUM(CASE WHEN s - pt < 350.0 THEN 0 ELSE 1 END) OVER (PARTITION BY take_id ORDER BY s) AS g
  FROM (SELECT *, lag(t) OVER (PARTITION BY take_id ORDER BY s) AS pt FROM sp)),
bu AS (SELECT take_id, MIN(s) AS s, MAX(t) AS t, ANY_VALUE(total_ms) AS total_ms FROM mg GROUP BY take_id, g),
bursts AS (SELECT take_id, GREATEST(s - 100, 0) AS start_ms, LEAST(t + 180, total_ms) AS end_ms FROM bu WHERE t - s >= 80)"""


@query("rms_envelope", f"WITH {_ENVELOPE_SQL} SELECT take_id, CAST(f AS INTEGER) AS frame, round(e, 6) AS rms FROM env")
def rms_envelope(spark: SparkSession, d: str) -> DataFrame:
    return explode_rows(b.clips(spark, d), ["take_id"], sg.rms_envelope(F.col(S), F.lit(FRAME)), "frame", "e").select(
        "take_id", "frame", F.round("e", 6).alias("rms"))


@query("energy_levels", f"WITH {_ENVELOPE_SQL} SELECT take_id, round(open_at, 6) AS open_at, round(close_at, 6) AS close_at FROM oc")
def energy_levels(spark: SparkSession, d: str) -> DataFrame:
    lev = b.clips(spark, d).select("take_id", sg.open_close(sg.rms_envelope(F.col(S), F.lit(FRAME))).alias("l"))
    return lev.filter("l IS NOT NULL").select("take_id", F.round("l.open", 6).alias("open_at"), F.round("l.close", 6).alias("close_at"))


def bursts(clips: DataFrame, rate: Column) -> DataFrame:
    """Sound bursts of clips(take_id, samples): take_id, start_ms, end_ms."""
    frame = sg.frame_length(rate)
    env = clips.withColumn("_env", sg.rms_envelope(F.col(S), frame)).withColumn("_lev", sg.open_close(F.col("_env")))
    runs = sg.hysteresis_runs(F.col("_env"), F.col("_lev.open"), F.col("_lev.close"))
    spans = sg.merge_and_pad(runs, frame * 1000.0 / rate, sg.total_ms(F.col(S), rate))
    return inline_rows(env, ["take_id"], spans).toDF("take_id", "start_ms", "end_ms")


@query("hysteresis_runs", f"WITH {_BURST_SQL} SELECT take_id, CAST(a AS BIGINT) AS first_frame, CAST(z AS BIGINT) AS end_frame FROM ru")
def hysteresis_runs(spark: SparkSession, d: str) -> DataFrame:
    env = b.clips(spark, d).withColumn("_env", sg.rms_envelope(F.col(S), F.lit(FRAME))).withColumn("_lev", sg.open_close(F.col("_env")))
    runs = inline_rows(env, ["take_id"], sg.hysteresis_runs(F.col("_env"), F.col("_lev.open"), F.col("_lev.close")))
    return runs.select("take_id", F.col("start").cast("bigint").alias("first_frame"), F.col("end").cast("bigint").alias("end_frame"))


@query("long_take_bursts", f"WITH {_BURST_SQL.replace('v_samples', 'v_long_samples')} SELECT take_id, start_ms, end_ms FROM bursts")
def long_take_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of takes that grow with the table, given as many rows of samples."""
    return fr.energy_bursts(b.long_takes(spark, d), ["take_id"], "offset", S, RATE)


@query("energy_bursts", f"WITH {_BURST_SQL} SELECT take_id, start_ms, end_ms FROM bursts")
def energy_bursts(spark: SparkSession, d: str) -> DataFrame:
    return bursts(b.clips(spark, d), F.lit(RATE))


@query("energy_slices", f"""
WITH {_BURST_SQL},
cl AS (SELECT take_id, CASE WHEN end_ms - start_ms > 1500 THEN end_ms - 1500 ELSE start_ms END AS s, end_ms AS e FROM bursts)
SELECT cl.take_id, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, COUNT(*) AS samples, CAST(SUM(x) AS BIGINT) AS sample_sum
FROM cl JOIN v_samples v ON v.take_id = cl.take_id AND v.i >= floor(s * 100 / 1000.0::DOUBLE) AND v.i < ceil(e * 100 / 1000.0::DOUBLE)
GROUP BY cl.take_id, s, e""")
def energy_slices(spark: SparkSession, d: str) -> DataFrame:
    """Bursts clamped to 1.5 s (tail kept) and cut out of the clip."""
    from ..operators.words import clamp_span

    c = b.clips(spark, d)
    start, end = clamp_span(F.col("start_ms"), F.col("end_ms"), True)
    cuts = bursts(c, F.lit(RATE)).select("take_id", start.alias("start_ms"), end.alias("end_ms"))
    cut = c.join(cuts, "take_id").withColumn("part", sg.cut(F.col(S), F.lit(RATE), F.col("start_ms"), F.col("end_ms")))
    return cut.filter("part IS NOT NULL").select(
        "take_id", F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"),
        F.size("part").cast("bigint").alias("samples"),
        F.aggregate("part", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sample_sum"))


@query("float_levels", """
WITH n AS (SELECT take_id, MAX(abs(x / 32768.0::DOUBLE)) AS pk FROM v_samples GROUP BY take_id),
y AS (SELECT v.take_id, x / 32768.0::DOUBLE AS f, CASE WHEN pk < 1e-8 THEN x / 32768.0::DOUBLE ELSE x / 32768.0::DOUBLE * (0.7::DOUBLE / pk) END AS s,
  x / 32768.0::DOUBLE * 4 * CASE WHEN pk * 4 > 0.99 THEN 0.99::DOUBLE / (pk * 4) ELSE 1 END AS g FROM v_samples v JOIN n USING (take_id))
SELECT take_id, round(SUM(f), 6) AS float_sum, round(SUM(s), 6) AS normal_sum, round(MAX(abs(s)), 6) AS normal_peak,
  round(SUM(g), 6) AS guarded_sum, round(MAX(abs(g)), 6) AS guarded_peak FROM y GROUP BY take_id""")
def float_levels(spark: SparkSession, d: str) -> DataFrame:
    f = b.clips(spark, d).select("take_id", sg.to_float(F.col(S)).alias("f"))
    y = f.select("take_id", "f", sg.scale_to_peak(F.col("f"), 0.7).alias("s"),
                 sg.guard_clipping(F.transform("f", lambda x: x * 4)).alias("g"))
    return y.select("take_id", F.round(_sum(F.col("f")), 6).alias("float_sum"), F.round(_sum(F.col("s")), 6).alias("normal_sum"),
                    F.round(sg.peak(F.col("s")), 6).alias("normal_peak"), F.round(_sum(F.col("g")), 6).alias("guarded_sum"),
                    F.round(sg.peak(F.col("g")), 6).alias("guarded_peak"))


@query("edge_fades", """
SELECT take_id, round(SUM(x / 32768.0::DOUBLE * CASE WHEN n < 32 THEN 1 WHEN i < 16 THEN 0.5::DOUBLE * (1 - cos(i * (pi() / 15)))
  WHEN i >= n - 16 THEN 0.5::DOUBLE * (1 - cos((n - 1 - i) * (pi() / 15))) ELSE 1 END), 6) AS faded_sum FROM v_samples GROUP BY take_id""")
def edge_fades(spark: SparkSession, d: str) -> DataFrame:
    return b.clips(spark, d).select("take_id", F.round(_sum(sg.fade_edges(sg.to_float(F.col(S)), 16)), 6).alias("faded_sum"))


_MIX_SQL = """
bed AS (SELECT take_id AS bed_id, x / 32768.0::DOUBLE AS y, i, n FROM v_samples),
pr AS (SELECT DISTINCT take_id, n, ((CAST(split_part(take_id, '_', 1) AS INT) + 1) % 10) || '_' || split_part(take_id, '_', 2) AS bed_id FROM v_samples)"""


@query("snr_mix", f"""
WITH {_MIX_SQL},
z AS (SELECT v.take_id, v.x / 32768.0::DOUBLE AS x, b.y FROM v_samples v JOIN pr USING (take_id)
  JOIN (SELECT DISTINCT bed_id, n AS bn FROM bed) bn ON bn.bed_id = pr.bed_id JOIN bed b ON b.bed_id = pr.bed_id AND b.i = v.i % bn.bn),
p AS (SELECT take_id, AVG(x * x) AS ap, AVG(y * y) AS bp FROM z GROUP BY take_id)
SELECT take_id, round(ANY_VALUE(sqrt((ap + 1e-8) / ((bp + 1e-8) * pow(10.0::DOUBLE, 0.6::DOUBLE)))), 6) AS scale,
  round(SUM(x + sqrt((ap + 1e-8) / ((bp + 1e-8) * pow(10.0::DOUBLE, 0.6::DOUBLE))) * y), 6) AS mixed_sum FROM z JOIN p USING (take_id) GROUP BY take_id""")
def snr_mix(spark: SparkSession, d: str) -> DataFrame:
    """Each clip with the next label's clip, looped to its length, at 6 dB."""
    f = b.clips(spark, d).select("take_id", sg.to_float(F.col(S)).alias("x"))
    part = F.split("take_id", "_")
    bed_id = F.concat(((part[0].cast("int") + 1) % 10).cast("string"), F.lit("_"), part[1])
    pairs = f.withColumn("bed_id", bed_id).join(f.select(F.col("take_id").alias("bed_id"), F.col("x").alias("bed")), "bed_id")
    fit = pairs.withColumn("bed", sg.loop_to(F.col("bed"), F.size("x"), F.lit(0)))
    fit = fit.withColumn("_scale", sg.snr_scale(sg.power(F.col("x")), sg.power(F.col("bed")), F.lit(6.0)))
    return fit.select("take_id", F.round("_scale", 6).alias("scale"),
                      F.round(_sum(sg.mix(F.col("x"), F.col("bed"), F.col("_scale"))), 6).alias("mixed_sum"))


@query("window_fits", """
WITH j AS (SELECT *, 2000 - (CAST(split_part(take_id, '_', 1) AS INT) * 37) % 200 AS e FROM v_samples)
SELECT take_id, CAST(SUM(CASE WHEN i >= n - LEAST(n, e) THEN x * (2000 - (2000 - e) - n + i + 1) ELSE 0 END) AS BIGINT) AS tail_moment,
  CAST(SUM(CASE WHEN n < 2000 THEN x * (i + (2000 - n) // 2 + 1) WHEN i >= (n - 2000) // 2 AND i < (n - 2000) // 2 + 2000
    THEN x * (i - (n - 2000) // 2 + 1) ELSE 0 END) AS BIGINT) AS center_moment FROM j GROUP BY take_id""")
def window_fits(spark: SparkSession, d: str) -> DataFrame:
    """Tail-aligned and centred windows; sums of sample times position."""
    jitter = (F.split_part("take_id", F.lit("_"), F.lit(1)).cast("int") * 37) % 200
    f = b.clips(spark, d).select("take_id", F.transform(S, lambda x: x.cast("double")).alias("x"), jitter.alias("j"))

    def moment(a: Column) -> Column:
        return F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x).cast("bigint")

    return f.select("take_id", moment(sg.align_to_end(F.col("x"), 2000, F.col("j"))).alias("tail_moment"),
                    moment(sg.center_fit(F.col("x"), 2000)).alias("center_moment"))


@query("reset_windows", """
WITH t AS (SELECT DISTINCT take_id, n FROM v_samples),
g AS (SELECT take_id, n, CAST(LEAST(e, n) AS BIGINT) AS e FROM (SELECT take_id, n, unnest(range(50, n + 50, 50)) AS e FROM t WHERE n > 0))
SELECT g.take_id, e AS end_at, CAST(COUNT(*) AS BIGINT) AS kept, CAST(SUM(x * (200 - (e - i) + 1)) AS BIGINT) AS moment
FROM g JOIN v_samples v ON v.take_id = g.take_id AND v.i < e AND v.i >= e - 70 GROUP BY g.take_id, e""")
def reset_windows(spark: SparkSession, d: str) -> DataFrame:
    """Scan grid every 0.5 s with the last 0.7 s kept in a 2 s silent window."""
    ends = b.clips(spark, d).select("take_id", F.transform(S, lambda x: x.cast("double")).alias("x"),
                                    F.explode(sg.scan_ends(F.size(S), 50)).alias("end_at"))
    w = sg.reset_window(F.col("x"), F.col("end_at"), 70, 200)
    moment = F.aggregate(F.transform(w, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return ends.select("take_id", F.col("end_at").cast("bigint").alias("end_at"),
                       F.least(F.col("end_at"), F.lit(70)).cast("bigint").alias("kept"), moment.cast("bigint").alias("moment"))


_BANK_SQL = """
bank AS (SELECT vec_id // 400 AS take, vec_id % 400 AS pos, vec_id, embedding AS v FROM embeddings),
win AS (SELECT e.take, e.pos, k, b.vec_id, b.v FROM (SELECT take, pos, unnest(range(0, 16)) AS k FROM bank WHERE pos >= 120 AND (pos - 120) % 2 = 0) e
  JOIN bank b ON b.take = e.take AND b.pos = e.pos - 8 * (15 - k))"""


def bank(spark: SparkSession, d: str) -> DataFrame:
    v = b.table(spark, d, "embeddings")
    return v.select(F.expr("vec_id div 400").alias("take"), (F.col("vec_id") % 400).alias("pos"), "vec_id",
                    F.transform("embedding", lambda e: e.cast("double")).alias("v"))


@query("strided_windows", f"""
WITH {_BANK_SQL}
SELECT take, pos, (pos + 76) * 10.0::DOUBLE AS time_ms, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY k) AS vec_ids FROM win GROUP BY take, pos""")
def strided_windows(spark: SparkSession, d: str) -> DataFrame:
    w = sc.strided_windows(bank(spark, d), "take", "pos", "vec_id", 2)
    return w.select("take", "pos", "time_ms", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("vec_ids"))


def test_weights(shift: int) -> np.ndarray:
    k, j = np.meshgrid(np.arange(16), np.arange(64), indexing="ij")
    return ((k * 7 + j * 3 + shift) % 11 - 5) / 100.0


@query("window_scores", f"""
WITH {_BANK_SQL},
u AS (SELECT take, pos, k, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM win),
s AS (SELECT take, pos, SUM(x::DOUBLE * ((k * 7 + j * 3) % 11 - 5) / 100.0::DOUBLE) AS a, SUM(x::DOUBLE * ((k * 7 + j * 3 + 4) % 11 - 5) / 100.0::DOUBLE) AS c
  FROM u GROUP BY take, pos)
SELECT take, pos, 'linear_a' AS model, round(1 / (1 + exp(-a)), 4) AS score, CAST(NULL AS VARCHAR) AS error FROM s
UNION ALL SELECT take, pos, 'linear_b', round(1 / (1 + exp(-c)), 4), NULL FROM s
UNION ALL SELECT take, pos, 'missing', NULL, 'no model file' FROM s""")
def window_scores(spark: SparkSession, d: str) -> DataFrame:
    w = sc.strided_windows(bank(spark, d), "take", "pos", "v", 2)
    models = {"linear_a": sc.linear_head(test_weights(0)), "linear_b": sc.linear_head(test_weights(4)),
              "missing": sc.failing_head("no model file")}
    return sc.score_windows(w, ["take", "pos"], models, decimals=4)


@query("composite_windows")
def composite_windows(spark: SparkSession, d: str) -> DataFrame:
    """Composited windows of all clips; draws are hashes, so there is no SQL twin."""
    f = settled(b.clips(spark, d).select(F.col("take_id").alias("clip_id"), sg.to_float(F.col(S)).alias("samples")), "clips")
    cfg = au.CompositeSettings(rate=100, fade_ms=100.0)
    beds = f.select(F.col("clip_id").alias("bed_id"), F.col("samples").alias("bed"))
    fillers = f.select(F.col("clip_id").alias("filler_id"), F.col("samples").alias("filler"))
    out = au.compose(f, beds, fillers.filter("filler_id LIKE '1%'"), fillers.filter("filler_id NOT LIKE '1%'"), cfg)
    return out.select("clip_id", F.size("window").cast("bigint").alias("length"), F.round(sg.peak(F.col("window")), 6).alias("peak"),
                      "margin", F.round("snr_db", 6).alias("snr_db"), "bed_id", "has_filler")


@query("augmentation_round")
def augmentation_round(spark: SparkSession, d: str) -> DataFrame:
    f = settled(b.clips(spark, d).select(
        F.col("take_id").alias("clip_id"), sg.to_float(F.col(S)).alias("samples"),
        F.when(F.startswith("take_id", F.lit("1")), "positive_train").otherwise("negative_train").alias("split")), "clips")
    cfg = au.CompositeSettings(rate=100, fade_ms=100.0)
    beds = f.select(F.col("clip_id").alias("bed_id"), F.col("samples").alias("bed"))
    fillers = f.select(F.col("clip_id").alias("filler_id"), F.col("samples").alias("filler"))
    out = au.augmentation_round(f, beds, fillers, fillers, 0, cfg)
    return out.select("clip_id", "split", "round", F.size("samples").cast("bigint").alias("length"),
                      F.round(_sum(F.col("samples")), 6).alias("sample_sum"))


_REF_SQL = """
refs AS (SELECT project_slug AS slug, doc_id, duration_ms / 1000.0::DOUBLE AS secs, ROW_NUMBER() OVER (PARTITION BY project_slug ORDER BY doc_id) - 1 AS rn,
  COUNT(*) OVER (PARTITION BY project_slug) AS n FROM v_takes)"""


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return b.takes(spark, d).select(F.col("project_slug").alias("slug"), "doc_id", (F.col("duration_ms") / 1000.0).alias("secs"))


@query("reference_rotation", f"""
WITH {_REF_SQL},
p AS (SELECT slug, n, set_idx, unnest(range(0, 3)) AS slot FROM (SELECT slug, n, unnest(range(0, 40)) AS set_idx FROM (SELECT DISTINCT slug, n FROM refs)))
SELECT p.slug, CAST(p.set_idx AS INTEGER) AS set_idx, CAST(p.slot AS INTEGER) AS slot, r.doc_id FROM p JOIN refs r ON r.slug = p.slug AND r.rn = (p.set_idx * 3 + p.slot) % p.n""")
def reference_rotation(spark: SparkSession, d: str) -> DataFrame:
    return rk.rotating_references(_refs(spark, d), "slug", "doc_id", 40, 3).select("slug", "set_idx", "slot", "doc_id")


_TAKEN_SQL = f"""
{_REF_SQL},
a AS (SELECT slug, doc_id, (rn - 5 + n) % n AS slot, SUM(secs) OVER (PARTITION BY slug ORDER BY (rn - 5 + n) % n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM refs),
pos AS (SELECT slug, doc_id, slot FROM a WHERE COALESCE(before, 0) < 600),
c AS (SELECT slug, doc_id, (rn - 11 + n) % n AS slot, SUM(secs) OVER (PARTITION BY slug ORDER BY (rn - 11 + n) % n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM refs),
ng AS (SELECT slug, doc_id, slot FROM c WHERE COALESCE(before, 0) < 300)"""


@query("reference_until", f"WITH {_TAKEN_SQL} SELECT slug, doc_id, CAST(slot AS BIGINT) AS slot FROM pos")
def reference_until(spark: SparkSession, d: str) -> DataFrame:
    return rk.take_until(_refs(spark, d), "slug", "doc_id", "secs", 5, 600.0).select("slug", "doc_id", "slot")


@query("reference_interleave", f"""
WITH {_TAKEN_SQL},
m AS (SELECT slug, LEAST(p, q) AS m FROM (SELECT slug, COUNT(*) AS p FROM pos GROUP BY slug) JOIN (SELECT slug, COUNT(*) AS q FROM ng GROUP BY slug) USING (slug)),
u AS (SELECT slug, doc_id, slot, 0 AS side FROM pos UNION ALL SELECT slug, doc_id, slot, 1 FROM ng)
SELECT slug, doc_id, CAST(CASE WHEN slot < m THEN slot * 2 + side ELSE m + slot END AS BIGINT) AS position FROM u JOIN m USING (slug)""")
def reference_interleave(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    first = rk.take_until(refs, "slug", "doc_id", "secs", 5, 600.0).select("slug", "doc_id", "slot")
    second = rk.take_until(refs, "slug", "doc_id", "secs", 11, 300.0).select("slug", "doc_id", "slot")
    return rk.interleave(first, second, "slug").select("slug", "doc_id", "position")


@query("udtf_energy_bursts", f"WITH {_BURST_SQL} SELECT take_id, start_ms, end_ms FROM bursts")
def udtf_energy_bursts(spark: SparkSession, d: str) -> DataFrame:
    """The burst table function over all clips, from SQL."""
    from ..udtf import register

    register(spark)
    return spark.sql("SELECT take_id, start_ms, end_ms FROM {clips}, LATERAL energy_bursts(samples, 100)", clips=b.clips(spark, d))
