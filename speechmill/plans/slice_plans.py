"""Queries that build and use the slice table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import slices as sl
from . import bindings as b
from .registry import query
from .signal_plans import _BURST_SQL, RATE, bursts
from .word_plans import CHUNKS_SQL, GEOMETRY_SQL

KEY = "recording_id"


def routed(spark: SparkSession, d: str, words: bool = False) -> DataFrame:
    """Takes with their cut strategy and the columns the slice builder needs; with ``words`` also their words and phrase."""
    t = b.takes(spark, d, *["_t"] * words)
    phrase_words = F.size(text.normalized_words(b.phrase_of(F.col("project_slug"))))
    strategy = rules.cut_strategy(F.col(KEY), F.col("kind"), F.col("script"), F.col("word_count"),
                                  F.coalesce(phrase_words, F.lit(0)))
    rows = t.select(
        KEY, "doc_id", "project_slug", "kind", strategy.alias("strategy"), F.col("duration_ms"),
        F.col("duration_ms").alias("source_end"), F.col("duration_ms").alias("take_ms"),
        F.col("imported_at_ms").alias("recorded_at"), *["_t"] * words)
    return b.with_phrase(rows, text.norm_edge) if words else rows


ROUTE_SQL = """
SELECT *, CASE WHEN recording_id LIKE 'test\\_%' ESCAPE '\\' THEN 'test' WHEN kind = 'enrollment' THEN 'enrollment'
  WHEN script = '__background_noise__' THEN 'background'
  WHEN kind = 'positive' AND script = '__energy_positive__' THEN 'energy_forced'
  WHEN word_count = 0 AND kind = 'positive' THEN 'energy_fallback' WHEN word_count = 0 THEN 'warn_no_words'
  ELSE 'lexical' END AS strategy FROM v_takes"""


@query("take_routing", f"""
WITH r AS ({ROUTE_SQL})
SELECT recording_id, strategy, kind NOT IN ('negative', 'hard_negative') AS expects_positive, kind <> 'positive' AS runs_negatives,
  CASE WHEN kind = 'hard_negative' THEN 'hard_negative' ELSE 'negative' END AS negative_label FROM r""")
def take_routing(spark: SparkSession, d: str) -> DataFrame:
    r = routed(spark, d)
    return r.select(KEY, "strategy", rules.expects_positive(F.col("kind")).alias("expects_positive"),
                    rules.runs_negative_pass(F.col("kind")).alias("runs_negatives"),
                    rules.negative_pass_label(F.col("kind")).alias("negative_label"))


_ROLES_SQL = f"""
r AS ({ROUTE_SQL}),
cue AS (SELECT a.doc_id, a.ordinal AS cf, CASE WHEN a.norm = 'not' THEN a.ordinal + 3 ELSE a.ordinal + 1 END AS cl
  FROM v_norm a JOIN v_norm b ON b.doc_id = a.doc_id AND b.ordinal = a.ordinal + 1
  LEFT JOIN v_norm c ON c.doc_id = a.doc_id AND c.ordinal = a.ordinal + 2
  LEFT JOIN v_norm e ON e.doc_id = a.doc_id AND e.ordinal = a.ordinal + 3
  WHERE a.norm || ' ' || b.norm IN ('near match', 'hard negative', 'similar phrase')
     OR a.norm || ' ' || b.norm || ' ' || c.norm || ' ' || e.norm = 'not the wake phrase'),
nm AS (SELECT DISTINCT h.doc_id, h.first FROM v_hits h JOIN cue c ON c.doc_id = h.doc_id AND c.cf >= h.first - 8 AND c.cl <= h.last + 5),
{GEOMETRY_SQL},
role AS (SELECT g.doc_id, g.vf, g.vl, g.cut_start_ms, g.cut_end_ms,
    CASE WHEN r.kind <> 'positive' AND nm.first IS NOT NULL THEN 'hard_negative' ELSE 'positive' END AS label
  FROM geo g JOIN r ON r.doc_id = g.doc_id LEFT JOIN nm ON nm.doc_id = g.doc_id AND nm.first = g.first
  WHERE r.strategy = 'lexical' AND r.kind NOT IN ('negative', 'hard_negative'))"""

_NEGATIVE_SQL = f"""
pool AS (SELECT w.*, r.kind, r.duration_ms, lag(w.end_ms) OVER q AS prev_end, lead(w.start_ms) OVER q AS next_start
  FROM v_words w JOIN r ON r.doc_id = w.doc_id WHERE r.strategy = 'lexical' AND r.kind <> 'positive'
  WINDOW q AS (PARTITION BY w.doc_id ORDER BY w.ordinal)),
free AS (SELECT w.doc_id, w.ordinal, w.start_ms, w.end_ms FROM pool w WHERE w.end_ms - w.start_ms <= 1500 AND NOT EXISTS (
  SELECT 1 FROM role c WHERE c.doc_id = w.doc_id AND w.start_ms < c.cut_end_ms AND w.end_ms > c.cut_start_ms)),
{CHUNKS_SQL},
nb AS (SELECT c.doc_id, c.ordinal AS first, c.last, f.kind,
    GREATEST(f.start_ms - 80, LEAST(COALESCE(f.prev_end, 0), f.start_ms)) AS cs,
    GREATEST(LEAST(l.end_ms + 100, GREATEST(COALESCE(l.next_start, l.duration_ms), l.end_ms)), l.end_ms) AS ce
  FROM chunk c JOIN pool f ON f.doc_id = c.doc_id AND f.ordinal = c.ordinal JOIN pool l ON l.doc_id = c.doc_id AND l.ordinal = c.last),
neg AS (SELECT n.doc_id, first, last, cs AS cut_start_ms, LEAST(ce, cs + 1500) AS cut_end_ms,
    CASE WHEN kind = 'hard_negative' THEN 'hard_negative' ELSE 'negative' END AS label FROM nb n),
negvis AS (SELECT n.doc_id, n.first, GREATEST(n.first, MAX(w.ordinal) FILTER (w.start_ms < n.cut_end_ms)) AS vl
  FROM neg n JOIN pool w ON w.doc_id = n.doc_id AND w.ordinal BETWEEN n.first AND n.last GROUP BY n.doc_id, n.first)"""

_ID_SQL = """sha256(concat_ws('|', t.recording_id, CAST(t.imported_at_ms AS VARCHAR), CAST(t.duration_ms AS VARCHAR), s.label,
    CAST(s.cut_start_ms AS VARCHAR), CAST(s.cut_end_ms AS VARCHAR), {words})) AS slice_id"""

_STEM_SQL = """COALESCE(NULLIF(trim(regexp_replace(translate(trim({x}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^a-z0-9]+', '-', 'g'), '-'), ''), 'clip')"""

_SPOKEN_ROWS = f"""
SELECT {_ID_SQL.format(words="s.idw")}, t.recording_id, t.project_slug, s.label, s.label AS category, s.spoken_phrase,
  CAST(s.cut_start_ms AS BIGINT) AS start_ms, CAST(s.cut_end_ms AS BIGINT) AS end_ms, round(s.p, 6) AS avg_probability,
  s.n AS word_count, CASE WHEN s.label = 'positive' THEN {_STEM_SQL.format(x="p.phrase")} ELSE {_STEM_SQL.format(x="s.spoken_phrase")} END AS stem
FROM spoken s JOIN v_takes t ON t.doc_id = s.doc_id JOIN v_projects p ON p.slug = t.project_slug"""

_SPOKEN_SQL = """
spoken AS (SELECT s.doc_id, s.label, s.cut_start_ms, s.cut_end_ms, s.vf, string_agg(w.word, ' ' ORDER BY w.ordinal) AS spoken_phrase,
    string_agg(w.word || '@' || w.start_ms || '@' || w.end_ms, ' ' ORDER BY w.ordinal) AS idw, AVG(w.prob) AS p, COUNT(*) AS n
  FROM span s JOIN v_words w ON w.doc_id = s.doc_id AND w.ordinal BETWEEN s.vf AND s.vl GROUP BY ALL)"""


@query("positive_slices", f"""
WITH {_ROLES_SQL},
span AS (SELECT doc_id, label, vf, vl, cut_start_ms, cut_end_ms FROM role WHERE label = 'positive'),
{_SPOKEN_SQL}
SELECT project_slug, COUNT(*) AS slices, CAST(SUM(word_count) AS BIGINT) AS words, CAST(SUM(end_ms - start_ms) AS BIGINT) AS total_ms
FROM ({_SPOKEN_ROWS}) GROUP BY project_slug""")
def positive_slices(spark: SparkSession, d: str) -> DataFrame:
    """Phrase slices per project, without the negative pass."""
    rows = sl.finish(sl.slice_rows(routed(spark, d, words=True), b.timed, negatives=False), b.phrase_table(spark))
    return rows.filter("category = 'positive'").groupBy("project_slug").agg(
        F.count(F.lit(1)).alias("slices"), F.sum("word_count").alias("words"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))


# Each take's audio is one of the clips, by its number.
CLIP_SQL = """CAST(r.doc_id % (SELECT MAX(label) + 1 FROM embeddings) AS VARCHAR) || '_'
      || CAST(r.doc_id // (SELECT MAX(label) + 1 FROM embeddings) % (SELECT MAX(vec_id) // 400 + 1 FROM embeddings) AS VARCHAR)"""


def take_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Sound bursts of the energy-cut takes; each take's audio is one of the clips, by its number."""
    vectors = b.table(spark, d, "embeddings")
    labels, parts = vectors.agg(F.max("label").cast("bigint") + 1).scalar(), vectors.agg(F.expr("max(vec_id) div 400 + 1")).scalar()
    takes = routed(spark, d).filter(F.col("strategy").isin("energy_forced", "energy_fallback")).withColumn("labels", labels).select(
        KEY, F.concat_ws("_", (F.col("doc_id") % F.col("labels")).cast("string"),
                         (F.expr("doc_id div labels") % parts).cast("string")).alias("take_id"))
    return takes.join(bursts(b.clips(spark, d), F.lit(RATE)), "take_id").select(
        KEY, F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"))


@query("slice_table", f"""
WITH RECURSIVE {_ROLES_SQL}, {_NEGATIVE_SQL}, {_BURST_SQL},
span AS (SELECT doc_id, label, vf, vl, cut_start_ms, cut_end_ms FROM role
  UNION ALL SELECT n.doc_id, n.label, n.first, v.vl, n.cut_start_ms, n.cut_end_ms FROM neg n JOIN negvis v ON v.doc_id = n.doc_id AND v.first = n.first),
{_SPOKEN_SQL}
{_SPOKEN_ROWS}
UNION ALL
SELECT {_ID_SQL.format(words="''")}, t.recording_id, t.project_slug, s.label, s.label, '', s.cut_start_ms, s.cut_end_ms, 0.0::DOUBLE, 0, 'background'
FROM (SELECT doc_id, 'background' AS label, g AS cut_start_ms, LEAST(g + 2000, duration_ms) AS cut_end_ms
  FROM (SELECT doc_id, duration_ms, unnest(range(0, duration_ms, 2000)) AS g FROM r WHERE strategy = 'background' AND duration_ms > 0)
  WHERE LEAST(g + 2000, duration_ms) - g >= 1000) s JOIN v_takes t ON t.doc_id = s.doc_id
UNION ALL
SELECT {_ID_SQL.format(words="''")}, t.recording_id, t.project_slug, s.label, s.label, '', s.cut_start_ms, s.cut_end_ms, 0.0::DOUBLE, 0, {_STEM_SQL.format(x="p.phrase")}
FROM (SELECT r.doc_id, 'positive' AS label, CAST(CASE WHEN end_ms - start_ms > 1500 THEN end_ms - 1500 ELSE start_ms END AS BIGINT) AS cut_start_ms,
    CAST(end_ms AS BIGINT) AS cut_end_ms FROM r JOIN bursts ON bursts.take_id = {{clip}} WHERE r.strategy IN ('energy_forced', 'energy_fallback')) s
JOIN v_takes t ON t.doc_id = s.doc_id JOIN v_projects p ON p.slug = t.project_slug""".replace("{clip}", CLIP_SQL))
def slice_table(spark: SparkSession, d: str) -> DataFrame:
    lexical = sl.slice_rows(routed(spark, d, words=True), b.timed)
    rows = sl.slice_table(lexical, routed(spark, d), b.phrase_table(spark), take_bursts(spark, d))
    return rows.withColumn("avg_probability", F.round("avg_probability", 6))


@query("verified_positives", """
SELECT s.slice_id, s.category FROM v_slices s
LEFT JOIN (SELECT slice_id, start_ms % 7 <> 0 AS heard FROM v_slices WHERE (doc_id + k) % 5 <> 0) v ON v.slice_id = s.slice_id
WHERE s.status = 'active' AND (s.category <> 'positive' OR COALESCE(v.heard, TRUE))""")
def verified_positives(spark: SparkSession, d: str) -> DataFrame:
    s = b.slices(spark, d)
    verdicts = s.filter((F.col("doc_id") + F.col("k")) % 5 != 0).select("slice_id", (F.col("start_ms") % 7 != 0).alias("heard"))
    return sl.verified(s.filter("status = 'active'").select("slice_id", "category"), verdicts)


@query("slice_words", """
SELECT s.slice_id, COUNT(w.ordinal) AS words, round(COALESCE(AVG(w.prob), 0), 6) AS avg_probability
FROM v_slices s LEFT JOIN v_words w ON w.doc_id = s.doc_id AND w.start_ms < s.end_ms AND w.end_ms > s.start_ms
WHERE s.status = 'active' GROUP BY s.slice_id""")
def slice_words(spark: SparkSession, d: str) -> DataFrame:
    """Mean word probability of the words inside each stored slice; 0 without words."""
    from ..operators.joins import band_join

    s = b.slices(spark, d).filter("status = 'active'").select(
        KEY, "slice_id", F.col("start_ms").alias("s_lo"), F.col("end_ms").alias("s_hi"))
    w = b.words(spark, d, KEY, "ordinal", "start_ms", "end_ms", "prob")
    inside = band_join(s, w, [KEY], ("s_lo", "s_hi"), ("start_ms", "end_ms"), 2000, strict=True).groupBy("slice_id").agg(
        F.count(F.lit(1)).alias("words"), F.avg("prob").alias("p"))
    return s.select("slice_id").join(inside, "slice_id", "left").select(
        "slice_id", F.coalesce("words", F.lit(0)).alias("words"),
        F.round(F.coalesce("p", F.lit(0.0)), 6).alias("avg_probability"))
