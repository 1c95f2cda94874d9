"""Queries for readers and writers' rules, on documents of the exchange formats
that Spark builds from the given tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import lexicon as lx
from ..operators import pool as pl
from ..operators import tables as tb
from ..operators.words import longest
from ..session import settled
from ..sources import audio, lists, manifests, sinks
from . import bindings as b
from .lexicon_plans import _PHRASE_SQL as PHRASE_SQL
from .lexicon_plans import VOCAB_SQL, phrases, vocab
from .registry import query
from .report_plans import _SYNTH_SQL, category_counts, label_counts, synthetic

RATE = 16_000


@F.pandas_udf(T.BinaryType())
def _as_wav(samples: pd.Series) -> pd.Series:
    return pd.Series([audio.encode_wav(np.clip(np.asarray(s), -32768, 32767), RATE) for s in samples])


@query("wav_files", """
WITH w AS (SELECT take_id, COUNT(*) AS n, SUM(LEAST(GREATEST(x, -32768), 32767)) AS total,
    string_agg(printf('%02x%02x', LEAST(GREATEST(x, -32768), 32767) & 255, (LEAST(GREATEST(x, -32768), 32767) >> 8) & 255), '' ORDER BY i) AS body
  FROM v_samples GROUP BY take_id),
le AS (SELECT *, printf('%02x%02x%02x%02x', (36 + 2 * n) & 255, ((36 + 2 * n) >> 8) & 255, ((36 + 2 * n) >> 16) & 255, (36 + 2 * n) >> 24) AS riff,
    printf('%02x%02x%02x%02x', (2 * n) & 255, ((2 * n) >> 8) & 255, ((2 * n) >> 16) & 255, (2 * n) >> 24) AS size FROM w)
SELECT take_id AS path, 44 + 2 * n AS length, 1 AS channels, 16 AS bits, 16000 AS rate, n AS samples, CAST(total AS BIGINT) AS total,
  sha256(unhex('52494646' || riff || '57415645666d74201000000001000100803e0000007d0000020010006461746' || '1' || size || body)) AS sha256 FROM le""")
def wav_files(spark: SparkSession, d: str) -> DataFrame:
    """Clips as WAV files, decoded again: header fields, digest and samples."""
    files = b.clips(spark, d).select(F.col("take_id").alias("path"), _as_wav("samples").alias("content")).select(
        "path", F.octet_length("content").cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("modified_ms"), "content")
    read = audio.decode_files(files).filter("error IS NULL")
    return read.select("path", "length", "channels", "bits", "rate", F.size("samples").cast("bigint").alias("samples"),
                       F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), "sha256")


@query("manifest_scan", """
SELECT project_slug AS slug, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'background' ELSE 'bulk' END AS section, recording_id AS id,
  duration_ms, CASE WHEN doc_id % 10 = 1 THEN NULL ELSE kind END AS kind, session_id, route AS input_route FROM v_takes""")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Upload manifests as JSON text, parsed with the declared schema."""
    take = F.struct("doc_id", F.col("recording_id").alias("id"), "kind", "duration_ms", "session_id",
                    F.struct(F.col("route").alias("input_route")).alias("capture"))

    def part(prefix: str) -> F.Column:
        return F.sort_array(F.collect_list(F.when(F.startswith("recording_id", F.lit(prefix)), take)))

    packed = b.takes(spark, d).groupBy("project_slug", F.expr("doc_id div 50").alias("page")).agg(
        part("bulk_").alias("bulk_recordings"), part("background_").alias("background_recordings"), part("test_").alias("test_recordings"))
    texts = packed.select(F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.struct(F.col("project_slug").alias("slug")).alias("wake_word"), "bulk_recordings",
        "background_recordings", "test_recordings")).alias("value"))
    takes = manifests.flatten_takes(manifests.parse_manifests(texts), ["wake_word"])
    return takes.select(F.col("wake_word.slug").alias("slug"), "section", "id", "duration_ms", "kind", "session_id",
                        F.col("capture.input_route").alias("input_route"))


@query("missing_columns", """
SELECT recording_id AS id, project_slug, duration_ms, CAST(NULL AS VARCHAR) AS source_wav, kind, CAST(NULL AS BIGINT) AS capture_source_channels FROM v_takes""")
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Takes in a newer schema; columns they lack are null."""
    newer = T.StructType.fromDDL("id string, project_slug string, duration_ms bigint, source_wav string, kind string, capture_source_channels bigint")
    return tb.with_missing_columns(b.takes(spark, d).withColumnRenamed("recording_id", "id"), newer)


@query("closed_pool", f"""
WITH {_SYNTH_SQL},
t AS (SELECT unnest(['en', 'nobody']) AS target),
re AS (SELECT t.target, s.project_slug, s.slice_id AS stem, CASE WHEN s.project_slug = t.target THEN 'own_' || category
    WHEN category = 'negative' THEN 'borrowed_negative' END AS branch FROM v_slices s CROSS JOIN t WHERE s.status = 'active')
SELECT target, branch, project_slug AS source_slug, stem, project_slug || CASE WHEN branch = 'own_hard_negative' THEN '_hardneg' ELSE '' END || '__' || stem AS name,
  CASE WHEN branch LIKE '%background' THEN 'background' WHEN branch LIKE '%positive' THEN 'positive' ELSE 'negative' END AS category
FROM re WHERE branch IS NOT NULL""")
def closed_pool(spark: SparkSession, d: str) -> DataFrame:
    """Pools with every borrow switch off, for one project with clips and one without."""
    clips = b.slices(spark, d).filter("status = 'active'").select("project_slug", "category", F.col("slice_id").alias("stem"))
    return pl.training_pool(clips, ["en", "nobody"], pl.PoolSettings(borrow_positives=False, borrow_background=False), synthetic(spark, d))


@query("report_document", """
WITH c AS (SELECT project_slug, category AS k, COUNT(*) AS n FROM v_slices WHERE status = 'active' GROUP BY ALL),
l AS (SELECT project_slug, label AS k, COUNT(*) AS n FROM v_slices WHERE status = 'active' GROUP BY ALL)
SELECT p.slug, (SELECT string_agg(k || '=' || n, '|' ORDER BY k) FROM c WHERE c.project_slug = p.slug) AS categories,
  (SELECT string_agg(k || '=' || n, '|' ORDER BY k) FROM l WHERE l.project_slug = p.slug) AS labels FROM v_projects p""")
def report_document(spark: SparkSession, d: str) -> DataFrame:
    """The nested report of every project, its maps as text."""
    report = sinks.nested_report(b.projects(spark, d).select("slug"), category_counts(spark, d), label_counts(spark, d))

    def listed(name: str) -> F.Column:
        return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|").alias(name)

    return report.select("slug", listed("categories"), listed("labels"))


@query("metadata_append", """
SELECT slice_id AS id, file_name AS file, CASE WHEN k % 2 = 0 THEN 'stored' ELSE 'new' END AS state FROM v_slices""")
def metadata_append(spark: SparkSession, d: str) -> DataFrame:
    """Clip records after an append that repeats half of the stored ones."""
    s = b.slices(spark, d).select("k", F.col("slice_id").alias("id"), F.col("file_name").alias("file"))
    stored = s.filter("k % 2 = 0").select("id", "file", F.lit("stored").alias("state"))
    sent = s.select("id", "file", F.lit("new").alias("state"))
    return stored.unionByName(tb.new_rows(stored, sent, ["id"]))


# Every word of the ranked list is spelt by two lines; every seventh line is broken.
_SPELT_SQL = f"""
{VOCAB_SQL},
sy AS (SELECT [{", ".join(f"'{p}'" for p in lx.PHONES)}] AS s),
ln AS (SELECT word, rank, v, rank * 2 + v AS pos,
    list_transform(string_split(word, ''), lambda c, i: s[(ascii(c) * 7 + v * i) % {len(lx.PHONES)} + 1]) AS phones
  FROM lex, sy, (SELECT unnest([0, 1]) AS v) WHERE (rank * 2 + v) % 7 <> 0),
fp AS (SELECT word, arg_min(phones, pos) AS phones FROM ln GROUP BY word)"""


@query("ranked_words", f"WITH {VOCAB_SQL} SELECT word, rank - 1 AS rank FROM lex")
def ranked_words(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary read back from the lines of a ranked list, with comments, blanks and capitals in it."""
    lex = vocab(spark, d)
    value = F.when(F.col("rank") % 3 == 0, F.concat(F.lit("  "), F.initcap("word"))).otherwise(F.col("word"))
    more = F.when(F.col("rank") % 5 == 0, F.concat(F.lit("# "), "word")).when(F.col("rank") % 7 == 0, " ")
    lines = lex.select(F.explode(F.array(F.struct((F.col("rank") * 2).alias("pos"), value.alias("value")),
                                         F.struct((F.col("rank") * 2 + 1).alias("pos"), F.coalesce(more, F.lit("")).alias("value")))).alias("x")).select("x.*")
    return lists.rank_lines(lines)


def spelt(lex: DataFrame) -> DataFrame:
    """Pronunciation lines of the ranked words with their position."""
    known = F.array(*[F.lit(p) for p in lx.PHONES])
    lines = lex.select("word", "rank", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    phones = F.transform(F.split("word", ""), lambda c, i: F.concat(
        F.get(known, ((F.ascii(c) * 7 + F.col("v") * (i + 1)) % len(lx.PHONES)).cast("int")), F.when(i == 0, "1").otherwise("")))
    pos = F.col("rank") * 2 + F.col("v")
    return lines.select(pos.alias("pos"), F.when(pos % 7 == 0, F.col("word")).otherwise(F.concat_ws("\t", "word", F.array_join(phones, " "))).alias("value"))


@query("lexicon_phones", f"""
WITH {_SPELT_SQL}
SELECT l.word, l.rank, array_to_string(fp.phones, ' ') AS phones FROM lex l JOIN fp USING (word)""")
def lexicon_phones(spark: SparkSession, d: str) -> DataFrame:
    """Ranked words with their first pronunciation."""
    lex = settled(vocab(spark, d), "vocabulary")
    first = lists.first_phones(lists.parse_phones(spelt(lex)), "pos")
    return lex.join(first, "word").select("word", "rank", F.array_join("phones", " ").alias("phones"))


@query("near_phones", f"""
WITH {_SPELT_SQL}, {PHRASE_SQL},
lp AS MATERIALIZED (SELECT l.word, l.rank, array_to_string(list_transform(fp.phones, lambda p: chr(CAST(64 + list_position(sy.s, p) AS INTEGER))), '') AS code FROM lex l JOIN fp USING (word), sy),
tg AS (SELECT DISTINCT words, w AS word FROM (SELECT words, unnest(words) AS w FROM ph) WHERE w IN (SELECT word FROM lp)),
dw AS MATERIALIZED (SELECT word, code FROM lp WHERE word IN (SELECT word FROM tg)),
ds AS MATERIALIZED (SELECT dw.word, l.word AS near, l.rank AS near_rank, levenshtein(dw.code, l.code) AS distance
  FROM dw JOIN lp l ON length(l.word) > 2 AND length(l.code) BETWEEN GREATEST(length(dw.code) - 2, 1) AND length(dw.code) + 2
  WHERE levenshtein(dw.code, l.code) BETWEEN 1 AND 4),
dr AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY word ORDER BY distance, near_rank, near) AS r FROM ds)
  WHERE r <= 16 + (SELECT MAX(len(words)) FROM ph)),
nr AS (SELECT words, word, near, near_rank, distance, ROW_NUMBER() OVER (PARTITION BY words, word ORDER BY distance, near_rank, near) AS position
  FROM tg JOIN dr USING (word) WHERE NOT list_contains(words, near))
SELECT word, md5(array_to_string(words, ' ')) AS phrase, near, near_rank, CAST(distance AS INTEGER) AS distance, CAST(position AS INTEGER) AS position FROM nr WHERE position <= 16""")
def near_phones(spark: SparkSession, d: str) -> DataFrame:
    """Near words by sound: the edit distance counts phones of the first pronunciation."""
    lex = settled(vocab(spark, d), "vocabulary")
    first = lists.first_phones(lists.parse_phones(spelt(lex)), "pos").withColumn("code", lx.phone_code(F.col("phones")))
    lexicon = settled(lex.join(first.select("word", "code"), "word"), "lexicon")
    words = phrases(spark, d).select(F.explode("words").alias("word"), F.col("words").alias("exclude")).distinct()
    near = lx.near_words(words.join(lexicon.select("word", "code"), "word"), lexicon, most=longest(phrases(spark, d), F.size("words")))
    return near.select("word", F.md5(F.array_join("exclude", " ")).alias("phrase"), "near", "near_rank", "distance", "position")
