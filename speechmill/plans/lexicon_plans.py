"""Lexicon, near-miss and synthesis-plan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..functions.draws import arithmetic_uniform
from ..operators import lexicon as lx
from ..operators.words import longest
from ..session import settled
from . import bindings as b
from .registry import query

SIZE = lx.PHONE_WORDS


def vocab(spark: SparkSession, d: str, size: int = SIZE) -> DataFrame:
    return lx.frequency_lexicon(b.tokens(spark, d), text.norm_edge(F.col("word")), size)


VOCAB_SQL = f"""
vn AS (SELECT translate(regexp_replace(word, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM v_tokens),
vc AS (SELECT word, COUNT(*) AS n FROM vn WHERE regexp_full_match(word, '[a-z]{{2,12}}') GROUP BY word),
lex AS MATERIALIZED (SELECT * FROM (SELECT word, n, ROW_NUMBER() OVER (ORDER BY n DESC, word) AS rank FROM vc) WHERE rank <= {SIZE})"""


@query("lexicon", f"WITH {VOCAB_SQL} SELECT word, n, rank FROM lex")
def lexicon(spark: SparkSession, d: str) -> DataFrame:
    return vocab(spark, d)


@query("content_words", f"""
WITH {VOCAB_SQL}
SELECT word, rank FROM lex WHERE length(word) BETWEEN 4 AND 10 AND NOT ends_with(word, 'ed') AND NOT ends_with(word, 'ing')
  AND word NOT IN ({", ".join(f"'{w}'" for w in lx.STOP_WORDS)}) ORDER BY rank LIMIT {lx.CONTENT_WORDS}""")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    return lx.content_words(vocab(spark, d)).select("word", "rank")


def phrases(spark: SparkSession, d: str) -> DataFrame:
    """The normal words of each benchmark item as a phrase."""
    return b.table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), text.normalized_words(F.col("text")).alias("words"))


#: One-word phrases, the first word of each item, are numbered from here.
ONE_WORD = 1_000_000_000


def long_and_short(spark: SparkSession, d: str) -> DataFrame:
    """The items as phrases, and the first word of each as a phrase of one word."""
    p = phrases(spark, d)
    return p.unionByName(p.filter(F.size("words") > 0).select((F.col("phrase_id") + ONE_WORD).alias("phrase_id"), F.slice("words", 1, 1).alias("words")))


def _near(spark: SparkSession, d: str, p: DataFrame, lex: DataFrame) -> DataFrame:
    """Near words by letters: each letter stands for a phone."""
    words = p.select(F.explode("words").alias("word"), F.array_distinct("words").alias("exclude")).distinct()
    coded = lex.withColumn("code", F.col("word"))
    targets = words.join(coded.select("word", "code"), "word")
    return lx.near_words(targets, coded, most=longest(p, F.size("words")))


_PHRASE_SQL = """
ph AS (SELECT item_id AS phrase_id, list_filter(list_transform(string_split_regex(text, '[ \\t\\n\\r\\f]+'),
    lambda x: translate(regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
    lambda x: x <> '') AS words FROM benchmark)"""

_NEAR_SQL = f"""
{VOCAB_SQL}, {_PHRASE_SQL.replace("ph AS", "pi AS", 1)},
ph AS (SELECT * FROM pi %s),
tg AS (SELECT DISTINCT phrase_id, words, w AS word FROM (SELECT phrase_id, words, unnest(words) AS w FROM ph) WHERE w IN (SELECT word FROM lex)),
dw AS MATERIALIZED (SELECT DISTINCT word FROM tg),
ds AS MATERIALIZED (SELECT dw.word, l.word AS near, l.rank AS near_rank, levenshtein(dw.word, l.word) AS distance
  FROM dw JOIN lex l ON length(l.word) > 2 AND length(l.word) BETWEEN GREATEST(length(dw.word) - 2, 1) AND length(dw.word) + 2
  WHERE levenshtein(dw.word, l.word) BETWEEN 1 AND 4),
dr AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY word ORDER BY distance, near_rank, near) AS r FROM ds)
  WHERE r <= 16 + (SELECT MAX(len(words)) FROM ph)),
nr AS (SELECT phrase_id, words, word, near, near_rank, distance, ROW_NUMBER() OVER (PARTITION BY phrase_id, word ORDER BY distance, near_rank, near) AS position
  FROM tg JOIN dr USING (word) WHERE NOT list_contains(words, near)),
nw AS (SELECT * FROM nr WHERE position <= 16)"""


NEAR_SQL = _NEAR_SQL % ""
NEAR_BOTH_SQL = _NEAR_SQL % f"UNION ALL SELECT phrase_id + {ONE_WORD}, words[1:1] FROM pi WHERE len(words) > 0"


def _u(key: str, purpose: int) -> str:
    return f"((({key}) * 7919 + {purpose} * 104729) % 1000003 / 1000003.0::DOUBLE)"


@query("near_words", f"""
WITH {NEAR_SQL}
SELECT DISTINCT word, array_to_string(list_sort(list_distinct(words)), ' ') AS exclude, near, near_rank, CAST(distance AS INTEGER) AS distance, CAST(position AS INTEGER) AS position FROM nw""")
def near_words(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, phrases(spark, d), settled(vocab(spark, d), "vocabulary")).select("word", F.array_join(F.sort_array("exclude"), " ").alias("exclude"), "near", "near_rank", "distance", "position").distinct()


@query("near_miss_phrases", f"""
WITH {NEAR_BOTH_SQL},
ea AS (SELECT phrase_id, words, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS wi FROM ph),
mt AS MATERIALIZED (SELECT e.phrase_id, e.words, e.word, e.wi, n.near, n.position FROM ea e JOIN nw n ON n.phrase_id = e.phrase_id AND n.word = e.word),
nd AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY phrase_id, wi ORDER BY {_u("phrase_id * 1000003 + wi * 100 + position", 5)}, position) AS np FROM mt),
co AS MATERIALIZED (SELECT word, ROW_NUMBER() OVER (ORDER BY rank) AS k FROM (SELECT word, rank FROM lex
  WHERE length(word) BETWEEN 4 AND 10 AND NOT ends_with(word, 'ed') AND NOT ends_with(word, 'ing')
    AND word NOT IN ({", ".join(f"'{w}'" for w in lx.STOP_WORDS)}) ORDER BY rank LIMIT {lx.CONTENT_WORDS})),
nc AS (SELECT COUNT(*) AS n FROM co),
ap AS (SELECT a.*, o.k AS own, CAST(floor({_u("phrase_id * 1000003 + np", 7)} * (n - CASE WHEN o.k IS NULL THEN 0 ELSE 1 END)) + 1 AS BIGINT) AS k
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY phrase_id, wi ORDER BY {_u("phrase_id * 1000003 + wi * 100 + position", 6)}, position) AS np
    FROM mt WHERE len(words) = 1 AND position <= {lx.APPENDED_NEAREST}) a LEFT JOIN co o ON o.word = a.word, nc),
rp AS (SELECT phrase_id, words, 0 AS part, wi, np, array_to_string(list_transform(words, lambda w, i: CASE WHEN i - 1 = wi THEN near ELSE w END), ' ') AS variant
  FROM nd WHERE np <= 4
  UNION ALL SELECT phrase_id, words, 1, wi, np, near || ' ' || coalesce(c.word, 'now')
  FROM ap LEFT JOIN co c ON c.k = ap.k + CASE WHEN own <= ap.k THEN 1 ELSE 0 END WHERE np <= 4),
fi AS (SELECT phrase_id, variant, MIN((part, wi, np)) AS o FROM rp WHERE variant <> array_to_string(words, ' ') GROUP BY ALL)
SELECT * FROM (SELECT phrase_id, variant, CAST(ROW_NUMBER() OVER (PARTITION BY phrase_id ORDER BY o, variant) AS INTEGER) AS position FROM fi) WHERE position <= 10""")
def near_miss_phrases(spark: SparkSession, d: str) -> DataFrame:
    lex, p = settled(vocab(spark, d), "vocabulary"), long_and_short(spark, d)
    fillers = lx.content_words(lex).select("word", F.row_number().over(W.orderBy("rank")).cast("bigint").alias("rank"))
    return lx.near_miss_phrases(p, _near(spark, d, p, lex), arithmetic_uniform, fillers)


def short_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation turn cut into phrases of one to three words.

    In every fifth conversation each word is a phrase, said twice.
    """
    w = text.normalized_words(F.col("text"))
    c = b.table(spark, d, "conversations").select("conv_id", "turn", w.alias("w")).filter(F.size("w") > 0)
    n = ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int")
    twice = F.transform("w", lambda x: F.array(x, x))
    cut = F.transform(F.sequence(F.lit(0), ((F.size("w") - 1) / n).cast("int")), lambda k: F.slice("w", k * n + 1, n))
    parts = F.when(F.col("conv_id") % 5 == 0, twice).otherwise(cut)
    return c.select("conv_id", "turn", F.posexplode(parts).alias("part", "words"))


_SHORT_SQL = """
sw AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[ \\t\\n\\r\\f]+'),
    lambda x: translate(regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda x: x <> '') AS w FROM conversations),
sc AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN list_transform(w, lambda x: [x, x])
    ELSE list_transform(range(0, (len(w) - 1) // ((conv_id + turn) % 3 + 1) + 1), lambda k: w[k * ((conv_id + turn) % 3 + 1) + 1:(k + 1) * ((conv_id + turn) % 3 + 1)]) END AS ps
  FROM sw WHERE len(w) > 0),
sp AS (SELECT conv_id, turn, unnest(ps) AS p, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS part FROM sc)"""


def _alike(x: str) -> str:
    return (f"CASE WHEN ends_with({x}, 'ing') AND length({x}) > 5 THEN [{x}[1:length({x}) - 3], {x} || ' now'] WHEN ends_with({x}, 'er') AND length({x}) > 4 "
            f"THEN [{x}[1:length({x}) - 2], {x} || ' now'] WHEN length({x}) <= 3 THEN [{x} || ' now', 'not ' || {x}] ELSE [{x} || ' now', 'not ' || {x}, {x} || ' please'] END")


@query("sound_alikes", f"""
WITH {_SHORT_SQL}, w AS (SELECT DISTINCT unnest(p) AS word FROM sp)
SELECT word, array_to_string({_alike("word")}, '|') AS alikes FROM w""")
def sound_alikes(spark: SparkSession, d: str) -> DataFrame:
    w = short_phrases(spark, d).select(F.explode("words").alias("word")).distinct()
    return w.select("word", F.array_join(lx.sound_alikes(F.col("word")), "|").alias("alikes"))


@query("hard_negative_candidates", f"""
WITH {_SHORT_SQL},
v AS (SELECT conv_id, turn, part, p, CASE WHEN len(p) = 1 THEN list_concat({_alike("p[1]")}, [p[1] || ' now', p[1], p[1]])
    ELSE list_concat(list_concat(list_concat([array_to_string(list_transform(p, lambda x: ({_alike("x")})[1]), ' ')],
      flatten(list_transform(p, lambda x, i: list_transform(({_alike("x")})[1:2], lambda r: array_to_string(list_transform(p, lambda y, j: CASE WHEN j = i THEN r ELSE y END), ' '))))),
      [p[1], p[-1]]), list_concat(CASE WHEN len(p) = 2 AND p[1] = p[2] THEN [p[1] || ' ' || ({_alike("p[1]")})[1], ({_alike("p[1]")})[1] || ' ' || p[1], p[1] || ' ' || p[1] || ' ' || p[1]] ELSE [] END,
      [array_to_string(p[2:], ' '), array_to_string(p[1:len(p) - 1], ' ')])) END AS c FROM sp WHERE len(p) > 0),
u AS (SELECT conv_id, turn, part, p, unnest(c) AS x, generate_subscripts(c, 1) AS o FROM v),
k AS (SELECT conv_id, turn, part, x, MIN(o) AS o FROM u WHERE x <> '' AND NOT contains(' ' || x || ' ', ' ' || array_to_string(p, ' ') || ' ') GROUP BY ALL)
SELECT conv_id, turn, part, string_agg(x, '|' ORDER BY o) AS candidates FROM k GROUP BY conv_id, turn, part""")
def hard_negative_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rule-based candidates of every phrase (without the phonetic part)."""
    p = short_phrases(spark, d)
    c = p.select("conv_id", "turn", "part", lx.candidates(F.col("words"), F.lit(None).cast("array<string>")).alias("c")).filter(F.size("c") > 0)
    return c.select("conv_id", "turn", "part", F.array_join("c", "|").alias("candidates"))


def _project_keys(spark: SparkSession, d: str) -> DataFrame:
    """One synthetic project per item, keyed by a whole number."""
    return phrases(spark, d).select(F.col("phrase_id").alias("slug"), F.col("phrase_id").alias("key"), "words", F.array_join("words", " ").alias("phrase"))


@query("weighted_words", f"""
WITH RECURSIVE {VOCAB_SQL}, {_PHRASE_SQL},
n AS (SELECT LEAST(COUNT(*), {lx.PROMPT_WORDS}) AS n FROM lex),
dr AS MATERIALIZED (SELECT slug, i, l.word FROM (
    SELECT phrase_id AS slug, i, CAST(LEAST(floor(n * {_u("phrase_id * 1000003 + i", 1)} * {_u("phrase_id * 1000003 + i", 1)}), n - 1) AS BIGINT) + 1 AS rank
    FROM (SELECT *, unnest(range(0, 12064)) AS i FROM ph), n) d JOIN lex l ON l.rank = d.rank),
st(slug, words, i, acc) AS (
  SELECT phrase_id, words, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM ph
  UNION ALL SELECT st.slug, st.words, st.i + 1, CASE WHEN length(d.word) >= 2 AND NOT list_contains(st.words, d.word)
      AND NOT list_contains(acc[-(LEAST(48, n // 2)):], d.word) THEN list_append(acc, d.word) ELSE acc END
    FROM st JOIN dr d ON d.slug = st.slug AND d.i = st.i, n WHERE len(acc) < 300),
fi AS (SELECT slug, arg_max(acc, i) AS acc FROM st GROUP BY slug)
SELECT slug, CAST(generate_subscripts(acc, 1) - 1 AS INTEGER) AS i, unnest(acc) AS word FROM fi""")
def weighted_words(spark: SparkSession, d: str) -> DataFrame:
    return lx.weighted_words(_project_keys(spark, d), vocab(spark, d, lx.PROMPT_WORDS), 300, arithmetic_uniform)


@query("synth_plan", f"""
WITH {_PHRASE_SQL},
p AS (SELECT phrase_id AS slug, array_to_string(words, ' ') AS phrase, CAST(i AS INTEGER) AS i, phrase_id * 1000003 + i AS k FROM (SELECT *, unnest(range(0, 50)) AS i FROM ph)),
q AS (SELECT *, (['ada', 'ben', 'cleo'])[i % 3 + 1] AS voice, 0.9::DOUBLE + {_u("k", 2)} * (1.1::DOUBLE - 0.9::DOUBLE) AS speed,
  CASE WHEN {_u("k", 3)} < 0.5 THEN (['please say', 'now'])[CAST(floor({_u("k", 4)} * 2) AS INT) + 1] ELSE '' END AS lead FROM p),
r AS (SELECT *, CASE WHEN lead = '' THEN phrase ELSE lead || ' ' || phrase END AS text FROM q)
SELECT slug, i, voice, round(speed, 6) AS speed, lead, text, round(GREATEST(len(list_filter(string_split(text, ' '), lambda x: x <> '')), 1) * 0.4::DOUBLE / speed + 0.3::DOUBLE, 6) AS seconds FROM r""")
def synth_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = lx.synthesis_plan(_project_keys(spark, d), 50, ["ada", "ben", "cleo"], ["please say", "now"], arithmetic_uniform)
    return plan.select("slug", "i", "voice", F.round("speed", 6).alias("speed"), "lead", "text", F.round("seconds", 6).alias("seconds"))
