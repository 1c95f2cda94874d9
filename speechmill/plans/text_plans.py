"""Text, validation and scan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from . import bindings as b
from .registry import query

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EDGE = _LOWER.format("regexp_replace({x}, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')")


@query("word_normalisers", rf"""
SELECT word, COUNT(*) AS n, {_EDGE.format(x="word")} AS edge, lower(regexp_replace(word, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum,
  regexp_replace(lower(word), '[^\p{{L}}]', '', 'g') AS letters FROM v_tokens GROUP BY word""")
def word_normalisers(spark: SparkSession, d: str) -> DataFrame:
    """All three normal forms of every distinct word."""
    w = F.col("word")
    distinct = b.tokens(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return distinct.select("word", "n", text.norm_edge(w).alias("edge"), text.norm_alnum(w).alias("alnum"), text.norm_letters(w).alias("letters"))


_NORM_LIST = f"list_filter(list_transform(list_filter(string_split_regex({{t}}, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), lambda x: {_EDGE.format(x='x')}), lambda x: x <> '')"


@query("normalized_words", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS words, sha256(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_NORM_LIST.format(t='text')} AS w FROM documents)")
def normalized_words(spark: SparkSession, d: str) -> DataFrame:
    w = b.table(spark, d, "documents").select("doc_id", text.normalized_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("words"), F.sha2(F.array_join("w", " "), 256).alias("digest"))


@query("safe_filename", f"""
SELECT doc_id, turn, COALESCE(NULLIF(trim(regexp_replace({_LOWER.format("trim(text)")}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'clip') AS stem
FROM (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 5 = 4 THEN ' ?! ' ELSE text END AS text FROM conversations)""")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "conversations")
    value = F.when(F.col("turn") % 5 == 4, F.lit(" ?! ")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("doc_id"), "turn", text.safe_filename(value).alias("stem"))


@query("ordered_dedupe", """
SELECT doc_id, len(u) AS distinct_words, sha256(array_to_string(u, ' ')) AS digest FROM (
  SELECT doc_id, COALESCE(list(word ORDER BY o), []) AS u FROM (SELECT d.doc_id, t.word, MIN(t.ordinal) AS o FROM v_docs d LEFT JOIN v_tokens t ON t.doc_id = d.doc_id GROUP BY d.doc_id, t.word) WHERE word IS NOT NULL GROUP BY doc_id)""")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    u = b.table(spark, d, "documents").select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("u")).filter(F.size("u") > 0)
    return u.select("doc_id", F.size("u").cast("bigint").alias("distinct_words"), F.sha2(F.array_join("u", " "), 256).alias("digest"))


@query("prompt_cases", r"""
WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM conversations),
u AS (SELECT conv_id, turn, upper(t[1:1]) || t[2:] AS t FROM f)
SELECT conv_id, turn, CASE WHEN ends_with(t, '.') THEN t ELSE t || '.' END AS sentence, CASE WHEN t = '' OR regexp_matches(t, '[.?!]$') THEN t ELSE t || '.' END AS compact FROM u""")
def prompt_cases(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return b.table(spark, d, "conversations").select("conv_id", "turn", text.sentence_case(t).alias("sentence"), text.compact_case(t).alias("compact"))


@query("phrase_in_text", f"""
WITH p AS (SELECT slug, string_split(phrase, ' ') AS p FROM v_projects),
w AS (SELECT doc_id, lang, {_NORM_LIST.format(t='text')} AS w FROM documents)
SELECT doc_id, contains(chr(1) || array_to_string(w, chr(1)) || chr(1), chr(1) || array_to_string(p, chr(1)) || chr(1)) AS anywhere,
  len(w) >= 2 AND (w[-2:] = p OR w[-3:-2] = p OR w[-4:-3] = p) AS at_tail FROM w JOIN p ON p.slug = w.lang""")
def phrase_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Does each text hold its project's phrase, and does it end with it (two words of slack)."""
    w = b.table(spark, d, "documents").select(
        "doc_id", text.normalized_words(F.col("text")).alias("w"), text.normalized_words(b.phrase_of(F.col("lang"))).alias("p"))
    return w.select("doc_id", text.contains_run(F.col("w"), F.col("p")).alias("anywhere"), text.tail_has_phrase(F.col("w"), F.col("p")).alias("at_tail"))


@query("prompt_lines", r"""
SELECT doc_id, len(l) AS lines, sha256(array_to_string(l, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""")
def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "documents").select("doc_id", text.prompt_lines(F.col("text")).alias("l"))
    return p.select("doc_id", F.size("l").cast("bigint").alias("lines"), F.sha2(F.array_join("l", "|"), 256).alias("digest"))


@query("comment_lines", r"""
SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, trim(raw) AS line FROM documents)
WHERE line <> '' AND NOT starts_with(line, '#')""")
def comment_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.lists import keep_lines

    lines = b.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return keep_lines(lines).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("value").alias("line"))


@query("run_stamps", """
SELECT run_id, strftime(to_timestamp(created_at_ms // 1000), '%Y%m%dT%H%M%SZ') AS stamp, created_at_ms AS back_ms,
  CASE WHEN run_id % 4 = 0 THEN NULL ELSE created_at_ms + 3600000 END AS iso_ms FROM v_models""")
def run_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Run ids from times and back; offset stamps and unreadable ones."""
    ts = F.timestamp_millis("created_at_ms")
    m = b.models(spark, d).select("run_id", text.run_stamp(ts).alias("stamp"), F.when(
        F.col("run_id") % 4 == 0, F.lit("garbage")).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-01:00"))).alias("iso"))
    return m.select("run_id", "stamp", F.unix_millis(text.parse_run_stamp(F.col("stamp"))).alias("back_ms"),
                    F.unix_millis(F.try_to_timestamp("iso")).alias("iso_ms"))


@query("rounded_ms", """
SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 1000.0::DOUBLE / 7.0::DOUBLE) AS BIGINT) AS ms,
  CAST(round(-l_quantity / 2.0::DOUBLE) AS BIGINT) AS half_ms FROM lineitem""")
def rounded_ms(spark: SparkSession, d: str) -> DataFrame:
    li = b.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 1000.0 / 7.0).cast("bigint").alias("ms"),
                     text.rounded_ms(-F.col("l_quantity") / 2000.0).alias("half_ms"))


@query("local_paths", r"""SELECT recording_id, regexp_replace(p, '^(/work)?/data/', '/mnt/takes/') AS path FROM (
  SELECT recording_id, CASE doc_id % 3 WHEN 0 THEN '/data/' WHEN 1 THEN '/work/data/' ELSE '/other/' END || project_slug || '/' || recording_id || '.wav' AS p FROM v_takes)""")
def local_paths(spark: SparkSession, d: str) -> DataFrame:
    root = F.when(F.col("doc_id") % 3 == 0, "/data/").when(F.col("doc_id") % 3 == 1, "/work/data/").otherwise("/other/")
    p = F.concat(root, "project_slug", F.lit("/"), "recording_id", F.lit(".wav"))
    return b.takes(spark, d).select("recording_id", text.remap_path(p, "/mnt/takes").alias("path"))


# --- validation --------------------------------------------------------------------


@query("safe_ids", r"""
SELECT doc_id, regexp_full_match(slug, '[a-z0-9][a-z0-9_]*') AS slug_ok, regexp_full_match(rid, '[A-Za-z0-9_-]+') AS recording_ok, regexp_full_match(run, '[A-Za-z0-9]+') AS run_ok
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '_' ELSE '' END || device AS slug, recording_id || CASE WHEN doc_id % 6 = 0 THEN '/..' ELSE '' END AS rid,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE device || doc_id END AS run FROM v_takes)""")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    t = b.takes(spark, d).select(
        i, F.concat(F.when(i % 5 == 0, "_").otherwise(""), "device").alias("slug"), F.concat("recording_id", F.when(i % 6 == 0, "/..").otherwise("")).alias("rid"),
        F.when(i % 7 == 0, "").otherwise(F.concat("device", i.cast("string"))).alias("run"))
    return t.select(i, rules.is_safe_slug(F.col("slug")).alias("slug_ok"), rules.is_safe_recording_id(F.col("rid")).alias("recording_ok"),
                    rules.is_safe_run_id(F.col("run")).alias("run_ok"))


@query("path_escapes", """
SELECT page_id, path, starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') AS escapes
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' || split_part(url, '://', 2) WHEN 1 THEN '../' || split_part(url, '://', 2) WHEN 2 THEN replace(split_part(url, '://', 2), '.', '..')
  ELSE split_part(url, '://', 2) END AS path FROM pages)""")
def path_escapes(spark: SparkSession, d: str) -> DataFrame:
    tail, i = F.split_part("url", F.lit("://"), F.lit(2)), F.col("page_id") % 4
    path = F.when(i == 0, F.concat(F.lit("/"), tail)).when(i == 1, F.concat(F.lit("../"), tail)).when(i == 2, F.replace(tail, F.lit("."), F.lit(".."))).otherwise(tail)
    p = b.table(spark, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", "path", rules.path_escapes(F.col("path")).alias("escapes"))


@query("label_categories", """
SELECT slice_id, label, category, CASE WHEN label = 'hard_negative' THEN 'negative' ELSE category END AS coarse FROM v_slices""")
def label_categories(spark: SparkSession, d: str) -> DataFrame:
    return b.slices(spark, d).select("slice_id", "label", rules.category(F.col("label")).alias("category"), rules.category(F.col("label"), True).alias("coarse"))


@query("take_kinds", r"""
SELECT recording_id, COALESCE(NULLIF(kind, ''), 'mixed') AS kind, starts_with(recording_id, 'test_') AS is_test, starts_with(recording_id, 'background_') AS is_background,
  CASE WHEN kind IN ('positive', 'negative', 'hard_negative', 'enrollment') THEN kind ELSE 'other' END AS bucket FROM v_takes""")
def take_kinds(spark: SparkSession, d: str) -> DataFrame:
    k, r = F.col("kind"), F.col("recording_id")
    return b.takes(spark, d).select("recording_id", rules.resolved_kind(k).alias("kind"), rules.is_test(r).alias("is_test"),
                                    rules.is_background(r).alias("is_background"), rules.review_bucket(k).alias("bucket"))


@query("prefix_filters", r"""
SELECT id, id LIKE 'test\_%' ESCAPE '\' AS exact_prefix, id LIKE 'test_%' AS loose_prefix FROM (
  SELECT CASE WHEN doc_id % 20 = 0 THEN replace(recording_id, 'test_', 'testX') ELSE recording_id END AS id FROM v_takes)""")
def prefix_filters(spark: SparkSession, d: str) -> DataFrame:
    """The escaped prefix against LIKE, where ``_`` matches any character."""
    x = F.when(F.col("doc_id") % 20 == 0, F.replace("recording_id", F.lit("test_"), F.lit("testX"))).otherwise(F.col("recording_id"))
    return b.takes(spark, d).select(x.alias("id")).select("id", rules.is_test(F.col("id")).alias("exact_prefix"), F.col("id").like("test_%").alias("loose_prefix"))


@query("capture_fields", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS device_model,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) - 50 END AS source_channels FROM events""")
def capture_fields(spark: SparkSession, d: str) -> DataFrame:
    """Capture fields out of JSON: blanks and numbers up to 0 become null."""
    e = b.table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    capture = F.struct(F.when(F.col("event_id") % 4 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("device_model"),
                       (F.col("k") - 50).alias("source_channels"))
    e = e.select("event_id", capture.alias("capture"))
    return e.select("event_id", rules.capture_text(F.col("capture"), "device_model").alias("device_model"),
                    rules.capture_number(F.col("capture"), "source_channels").alias("source_channels"))


@query("manifest_rejects", """
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN doc_id % 13 = 0 THEN '' ELSE recording_id END AS id,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'a/' || doc_id || '.wav' END AS file, kind, script, doc_id % 10 = 0 OR doc_id % 23 = 0 AS is_test FROM v_takes)
SELECT doc_id, unnest(list_filter([CASE WHEN v <> 1 THEN 'unsupported schema_version' END, CASE WHEN id = '' THEN 'missing id' END, CASE WHEN file = '' THEN 'missing file' END,
  CASE WHEN NOT is_test AND trim(kind) IN ('', 'mixed') AND trim(script) = '' THEN 'missing script' END,
  CASE WHEN is_test AND NOT starts_with(id, 'test_') THEN 'id must start with test_' END], lambda x: x IS NOT NULL)) AS reason FROM m""")
def manifest_rejects(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.validate import take_rejects

    i = F.col("doc_id")
    t = b.takes(spark, d).select(
        i, F.when(i % 17 == 0, 2).otherwise(1).alias("schema_version"), F.when(i % 13 == 0, "").otherwise(F.col("recording_id")).alias("id"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("a/"), i.cast("string"), F.lit(".wav"))).alias("file"), "kind", "script",
        F.when((i % 10 == 0) | (i % 23 == 0), "test").otherwise("bulk").alias("section"))
    return t.select(i, F.explode(take_rejects()).alias("reason"))


@query("clip_rejects", """
SELECT slice_id, unnest(list_filter([CASE WHEN file = '' THEN 'missing file' END, CASE WHEN label NOT IN ('positive', 'false_negative', 'negative', 'false_positive', 'hard_negative', 'background')
  THEN 'unknown label ' || label END], lambda x: x IS NOT NULL)) AS reason
FROM (SELECT slice_id, CASE WHEN k % 9 = 0 THEN '' ELSE file_name END AS file, CASE WHEN doc_id % 8 = 0 THEN upper(label) ELSE label END AS label FROM v_slices)""")
def clip_rejects(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.validate import clip_rejects as rejects

    s = b.slices(spark, d).select(
        "slice_id", F.col("slice_id").alias("id"), F.when(F.col("k") % 9 == 0, "").otherwise(F.col("file_name")).alias("file"),
        F.when(F.col("doc_id") % 8 == 0, F.upper("label")).otherwise(F.col("label")).alias("label"))
    return s.select("slice_id", F.explode(rejects()).alias("reason"))


@query("take_table", """
SELECT id, section, position FROM (SELECT recording_id AS id, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'background' ELSE 'bulk' END AS section,
  ROW_NUMBER() OVER (PARTITION BY project_slug, doc_id // 50, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'background' ELSE 'bulk' END ORDER BY doc_id) - 1 AS position FROM v_takes)""")
def take_table(spark: SparkSession, d: str) -> DataFrame:
    """Takes packed into manifests of one project and 50 ids, and flattened again."""
    from ..sources.manifests import flatten_takes

    item = F.struct("doc_id", F.col("recording_id").alias("id"))

    def part(prefix: str) -> F.Column:
        mine = F.startswith("recording_id", F.lit(prefix))
        return F.sort_array(F.collect_list(F.when(mine, item)))

    packed = b.takes(spark, d).groupBy("project_slug", F.expr("doc_id div 50")).agg(
        part("bulk_").alias("bulk_recordings"), part("background_").alias("background_recordings"), part("test_").alias("test_recordings"))
    return flatten_takes(packed).select("id", "section", F.col("position").cast("bigint").alias("position"))


@query("curve_ticks", """
SELECT recording_id, model, page, CAST(t_ms AS DOUBLE) AS t_ms, score FROM (
  SELECT *, t_ms // 600000 AS page FROM v_ticks) WHERE page % 9 <> 0""")
def curve_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Score curves stored as JSON, in pages of ten minutes, and read as ticks.

    A page whose JSON is broken (here every ninth) yields none.
    """
    from ..sources.curves import curves_to_ticks

    keys = ["recording_id", "model", "page"]
    ticks = b.ticks(spark, d).withColumn("page", F.expr("t_ms div 600000"))
    pages = ticks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t_ms", "seq", "score"))).alias("_p"))
    times = F.to_json(F.col("_p.t_ms"))
    stored = pages.select(*keys, F.when(F.col("page") % 9 == 0, F.regexp_replace(times, "]$", "")).otherwise(times).alias("times_ms"),
                          F.to_json(F.col("_p.score")).alias("scores"))
    return curves_to_ticks(stored, keys)
