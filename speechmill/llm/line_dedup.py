"""Operator 2, line dedup: lines that many documents share stay in one of them.

Lines are exploded with their position and hashed; documents are counted per
hash; the lines of a frequent hash go, except in the largest document id that
holds it; each text is put together again from the positions that stay.
DataFrame functions only.

Defined results: a null or empty text is one empty line; a null id is not
counted and its text stays whole; repeated rows of one id count as one document
and all keep or lose the same lines; result columns replace input columns of
the same name, other columns of any name stay as they are; ties do not matter; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, text_of, wide_hash


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row hash, position, two hashes of the key) of every line that is long enough."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_row"),
        F.posexplode(lines_of(text_of(text_col))).alias("_pos", "_line"))
    rows = rows.filter(F.length("_line") >= min_chars).withColumn("_key", ascii_lower(F.btrim("_line", F.lit(BLANKS))))
    return rows.filter(F.length("_key") >= min_chars).select(
        "_id", "_row", "_pos", *(h.alias(f"_h{i}") for i, h in enumerate(wide_hash(F.col("_key")))))


def frequent_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """Hashes held by at least min_docs documents, with the document that keeps them."""
    return (keys.groupBy("_h0", "_h1").agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_keeper"))
            .filter(F.col("_n") >= min_docs).drop("_n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    Texts move once, to meet their dropped positions; a line that a third of all
    documents hold is one hash whose side of the join Spark may split.
    """
    keys = line_keys(docs, id_col, text_col, min_chars)
    # Computed anew, the hashes don't count as dealt out already: the join has a
    # shuffle of its own on either side, and Spark can split that of a hot line.
    again = [F.col(h).bitwiseOR(F.lit(0).cast("long")).alias(h) for h in ("_h0", "_h1")]
    frequent = frequent_lines(keys, min_docs).select(*again, "_keeper")
    dropped = (keys.join(frequent, ["_h0", "_h1"]).filter("_id < _keeper")
               .groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_dropped")))
    # what the caller gave stays in one struct (the text beside it), away from the names used here
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_given"), F.col(f"`{text_col}`").alias("_raw"))
    met = packed.join(
        dropped, (F.col(f"_given.`{id_col}`") == F.col("_id")) & (F.xxhash64(text_of("_raw")) == F.col("_row")), "left")
    met = met.withColumn("_text", text_of("_raw")).withColumn("_lines", lines_of(F.col("_text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_dropped")
    kept = F.array_join(F.transform(places, lambda p: F.get("_lines", p)), "\n")
    found = met.select(
        "_given", "_raw", F.size("_lines").cast("long").alias("_n"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("_gone"),
        F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(kept).alias("_kept"))
    columns = [F.col("_raw").alias(c) if c == text_col else F.col(f"_given.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    return found.select(*columns, F.col("_n").alias("n_lines"), F.col("_gone").alias("n_dropped"), F.col("_kept").alias("kept_text"))


def line_report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of their texts (pipeline stage)."""
    out = dedup_lines(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (keeper > k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper <= k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id
"""
