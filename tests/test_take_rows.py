"""Words that stay in their rows: the results of the word tables, and no exchange of words."""

import re

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from speechmill.functions import text
from speechmill.operators import slices as sl
from speechmill.operators import takes as tk
from speechmill.operators import words as ww
from speechmill.plans import bindings as b
from speechmill.plans import word_plans as wp

SF = "/root/testdata/sf0.001"
KEY = "recording_id"
IN_ROWS = ["phrase_ranges", "target_tails", "phrase_occurrences", "near_miss_context", "near_miss_split", "phrase_geometry",
           "words_outside_slices", "negative_chunks", "alignment_view", "transcript_words"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    texts = {0: "The the the. THE, the x of the of", 10: None, 20: "", 30: " \t\n", 40: "the", 50: "the the", 2: "the the near match " * 40,
             3: "été the «the» of the " * 9, 97: "a the the " * 70 + "the the", 12: "x the", 22: "the x"}
    spark.createDataFrame([(i, t, "en" if i != 3 else "fr", "s") for i, t in texts.items()], "doc_id bigint, text string, lang string, source string"
                          ).coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def by_words(spark, d):
    words = b.words(spark, d)
    return words, sl.phrase_hits(words, b.phrase_table(spark))


def test_hits_and_cuts_equal_those_of_a_word_table(spark, odd):
    words, hits = by_words(spark, odd)
    want = ["first", "last", "start_ms", "end_ms"]
    assert rows_of(wp._hits(spark, odd, KEY, *want), KEY, *want) == rows_of(hits, KEY, *want)
    ends = b.takes(spark, odd).select(KEY, F.col("duration_ms").alias("source_end"))
    geometry = ww.phrase_geometry(hits.join(ends, KEY), ww.neighbours(words, KEY), KEY).withColumn("seen", F.to_json("visible"))
    cols = [KEY, "first", "context_first", "padded_start_ms", "cut_start_ms", "cut_end_ms", "seen"]
    got = wp._geometry(spark, odd).withColumn("seen", F.to_json("visible"))
    assert len(rows_of(got, *cols)) > 50 and rows_of(got, *cols) == rows_of(geometry, *cols)


def test_chunks_equal_those_of_a_word_table(spark, odd):
    words, _ = by_words(spark, odd)
    want = ww.negative_chunks(words, wp._geometry(spark, odd), KEY)
    ends = want.select(KEY, F.get("chunk", F.lit(0))["ordinal"].alias("first"), F.element_at("chunk", -1)["ordinal"].alias("last"))
    assert rows_of(wp.negative_chunks(spark, odd), KEY, "first", "last") == rows_of(ends, KEY, "first", "last")


def test_near_cues_and_greedy_hits_equal_those_of_a_word_table(spark, odd):
    words, hits = by_words(spark, odd)
    cues = ww.cue_hits(words, text.norm_edge(F.col("word")), [KEY])
    assert rows_of(wp._hits(spark, odd, KEY, "first", "near_miss"), KEY, "first", "near_miss") == rows_of(
        ww.near_miss(hits, cues, [KEY]), KEY, "first", "near_miss")
    kept = tk.take_hits(b.phrased(spark, odd, text.norm_edge, KEY), b.timed, [KEY, "first"], greedy=True)
    assert rows_of(kept, KEY, "first") == rows_of(ww.phrase_occurrences(hits, [KEY], 2), KEY, "first")


def test_many_phrases_and_free_words_equal_those_of_a_word_table(spark, odd):
    words, _ = by_words(spark, odd)
    phrases = spark.createDataFrame([(1, ["the"]), (2, ["the", "the", "the"]), (3, ["of", "the"]), (4, [])], "item_id int, t array<string>")
    got = tk.many_phrase_hits(b.phrased(spark, odd, text.norm_edge, KEY), b.timed, phrases, F.col("t"), [KEY], ["item_id"])
    want = ww.many_phrase_ranges(words, phrases, F.col("t"), text.norm_edge(F.col("word")), [KEY], ["item_id"])
    cols = ["item_id", KEY, "first", "last", "start_ms", "end_ms"]
    assert len(rows_of(got, *cols)) > 100 and rows_of(got, *cols) == rows_of(want, *cols)
    spans = b.slices(spark, odd).filter("status = 'active'").select(KEY, F.col("start_ms").alias("span_start"), F.col("end_ms").alias("span_end"))
    free = ww.words_outside(words, spans, KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("free"), F.sum("ordinal").alias("ordinal_sum"))
    assert rows_of(wp.words_outside_slices(spark, odd), KEY, "free", "ordinal_sum") == rows_of(free, KEY, "free", "ordinal_sum")


@pytest.mark.parametrize("name", IN_ROWS)
def test_no_word_is_exchanged(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join|Aggregate|Window|Sort", plan)


@pytest.mark.parametrize("name", ["slice_table", "positive_slices", "many_phrases", "locate_targets"])
def test_words_meet_nothing_by_their_take(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan.split("Union")[0] and not re.search(r"recording_id#\d+ = recording_id#\d+\) AND", plan)


def test_phrase_function_takes_texts_by_the_hundred(spark):
    plan = wp.udtf_phrase_hits(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan


def test_beds_and_clips_are_read_from_one_written_table(spark):
    plan = entry.queries()["bed_pairing"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan
