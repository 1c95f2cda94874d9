"""Word operators: worked examples and brute force on random data."""

import random

import numpy as np
import pytest
from conftest import rows_of, words_frame
from pyspark.sql import functions as F

from speechmill.functions import text
from speechmill.operators import greedy as gr
from speechmill.operators import slices as sl
from speechmill.operators import words as ww

FIVE = [("alpha", 0.0, 0.2), ("bravo", 0.35, 0.55), ("charlie", 0.9, 1.1), ("wake", 1.3, 1.55), ("word", 1.65, 1.9)]
KEY = "recording_id"


def projects(spark, phrase, slug="p"):
    return spark.createDataFrame([(slug, phrase)], "slug string, phrase string")


def geometry(spark, words, phrase, source_end):
    w = words_frame(spark, words)
    hits = sl.phrase_hits(w, projects(spark, phrase)).withColumn("source_end", F.lit(source_end))
    return ww.phrase_geometry(hits, ww.neighbours(w, KEY), KEY).collect()


def test_context_and_padding(spark):
    row = geometry(spark, FIVE, "Wake, word!", 3000)[0]
    assert row.context_first == 2
    assert (row.padded_start_ms, row.cut_start_ms, row.cut_end_ms) == (820, 820, 2180)
    assert [w.word for w in row.visible] == ["charlie", "wake", "word"]


def test_padded_bounds_examples(spark):
    def bounds(start, end, prev_end, next_start, lead, tail, clamp):
        cols = [F.lit(x).cast("bigint") for x in (start, end, prev_end, next_start, 3000)]
        s, e = ww.padded_bounds(*cols, lead, tail, clamp)
        return tuple(spark.range(1).select(s, e).first())

    assert bounds(900, 1900, 550, None, 80, 180, False) == (820, 2080)
    assert bounds(900, 1550, 550, 1650, 80, 180, True)[1] == 1650
    assert bounds(900, 1550, 550, 1650, 80, 180, False)[1] == 1730
    assert bounds(350, 550, 200, 900, 500, 100, True)[0] == 200


def test_clamp(spark):
    def clamp(s, e, tail):
        return tuple(spark.range(1).select(*ww.clamp_span(F.lit(s), F.lit(e), tail)).first())

    assert clamp(500, 1500, True) == (500, 1500)
    assert clamp(0, 1800, True) == (300, 1800)
    assert clamp(0, 1800, False) == (0, 1500)


@pytest.mark.parametrize("span,kept", [((600, 2000), ["wake", "word"]), ((0, 1200), ["alpha", "bravo"]),
                                       ((0, 2000), ["alpha", "bravo", "wake", "word"])])
def test_visible_words(spark, span, kept):
    four = [FIVE[0], FIVE[1], FIVE[3], FIVE[4]]
    w = words_frame(spark, four).agg(F.sort_array(F.collect_list(F.struct("ordinal", "word", "start_ms", "end_ms"))).alias("w"))
    row = w.select(ww.visible_words(F.col("w"), F.lit(span[0]), F.lit(span[1])).alias("v")).first()
    assert [x.word for x in row.v] == kept


def chunks_of(spark, words, occupied, block=300_000):
    w = words_frame(spark, words) if isinstance(words, list) else words
    spans = spark.createDataFrame([("r", a, b) for a, b in occupied], "recording_id string, span_start bigint, span_end bigint")
    out = gr.greedy_chunks(w, spans, [KEY], ["word"], [], 1500, block_ms=block)
    return sorted((r.chunk[0].ordinal, r.chunk[-1].ordinal) for r in out.collect())


def test_negative_chunk_example(spark):
    words = [("one", 0.0, 0.2), ("two", 0.5, 0.7), ("wake", 1.7, 1.9), ("word", 2.0, 2.2), ("three", 2.7, 2.9), ("four", 3.4, 3.6),
             ("five", 4.1, 4.3), ("overlong", 5.0, 6.7)]
    assert chunks_of(spark, words, [(1600, 2300)]) == [(0, 1), (4, 5), (6, 6)]


def brute_chunks(words, occupied):
    def taken(w):
        return any(w[1] < b and w[2] > a for a, b in occupied)

    out, i = [], 0
    while i < len(words):
        if taken(words[i]) or words[i][2] - words[i][1] > 1500:
            i += 1
            continue
        j = i
        while j + 1 < len(words) and not taken(words[j + 1]) and words[j + 1][2] - words[i][1] <= 1500:
            j += 1
        out.append((i, j))
        i = j + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chunks_match_a_plain_walk_across_blocks(spark, seed):
    """Blocks of 3 s force hundreds of block crossings in one long take."""
    rng = random.Random(seed)
    words, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 20, 40, 300, 900])
        dur = rng.choice([50, 100, 200, 400, 1600])
        words.append((i, t, t + dur))
        t += dur if seed % 2 else dur // 2  # odd seeds: ordered ends, even: overlaps
    occupied = [(a, a + rng.randint(100, 1500)) for a in rng.sample(range(t), 40)]
    rows = [("r", "p", i, "w", s, e, 1.0) for i, s, e in words]
    df = spark.createDataFrame(rows, "recording_id string, project_slug string, ordinal bigint, word string, start_ms bigint, end_ms bigint, prob double")
    assert chunks_of(spark, df, occupied, 3000) == brute_chunks(words, occupied)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_select_matches_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    starts = sorted(rng.sample(range(4000), 1500))
    n = rng.choice([2, 3, 7])
    df = spark.createDataFrame([("r", s, s + n) for s in starts], "recording_id string, first bigint, nxt bigint")
    want, at = [], -1
    for s in starts:
        if s >= at:
            want.append(s)
            at = s + n
    assert [r[0] for r in rows_of(gr.greedy_select(df, [KEY], "first", "nxt", n, 64), "pos")] == want


def test_dense_repeats_count_once(spark):
    w = words_frame(spark, [("all", 0.0, 0.1), ("all", 0.12, 0.22), ("set", 0.24, 0.4)])
    toks = ww.phrase_tokens(projects(spark, "all set").select(F.col("slug").alias("project_slug"), "phrase"), text.tokens(F.col("phrase")), ["project_slug"])
    hits = ww.phrase_ranges(w, toks, text.norm_alnum(F.col("word")), [KEY], [], ["project_slug"])
    assert rows_of(ww.phrase_occurrences(hits, [KEY]), "start_ms", "end_ms") == [(120, 400)]


def test_overlapping_and_consuming_matchers_differ(spark):
    w = words_frame(spark, [("the", i * 0.2, i * 0.2 + 0.1) for i in range(5)])
    hits = sl.phrase_hits(w, projects(spark, "the the"))
    assert [r[0] for r in rows_of(hits, "first")] == [0, 1, 2, 3]
    assert [r[0] for r in rows_of(ww.phrase_occurrences(hits, [KEY]), "first")] == [0, 2]


MIXED = ("this is not the wake phrase all set okay now let us go ahead and finally say all set").split()


def roles(spark, kind):
    w = words_frame(spark, [(x, i * 0.3, i * 0.3 + 0.2) for i, x in enumerate(MIXED)])
    out = ww.split_hits(ww.mark_near_miss(sl.hits_and_cues(w, projects(spark, "all set")), [KEY]), F.lit(kind))
    return rows_of(out, "first", "last", "role")


def test_near_miss_split_by_kind(spark):
    assert roles(spark, "mixed") == [(6, 7, "hard_negative"), (17, 18, "positive")]
    assert roles(spark, "positive") == [(6, 7, "positive"), (17, 18, "positive")]
    assert roles(spark, "negative") == []


@pytest.mark.parametrize("ms,want", [(500, 0), (2000, 1), (5000, 3), (4500, 2)])
def test_background_windows(spark, ms, want):
    t = spark.createDataFrame([("b", ms)], "recording_id string, duration_ms bigint")
    assert ww.background_windows(t).count() == want


def test_active_word_and_markers(spark):
    w = words_frame(spark, FIVE)
    probes = spark.createDataFrame([("r", i, t) for i, t in enumerate((100, 270, 276, 1250, 5000))], "recording_id string, probe int, at_ms bigint")
    assert rows_of(ww.active_word(probes, w, KEY, ["probe"]), "probe", "ordinal") == [(0, 0), (1, 0), (2, 1), (3, 3)]
    cuts = spark.createDataFrame([("r", "a", 0), ("r", "b", 350), ("r", "c", 351), ("r", "d", 9000)], "recording_id string, slice_id string, start_ms bigint")
    assert sorted((r.slice_id, r.before_ordinal) for r in ww.cut_markers(cuts, w, KEY).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", None)]


def test_slice_ids_are_stable_and_distinct(spark):
    rows = spark.createDataFrame([("r", 0), ("r", 0), ("q", 0), ("r", 1)], "rec string, s bigint")
    empty = F.array().cast("array<struct<word:string,start_ms:bigint,end_ms:bigint>>")
    ids = [r[0] for r in rows.select(sl.slice_id(F.col("rec"), F.lit("t"), F.lit(5), F.lit("positive"), F.col("s"), F.lit(9), empty)).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_slice_table_invariants(spark):
    """Slices last at most 1.5 s (background 2 s) and negatives miss every positive."""
    from speechmill.plans import registry

    t = registry.all_queries()["slice_table"](spark, "/root/testdata/sf0.001").cache()
    assert t.filter("category <> 'background' AND end_ms - start_ms > 1500").count() == 0
    assert t.select("slice_id").distinct().count() == t.count()
    t.unpersist()


def test_transcript_offsets(spark):
    from speechmill.sources import transcripts as tr

    doc = ('{"text": "x", "segments": [{"start": 10, "end": 12, "words": [{"word": " a", "start": 0.1, "end": 0.4, "probability": 1},'
           '{"word": "b", "start": 0.9, "end": 1.4, "probability": 1}]}, {"start": 20, "end": 21, "words": [{"word": "c", "start": 20.1, "end": 20.9, "probability": 1},'
           '{"word": "bad", "start": 20.9, "end": 20.1, "probability": 1}]}, {"start": 30, "end": 31, "words": []}]}')
    raw = spark.createDataFrame([(1, doc)], "id int, response string")
    out = tr.transcript_words(tr.parse_transcripts(raw), ["id"])
    assert rows_of(out, "ordinal", "word", "start_ms", "end_ms") == [(0, "a", 10000, 10300), (1, "b", 10800, 11300), (2, "c", 20100, 20900)]


def test_phrases_longer_than_a_block_edge_allows(spark):
    """70-word phrases that cross the edge of a word block, against a plain walk."""
    n, edge = 70, ww.WORD_BLOCK
    starts = [edge - 200, edge - 150, edge - 65, edge - 1, edge + 3, edge + 60, edge + 140]
    hits = spark.createDataFrame([("r", s, s + n - 1, n, -1) for s in starts], "recording_id string, first bigint, last bigint, n bigint, cue_id int")
    want, at = [], -1
    for s in starts:
        if s >= at:
            want.append(s)
            at = s + n
    assert sorted(r[0] for r in rows_of(ww.phrase_occurrences(hits, [KEY]), "first")) == want
    cues = [(edge + 3 + n - 1 + d, edge + 3 + n + d) for d in (1, 4)] + [(edge - 210, edge - 209)]
    found = hits.unionByName(spark.createDataFrame([("r", a, z, 2, 0) for a, z in cues], hits.schema))
    got = {r["first"]: r["near_miss"] for r in ww.mark_near_miss(found, [KEY]).collect()}
    assert got == {s: any(a >= s - ww.CUE_BEFORE and z <= s + n - 1 + ww.CUE_AFTER for a, z in cues) for s in starts}


@pytest.mark.parametrize("seed", range(2))
def test_rare_token_search_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    said = [rng.choice(["a", "bb", "the", "ccc", "dddd"]) for _ in range(400)]
    w = words_frame(spark, [(x, i * 0.3, i * 0.3 + 0.2) for i, x in enumerate(said)])
    phrases = [(i, said[k: k + m]) for i, (k, m) in enumerate([(0, 1), (5, 2), (50, 6), (120, 40), (390, 10)])] + [(9, ["zz", "a"]), (10, [])]
    df = spark.createDataFrame(phrases, "item_id int, t array<string>")
    got = rows_of(ww.many_phrase_ranges(w, df, F.col("t"), text.norm_edge(F.col("word")), [KEY], ["item_id"]), "item_id", "first", "last")
    want = sorted((i, k, k + len(t) - 1) for i, t in phrases if t for k in range(len(said)) if said[k: k + len(t)] == t)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_prefix_over_blocks_matches_a_chain(spark, monkeypatch, seed):
    """Groups of two blocks and three levels give the entries of a plain left-to-right chain."""
    monkeypatch.setattr(gr, "FAN_BITS", 1)
    rng = random.Random(seed)
    rows, want = [], []
    for take in ("a", "b"):
        x, tail = gr.NOWHERE, None
        for blk in sorted(rng.sample(range(40), 25)):
            entry = sorted(rng.sample(range(100 * blk, 100 * blk + 30), rng.randrange(0, 4)))
            leave = [max(e + rng.randrange(1, 20), 100 * blk + rng.randrange(60, 130)) for e in entry]
            leave = sorted(leave)
            rows.append((take, blk, entry, leave, None, blk * 7))
            want.append((take, blk, x, tail))
            x = next((v for e, v in zip(entry, leave) if e >= x), x)
            tail = blk * 7
    df = spark.createDataFrame(rows, "take string, _blk bigint, entry array<bigint>, leave array<bigint>, rest bigint, tail bigint")
    for levels in (0, 1, 3):
        got = gr.block_entries(df, ["take"], levels).select("take", "_blk", "enter", "before").collect()
        assert sorted(map(tuple, got)) == want


def test_doubling_matches_a_plain_walk():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        pos = np.sort(rng.choice(10 * n, n, replace=False)).astype(np.int64)
        nxt = pos + rng.integers(1, 30, n)
        leave = {}
        for e in range(n):
            i, trail = e, []
            while i < n:
                trail.append(i)
                i = int(np.searchsorted(pos, nxt[i]))
            leave[e] = (trail, nxt[trail[-1]])
        got = gr._paths(pos, nxt, 5)
        assert got["leave"].tolist() == [leave[e][1] for e in range(min(5, n))]
        assert got["pos"].tolist() == pos[sorted({i for e in range(min(5, n)) for i in leave[e][0]})].tolist()
        assert gr._walk(pos, nxt, int(pos[0])).tolist() == leave[0][0] and gr._walk(pos, nxt, int(pos[-1]) + 1).tolist() == []
