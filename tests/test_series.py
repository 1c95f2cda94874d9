"""Joins, islands and grading against brute force on one hot recording."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from speechmill.operators import evaluate as ev
from speechmill.operators import islands as isl
from speechmill.operators import joins as jn

TICKS = "recording_id string, model string, t_ms bigint, seq bigint, score double"


def ticks_frame(spark, rows):
    return spark.createDataFrame([("r", "m", t, i, float(s)) for i, (t, s) in enumerate(rows)], TICKS)


def targets_frame(spark, ends):
    return spark.createDataFrame([("r", i, e) for i, e in enumerate(ends)], "recording_id string, target_id int, end_ms bigint")


def random_curve(seed, n=3000, span=120_000):
    rng = random.Random(seed)
    return [(t, rng.random()) for t in sorted(rng.randrange(span) for _ in range(n))]


def brute_bands(ends):
    out = []
    for k, e in enumerate(ends):
        lo, hi = e - 1200, e + 1200
        if k:
            lo = max(lo, (ends[k - 1] + e) / 2)
        if k + 1 < len(ends):
            hi = min(hi, (e + ends[k + 1]) / 2)
        out.append((max(lo, 0), hi))
    return out


@pytest.mark.parametrize("gap", [0, 30, 200])
def test_gap_runs_across_blocks(spark, gap):
    pos = [t for t, s in random_curve(gap)]
    want, start, prev, n = [], None, None, 0
    for p in pos:
        if prev is not None and p - prev > gap:
            want.append((start, prev, n))
            start, n = p, 0
        start = p if start is None else start
        prev, n = p, n + 1
    want.append((start, prev, n))
    df = ticks_frame(spark, [(p, 0) for p in pos])
    got = isl.runs(df, ["recording_id"], "t_ms", "seq", 1000, gap=gap)
    assert rows_of(got, "start", "end", "n") == sorted(want)


@pytest.mark.parametrize("share", [0.05, 0.5, 0.95, 0.999])
def test_value_runs_across_blocks(spark, share):
    """At 0.999 single runs span dozens of blocks."""
    curve = random_curve(int(share * 1000))
    flags = [s < share for _, s in curve]
    want = []
    for i, (t, _) in enumerate(curve):
        if i == 0 or flags[i] != flags[i - 1]:
            want.append([t, t, flags[i], 0, None])
            if len(want) > 1:
                want[-2][4] = t
        want[-1][1], want[-1][3] = t, want[-1][3] + 1
    df = ticks_frame(spark, curve)
    got = isl.runs(df, ["recording_id"], "t_ms", "seq", 2000, value=F.col("score") < share)
    key = lambda r: (r[0], r[1], r[2], r[3], -1 if r[4] is None else r[4])
    assert sorted(map(key, [tuple(r) for r in got.select("start", "end", "value", "n", "next_start").collect()])) == sorted(map(key, map(tuple, want)))


def test_hysteresis_example(spark):
    df = ticks_frame(spark, enumerate([0, 12, 6, 0, 11]))
    assert rows_of(isl.hysteresis(df, ["recording_id"], "t_ms", "seq", "score", 10, 5, 2), "start", "end") == [(1, 3), (4, 4)]


def test_bands_and_false_positive_examples(spark):
    one = ev.target_bands(targets_frame(spark, [1000]))
    assert rows_of(one, "lo", "hi") == [(0.0, 2200.0)]
    two = ev.target_bands(targets_frame(spark, [1000, 1400]))
    assert rows_of(two, "lo", "hi") == [(0.0, 1200.0), (1200.0, 2600.0)]
    curve = ticks_frame(spark, [(950, 0.8), (1000, 0.9), (5000, 0.7), (5040, 0.7), (5080, 0.7)])
    assert ev.false_positive_runs(curve, one, 0.5).count() == 1
    assert ev.false_positive_runs(curve, one, 0.99).count() == 0


def test_peak_examples(spark):
    curve = ticks_frame(spark, [(0, 0.1), (100, 0.9), (200, 0.4), (300, 0.95)])
    bands = spark.createDataFrame([("r", 1, 50.0, 250.0), ("r", 2, 500.0, 600.0)], "recording_id string, target_id int, lo double, hi double")
    got = ev.target_peaks(curve, bands, 0.5)
    assert rows_of(got, "target_id", "peak_ms", "peak_score", "detected") == [(1, 100.0, 0.9, True), (2, 500.0, 0.0, False)]


@pytest.mark.parametrize("seed", range(3))
def test_dense_targets_match_brute_force(spark, seed):
    """Targets as dense as the ticks, repeats included: bands shrink to points."""
    rng = random.Random(seed)
    curve = random_curve(seed, 1200, 40_000)
    ends = sorted(rng.randrange(40_000) for _ in range([40, 400, 1500][seed]))
    bands = brute_bands(ends)
    df, tg = ticks_frame(spark, curve), ev.target_bands(targets_frame(spark, ends))
    want = []
    for k, (lo, hi) in enumerate(bands):
        t, s = max(lo, 0), 0.0
        for p, q in curve:
            if lo <= p <= hi and q >= s:
                t, s = p, q
        want.append((k, float(t), s))
    assert rows_of(ev.target_peaks(df, tg, 0.5), "target_id", "peak_ms", "peak_score") == want
    count, inside = 0, False
    for p, q in curve:
        hot = q >= 0.5 and not any(lo <= p <= hi for lo, hi in bands)
        count += hot and not inside
        inside = hot
    assert ev.false_positive_runs(df, tg, 0.5).count() == count
    swept = {r.threshold: r.false_positives for r in ev.threshold_sweep(df, tg, [0.5, 0.9]).collect()}
    assert swept[0.5] == count
    acc = ev.account(df, targets_frame(spark, ends), 0.8).first()
    peaks = [max([q for p, q in curve if e - 600 <= p <= e + 500], default=0.0) for e in ends]
    assert (acc.targets, acc.hits) == (len(ends), sum(p >= 0.8 for p in peaks))
    assert abs(acc.peak_sum - sum(peaks)) < 1e-9
    fires, i = 0, 0
    while i < len(curve):
        if curve[i][1] >= 0.8:
            j = i
            while j + 1 < len(curve) and curve[j + 1][1] >= 0.8:
                j += 1
            at = max(range(i, j + 1), key=lambda k: curve[k][1])
            fires += not any(abs(curve[at][0] - e) < 700 for e in ends)
            i = j
        i += 1
    assert acc.false_fires == fires


@pytest.mark.parametrize("window", [20, 150, 5000, 60_000])
def test_events_and_tally_match_brute_force(spark, window):
    """The widest window makes one event over several blocks."""
    curve = [(t, s) for t, s in random_curve(window, 900, 90_000)]
    ends = [5000, 5400, 20_000, 61_000, 88_000]
    hot = [(t, s) for t, s in curve if s >= 0.9]
    events = []
    for t, s in hot:
        lo, hi = t - window / 2, t + window / 2
        if events and lo <= events[-1][1]:
            events[-1][1] = hi
            if s > events[-1][3]:
                events[-1][2:] = [t, s]
        else:
            events.append([lo, hi, t, s])
    events = [(max(a, 0.0), b, c, d) for a, b, c, d in events]
    df, tg = ticks_frame(spark, curve), ev.target_bands(targets_frame(spark, ends))
    assert rows_of(ev.fire_events(df, 0.9, window), "start_ms", "end_ms", "peak_ms", "peak") == sorted(events)
    bands = brute_bands(ends)
    met = [any(a <= hi and b >= lo for a, b, *_ in events) for lo, hi in bands]
    stray = [d for a, b, _, d in events if not any(a <= hi and b >= lo for lo, hi in bands)]
    row = ev.tally(df, tg, 0.9, window).first()
    assert (row.detected, row.missed) == (sum(met), len(met) - sum(met))
    assert (row.model_only, row.false_alarms) == (sum(d >= 0.9 for d in stray), sum(d < 0.9 for d in stray))


@pytest.mark.parametrize("seed", range(3))
def test_band_join_and_anti(spark, seed):
    rng = random.Random(seed)
    a = [(i, s, s + rng.randrange(0, 900)) for i, s in enumerate(rng.randrange(20_000) for _ in range(150))]
    b = [(i, s, s + rng.randrange(1, 2500)) for i, s in enumerate(rng.randrange(20_000) for _ in range(40))]
    left = spark.createDataFrame([("r", *x) for x in a], "k string, i int, lo bigint, hi bigint")
    right = spark.createDataFrame([("r", *x) for x in b], "k string, j int, rlo bigint, rhi bigint")
    pairs = jn.band_join(left, right, ["k"], ("lo", "hi"), ("rlo", "rhi"), 300)
    assert rows_of(pairs, "i", "j") == sorted((i, j) for i, lo, hi in a for j, rl, rh in b if lo <= rh and rl <= hi)
    free = jn.overlap_anti(left, right, ["k"], ["i"], ("lo", "hi"), ("rlo", "rhi"), 300)
    assert [r[0] for r in rows_of(free, "i")] == [i for i, lo, hi in a if not any(lo < rh and hi > rl for _, rl, rh in b)]


def test_no_shuffle_by_recording_alone(spark):
    """Curve operators must not gather a whole recording in one task."""
    df, tg = ticks_frame(spark, random_curve(1)), ev.target_bands(targets_frame(spark, [1000]))
    plan = ev.false_positive_runs(df, tg, 0.5)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "hashpartitioning(" in line:
            keys = line.split("hashpartitioning(")[1].split(")")[0]
            assert "_blk" in keys or "_part" in keys or "_group" in keys or "lo#" in keys, line
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_late_ticks_of_a_settled_curve_open_nothing(spark, tmp_path):
    """A curve closes, is silent for a batch, and then gets a tick behind its end."""
    from speechmill.streaming import live

    schema = "recording_id string, model string, t_ms bigint, seq bigint, score double"
    for n, ticks in enumerate([[("a", 0, 12.0), ("a", 100, 0.0)], [("b", 0, 1.0)], [("a", 50, 12.0), ("a", 60, 0.0), ("b", 10, 12.0)]]):
        rows = [(r, "m", t, n * 100 + i, s) for i, (r, t, s) in enumerate(ticks)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    got = live.hysteresis(stream, 10, 5, 1000)
    assert rows_of(got, "recording_id", "start", "end", "is_open") == [("a", 0, 100, False), ("b", 10, 10, True)]


def test_hashed_index_numbers_all_rows(spark):
    from speechmill.operators.ranking import hashed_index

    got = hashed_index(spark.range(500), "id", 4).collect()
    assert sorted(r["rn"] for r in got) == list(range(500)) and {r["n"] for r in got} == {500}


def test_unknown_phones_differ(spark):
    from pyspark.sql import functions as F

    from speechmill.operators.lexicon import phone_code

    row = spark.range(1).select(phone_code(F.array(F.lit("AA"), F.lit("Q1"), F.lit("Q2"))).alias("c")).first()
    assert len(row["c"]) == 3 and len(set(row["c"])) == 3
