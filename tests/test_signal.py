"""Sample operators, audio files and window scoring."""

import math
import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from speechmill.functions import signal as sg
from speechmill.operators import augment as au
from speechmill.operators import frames as fr
from speechmill.operators import scoring as sc
from speechmill.plans.signal_plans import bursts
from speechmill.sources import audio


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(xs, kind="int"):
    return F.lit(list(xs)).cast(f"array<{kind}>")


def test_envelope_and_levels(spark):
    assert value(spark, sg.rms_envelope(arr([3, 4, 0, 0, 6]), F.lit(2))) == pytest.approx([math.sqrt(12.5), 0, 6])
    assert value(spark, sg.open_close(arr([10.0, 10.0, 10.5], "double"))) is None
    level = value(spark, sg.open_close(arr([0.0, 0.0, 0.0, 100.0], "double")))
    assert 0 < level.close < level.open < 100


def test_hysteresis_and_merge(spark):
    runs = value(spark, sg.hysteresis_runs(arr([0, 12, 6, 0, 11], "double"), F.lit(10.0), F.lit(5.0)))
    assert [tuple(r) for r in runs] == [(1, 3), (4, 5)]
    spans = F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in ((6, 8), (10, 14))])
    assert len(value(spark, sg.merge_and_pad(spans, F.lit(50.0), F.lit(2000.0)))) == 1
    short = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    assert value(spark, sg.merge_and_pad(short, F.lit(50.0), F.lit(2000.0))) == []


def beeps():
    sr, out = 16000, []
    def quiet(s): out.extend([0] * int(s * sr))
    def tone(s): out.extend([8000 if i % 2 == 0 else -8000 for i in range(int(s * sr))])
    for part in ((quiet, .3), (tone, .1), (quiet, .1), (tone, .1), (quiet, 1.0), (tone, .1), (quiet, .1), (tone, .1), (quiet, .3)):
        part[0](part[1])
    return out


def test_bursts(spark):
    clips = spark.createDataFrame([("beep", beeps()), ("flat", [0] * 3200), ("hiss", [25] * 3200)], "take_id string, samples array<int>")
    got = rows_of(bursts(clips, F.lit(16000)), "take_id", "start_ms", "end_ms")
    assert [g[0] for g in got] == ["beep", "beep"]
    assert 150 < got[0][1] < 310 and got[0][2] - got[0][1] > 250 and got[1][1] > 1400
    from speechmill.udtf import register

    register(spark)
    sql = spark.sql("SELECT take_id, start_ms, end_ms FROM {c}, LATERAL energy_bursts(samples, 16000)", c=clips)
    assert rows_of(sql, "take_id", "start_ms", "end_ms") == got


def test_array_shapes_against_numpy(spark):
    x = np.linspace(-0.5, 0.8, 50)
    a = arr(x.tolist(), "double")
    n, fade = len(x), 8
    ramp = 0.5 * (1 - np.cos(np.linspace(0, np.pi, fade)))
    want = x.copy()
    want[:fade] *= ramp
    want[-fade:] *= ramp[::-1]
    assert value(spark, sg.fade_edges(a, fade)) == pytest.approx(want.tolist())
    assert value(spark, sg.fade_edges(a, 30)) == pytest.approx(x.tolist())
    assert value(spark, sg.scale_to_peak(a, 0.7)) == pytest.approx((x * 0.7 / 0.8).tolist())
    tail = np.zeros(80)
    tail[20:70] = x
    assert value(spark, sg.align_to_end(a, 80, F.lit(10))) == pytest.approx(tail.tolist())
    assert value(spark, sg.align_to_end(a, 30, F.lit(5))) == pytest.approx(np.concatenate([x[-25:], np.zeros(5)]).tolist())
    assert value(spark, sg.center_fit(a, 21)) == pytest.approx(x[14:35].tolist())
    assert len(value(spark, sg.center_fit(a, 77))) == 77
    assert value(spark, sg.loop_to(a, F.lit(120), F.lit(0))) == pytest.approx(np.tile(x, 3)[:120].tolist())
    assert value(spark, sg.scan_ends(F.lit(n), 20)) == [20, 40, 50]
    assert value(spark, sg.reset_window(a, F.lit(40), 10, 16)) == pytest.approx([0] * 6 + x[30:40].tolist())
    assert value(spark, sg.cut(a, F.lit(1000), F.lit(3.2), F.lit(5.1))) == pytest.approx(x[3:6].tolist())
    assert value(spark, sg.cut(a, F.lit(1000), F.lit(5.0), F.lit(5.0))) is None


def test_composite_windows(spark):
    cfg = au.CompositeSettings(rate=100, fade_ms=50, lead_probability=1.0, seed=3)
    clips = spark.createDataFrame([(f"c{i}", [0.1 * (i + 1)] * (40 + 60 * i)) for i in range(5)], "clip_id string, samples array<double>")
    beds = spark.createDataFrame([("b", [0.01, -0.01] * 30)], "bed_id string, bed array<double>")
    fillers = spark.createDataFrame([("f", [0.2] * 30)], "filler_id string, filler array<double>")
    none = fillers.limit(0)
    out = au.compose(clips, beds, none, fillers, cfg).collect()
    assert len(out) == 5 and all(len(r.window) == 200 and max(map(abs, r.window)) <= 0.99 + 1e-9 for r in out)
    assert all(r.has_filler for r in out)  # the other source stands in
    again = {r.clip_id: r.window for r in au.compose(clips.repartition(3), beds, none, fillers, cfg).collect()}
    assert all(again[r.clip_id] == r.window for r in out)


def test_rounds_are_repeatable(spark, tmp_path):
    cfg = au.CompositeSettings(rate=100, fade_ms=50)
    clips = spark.createDataFrame([(f"clip_{i}", s, [0.1] * 50) for i, s in enumerate(["positive_train", "negative_train"] * 3)],
                                  "clip_id string, split string, samples array<double>")
    beds = spark.createDataFrame([("b", [0.01, -0.01] * 150)], "bed_id string, bed array<double>")
    fillers = spark.createDataFrame([("f", [0.2] * 30)], "filler_id string, filler array<double>")
    path = str(tmp_path / "aug")
    for _ in range(2):
        au.run_rounds(clips, beds, fillers, fillers, 2, path, cfg)
        got = spark.read.parquet(path)
        assert got.count() == 12 and {r[0] for r in got.select("round").distinct().collect()} == {0, 1}
    assert {r.clip_id for r in got.filter("round = 1").collect()} == {f"clip_{i}_r1" for i in range(6)}


def test_strided_windows_and_scores(spark):
    n = 4200  # over two blocks
    bank = spark.createDataFrame([("t", i, [float(i), 1.0]) for i in range(n)], "take string, pos bigint, v array<double>")
    w = sc.strided_windows(bank, "take", "pos", "v", 10)
    got = {r.pos: [x[0] for x in r.window] for r in w.collect()}
    assert sorted(got) == list(range(120, n, 10))
    assert all(v == [p - 8.0 * k for k in range(15, -1, -1)] for p, v in got.items())
    weights = np.zeros((16, 2))
    weights[15, 0] = 1e-3

    def broken():
        return lambda tensor: 1 / 0

    out = sc.score_windows(w, ["take", "pos"], {"ok": sc.linear_head(weights), "lost": sc.failing_head("no file"), "bad": broken}).collect()
    assert {r.error for r in out if r.model != "ok"} == {"no file", "division by zero"}
    assert all(abs(r.score - 1 / (1 + math.exp(-r.pos / 1000))) < 1e-12 for r in out if r.model == "ok")


def test_wav_scan(spark, tmp_path):
    import hashlib

    ramp = np.array([i % 100 for i in range(1600)], dtype=np.int16)
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(ramp, 16000))
    (tmp_path / "broken.wav").write_bytes(b"RIFF0000")
    (tmp_path / "note.txt").write_text("x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.read_wavs(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.wav", "broken.wav"}
    good = rows["a.wav"]
    assert (good.channels, good.bits, good.rate, good.samples, good.error) == (1, 16, 16000, ramp.tolist(), None)
    assert good.sha256 == hashlib.sha256((tmp_path / "a.wav").read_bytes()).hexdigest()
    assert rows["broken.wav"].samples is None and rows["broken.wav"].error


@pytest.mark.parametrize("seed,chunk,block", [(1, 64, 4096), (2, 7, 16), (3, 500, 3)])
def test_bursts_of_chunked_takes_equal_those_of_whole_rows(spark, seed, chunk, block):
    rng = random.Random(seed)
    rows, chunks = [], []
    for k in range(6):
        x = []
        for _ in range(rng.randrange(3, 40)):
            level = rng.choice([0, 5, 200, 4000, 20000])
            x += [rng.randrange(-level, level + 1) for _ in range(rng.randrange(1, 120))]
        x = [3] * 400 if k == 5 else x
        rows.append((f"t{k}", x))
        chunks += [(f"t{k}", a, x[a: a + chunk]) for a in range(0, len(x), chunk)]
    chunks.append(("t0", 10 ** 6, []))
    whole = bursts(spark.createDataFrame(rows, "take_id string, samples array<int>"), F.lit(100))
    df = spark.createDataFrame(chunks, "take_id string, offset bigint, samples array<int>")
    got = fr.energy_bursts(df, ["take_id"], "offset", "samples", 100, block)
    want = rows_of(whole, "take_id", "start_ms", "end_ms")
    assert rows_of(got, "take_id", "start_ms", "end_ms") == want and len({r[0] for r in want}) >= 4


def test_order_statistic_of_a_long_series(spark):
    """Half of the values are equal, and most of the rest lie within one unit."""
    df = spark.range(300_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 4 < 2, 7.25).otherwise(
        7 + (F.col("id") * 7919 % 100_003) / 100_003.0).alias("v"))
    values = {}
    for k, v in df.collect():
        values.setdefault(k, []).append(v)
    for share in (0.0, 0.1, 0.5, 0.9):
        rank = df.groupBy("k").agg(F.floor(F.count(F.lit(1)) * share).cast("bigint").alias("_k"))
        got = rows_of(fr.kth_smallest(df, ["k"], "v", rank), "k", "kth")
        assert got == sorted((k, sorted(v)[int(len(v) * share)]) for k, v in values.items())
