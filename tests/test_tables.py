"""Rules, pools, table maintenance, sources and sinks, streams."""

import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from speechmill import schemas
from speechmill.functions import rules, text
from speechmill.operators import lexicon as lx
from speechmill.operators import pool as pl
from speechmill.operators import ranking as rk
from speechmill.operators import reports as rp
from speechmill.operators import tables as tb
from speechmill.operators import validate as vd
from speechmill.sources import curves, lists, manifests, sinks


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def clips(spark, counts):
    rows = [(slug, cat, f"{cat[0]}{i}") for slug, cats in counts.items() for cat, n in cats.items() for i in range(n)]
    return spark.createDataFrame(rows, "project_slug string, category string, stem string")


TWO = {"a": {"positive": 3, "negative": 2, "background": 1}, "b": {"positive": 4, "negative": 5, "background": 2, "hard_negative": 3}}


def test_pool_numbers(spark):
    c = clips(spark, TWO)
    row = pl.pool_counts(c, pl.PoolSettings()).filter("target = 'a'").first()
    assert (row.positive, row.negative, row.background, row.borrowed_positive) == (3, 11, 3, 4)
    pool = pl.training_pool(c, ["a"], pl.PoolSettings(positive_boost=4))
    by = {r[0]: r[1] for r in pool.groupBy("category").count().collect()}
    assert by == {"positive": 12, "negative": 11, "background": 3}
    assert pool.filter("name = 'a__p0__x0'").count() == 1
    assert pool.filter("source_slug = 'b' AND name LIKE '%hardneg%'").count() == 0
    assert pl.contributors(c, pl.PoolSettings()).filter("target = 'a'").first().others == ["b"]


def test_pool_switches_and_new_project(spark):
    c = clips(spark, TWO)
    off = pl.PoolSettings(borrow_positives=False, borrow_background=False)
    row = pl.pool_counts(c, off).filter("target = 'a'").first()
    assert (row.borrowed_positive, row.borrowed_background, row.borrowed_negative, row.background) == (0, 0, 5, 1)
    fresh = spark.createDataFrame([("new",)], "slug string")
    row = pl.pool_counts(c, pl.PoolSettings(), projects=fresh).filter("target = 'new'").first()
    assert (row.positive, row.negative, row.background) == (0, 14, 3)
    assert pl.training_pool(c, ["new"], pl.PoolSettings()).filter("category = 'positive'").count() == 0
    assert pl.training_pool(c.limit(0), ["new"], pl.PoolSettings()).count() == 0


def test_corrections_example(spark):
    from speechmill.operators.evaluate import corrections

    rows = [("miss", "positive", .2), ("fire", "negative", .9), ("noise", "background", .8), ("good_pos", "positive", .95), ("good_neg", "negative", .1)]
    df = spark.createDataFrame([(*r, None, 0.5) for r in rows], "id string, label string, score double, mistake string, threshold double")
    assert rows_of(corrections(df, None), "id", "mistake_label", "category") == [
        ("fire", "false_positive", "negative"), ("miss", "false_negative", "positive"), ("noise", "false_positive", "negative")]
    with pytest.raises(Exception, match="no threshold"):
        corrections(df.drop("threshold"), None).collect()
    with pytest.raises(Exception, match="unknown label"):
        corrections(df.withColumn("label", F.lit("odd")), None).collect()


def test_report_counts_skip_deleted(spark):
    s = spark.createDataFrame([("p", "r1", "positive", "positive", "active"), ("p", "r1", "negative", "hard_negative", "active"),
                               ("p", "r2", "negative", "negative", "deleted")],
                              "project_slug string, recording_id string, category string, label string, status string")
    t = spark.createDataFrame([("r1", "Pixel", "", "s1"), ("r2", "Pixel", "usb", "s1")], "recording_id string, device string, route string, session_id string")
    assert rows_of(rp.category_counts(s), "category", "n") == [("negative", 1), ("positive", 1)]
    assert ("input route", "(unknown)", 2) in rows_of(rp.provenance_counts(s, t), "dimension", "key", "n")
    bare = rp.provenance_counts(s, t.drop("session_id"))
    assert ("session", "(unknown)", 2) in rows_of(bare, "dimension", "key", "n")
    p = spark.createDataFrame([("p", "all set")], "slug string, phrase string")
    report = sinks.nested_report(p, rp.category_counts(s), rp.category_counts(s, "label"), rp.provenance_counts(s, t)).first()
    assert report.categories == {"negative": 1, "positive": 1} and report.provenance["device"] == {"Pixel": 2}


def test_progress_and_percent(spark):
    assert one(spark, rp.overall_percent(F.lit(4), F.lit(50), F.lit(False))) == (58,)
    assert one(spark, rp.overall_percent(F.lit(0), F.lit(0), F.lit(True))) == (100,)
    log = "boot\nStep 1/6 go\nSynthesizing clips: 40%|##|\rAugmenting positive r0:  12%|#|\nStep 1/6 again 99%\rAugmenting positive r0: 150%|##########|"
    lines = spark.createDataFrame([("run", i, x) for i, x in enumerate(log.replace("\r", "\n").split("\n"))], "run string, pos int, line string")
    assert rows_of(rk.progress(lines, "run", "pos", "line"), "step", "percent", "label") == [(2, 100, "Augmenting positive r0")]


def test_ranking_helpers(spark):
    df = spark.createDataFrame([("g", i * 3) for i in range(100)], "k string, o bigint")
    idx = rk.ordered_index(df, ["k"], "o", 7)
    assert rows_of(idx, "o", "rn", "n") == [(i * 3, i, 100) for i in range(100)]
    assert [r[0] for r in rows_of(rk.even_sample(df, ["k"], "o", 4), "o")] == [0, 75, 150, 225]
    assert sorted(r[0] for r in rows_of(rk.hashed_index(df, "o", 8), "rn")) == list(range(100))
    refs = spark.createDataFrame([("p", i, 1.0 + i) for i in range(4)], "k string, o bigint, secs double")
    assert rows_of(rk.take_until(refs, "k", "o", "secs", 3, 5.0), "slot", "o") == [(0, 3), (1, 0)]
    assert rows_of(rk.rotating_references(refs, "k", "o", 2, 3), "set_idx", "slot", "o") == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 0), (1, 2, 1)]
    a = refs.select("k", F.col("o").alias("id"), F.col("o").alias("slot"))
    mixed = rk.interleave(a, a.filter("slot < 2").withColumn("id", F.col("id") + 10), "k")
    assert [i for _, i in rows_of(mixed, "position", "id")] == [0, 10, 1, 11, 2, 3]


def test_ms_per_step(spark):
    runs = spark.createDataFrame([("m", 10.0, 1, "succeeded"), ("m", 20.0, 1, "succeeded"), ("s", 60.0, 1, "succeeded"), ("s", 1.0, 1, "failed")],
                                 "model_size string, duration_ms double, steps bigint, state string")
    assert {r.model_size: r.avg_ms for r in rp.ms_per_step(runs).collect()} == {"m": 15.0, "s": 60.0, None: 30.0}


def test_table_functions_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x", None), ("b", 1, "y", "k")], "id string, v int, name string, note string")
    new = spark.createDataFrame([("b", 2, "z", None), ("c", 3, "w", "n")], "id string, v int, name string, note string")
    once = tb.upsert(old, new, ["id"], keep=["note"], frozen=["v"])
    assert rows_of(once, "id", "v", "name") == [("a", 1, "x"), ("b", 1, "z"), ("c", 3, "w")]
    assert once.filter("id = 'b'").first().note == "k"
    twice = tb.upsert(once, new, ["id"], keep=["note"], frozen=["v"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert rows_of(tb.insert_ignore(old, new, ["id"]), "id", "name") == [("a", "x"), ("b", "y"), ("c", "w")]
    assert rows_of(tb.replace_groups(old, new, ["id"]), "id", "name") == [("a", "x"), ("b", "z"), ("c", "w")]
    wide = tb.with_missing_columns(old.drop("note"), old.schema)
    assert wide.schema == old.schema


def test_upload_delta_rules(spark):
    local = spark.createDataFrame([("new", "a"), ("same", "AB"), ("other", "c"), ("legacy", "d"), ("unread", None)], "recording_id string, sha string")
    server = spark.createDataFrame([("same", "ab"), ("other", "x"), ("legacy", None), ("unread", "q")], "recording_id string, sha string")
    assert rows_of(tb.upload_delta(local, server), "recording_id", "reason") == [("new", "new"), ("other", "changed"), ("unread", "changed")]


def test_text_functions(spark):
    assert one(spark, text.norm_edge(F.lit("“Don't!")), text.norm_alnum(F.lit(" Été-2 ")), text.norm_letters(F.lit("Été-2"))) == ("don't", "été2", "été")
    assert one(spark, text.safe_filename(F.lit("  Hey, Tester!  ")), text.safe_filename(F.lit("??"))) == ("hey-tester", "clip")
    assert one(spark, text.sentence_case(F.lit(" hi  there ")), text.compact_case(F.lit("really?"))) == ("Hi there.", "Really?")
    phrase = F.lit(["all", "set"])
    tails = {"we are all set": True, "all set now then": True, "all set now then go": False, "set": False}
    for said, want in tails.items():
        assert one(spark, text.tail_has_phrase(text.normalized_words(F.lit(said)), phrase)) == (want,)
    assert one(spark, rules.path_escapes(F.lit("/x")), rules.path_escapes(F.lit("a/../b")), rules.path_escapes(F.lit("a..b/c"))) == (True, True, False)
    assert one(spark, text.last_percent(F.lit("5%| 250% x")), text.last_percent(F.lit("none"))) == (100, None)


def test_lexicon_rules(spark):
    assert one(spark, lx.sound_alikes(F.lit("beep")))[0] == ["peep", "deep", "bleep", "boop"]
    got = one(spark, lx.candidates(F.lit(["beep", "beep"]), F.lit(None).cast("array<string>")))[0]
    assert "beep peep" in got and "peep peep" in got and "beep beep" not in got and "beep beep beep" not in got
    a, b = F.lit(["HH", "EY1"]), F.lit(["HH", "AY", "D"])
    strip = lambda c: F.transform(c, lambda p: F.regexp_replace(p, "[0-9]", ""))
    assert one(spark, F.levenshtein(lx.phone_code(strip(a)), lx.phone_code(strip(b)))) == (2,)


def bundle():
    take = {"id": "bulk_1", "file": "a.wav", "script": "line", "kind": "", "capture": {"device_model": " ", "source_channels": 0}}
    return {"schema_version": 1, "wake_word": {"slug": "all_set", "phrase": "all set"}, "clips": [{"id": "c", "file": "c.wav", "label": "positive"}],
            "bulk_recordings": [take], "background_recordings": [{"id": "background_1", "file": "b.wav"}], "test_recordings": [{"id": "test_1", "file": "t.wav"}]}


def test_manifest_scan_and_rejects(spark, tmp_path):
    bad = bundle()
    bad["schema_version"], bad["test_recordings"][0]["id"], bad["clips"][0]["label"] = 2, "x", "odd"
    bad["bulk_recordings"][0]["script"] = " "
    for name, doc in (("good", bundle()), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    m = manifests.read_manifests(spark, str(tmp_path))
    good, rejected = vd.split_rejects(m, vd.manifest_rejects())
    assert good.count() == 1
    assert rejected.first().reasons == ["unsupported schema_version", "clips: unknown label", "bulk_recordings: missing script",
                                        "test_recordings: id must start with test_"]
    takes = manifests.flatten_takes(good)
    assert rows_of(takes, "section", "id") == [("background", "background_1"), ("bulk", "bulk_1"), ("test", "test_1")]
    row = takes.filter("section = 'bulk'").select(rules.capture_text(F.col("capture"), "device_model"), rules.capture_number(F.col("capture"), "source_channels")).first()
    assert tuple(row) == (None, None)


def test_lists_and_curves(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# head\nThe\n\n of \n#x\nand\n")
    assert rows_of(lists.read_ranked_words(spark, str(tmp_path / "w.txt")), "rank", "word") == [(0, "the"), (1, "of"), (2, "and")]
    (tmp_path / "p.tsv").write_text("# c\nhey\tHH EY1\nbroken line\n")
    assert lists.read_phones(spark, str(tmp_path / "p.tsv")).first().phones == ["HH", "EY"]
    stored = spark.createDataFrame([("a", "[1.0, 2.0]", "[0.5, 0.6]"), ("b", "[1.0", "[0.1]")], "id string, times_ms string, scores string")
    ticks = curves.curves_to_ticks(stored, ["id"])
    assert rows_of(ticks, "id", "t_ms", "score") == [("a", 1.0, 0.5), ("a", 2.0, 0.6)]
    assert curves.ticks_to_curves(ticks, ["id"]).first().scores == [0.5, 0.6]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "pool")
    c = clips(spark, TWO)
    for _ in range(2):
        sinks.rebuild_pool(pl.training_pool(c, ["a", "b"], pl.PoolSettings()), path)
    before = spark.read.parquet(path).filter("target = 'b'").count()
    sinks.rebuild_pool(pl.training_pool(c.filter("category = 'positive'"), ["a"], pl.PoolSettings()), path)
    after = spark.read.parquet(path)
    assert after.filter("target = 'b'").count() == before
    meta = str(tmp_path / "meta")
    recs = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, label string")
    for _ in range(2):
        sinks.append_metadata(recs, meta, ["id"])
    assert spark.read.json(meta).count() == 2
    sinks.write_clips(c, str(tmp_path / "clips"))
    assert spark.read.parquet(str(tmp_path / "clips")).count() == c.count()
    sinks.write_report(recs, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_schemas_parse(spark):
    for ddl in (schemas.MANIFEST, schemas.CORRECTIONS, schemas.TRANSCRIPT, schemas.RECORDINGS, schemas.SLICES):
        assert spark.createDataFrame([], ddl).columns


def test_streams_over_several_batches(spark, tmp_path):
    """State is carried from batch to batch: results equal the batch form."""
    import random

    from speechmill.operators.islands import hysteresis
    from speechmill.streaming import live

    rng = random.Random(5)
    rows = [("r", "m", t, i, rng.random()) for i, t in enumerate(range(0, 6000, 10))]
    schema = "recording_id string, model string, t_ms bigint, seq bigint, score double"
    folder = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(rows[i * 150:(i + 1) * 150], schema).coalesce(1).write.parquet(str(folder / f"p{i}"))
    import os
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(4):
        part = next(f for f in os.listdir(folder / f"p{i}") if f.endswith(".parquet"))
        shutil.copy(folder / f"p{i}" / part, flat / f"t{i}.parquet")
        os.utime(flat / f"t{i}.parquet", (1000 + i, 1000 + i))
    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))

    batch = spark.createDataFrame(rows, schema)
    want = rows_of(hysteresis(batch, ["recording_id", "model"], "t_ms", "seq", "score", 0.9, 0.1, 500), "start", "end")
    assert rows_of(live.hysteresis(stream(), 0.9, 0.1, 500), "start", "end") == want
    counts = live.rolling_counts(stream().withColumn("odd", F.col("seq") % 2), ["odd"])
    assert rows_of(counts, "odd", "n") == [(0, 300), (1, 300)]
    seen = spark.createDataFrame([(i,) for i in range(0, 600, 3)], "seq bigint")
    fresh = live.ingest(stream().select((F.col("seq") % 400).alias("seq")), seen, ["seq"])
    assert [r[0] for r in rows_of(fresh, "seq")] == [i for i in range(400) if i % 3]
    last = live.latest_state(stream(), ["model"], ["t_ms"], ["seq", "score"])
    assert last.first().seq == 599


@pytest.mark.parametrize("failing", ["r-staged", "r-done", None])
def test_swap_goes_on_after_a_failure(spark, tmp_path, monkeypatch, failing):
    """A run that dies before a mark is run again and gives the same rows; other buckets are not written."""
    store = sinks.TakeStore(spark, str(tmp_path / "store"), buckets=8)
    rows = [(f"t{i}", k) for i in range(30) for k in range(3)]
    store.create(spark.createDataFrame(rows, "recording_id string, at int"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").glob("_bucket=*/*.parquet")}
    touched = spark.createDataFrame([("t1",), ("t2",), ("new",)], "recording_id string")
    fresh = spark.createDataFrame([("t1", 100), ("new", 5), ("t9", 7)], "recording_id string, at int")
    mark = sinks.TakeStore._mark

    def dying(self, name):
        if name == failing:
            raise RuntimeError("lost")
        mark(self, name)

    monkeypatch.setattr(sinks.TakeStore, "_mark", dying)
    if failing:
        with pytest.raises(RuntimeError):
            store.swap(touched, fresh, "r")
    monkeypatch.setattr(sinks.TakeStore, "_mark", mark)
    store.swap(touched, fresh, "r")
    want = sorted([r for r in rows if r[0] not in ("t1", "t2")] + [("t1", 100), ("new", 5)])
    assert sorted(map(tuple, store.read().collect())) == want
    store.swap(touched, spark.createDataFrame([("t1", -1)], "recording_id string, at int"), "r")  # already done
    assert sorted(map(tuple, store.read().collect())) == want
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").glob("_bucket=*/*.parquet")}
    hit = {r[0] for r in store._bucketed(touched).select("_bucket").collect()}
    assert all(after.get(p) == t for p, t in before.items() if int(p.parent.name.split("=")[1]) not in hit)


def test_swap_empties_a_bucket(spark, tmp_path):
    store = sinks.TakeStore(spark, str(tmp_path / "store"), buckets=64)
    store.create(spark.createDataFrame([("a", 1), ("b", 2)], "recording_id string, at int"))
    store.swap(spark.createDataFrame([("a",)], "recording_id string"), store.read().limit(0), "gone")
    assert list(map(tuple, store.read().collect())) == [("b", 2)]


def test_deletion_neighbourhoods_meet_within_the_distance(spark):
    import random

    import numpy as np

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(1)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randrange(1, 8))) for _ in range(120)})
    lex = spark.createDataFrame([(w, k + 1, w) for k, w in enumerate(words)], "near string, near_rank bigint, _nc string")
    targets = spark.createDataFrame([(w, w) for w in words[::7]], "word string, _tc string")
    for far in (1, 2, 3):
        want = sorted((a, b, distance(a, b)) for a in words[::7] for b in words if 1 <= distance(a, b) <= far and abs(len(a) - len(b)) <= lx.LENGTH_SLACK)
        assert rows_of(lx.pairs_within(targets, lex, far), "word", "near", "distance") == want
    codes = np.array([[1, 2, 3]], dtype=np.uint64)
    assert lx.deletion_hashes(codes, 1).shape == (1, 4) and lx.deletion_hashes(codes, 9).shape == (1, 8)
