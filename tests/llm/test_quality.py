"""The quality classifier: its learner against the plain formulas, and held-out accuracy."""

import math
import zlib

import numpy as np

from llm_samples import none, odd, odd_rows, prose  # noqa: F401
from speechmill.llm import quality

SF = "/root/testdata/sf0.01"


def test_learner_against_plain_formulas():
    r = np.random.default_rng(1)
    rows = [(np.sort(r.choice(50, 5, replace=False)), r.random(5)) for _ in range(40)]
    labels = np.array([float(s[0] < 5) for s, _ in rows])
    got = quality.fit_ftrl(rows, labels, alpha=0.5, beta=1.0, l1=0.1, l2=0.3, epochs=2, seed=4)
    z, n = {}, {}

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        return 0.0 if abs(zk) <= 0.1 else -(zk - math.copysign(0.1, zk)) / ((1.0 + math.sqrt(nk)) / 0.5 + 0.3)

    order = np.random.default_rng(4)
    for _ in range(2):
        for i in order.permutation(40):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), (quality.SLOTS, 1.0)]
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x)))
            steps = [(k, (p - labels[i]) * v, weight(k)) for k, v in x]
            for k, g, w in steps:
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / 0.5 * w
                n[k] = before + g * g
    assert all(abs(got[k] - weight(k)) < 1e-9 for k in z) and (got != 0).sum() == sum(weight(k) != 0 for k in z)


def test_features_of_words_and_pairs():
    slots, values = quality.Features()(b"One two one\ttwo")
    assert len(slots) == 4 and abs((values ** 2).sum() - 1) < 1e-9  # one, two, one two (twice), two one
    assert len(quality.Features()(b"")[0]) == 0 and len(quality.Features()(b"word")[0]) == 1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.quality_report(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in truth if i in got and got[i]["held_out"]]
    good, poor = ([got[i]["score"] for i in held if truth[i] == y] for y in (1, 0))
    above = np.mean([(g > p) + 0.5 * (g == p) for g in good for p in poor])
    assert above > 0.95 and np.mean([g >= 0.3 for g in good]) > 0.97


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(quality.fit_quality(docs, labels), quality.fit_quality(docs, flipped))


def test_sample_is_bounded_at_any_size(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    rows = quality.labelled_sample(docs.union(docs), labels.union(labels), ~quality.held_out(), 50).collect()
    assert len(rows) == 50 == len({r["id"] for r in rows})


def test_odd_rows_and_missing_labels(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (7, None), (None, 0), (99, 1), (9, 0), (9, 1)], "doc_id long, quality int")
    got = quality.quality_report(odd, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(odd_rows)
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got.collect())
    assert quality.quality_report(none, labels).count() == 0
    bare = quality.quality_report(odd, labels.limit(0)).collect()
    assert {r["score"] for r in bare} == {0.5}
    assert quality.without_poor(odd, labels.limit(0)).count() == len(odd_rows)
    kept = quality.without_poor(odd.withColumnRenamed("part", "_quality_score"), labels)
    assert "_quality_score" in kept.columns and kept.count() <= len(odd_rows)
    one = quality.quality_report(odd, labels.filter("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)
