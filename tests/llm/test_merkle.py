"""The dataset manifest against a plain tree over lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm_samples import none, odd, odd_rows  # noqa: F401
from speechmill.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests, arity):
    """Levels of digests, and per leaf the steps (place, others)."""
    levels = [digests]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([sha(*d[a: a + arity]) for a in range(0, len(d), arity)])
    steps = []
    for i in range(len(digests)):
        mine = []
        for d in levels[:-1]:
            a = i // arity * arity
            mine.append((i - a, [x for k, x in enumerate(d[a: a + arity]) if a + k != i]))
            i //= arity
        steps.append(mine)
    return levels[-1][0], steps


def brute(rows, arity=2):
    """Rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i, leaf((i, source, lang, n, text)), leaf((i, source, lang, None if n is None else n + 1, text))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([r[1] for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))], arity) for g in order]
    root, tops = tree([t[0] for t in trees], arity) if trees else (None, [])
    out = []
    for g, (subroot, steps), top in zip(order, trees, tops):
        for (i, own, other), mine in zip(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1])), steps):
            path = mine + top
            now = other if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else own
            for place, others in path:
                now = sha(*others[:place], now, *others[place:])
            out.append((i, own, subroot, root, sha(*[x for _, others in path for x in others]), now, now == root))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def report(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=key)


def test_odd_rows_and_empty_table(odd, odd_rows, none):
    got = report(merkle.manifest_report(odd))
    assert got == sorted(brute([r[:5] for r in odd_rows]), key=key)
    assert any(not r[-1] for r in got) or not any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None for r in odd_rows)
    df = merkle.manifest_report(none)
    assert df.columns == COLUMNS and df.count() == 0


@pytest.mark.parametrize("sizes", [(1,), (1, 1, 1), (2, 1), (5, 1, 300), (257, 256, 3, 1, 1)])
def test_tree_shapes(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "STRIDE_NODES", 16)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 40)
    rows = [(1000 * k + 3 * i, f"text {i % 5}", None if k == 0 else f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(7)
    assert report(merkle.manifest_report(docs)) == sorted(brute(rows), key=key)


def test_repeated_rows_keep_their_own_places(spark):
    rows = [(7, "x", "en", "s", 1)] * 40 + [(7, "y", "en", "s", 1), (None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    got = report(merkle.manifest_report(docs))
    assert got == sorted(brute(rows), key=key) and len(got) == 46


def test_other_arity_and_fold(spark):
    rows = [(i, f"t{i}", f"l{i % 4}", "s", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    manifest = merkle.build_manifest(docs, arity=3)
    want = {r[0]: r for r in brute(rows, 3)}
    got = manifest.proofs.collect()
    assert len(got) == 100 and manifest.root.hex() == want[0][3]
    for r in got:
        assert merkle.fold(bytes(r["leaf"]), bytes(r["path"])) == manifest.root
        assert merkle.siblings_hash(bytes(r["path"])) == want[r["id"]][4]


def test_any_change_of_a_row_is_seen(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    claimed = F.unhex(merkle.leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.concat("text", F.lit(" "))]))
    manifest = merkle.build_manifest(docs, more=F.when(F.col("doc_id") == 11, claimed))
    rows = merkle.verified(manifest.proofs.join(manifest.subroots, "tree"), manifest.root).collect()
    assert {r["id"] for r in rows if not r["verified"]} == {11}
