"""Conversation repair against a search over edits from the end of each conversation."""

import functools
import hashlib
import random
import zlib

import pytest

from llm_samples import none, odd, odd_rows  # noqa: F401
from speechmill.llm import repair

BLANKS = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """Conversations of (turn, role, text) after damage."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        elif k == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        elif k == 4:
            role = "user"
        mine.extend([(turn, role, text)] * {0: 0, 3: 2}.get(k, 1))
    return out


def cheapest(rows):
    """(cost, audit) by trying all edits; states: nothing, s, u, a."""
    @functools.cache
    def rest(i, state, free):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if free:
            ways.append((3, "I", rest(i, "a" if state == "u" else "u", free - 1)))
        if i < len(rows):
            initial, gone, cut = rows[i]
            ways.append((4, "D", rest(i + 1, state, 2)))
            if not gone:
                extra = 3 if cut else 0
                to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))
                if to:
                    ways.append((extra, "K", rest(i + 1, to, 2)))
                ways.append((3 + extra, "R", rest(i + 1, "a" if state == "u" else "u", 2)))
        ways = [w if len(w) == 2 else (w[0] + w[2][0], w[1] + w[2][1]) for w in ways if len(w) == 2 or w[2]]
        return min(ways) if ways else None

    for i in range(len(rows), -1, -1):  # fill the cache from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            rest(i, state, 2)
    return rest(0, "", 2)


def brute(rows, damaged=True):
    out = []
    given = damage(rows) if damaged else rows
    for conv, mine in given.items():
        mine = sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, read, counts = set(), [], [0, 0, 0]
        for _, role, text in mine:
            end = text.rstrip(BLANKS)
            kind = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                counts[kind] += 1
            read.append((role[:1], kind in (0, 1), kind == 2))
        cost, audit = cheapest(tuple(read))
        lines, state, it = [], "", iter(mine)
        for e in audit:
            if e == "I":
                state = "a" if state == "u" else "u"
                lines.append({"u": "user:", "a": "assistant:"}[state])
                continue
            _, role, text = next(it)
            if e == "K":
                state = role[:1]
                lines.append(f"{role}:{text}")
            elif e == "R":
                state = "a" if state == "u" else "u"
                lines.append({"u": "user:", "a": "assistant:"}[state] + text)
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(read, read[1:]))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def report(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def conversations(seed, n, longest, roles=("user", "assistant", "user", "assistant", "system", "tool", "u", None)):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(roles) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv or None, None if r.random() < 0.05 else turn + r.randrange(2), role,
                         r.choice(["Yes.", "No", "Who?", " ", "", None, f"a{turn}.", f"b {turn}!\n", "c\t", "x?y"])))
    return rows


@pytest.fixture
def many_partitions(spark):
    """Small tables stay dealt over all shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed,n,longest,block", [(1, 60, 9, 8192), (2, 6, 60, 8192), (3, 3, 200, 4), (4, 2, 300, 17)])
def test_against_search(spark, many_partitions, monkeypatch, seed, n, longest, block):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rows = conversations(seed, n, longest)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert report(repair.repair_report(df)) == brute(rows)


def test_one_conversation_over_all_partitions(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 50)
    rows = [(1, t, ("user", "assistant")[t % 2], r, ) for t, r in enumerate(random.Random(5).choices(["Yes.", "And?", "No", "", *[f"t{i}." for i in range(300)]], k=800))]
    rows += conversations(6, 20, 6)
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ordered = repair.in_order(repair.damaged(df))
    assert repair.crossing(ordered) == [1]
    assert report(repair.repair_report(df)) == brute(rows)
    lines = sorted((r["n"], r["line"]) for r in repair.repaired(repair.damaged(df), lines=True).filter("conv_id = 1").collect())
    want = next(r for r in brute(rows) if r[0] == 1)
    assert hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest() == want[-1]
    assert [n for n, _ in lines] == list(range(len(lines)))


def test_all_rows_gone_and_empty_table(spark):
    turns = [t for t in range(400) if zlib.crc32(f"3:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(3, t, "user", "Yes.") for t in turns], SCHEMA)
    assert report(repair.repair_report(df)) == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_report(df.limit(0)).count() == 0


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "y" * 300_000), (None, None, None, None), (2, 5, "", "Yes.")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA + ", seq int, ghost string").selectExpr("*", "1 AS block", "2 AS conv", "3 AS uid", "4 AS k", "5 AS copy")
    assert report(repair.repair_report(df)) == brute(rows)


def test_trails_are_compared_back_to_where_they_part():
    base = ("K", None, 1)
    a, b = ("D", base, 2), ("K", base, 2)
    assert repair.precedes(a, b) and not repair.precedes(b, a) and not repair.precedes(a, a)
    assert repair.precedes(("I", a, 3), b) and repair.audit_of(("I", a, 3)) == "KDI"
