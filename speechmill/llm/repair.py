"""Operator 11, conversation structure repair: generalised LR over the role grammar.

The grammar is S -> T | s T | empty, T -> u a | T u a over role initials. A
conversation is read turn by turn on a graph-structured stack: a row may be kept,
given another role or deleted, and empty user or assistant turns may be inserted
anywhere, each at a cost. Stacks with equal tops are merged to the one of least
(cost, audit): what may follow depends on the top alone. A trail of edits is a
linked list, so stacks share their common past and ties are compared only back
to where two trails part.

Rows are range-partitioned by (conversation, turn). A conversation inside one
partition is repaired where it lies. Those that cross a partition edge, at most
one per edge, may be of any length and are solved in blocks: repeated texts are
found by a grouping of (conversation, text, partition); every block is read for
each top it can be entered with; the blocks' results are chained per
conversation; and the rows are read once more with the edits chosen. Only the
digest of a conversation is one pass in one task, row by row, since sha256 is
sequential.

Defined results: null role and text count as one space; null turns come first
and rows of one turn go by role and text (its first 100 characters, then a
hash), so repeated rows are duplicates; null conversation ids are one
conversation; roles of another initial must be changed or deleted; empty and
very long texts are as any; an empty table gives no rows. Only the four columns
are read, others of any name are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BLANKS, settled

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
BLOCK_ROWS = 8192

# The automaton of the grammar: states are 0 nothing, 1 s, 2 u, 3 T, 4 s T, 5 u a, 6 T u, 7 T u a.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
POPS = {5: 2, 7: 3}
GOTO = {0: 3, 1: 4}
ACCEPT = (0, 3, 4)
#: A stack for every top with which a block can be entered.
STACKS = {0: (0,), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 1, 4), 6: (0, 3, 6)}


class Top(NamedTuple):
    """A node of the graph-structured stack with the cheapest way to it."""

    state: int
    below: Top | None
    cost: int
    trail: tuple | None  # (edit, trail before, length)


def audit_of(trail: tuple | None, until: tuple | None = None) -> str:
    edits = []
    while trail is not until:
        edits.append(trail[0])
        trail = trail[1]
    return "".join(reversed(edits))


def precedes(a: tuple | None, b: tuple | None) -> bool:
    """Whether the audit of a trail comes before that of another."""
    left, right = [], []
    while a is not b:
        la, lb = a[2] if a else 0, b[2] if b else 0
        if la >= lb:
            left.append(a[0])
            a = a[1]
        if lb >= la:
            right.append(b[0])
            b = b[1]
    return left[::-1] < right[::-1]


def offer(front: dict[int, Top], top: Top | None) -> bool:
    """Merge a stack into the front; whether it is the best of its top now."""
    if top is None:
        return False
    old = front.get(top.state)
    if old is None or top.cost < old.cost or (top.cost == old.cost and precedes(top.trail, old.trail)):
        front[top.state] = top
        return True
    return False


def edited(top: Top, cost: int, edit: str) -> Top:
    trail = top.trail
    return Top(top.state, top.below, top.cost + cost, (edit, trail, trail[2] + 1 if trail else 1))


def shift(top: Top, symbol: str, cost: int, edit: str) -> Top | None:
    """The stack after the symbol and all reductions that follow it."""
    state = SHIFT.get((top.state, symbol))
    if state is None:
        return None
    trail = top.trail
    node = Top(state, top, top.cost + cost, (edit, trail, trail[2] + 1 if trail else 1))
    while node.state in POPS:
        base = node
        for _ in range(POPS[node.state]):
            base = base.below
        node = Top(GOTO[base.state], base, node.cost, node.trail)
    return node


def inserted(front: dict[int, Top]) -> None:
    """Add what inserted turns lead to."""
    work = list(front.values())
    while work:
        top = work.pop()
        if front[top.state] is top:
            for symbol in ROLES:
                new = shift(top, symbol, INSERT, "I")
                if offer(front, new):
                    work.append(new)


def read_rows(front: dict[int, Top], rows: Iterable[tuple[str, bool, bool]]) -> dict[int, Top]:
    """The front after rows (role initial, must go, truncated), insertions at both ends included."""
    inserted(front)
    for initial, gone, truncated in rows:
        after: dict[int, Top] = {}
        extra = TRUNCATED if truncated else 0
        for top in front.values():
            offer(after, edited(top, DELETE, "D"))
            if not gone:
                offer(after, shift(top, initial, KEEP + extra, "K"))
                for symbol in ROLES:
                    offer(after, shift(top, symbol, REROLE + extra, "R"))
        front = after
        inserted(front)
    return front


def stack(states: Sequence[int]) -> Top:
    top = None
    for s in states:
        top = Top(s, top, 0, None)
    return top


def best(front: dict[int, Top]) -> Top:
    """The cheapest accepted stack."""
    out: Top | None = None
    for state in ACCEPT:
        top = front.get(state)
        if top and (out is None or top.cost < out.cost or (top.cost == out.cost and precedes(top.trail, out.trail))):
            out = top
    return out


class Writer:
    """Lines of the repaired conversation, in order, with the digest of what was written."""

    def __init__(self):
        self.sha, self.role, self.first = hashlib.sha256(), "u", True

    def line(self, role: str, text: str) -> str:
        out = f"{role}:{text}"
        self.sha.update(out.encode() if self.first else b"\n" + out.encode())
        self.first = False
        return out

    def expected(self) -> str:
        role = ROLES[self.role]
        self.role = "a" if self.role == "u" else "u"
        return role

    def apply(self, rows: Iterable[tuple[str, str]], audit: str) -> Iterator[str]:
        """The lines that rows (role, text) become by the edits."""
        rows = iter(rows)
        for edit in audit:
            if edit == "I":
                yield self.line(self.expected(), "")
                continue
            role, text = next(rows)
            if edit == "R":
                yield self.line(self.expected(), text)
            elif edit == "K":
                if role[:1] != "s":
                    self.expected()
                yield self.line(role, text)


class Facts(NamedTuple):
    """What is counted over consecutive rows; nulls have no part in turns."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


def joined(a: Facts, b: Facts) -> Facts:
    if a.first is None:
        return b
    if b.first is None:
        return a
    return Facts(a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
                 a.illegal + b.illegal + (a.last + b.first not in ("su", "ua", "au")),
                 a.distinct + b.distinct - (a.high is not None and a.high == b.low),
                 b.low if a.low is None else a.low, a.high if b.high is None else b.high, a.first, b.last)


def fact(turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> Facts:
    return Facts(int(blank), int(duplicate and not blank), int(truncated and not blank and not duplicate), 0, int(turn is not None), turn, turn, initial, initial)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LINES = "conv_id long, n long, line string"


def result(conv: int | None, facts: Facts, cost: int, audit: str, sha: str) -> tuple:
    return conv, facts.gaps, facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, sha


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv, turn, role, text, ghost) after damage; a dropped row stays as a ghost that names its conversation."""
    id_text, turn_text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(id_text, F.lit(":"), turn_text).cast("binary")) % 20).alias("k"))
    k = F.col("k")
    text = F.when(k <= 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(k == 0, "").when(k == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (k == 0).alias("ghost"),
                       F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """rows with blank, truncated and seq: sorted over partitions, whose number and place make up seq."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    marked = rows.select("*", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?") & (end != "")).alias("truncated"),
                         F.monotonically_increasing_id().alias("uid"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 100), F.xxhash64("text"), F.col("uid")]
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return settled(placed.select("conv", "turn", "role", "text", "ghost", "blank", "truncated", F.monotonically_increasing_id().alias("seq")))


def partition_of(seq: str = "seq"):
    return F.shiftright(F.col(seq), 33)


def crossing(rows: DataFrame) -> list[int | None]:
    """Conversations that lie in several partitions: at most one per partition edge."""
    ends = rows.groupBy(partition_of().alias("pid")).agg(F.min(F.struct(F.col("seq"), F.col("conv"))).alias("a"), F.max(F.struct(F.col("seq"), F.col("conv"))).alias("b"))
    ends = sorted(ends.collect(), key=lambda r: r["pid"])
    return list(dict.fromkeys(x["b"]["conv"] for x, y in zip(ends, ends[1:]) if x["b"]["conv"] == y["a"]["conv"]))


def _schema(lines: bool) -> tuple[str, pa.Schema]:
    fields = _LINES if lines else _RESULT
    return fields, to_arrow_schema(StructType.fromDDL(fields))


def _batches(rows: Iterable[tuple], arrow: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


def short_repairs(rows: DataFrame, skipped: list[int | None], lines: bool) -> DataFrame:
    """The result or the lines of every conversation that lies in one partition, none of `skipped`."""
    skip, (fields, arrow) = set(skipped), _schema(lines)

    def solve(conv, rows):
        facts, seen, read = Facts(), set(), []
        for _, turn, role, text, ghost, blank, truncated in rows:
            if ghost:
                continue
            duplicate = (role, text) in seen
            seen.add((role, text))
            facts = joined(facts, fact(turn, role[:1], blank, duplicate, truncated))
            read.append((role, text, blank or duplicate, truncated))
        top = best(read_rows({0: stack(STACKS[0])}, [(r[:1], gone, cut) for r, _, gone, cut in read]))
        audit, writer = audit_of(top.trail), Writer()
        written = list(writer.apply([r[:2] for r in read], audit))
        if lines:
            return [(conv, n, x) for n, x in enumerate(written)]
        return [result(conv, facts, top.cost, audit, writer.sha.hexdigest())]

    def run(batches):
        yield from _batches((out for conv, group in groupby(_streamed(batches), key=itemgetter(0)) if conv not in skip
                             for out in solve(conv, group)), arrow)

    return rows.select("conv", "turn", "role", "text", "ghost", "blank", "truncated").mapInArrow(run, fields)


def _packed(value) -> bytes:
    return zlib.compress(json.dumps(value).encode(), 1)


def _streamed(batches, rows: int = 512):
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield from zip(*[c.to_pylist() for c in b.slice(s, rows).columns])


def long_repairs(rows: DataFrame, convs: list[int | None], lines: bool) -> DataFrame:
    """The results or the lines of the given conversations, however long each is."""
    spark = rows.sparkSession
    chosen = spark.createDataFrame([(c,) for c in convs], "chosen long")  # at most one per partition
    mine = rows.join(F.broadcast(chosen), F.col("conv").eqNullSafe(F.col("chosen")), "left_semi")
    text = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    cut = mine.select("*", partition_of().alias("pid"), F.floor(F.col("seq") / BLOCK_ROWS).cast("long").alias("block"), text.alias("key"))
    # a text of a conversation is one row per block here, however often it is repeated
    first = cut.filter(~F.col("ghost")).groupBy("conv", "key", "pid", "block").agg(F.min("seq").alias("here"))
    firsts = first.groupBy("conv", "key").agg(F.min("here").alias("earliest"))
    known = first.join(firsts.withColumnsRenamed({"conv": "c", "key": "k"}), F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).select(
        F.col("conv").alias("c"), F.col("key").alias("k"), F.col("block").alias("b"), "earliest")
    # within a block a text has at most BLOCK_ROWS rows
    flagged = cut.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")), "left")
    flagged = settled(flagged.select("conv", "block", "seq", "turn", "role", "text", "ghost", "blank", "truncated",
                                     F.coalesce(F.col("seq") > F.col("earliest"), F.lit(False)).alias("duplicate")))

    def transfer(batches):
        for (conv, block), group in groupby(_streamed(batches), key=itemgetter(0, 1)):
            facts, read = Facts(), []
            for _, _, _, turn, initial, ghost, blank, truncated, duplicate in group:
                if not ghost:
                    facts = joined(facts, fact(turn, initial, blank, duplicate, truncated))
                    read.append((initial, blank or duplicate, truncated))
            ways = [(entry, state, top.cost, audit_of(top.trail)) for entry, states in STACKS.items()
                    for state, top in read_rows({entry: stack(states)}, read).items()]
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([block], pa.int64()), pa.array([_packed([facts, ways])])],
                                             names=["conv", "block", "ways"])

    blocks = (flagged.select("conv", "block", "seq", "turn", F.left("role", F.lit(1)).alias("initial"), "ghost", "blank", "truncated", "duplicate")
              .repartition("conv", "block").sortWithinPartitions("conv", "block", "seq").mapInArrow(transfer, "conv long, block long, ways binary"))

    def chain(batches):
        for conv, group in groupby(_streamed(batches, 16), key=itemgetter(0)):
            # per top: cost and a trail of (edits of a block, trail before, number of blocks)
            facts, front, numbers = Facts(), {0: (0, None)}, []
            for _, block, ways in group:
                more, ways = json.loads(zlib.decompress(ways))
                facts, after = joined(facts, Facts(*more)), {}
                for entry, state, cost, edits in ways:
                    if entry in front:
                        before, trail = front[entry]
                        new = (before + cost, (edits, trail, len(numbers) + 1))
                        old = after.get(state)
                        if old is None or new[0] < old[0] or (new[0] == old[0] and earlier(new[1], old[1])):
                            after[state] = new
                front = after
                numbers.append(block)
            cost, trail = min((front[s] for s in ACCEPT if s in front), key=_Ranked)
            edits = []
            while trail:
                edits.append(trail[0])
                trail = trail[1]
            edits.reverse()
            head = result(conv, facts, cost, "".join(edits), "")
            yield pa.RecordBatch.from_arrays([pa.array([conv] * (len(edits) + 1), pa.int64()), pa.array([-1, *numbers], pa.int64()),
                                              pa.array([_packed(head), *map(_packed, edits)])], names=["conv", "block", "edits"])

    chained = (blocks.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(chain, "conv long, block long, edits binary"))
    fields, arrow = _schema(lines)

    def written(batches):
        for conv, group in groupby(_streamed(batches), key=itemgetter(0)):
            writer, head, n = Writer(), None, 0
            for block, part in groupby(group, key=itemgetter(1)):
                edits = json.loads(zlib.decompress(next(part)[3]))  # sorted before the block's rows
                if block < 0:
                    head = edits
                    continue
                for line in writer.apply(((r[4], r[5]) for r in part if not r[6]), edits):
                    if lines:
                        yield conv, n, line
                    n += 1
            if not lines:
                yield *head[:-1], writer.sha.hexdigest()

    edits = chained.select("conv", "block", F.lit(-1).cast("long").alias("seq"), "edits", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("ghost"))
    turns = flagged.select("conv", "block", "seq", F.lit(None).cast("binary").alias("edits"), "role", "text", "ghost")
    return (edits.union(turns).repartition("conv").sortWithinPartitions("conv", "block", "seq")
            .mapInArrow(lambda batches: _batches(written(batches), arrow), fields))


def earlier(a: tuple | None, b: tuple | None) -> bool:
    """As `precedes`, for trails of the edits of whole blocks, which are equally long."""
    left, right = [], []
    while a is not b:
        left.append(a[0])
        right.append(b[0])
        a, b = a[1], b[1]
    return "".join(reversed(left)) < "".join(reversed(right))


class _Ranked:
    """Order of (cost, trail) pairs."""

    def __init__(self, pair):
        self.pair = pair

    def __lt__(self, other):
        return self.pair[0] < other.pair[0] or (self.pair[0] == other.pair[0] and earlier(self.pair[1], other.pair[1]))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation after the damage of its contract."""
    return repaired(damaged(conversations))


def repaired(rows: DataFrame, lines: bool = False) -> DataFrame:
    """The same for rows (conv, turn, role, text, ghost) as they are, where ghosts only
    name their conversation; or the lines (conv_id, n, line) of the repaired conversations."""
    ordered = in_order(rows)
    crossed = crossing(ordered)
    out = short_repairs(ordered, crossed, lines)
    return out.union(long_repairs(ordered, crossed, lines)) if crossed else out


def _edit(v: str, cost: str, edit: str, line: str) -> str:
    """SQL of a state's text `v` after one more edit and one more line."""
    return (f"(lpad(CAST(CAST({v}[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || {v}[11:strpos({v}, chr(1)) - 1] || '{edit}'"
            f" || {v}[strpos({v}, chr(1)):] || {line})")


#: A fold over the rows of a conversation: per state (nothing, s, u, a) the cheapest
#: cost (ten digits), audit, and behind chr(1) the repaired lines, as one text.
SQL = rf"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
crc(s, rest, c) AS (
  SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), CAST(4294967295 AS BIGINT) FROM conversations
  UNION ALL SELECT s, rest[2:], xor(t[xor(c % 256, ascii(rest[1])) + 1], c // 256) FROM crc, crc_table WHERE rest <> ''),
k AS MATERIALIZED (
  SELECT coalesce(conv_id, -9223372036854775807) AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(c.c, 4294967295) % 20 AS k
  FROM conversations JOIN crc c ON c.rest = '' AND c.s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
d AS (
  SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(CASE WHEN k.k = 3 THEN 2 ELSE 1 END) WHERE k > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS n,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
f AS MATERIALIZED (SELECT conv, turn, role, text, n, left(role, 1) AS i, last = '' AS blank,
  last <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS duplicate,
  row_number() OVER (PARTITION BY conv, role, text ORDER BY n) = 1 AND last NOT IN ('', '.', '!', '?') AS truncated,
  coalesce(lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
t AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM f GROUP BY conv),
w(conv, n, v0, v1, v2, v3) AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT), '0000000000' || chr(1), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM k
  UNION ALL
  SELECT conv, n, {_edit("v0", "4", "D", "''")}, least({_edit("v1", "4", "D", "''")}, CASE WHEN keep AND i = 's' THEN {_edit("v0", "e", "K", "line")} END),
    least({_edit("u", "4", "D", "''")},
      CASE WHEN keep AND i = 'u' THEN least({_edit("v0", "e", "K", "line")}, {_edit("v1", "e", "K", "line")}, {_edit("a", "e", "K", "line")}) END,
      CASE WHEN keep THEN least({_edit("v0", "3 + e", "R", "'user:' || text || chr(10)")}, {_edit("v1", "3 + e", "R", "'user:' || text || chr(10)")},
        {_edit("a", "3 + e", "R", "'user:' || text || chr(10)")}) END),
    least({_edit("a", "4", "D", "''")}, CASE WHEN keep AND i = 'a' THEN {_edit("u", "e", "K", "line")} END,
      CASE WHEN keep THEN {_edit("u", "3 + e", "R", "'assistant:' || text || chr(10)")} END)
  FROM (SELECT *, least(v3, {_edit("u", "3", "I", "'assistant:' || chr(10)")}) AS a FROM (
    SELECT w.*, least(v2, {_edit("v0", "3", "I", "'user:' || chr(10)")}, {_edit("v1", "3", "I", "'user:' || chr(10)")}, {_edit("v3", "3", "I", "'user:' || chr(10)")}) AS u,
      f.i, f.text, f.role || ':' || f.text || chr(10) AS line, NOT (f.blank OR f.duplicate) AS keep, CASE WHEN f.truncated THEN 3 ELSE 0 END AS e
    FROM (SELECT conv, n + 1 AS n, v0, v1, v2, v3 FROM w) w JOIN f ON f.conv = w.conv AND f.n = w.n))),
z AS (
  SELECT conv, least(v0, v3, {_edit("u", "3", "I", "'assistant:' || chr(10)")}) AS v FROM (
    SELECT w.*, least(v2, {_edit("v0", "3", "I", "'user:' || chr(10)")}, {_edit("v1", "3", "I", "'user:' || chr(10)")}, {_edit("v3", "3", "I", "'user:' || chr(10)")}) AS u
    FROM w LEFT JOIN t ON t.conv = w.conv WHERE w.n = coalesce(t.n, 0)))
SELECT nullif(z.conv, -9223372036854775807) AS conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(v[1:10] AS BIGINT) AS cost, v[11:strpos(v, chr(1)) - 1] AS audit,
  sha256(CASE WHEN strpos(v, chr(1)) = len(v) THEN '' ELSE v[strpos(v, chr(1)) + 1:len(v) - 1] END) AS repaired_sha256
FROM z LEFT JOIN t ON t.conv = z.conv
"""
