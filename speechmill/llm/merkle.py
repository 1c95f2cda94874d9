"""Operator 13, Merkle dataset manifest: proofs of all rows by pointer jumping.

A row's leaf is the sha256 of its fields, each `-` if null, else its UTF-8 byte
count, `:` and its value. The leaves of a group (a language) ascend by id and are
hashed in runs of `arity`, level by level, up to the group's subroot; the
subroots, in order of their groups (null first), are hashed likewise to the root.
A run shorter than `arity` is hashed as it is, even one node alone.

* Leaves are range-partitioned by (group, id) and numbered per partition; only
  one summary per partition reaches the driver, so a group may span any number of
  tasks. Levels are built STRIDE at a time: runs of at most 256 nodes meet.
* Every node starts with the segment to its parent: the digests of the other
  nodes of its run. Rounds of self-joins double that distance: a node takes over
  its ancestor's segment and pointer. After a round at distance d only nodes at
  levels that 2 d divides are still pointed at by leaves, so the ancestor table
  shrinks to its square root in size while the distance doubles. It is broadcast
  once it has at most BROADCAST_ROWS rows (each under 2 KB); before that a key is
  shared by at most arity ** d nodes.

Defined results: null, empty and very long fields hash as said above; equal ids
follow the order of their leaves, so repeated rows take places of their own; null
ids come first; a null group is a group; an empty table gives no rows. Only the
named fields are read, further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import settled, slices

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that meet in one step of the tree: at most this many.
STRIDE_NODES = 256
BROADCAST_ROWS = 20_000
TOP = -1
DIGEST = 32


def leaf_of(values: Sequence[Column]) -> Column:
    """The leaf digest (hex) of the given fields."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def run_hash(digests: Sequence[bytes]) -> bytes:
    """The node above a run of digests."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def levels_of(n: int, arity: int) -> int:
    """Levels between the leaves and the one node left of n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def segment(run: Sequence[bytes], place: int) -> bytes:
    """The step from a node to its parent: place in the run, number and digests of the others."""
    return bytes((place, len(run) - 1)) + b"".join(d for i, d in enumerate(run) if i != place)


def steps_of(path: bytes):
    """(place, digests of the others) of each step of a path."""
    at = 0
    while at < len(path):
        place, others = path[at], path[at + 1]
        at += 2
        yield place, [path[at + DIGEST * i: at + DIGEST * (i + 1)] for i in range(others)]
        at += DIGEST * others


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf digest and its path lead to."""
    for place, others in steps_of(path):
        digest = run_hash([*others[:place], digest, *others[place:]])
    return digest


def siblings_hash(path: bytes) -> str:
    """sha256 of the siblings' digests as hex text, from the leaf up to the root."""
    return hashlib.sha256(b"".join(d.hex().encode() for _, others in steps_of(path) for d in others)).hexdigest()


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (grp, id, leaf, more) with tree (order number of grp) and pos in it; and the number of trees."""
    # the number settles ties for good, once the rows are written
    given = settled(rows.withColumn("uid", F.monotonically_increasing_id()))
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("uid")]
    fields = "id long, leaf binary, more binary, pid int, tree long, pos long, grp binary"
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def number(batches):
        pid, tree, pos, last, first, n = TaskContext.get().partitionId(), -1, 0, None, None, 0
        for batch in batches:
            trees, places = [], []
            for g in batch.column(0).to_pylist():
                if tree < 0 or g != last:
                    if tree == 0:
                        n = pos
                    tree, pos, last = tree + 1, 0, g
                    if tree == 0:
                        first = g
                trees.append(tree)
                places.append(pos)
                pos += 1
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([pid] * k, pa.int32()), pa.array(trees, pa.int64()), pa.array(places, pa.int64()), pa.nulls(k, pa.binary())],
                schema=arrow)
        if tree >= 0:
            # the summary: first and last group with their rows here; the row itself has no leaf
            for which, g, c in (("first", first, n if tree else pos), ("last", last, pos)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([c], pa.int64()), pa.nulls(1, pa.binary()), pa.array([which.encode()]), pa.array([pid], pa.int32()),
                    pa.array([tree], pa.int64()), pa.array([-1], pa.int64()), pa.array([g], pa.binary())], schema=arrow)

    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("grp").cast("binary"), "id", "leaf", "more")
    out = settled(ordered.mapInArrow(number, fields))
    ends: dict[int, dict] = {}
    for r in out.filter("pos < 0").collect():
        ends.setdefault(r["pid"], {})[bytes(r["more"])] = r
    offsets, base, last, carried = [], 0, None, 0
    for pid in sorted(ends):
        first, end = ends[pid][b"first"], ends[pid][b"last"]
        same = last is not None and first["grp"] == last[0]
        base -= same
        carry = carried if same else 0
        offsets.append((pid, base, carry))
        base += first["tree"] + 1
        carried = end["id"] + (carry if first["tree"] == 0 else 0)
        last = (end["grp"],)
    if not offsets:
        return out.drop("grp", "pid"), 0
    # one row per partition
    starts = out.sparkSession.createDataFrame(offsets, "pid int, base long, carry long")
    placed = out.filter("pos >= 0").join(F.broadcast(starts), "pid").select(
        "id", "leaf", "more", (F.col("tree") + F.col("base")).alias("tree"),
        (F.col("pos") + F.when(F.col("tree") == 0, F.col("carry")).otherwise(F.lit(0))).alias("pos"))
    return placed, base


def looked_up(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """df with the columns of a table by key: broadcast if it has few rows, else Spark's join with its skew splits."""
    return df.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, key)


_NODE = "tree long, level int, pos long, n long, id long, leaf binary, more binary, digest binary, seg binary"


def stride_of(nodes: DataFrame, level: int, arity: int, stride: int) -> DataFrame:
    """The nodes of `stride` levels from `level` on with their segments, and those above without one."""
    size = arity ** stride
    arrow = to_arrow_schema(StructType.fromDDL(_NODE))

    def build(batches):
        def solved(tree, n, rows):
            top, first = levels_of(n, arity), rows[0][0]
            digests = [r[1] for r in rows]
            for up in range(stride):
                here = level + up
                if here == top:
                    break
                above = []
                for a in range(0, len(digests), arity):
                    run = digests[a: a + arity]
                    for k, d in enumerate(run):
                        payload = rows[a + k][2:] if up == 0 else (None, None, None)
                        yield tree, here, first + a + k, n, *payload, d, segment(run, k)
                    above.append(run_hash(run))
                digests, first = above, first // arity
            else:
                here = level + stride
            # a lone leaf is its own subroot and keeps its payload
            yield tree, here, first, n, *(rows[0][2:] if here == 0 else (None, None, None)), digests[0], None

        def packed(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

        key, rows, out = None, [], []
        for batch in slices(batches, 4096):
            for tree, block, n, pos, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if (tree, block) != key:
                    if rows:
                        out.extend(solved(key[0], count, rows))
                    key, rows, count = (tree, block), [], n
                rows.append((pos, *rest))
            if len(out) > 4096:
                yield packed(out)
                out = []
        if rows:
            out.extend(solved(key[0], count, rows))
        if out:
            yield packed(out)

    met = (nodes.select("tree", F.floor(F.col("pos") / size).cast("long").alias("block"), "n", "pos", "digest", "id", "leaf", "more")
           .repartition("tree", "block").sortWithinPartitions("tree", "block", "pos"))
    return settled(met.mapInArrow(build, _NODE))


def tree_nodes(leaves: DataFrame, most: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with segments, subroots) of leaves (tree, n, pos, digest, id, leaf, more); most: leaves of the largest tree."""
    stride = 1
    while arity ** (stride + 1) <= STRIDE_NODES:
        stride += 1
    nodes, tops, level, now = [], [], 0, leaves
    while True:
        built = stride_of(now, level, arity, stride)
        nodes.append(built.filter("seg IS NOT NULL"))
        above = built.filter("seg IS NULL")
        level += stride
        # the powers of arity say whether a tree ends at or below this level
        done = F.col("n") <= arity ** level
        tops.append(above.filter(done))
        if most <= arity ** level:
            break
        now = above.filter(~done)
    union = nodes[0]
    for df in nodes[1:]:
        union = union.union(df)
    roots = tops[0]
    for df in tops[1:]:
        roots = roots.union(df)
    return union, roots


def jump_of(top: bool, arity: int, last: int) -> list[Column]:
    """The key of a node's parent: in its own tree, or as a leaf of the tree of subroots; null at the root."""
    up = F.floor(F.col("pos") / arity).cast("long")
    level = F.col("level") + 1
    if top:
        end = level >= last
        return [F.when(~end, F.lit(TOP).cast("long")), F.when(~end, level), F.when(~end, up)]
    # the level of the parent is the top level if all leaves lie below one node there
    ends = F.pow(F.lit(float(arity)), level) >= F.col("n")
    none = F.lit(last == 0)
    return [F.when(~ends, F.col("tree")).when(~none, F.lit(TOP).cast("long")), F.when(~ends, level).when(~none, F.lit(0)),
            F.when(~ends, up).when(~none, F.col("tree"))]


def jumped(nodes: DataFrame, ancestors: DataFrame, few: bool) -> DataFrame:
    """One self-join: nodes take over the segments and pointers of the nodes that they point at."""
    there = ancestors.select(F.col("tree").alias("jt"), F.col("level").alias("jl"), F.col("pos").alias("jp"), F.col("seg").alias("seg2"),
                             F.col("jt").alias("jt2"), F.col("jl").alias("jl2"), F.col("jp").alias("jp2"))
    met = nodes.join(F.broadcast(there) if few else there, ["jt", "jl", "jp"], "left")
    kept = [c for c in nodes.columns if c not in ("seg", "jt", "jl", "jp")]
    return met.select(*kept, F.concat("seg", F.coalesce("seg2", F.lit(b""))).alias("seg"),
                      F.col("jt2").alias("jt"), F.col("jl2").alias("jl"), F.col("jp2").alias("jp"))


@dataclass
class Manifest:
    """The root (None for an empty table), the subroots (tree, subroot), and one
    proof per row (id, leaf, more, tree, pos, path): `path` leads from the leaf
    to the root, `more` is what the caller attached."""

    root: bytes | None
    subroots: DataFrame
    proofs: DataFrame


def build_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
                   more: Column | None = None, arity: int = 2) -> Manifest:
    """The manifest of all rows; `more` is a binary column to be kept with each row's proof."""
    columns = [F.col(f"`{c}`") for c in fields]
    rows = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{order}`").cast("long").alias("id"),
                       F.unhex(leaf_of(columns)).alias("leaf"), (F.lit(None) if more is None else more).cast("binary").alias("more"))
    leaves, n_trees = numbered(rows)
    if not n_trees:
        nothing = leaves.select("id", "leaf", "more", "tree", "pos", F.lit(b"").alias("path"))
        return Manifest(None, nothing.select("tree", F.col("leaf").alias("subroot")), nothing)
    counts = settled(leaves.groupBy("tree").agg((F.max("pos") + 1).alias("n")))
    most = counts.agg(F.max("n")).first()[0]
    nodes, roots = tree_nodes(looked_up(leaves, counts, "tree").withColumn("digest", F.col("leaf")), most, arity)
    empty = F.lit(None).cast("binary")
    subroots = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("pos"),
                            "digest", F.lit(None).cast("long").alias("id"), empty.alias("leaf"), empty.alias("more"))
    top_nodes, top = tree_nodes(subroots, n_trees, arity)
    root = bytes(top.first()["digest"])
    height = levels_of(n_trees, arity)
    # leaves that are the whole of their tree start at the subroot with nothing on their way
    lone = roots.filter("level = 0").withColumn("seg", F.lit(b""))
    none = F.lit(height == 0)
    lone = lone.select(*[c for c in lone.columns], F.when(~none, F.lit(TOP).cast("long")).alias("jt"),
                       F.when(~none, F.lit(0)).alias("jl"), F.when(~none, F.col("tree")).alias("jp"))

    def pointed(df, is_top):
        jt, jl, jp = jump_of(is_top, arity, height)
        return df.select("*", jt.alias("jt"), jl.alias("jl"), jp.alias("jp"))

    below = pointed(nodes, False)
    leafs = below.filter("level = 0").union(lone).select("id", "leaf", "more", "tree", "pos", "seg", "jt", "jl", "jp")
    inner = below.filter("level > 0").union(pointed(top_nodes, True)).select("tree", "level", "pos", "seg", "jt", "jl", "jp")
    # a leaf that is its own subroot spends its first jump on being that
    distance, depth = 1, max(levels_of(most, arity), 1) + height
    while distance < depth:
        few = inner.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        leafs = jumped(leafs, inner, few)
        wanted = inner.filter((F.col("tree") == TOP) | (F.col("level") % (2 * distance) == 0))
        inner = settled(jumped(wanted, inner, few))
        distance *= 2
    return Manifest(root, roots.select("tree", F.col("digest").alias("subroot")),
                    leafs.select("id", "leaf", "more", "tree", "pos", F.col("seg").alias("path")))


def verified(proofs: DataFrame, root: bytes | None, claimed: str = "more") -> DataFrame:
    """Per proof (id, leaf, subroot): proof_sha256, the root folded from the claimed
    leaf (the own one where that is null), and whether it is the root."""
    fields = "id long, leaf string, subroot string, proof_sha256 string, folded_root string, verified boolean"
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches):
        for part in slices(batches, 1024):
            ids, leaves, claims, subroots, paths = (part.column(i).to_pylist() for i in range(5))
            roots = [fold(own if other is None else other, path) for own, other, path in zip(leaves, claims, paths)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                ids, [x.hex() for x in leaves], [x.hex() for x in subroots], [siblings_hash(p) for p in paths], [r.hex() for r in roots],
                [r == root for r in roots]), arrow)], schema=arrow)

    return proofs.select("id", "leaf", claimed, "subroot", "path").mapInArrow(run, fields)


def manifest_report(docs: DataFrame) -> DataFrame:
    """The digest of every document's proof; of every seventh id (by its hash) one more is claimed for n_chars."""
    edited = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    manifest = build_manifest(docs, more=F.when(picked, F.unhex(leaf_of(edited))))
    rows = verified(looked_up(manifest.proofs, manifest.subroots, "tree"), manifest.root)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(manifest.root.hex() if manifest.root else None).cast("string").alias("root"),
                       "proof_sha256", "folded_root", "verified")


#: DuckDB has no crc32; the table of its 256 bytes is computed by the query.
SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
crc(doc_id, s, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s[2:], xor(t[xor(c % 256, ascii(s[1])) + 1], c // 256) FROM crc, crc_table WHERE s <> ''),
h AS MATERIALIZED (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars FROM documents),
l AS MATERIALIZED (
  SELECT h.doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(c.c, 4294967295) % 7 = 0
      THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS claimed
  FROM h LEFT JOIN (SELECT doc_id, c FROM crc WHERE s = '') c ON c.doc_id = h.doc_id),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
up(tree, level, d) AS (
  SELECT tree, 0, list(leaf ORDER BY pos) FROM p GROUP BY tree
  UNION ALL SELECT tree, level + 1, list_transform(range(1, len(d) + 1, 2), lambda i: sha256(d[i] || coalesce(d[i + 1], ''))) FROM up WHERE len(d) > 1),
levels AS MATERIALIZED (SELECT * FROM up),
subs AS MATERIALIZED (SELECT tree, level AS height, d[1] AS subroot FROM levels WHERE len(d) = 1),
over(level, d) AS (
  SELECT 0, list(subroot ORDER BY tree) FROM subs
  UNION ALL SELECT level + 1, list_transform(range(1, len(d) + 1, 2), lambda i: sha256(d[i] || coalesce(d[i + 1], ''))) FROM over WHERE len(d) > 1),
top AS MATERIALIZED (SELECT * FROM over),
step AS MATERIALIZED (SELECT tree, level, d FROM levels WHERE len(d) > 1
  UNION ALL SELECT s.tree, s.height + t.level, t.d FROM subs s, top t WHERE len(t.d) > 1),
walk(doc_id, tree, height, leaf, level, pos, sibs, folded) AS (
  SELECT doc_id, p.tree, height, leaf, 0, CASE WHEN height = 0 THEN p.tree ELSE pos END, '', coalesce(claimed, leaf) FROM p JOIN subs s ON s.tree = p.tree
  UNION ALL
  SELECT doc_id, w.tree, height, leaf, w.level + 1, CASE WHEN w.level + 1 = height THEN w.tree ELSE pos // 2 END,
    sibs || coalesce(d[CASE WHEN pos % 2 = 0 THEN pos + 2 ELSE pos END], ''),
    sha256(CASE WHEN pos % 2 = 0 THEN folded || coalesce(d[pos + 2], '') ELSE d[pos] || folded END)
  FROM walk w JOIN step s ON s.tree = w.tree AND s.level = w.level)
SELECT w.doc_id, leaf, subroot, t.d[1] AS root, sha256(sibs) AS proof_sha256, folded AS folded_root, folded = t.d[1] AS verified
FROM walk w JOIN subs s ON s.tree = w.tree, top t
WHERE len(t.d) = 1 AND w.level = s.height + t.level
"""
