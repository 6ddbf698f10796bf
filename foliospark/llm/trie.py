"""A trie of conversations: which first turns they share.

Conversations are sorted by their sequences of turns, so that a node's members are an interval of the order, and the
number of first turns that a conversation shares with the one before it (the LCP array) has all nodes: the nearest
smaller values to both sides of an entry bound the interval of a branching node. The order is cut into blocks. In each,
one sweep with a stack finds the nearest smaller values, merges intervals of equal LCP, expands the depths between an
interval and its parent, and sums over intervals. What the block's minima leave open at its ends (one interval a depth at
most) is a fragment; fragments of a depth, in the order of the blocks, are put together by a window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of a turn's digest in a path.
STEP = 16
#: Rows of a batch that a sweep gives.
ROWS = 20_000


def turn_lists(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv long, turns array<struct<key:string,size:long>>): each conversation's turns in order, as md5 digests of role
    and text, with the texts' UTF-8 bytes.

    Turns are ordered by turn, then role and text (ties), nulls first. Null roles and texts are empty ones; repeated rows
    are turns of their own; rows without a conversation id belong to no conversation and are left out; other columns
    are ignored whatever their names."""
    c = lambda name, to: F.col(f"`{name}`").cast(to)
    rows = df.select(c(conv_col, "long").alias("conv"), F.col(f"`{turn_col}`").alias("t"), F.coalesce(c(role_col, "string"), F.lit("")).alias("r"), F.coalesce(c(text_col, "string"), F.lit("")).alias("x")).where("conv is not null")
    key = F.md5(F.concat(F.octet_length("r").cast("string"), F.lit(":"), F.col("r"), F.col("x")).cast("binary"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("t"), "r", "x")))
    turn = F.struct("k", key.alias("key"), F.octet_length("x").cast("long").alias("size"))
    rows = rows.select("conv", turn.alias("turn")).groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return rows.select("conv", F.transform("turns", lambda s: F.struct(s["key"].alias("key"), s["size"].alias("size"))).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """How many first turns two paths share."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (n - (x.bit_length() + 7) // 8) // STEP


class Interval:
    """An interval of the order whose conversations share their first `depth` turns; sums are over the part of it that
    was seen in this block. all_bytes: of texts deeper than depth, once for each member; own_bytes: once for each node."""

    __slots__ = ("all_bytes", "children", "depth", "ends", "least", "leaves", "left", "n", "own_bytes", "start")

    def __init__(self, depth: int, start: int, left: bool = False):
        self.depth, self.start, self.left = depth, start, left
        self.n = self.children = self.leaves = self.all_bytes = self.own_bytes = 0
        self.least: int | None = None
        self.ends: list[int] = []

    def add(self, conv: int) -> None:
        """A conversation that ends at this depth."""
        self.n += 1
        self.ends.append(conv)
        self.least = conv if self.least is None else min(self.least, conv)

    def take(self, child: Interval) -> None:
        self.n += child.n
        self.children += not child.left
        self.leaves += child.leaves
        self.all_bytes += child.all_bytes
        self.own_bytes += child.own_bytes
        if child.least is not None:
            self.least = child.least if self.least is None else min(self.least, child.least)


#: Names and types of what a sweep gives: one row for a node, or for the part of it that lies in a block.
FRAGMENT = "block int, start long, depth int, parent_start long, left boolean, right boolean, n long, least long, children long, leaves long, all_bytes long, own_bytes long, ends string, digest string"


class Sweep:
    """One block's conversations in their order."""

    def __init__(self, block: int, before: bytes | None, after: bytes | None):
        self.block, self.before, self.after = block, before, after
        self.path, self.sizes, self.stack = before, [], []
        self.rows: list[tuple] = []
        self.started = False

    def close(self, bound: int, right: bool = False) -> None:
        """Intervals deeper than bound end here (right: at the block's end, and go on in the next)."""
        while self.stack and self.stack[-1].depth > bound:
            top = self.stack.pop()
            below = self.stack[-1] if self.stack else None
            to = max(bound, below.depth if below else -1)
            parent = below if below and below.depth == to else top
            for d in range(top.depth, to, -1):
                if d:
                    top.all_bytes += top.n * self.sizes[d - 1]
                    top.own_bytes += 0 if top.left else self.sizes[d - 1]
                ends = ",".join(map(str, top.ends))
                cut = top.left or right
                digest = None if cut else hashlib.sha256(ends.encode()).hexdigest()
                up = None if d == 0 else top.start if d - 1 > to else parent.start
                self.rows.append((self.block, top.start, d, up, top.left, right, top.n, top.least, top.children, top.leaves, top.all_bytes, top.own_bytes, ends if cut and top.ends else None, digest))
                top.children, top.ends = 0 if top.left else 1, []
            if parent is not top:
                parent.take(top)
            elif to >= 0:
                top.depth = to
                self.stack.append(top)

    def add(self, place: int, conv: int, path: bytes, sizes: list[int]) -> None:
        depth, common = len(path) // STEP, shared(self.path or b"", path)
        if not self.started:
            self.stack, self.started = [Interval(common, -1, True) if self.before is not None else Interval(0, place)], True
        else:
            if common < len(self.path) // STEP:
                self.stack[-1].leaves += 1
            self.close(common)
        if depth > common:
            self.stack.append(Interval(depth, place))
        self.stack[-1].add(conv)
        self.path, self.sizes = path, sizes

    def end(self) -> None:
        common = -1 if self.after is None else shared(self.path, self.after)
        if common < len(self.path) // STEP:
            self.stack[-1].leaves += 1
        self.close(common)
        self.close(-1, True)

    def given(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FRAGMENT.split(", ")])
        self.rows = []
        return out


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, conv, path, sizes, after) in the order of block and place; the first of a block (place -1) has
    the path before it and the one after it."""
    sweep: Sweep | None = None
    for batch in batches:
        for block, place, conv, path, sizes, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place < 0:
                if sweep:
                    sweep.end()
                    yield sweep.given()
                sweep = Sweep(block, path, after)
            else:
                sweep.add(place, conv, path, sizes)
                if len(sweep.rows) >= ROWS:
                    yield sweep.given()
    if sweep:
        sweep.end()
        yield sweep.given()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, node, block, ends) in their order: the digest of each node's ends, joined by commas."""
    key, state = None, hashlib.sha256()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["depth", "node", "cut_digest"])

    for batch in batches:
        for depth, node, _, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, node) != key:
                if key:
                    yield out()
                key, state = (depth, node), hashlib.sha256(ends.encode())
            else:
                state.update(f",{ends}".encode())
    if key:
        yield out()


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of convs (conv long, turns as of turn_lists): conv_id (the smallest member),
    depth, parent_conv_id (the parent's smallest member; null for the root), n_convs (conversations that begin with the
    node's turns), n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens (over its subtree,
    n_convs - 1 times the UTF-8 bytes of a node's last text), ends_sha256 (of the ids of the members that end there, in
    ascending order, joined by commas).

    A conversation without turns is a member of the root alone; equal conversations are members of all the same nodes;
    an empty table has no nodes. A conversation's path, 16 bytes a turn, is one value and must stay below 2 GB. Sorted
    conversations are told apart by their ids too, so a group of copies is spread over blocks. The digest of all the
    members that end in one node is one chain, so the ids of a node that lies in several blocks go through one task, a
    block's ids at a time."""
    ws = Scratch(convs.sparkSession, "trie")
    path = F.unhex(F.array_join(F.transform("turns", lambda s: s["key"]), ""))
    rows = convs.select("conv", path.alias("path"), F.transform("turns", lambda s: s["size"]).alias("sizes"))
    rows = rows.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    rows = ws.save(rows.select(F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place"), "*"), "order")

    edges = rows.groupBy("block").agg(F.min_by("path", "place").alias("first"), F.max_by("path", "place").alias("last"))
    w = Window.orderBy("block")  # a row for each block
    edges = edges.select("block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("conv"), F.lag("last").over(w).alias("path"), F.lit(None).cast("array<long>").alias("sizes"), F.lead("first").over(w).alias("after"))
    stream = rows.withColumn("after", F.lit(None).cast("binary")).unionByName(edges).select("block", "place", "conv", "path", "sizes", "after")
    nodes = ws.save(stream.repartition("block").sortWithinPartitions("block", "place").mapInArrow(_swept, FRAGMENT), "fragments")

    sums = ("n", "children", "leaves", "all_bytes", "own_bytes")
    w = Window.partitionBy("depth").orderBy("block", F.desc("left")).rowsBetween(Window.unboundedPreceding, 0)
    cut = ws.save(nodes.where("left or right").withColumn("node", F.count_if(~F.col("left")).over(w)), "cut")
    ends = cut.where("ends is not null").select("depth", "node", "block", "ends").repartition("depth", "node").sortWithinPartitions("depth", "node", "block")
    ends = ends.mapInArrow(_hashed, "depth int, node long, cut_digest string")
    whole = cut.groupBy("depth", "node").agg(F.min("least").alias("least"), *[F.sum(s).alias(s) for s in sums]).join(ends, ["depth", "node"], "left")
    whole = whole.withColumn("digest", F.coalesce("cut_digest", F.sha2(F.lit("").cast("binary"), 256)))
    cut = cut.select("block", "start", "depth", "parent_start", "left", "node").join(whole, ["depth", "node"])
    columns = ["block", "start", "depth", "parent_start", "left", "least", *sums, "digest"]
    nodes = ws.save(nodes.where("not left and not right").select(*columns).unionByName(cut.select(*columns)), "nodes")

    # A parent's part in the child's own block is joined, so a node with many children is as many keys as it has blocks.
    up = nodes.select("block", F.col("start").alias("parent_start"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
    out = nodes.where("not left").join(up, ["block", "parent_start", "depth"], "left")
    saved: Column = F.col("all_bytes") - F.col("own_bytes")
    return out.select(F.col("least").alias("conv_id"), F.col("depth").cast("long"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.col("digest").alias("ends_sha256"))


#: Conversations of a family, and the number of lengths of what they take from its first.
FAMILY, HEADS = 5, 9


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """convs rebuilt: conversation c has the first h turns of conversation c - c mod FAMILY (none if there is no such one)
    and then its own after its first h; h is the crc32 of c's decimal digits mod HEADS. Only heads are joined."""
    own = convs.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")).withColumn("base", F.col("conv") - F.pmod("conv", F.lit(FAMILY)))
    heads = convs.select(F.col("conv").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    head = F.slice(F.coalesce("head", F.array().cast(convs.schema["turns"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "base", "left").select("conv", F.concat(head, rest).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations with shared heads."""
    return prefix_trie(with_shared_heads(turn_lists(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: Nodes as prefixes of digests; a node's subtree is found through the prefixes of each node's smallest member.
OP13_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS state
  FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
  SELECT conv_id, xor(state, 4294967295) % 9 AS h, conv_id - (conv_id % 5 + 5) % 5 AS base FROM ids
), rebuilt AS (
  SELECT i.conv_id, t.k, t.r, t.x FROM heads i JOIN turns t ON t.conv_id = i.base AND t.k <= i.h
  UNION ALL SELECT i.conv_id, t.k + 1000000000, t.r, t.x FROM heads i JOIN turns t ON t.conv_id = i.conv_id AND t.k > i.h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, strlen(x) AS bytes,
    md5(strlen(r) || ':' || r || x) AS key FROM rebuilt
), prefixes AS (
  SELECT conv_id, d, bytes, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads
), lengths AS (
  SELECT conv_id, max(d) AS turns FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT p.d, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.bytes) AS bytes,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.turns = p.d), '')) AS ends_sha256
  FROM prefixes p JOIN lengths l USING (conv_id) GROUP BY p.d, p.path
), linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id, count(c.d) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.path = left(n.path, 32 * u.d::INT)
    LEFT JOIN nodes c ON c.d = n.d + 1 AND left(c.path, 32 * n.d::INT) = n.path
  GROUP BY ALL
), below AS (
  SELECT p.d, p.path, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM linked n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.path
)
SELECT l.conv_id, l.d AS depth, l.parent_conv_id, l.n_convs, l.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN below b ON b.d = l.d AND b.path = l.path
"""
