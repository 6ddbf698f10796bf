"""Packing token ids of documents into sequences of a fixed length, by bulk-synchronous best-fit.

Documents become pieces of at most `capacity` ids. In each round the unplaced pieces and the gaps of open sequences are
range-sorted together, largest first. A partition sweeps down its part: a piece takes the smallest gap that holds it (its
successor), and what is left of the gap is a gap again. Pieces that find none in their partition go to the gaps that
partitions before theirs have left, last ones (the smallest) first: which piece goes to which gap follows from its rank
in its partition alone, so no two take the same place. Then gaps are updated, new sequences are opened - as many as any
packing would need besides the gaps - and the next round begins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_table
from .tokens import _borrow, _give_back

CAPACITY = 4_096
#: Pieces and gaps of a partition of a round; where all go into one, it opens sequences itself and rounds end.
PART_ROWS, LAST_ROWS = 20_000, 10_000
GAP, PIECE, PLACED = 0, 1, 2

PIECES = "key long, id long, piece int, start long, length int, ids binary"


def _cut(path: str, end: int, spaced: bool, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, key, press = _borrow(path, spaced, 2), TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1)
        tail, step = end.to_bytes(2, "little"), 2 * capacity
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some, rows = batch.slice(at, 200), []
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                for id_, raw in zip(some.column(0).to_pylist(), encoder(texts), strict=True):
                    raw += tail
                    for k, a in enumerate(range(0, len(raw), step)):
                        ids = raw[a : a + step]
                        rows.append((key, id_, k, a // 2, len(ids) // 2, press.compress(ids)))
                        key += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        _give_back()

    return run


def cut_pieces(df: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, spaced: bool = False) -> DataFrame:
    """(key, id, piece, start, length, ids): the ids of every whole text and `end`, cut into pieces of `capacity`, ids as
    16-bit numbers in a zstandard frame. key tells the pieces of one write apart. A null text is an empty one."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer, end, spaced, capacity), PIECES)


def needed(pieces: np.ndarray, gaps: np.ndarray, capacity: int) -> int:
    """A number of new sequences that any packing of the pieces needs besides the gaps; both are counts by size from 0 to
    capacity. For each size s: pieces from s on fit only gaps from s on, by their sum and by how many of s each holds."""
    sizes = np.arange(capacity + 1)
    from_ = lambda x: np.cumsum(x[::-1])[::-1]
    by_sum = -(-(from_(pieces * sizes) - from_(gaps * sizes)) // capacity)
    count, most = from_(pieces), 0
    for s in np.flatnonzero(pieces):
        if s:
            room = int((gaps[s:] * (sizes[s:] // s)).sum())
            most = max(most, int(by_sum[s]), -(-(int(count[s]) - room) // (capacity // int(s))))
    return most


class Gaps:
    """Gaps by size, with the smallest of at least a size found by the bits of one number."""

    def __init__(self) -> None:
        self.by: dict[int, list[int]] = {}
        self.bits = 0

    def put(self, size: int, key: int) -> None:
        self.by.setdefault(size, []).append(key)
        self.bits |= 1 << size

    def take(self, size: int) -> tuple[int, int] | None:
        """(size, key) of a smallest gap of at least `size`."""
        rest = self.bits >> size
        if not rest:
            return None
        at = size + (rest & -rest).bit_length() - 1
        keys = self.by[at]
        key = keys.pop()
        if not keys:
            self.bits ^= 1 << at
        return at, key


SWEPT = "part int, kind int, rank long, size int, key long, seq long"


def _swept(capacity: int, alone: bool, fresh: int):
    """Of rows (size, kind, key), largest first and gaps before pieces: what is placed, and the pieces and gaps left,
    ranked (pieces from the largest, gaps from the smallest). Gaps smaller than all of the partition have no rank.
    alone: the partition has all rows; a piece that no gap holds opens a sequence, numbered from `fresh` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
        if not rows:
            return
        sizes, kinds, keys = (np.concatenate(x) for x in zip(*rows, strict=True))
        low, new = 0 if alone else int(sizes.min()), fresh
        gaps, out, left, small = Gaps(), [], 0, []
        for size, kind, key in zip(sizes.tolist(), kinds.tolist(), keys.tolist(), strict=True):
            if kind == GAP:
                gaps.put(size, key)
                continue
            found = gaps.take(size)
            if found is None and alone:
                found, new = (capacity, new), new + 1
            if found is None:
                out.append((PIECE, left, size, key, None))
                left += 1
                continue
            out.append((PLACED, None, size, key, found[1]))
            if rest := found[0] - size:
                gaps.put(rest, found[1]) if rest >= low else small.append((GAP, None, rest, found[1], None))
        rank = 0
        for size in sorted(s for s, k in gaps.by.items() if k):
            for key in gaps.by[size]:
                out.append((GAP, rank, size, key, None))
                rank += 1
        out += small
        for at in range(0, len(out), 20_000):
            some = out[at : at + 20_000]
            cols = [pa.array(list(c), k) for c, k in zip(zip(*some, strict=True), [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part, pa.int32()), len(some)), *cols], [x.split()[0] for x in SWEPT.split(", ")])

    return run


@dataclass
class Left:
    """Gaps that a partition has left: how many, the smallest's size, how many are taken."""

    part: int
    count: int
    least: int
    taken: int = 0


def successors(parts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which gaps the pieces go to that found none in their partition.

    parts: (part, pieces left, the largest's size, gaps left, the smallest's size), from the largest sizes on. Returns
    (part, from, to, other, first, each): pieces from rank `from` to `to` go to the gaps of `other` from rank `first`
    on, `each` to a gap. What a partition left lies on a stack, so a piece goes to the smallest gaps before it."""
    stack: list[Left] = []
    out = []
    for part, pieces, largest, gaps, least in parts:
        done = 0
        while done < pieces and stack:
            top = stack[-1]
            each = max(1, top.least // largest)
            n = min(pieces - done, (top.count - top.taken) * each)
            out.append((part, done, done + n, top.part, top.taken, each))
            done, top.taken = done + n, top.taken + -(-n // each)
            if top.taken == top.count:
                stack.pop()
        if gaps:
            stack.append(Left(part, gaps, least))
    return out


def plan(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, sequence_id, offset) of pieces (key, length): each has a place in a sequence of at most `capacity` ids; the
    places of a sequence follow one another from 0 on.

    A round's counts by size and figures by partition are what the driver sees: 2 * capacity rows and 4 a partition. All
    pieces of a size are alike, so it doesn't matter that many have one. Pieces of `capacity` ids are sequences of their
    own. Each round places a piece at least, in fact most that any gap holds."""
    spark = pieces.sparkSession
    ws = Scratch(spark, "packing")
    full, state = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity).select(F.col("length").alias("size"), F.lit(PIECE).alias("kind"), "key")
    placed = [full.select("key", (2 * F.col("key") + 1).alias("seq"), F.col("length").alias("size"))]
    fresh, turn = 0, 0
    while True:
        counts = np.zeros((2, capacity + 1), np.int64)
        for size, kind, n in state.groupBy("size", "kind").count().collect():  # capacity rows of a kind at most
            counts[kind, size] = n
        if not counts[PIECE].any():
            break
        smallest = int(np.flatnonzero(counts[PIECE])[0])
        counts[GAP, :smallest] = 0
        new = needed(counts[PIECE], counts[GAP], capacity)
        rows = state.where(f"kind = {PIECE} or size >= {smallest}")
        if new:
            rows = rows.unionByName(spark.range(fresh, fresh + new).select(F.lit(capacity).alias("size"), F.lit(GAP).alias("kind"), F.col("id").alias("key")))
            fresh += new
        n = int(counts.sum()) + new
        order = [F.desc("size"), "kind", "key"]
        alone = n <= LAST_ROWS
        dealt = rows.coalesce(1) if alone else rows.repartitionByRange(-(-n // PART_ROWS) + 1, *order)
        swept = ws.save(dealt.sortWithinPartitions(*order).select("size", "kind", "key").mapInArrow(_swept(capacity, alone, fresh), SWEPT), f"swept-{turn}")
        if alone:
            placed.append(swept.where(f"kind = {PLACED}").select("key", "seq", "size"))
            break
        of = lambda kind, f: f(F.when((F.col("kind") == kind) & F.col("rank").isNotNull(), F.col("size")))
        figures = swept.groupBy("part").agg(of(PIECE, F.count), of(PIECE, F.max), of(GAP, F.count), of(GAP, F.min)).orderBy("part").collect()  # a row for each partition
        ways = small_table(spark, successors([tuple(r) for r in figures]), "part int, first_piece long, after_piece long, other int, first_gap long, each long")
        sent = swept.where(f"kind = {PIECE}").join(F.broadcast(ways), "part").where("rank >= first_piece and rank < after_piece")  # 2 rows a partition at most
        sent = sent.select(F.col("other").alias("part"), F.expr("first_gap + (rank - first_piece) div each").alias("rank"), "size", "kind", "key")
        reach = ways.groupBy("part").agg(F.max("after_piece").alias("reach"))
        stay = swept.where(f"kind = {PIECE}").join(F.broadcast(reach), "part", "left").where("reach is null or rank >= reach")
        meet = swept.where(f"kind = {GAP} and rank is not null").select("part", "rank", "size", "kind", "key").unionByName(sent)
        w = Window.partitionBy("part", "rank")
        meet = meet.withColumn("seq", F.max(F.when(F.col("kind") == GAP, F.col("key"))).over(w)).withColumn("used", F.sum(F.when(F.col("kind") == PIECE, F.col("size")).otherwise(0)).over(w))
        met = meet.select(F.when(F.col("kind") == GAP, F.col("size") - F.col("used")).otherwise(F.col("size")).cast("int").alias("size"), F.when(F.col("kind") == GAP, GAP).otherwise(PLACED).alias("kind"), "key", F.when(F.col("kind") == PIECE, F.col("seq")).alias("seq"))
        columns = ["size", "kind", "key", "seq"]
        rest = swept.where(f"kind = {PLACED} or kind = {GAP} and rank is null").select(*columns)
        done = ws.save(met.unionByName(rest).unionByName(stay.select(*columns)).where("size > 0"), f"round-{turn}")
        ws.drop(f"swept-{turn}")
        placed.append(done.where(f"kind = {PLACED}").select("key", "seq", "size"))
        state = done.where(f"kind <> {PLACED}").select("size", "kind", "key")
        turn += 1
    all_ = placed[0]
    for p in placed[1:]:
        all_ = all_.unionByName(p.withColumn("seq", 2 * F.col("seq")))
    w = Window.partitionBy("seq").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, -1)
    return all_.select("key", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("size").over(w), F.lit(0)).alias("offset"))


SEQUENCES = "sequence_id long, length int, parts array<struct<id:long,piece:int,start:long,length:int,offset:int>>, ids binary"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sequence_id, offset, id, piece, start, length, ids) in the order of sequences and offsets, put together."""
    kind = pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int32())])
    now, parts, ids, rows, open_ = None, [], [], [], zstandard.ZstdDecompressor()

    def out() -> pa.RecordBatch:
        cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.list_(kind), pa.binary()], strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(cols, ["sequence_id", "length", "parts", "ids"])

    def done() -> None:
        whole = np.frombuffer(b"".join(ids), "<u2").astype("<u4").tobytes()
        rows.append((now, len(whole) // 4, parts, whole))

    for batch in batches:
        for seq, offset, id_, piece, start, length, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seq != now:
                if parts:
                    done()
                    if len(rows) == 100:
                        yield out()
                now, parts, ids = seq, [], []
            parts.append({"id": id_, "piece": piece, "start": start, "length": length, "offset": offset})
            ids.append(open_.decompress(raw))
    if parts:
        done()
    if rows:
        yield out()


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, length, parts, ids): the packed sequences, ids as little-endian 32-bit numbers, parts in order."""
    rows = pieces.join(places, "key").select("sequence_id", F.col("offset").cast("int").alias("offset"), "id", "piece", "start", "length", "ids")
    return rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(_joined, SEQUENCES)


def pack(df: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, spaced: bool = False) -> DataFrame:
    """The sequences of all documents of df. Null and empty texts are the end id alone; repeated rows and null ids are
    documents of their own; other columns are ignored whatever their names; an empty table has no sequences. Only texts
    of more than `capacity` ids are cut."""
    pieces = Scratch(df.sparkSession, "pieces").save(cut_pieces(df, tokenizer, end, id_col, text_col, capacity, spaced), "pieces", repeats=False)
    return sequences(pieces, plan(pieces.select("key", "length"), capacity))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of all documents, read from the packed sequences."""
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1, spaced=True)
    crc = lambda p: F.crc32(F.substring(F.col("ids"), p["offset"] * 4 + 1, p["length"] * 4))
    part = lambda p: F.struct(p["id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].cast("long").alias("length"), crc(p).alias("ids_crc32"), p["offset"].cast("long").alias("offset"))
    rows = packed.select("sequence_id", F.inline(F.transform("parts", part)))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
