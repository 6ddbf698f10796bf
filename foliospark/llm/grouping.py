"""Groups of equal keys: candidate pairs of small groups, links to leaders and the members of large ones.

Tasks pack (key, v) pairs into blobs by the key's upper bits (a bucket), so that a shuffle moves a few large rows, and
sort a bucket's pairs as numbers. A bucket of more pairs than a task may hold (a hot key) goes row by row through
Spark's sort, which spills, and is streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed

#: Pairs that a bucket has about; pairs that a task packs at once; pairs of a bucket that a task holds.
BUCKET, PACKED, HELD = 1 << 18, 1 << 19, 1 << 21

GROUPS = "key long, a long, b long"
_NAMES = ["key", "a", "b"]


def groups(small: int, leaders: int) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
    """A function of (keys, vs), sorted by key, called again and again: candidate pairs (null key), and for groups of
    over `small` (key, member, null), with pairs of a member and a leader only. A group may go on in the next call.

    v is a vertex; its lowest bit is set if it came from the band below, and two such aren't paired."""
    key0: int | None = None
    head, size0 = np.empty(0, np.int64), 0  # of the open group: all of a small one, the leaders of a large one

    def large(k: np.ndarray, v: np.ndarray, starts: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        """Whole groups of over `small` rows, all at once: (null, a, b) of pairs, (keys, members, null) of those of over `small` vertices."""
        if not len(starts):
            return
        of = np.repeat(np.arange(len(starts)), size)
        at = np.arange(len(of)) + np.repeat(starts - np.cumsum(size) + size, size)
        at = at[np.lexsort((v[at] & ~1, of))]  # stable: of the rows of one vertex, the first comes first
        new = np.concatenate(([True], (of[1:] != of[:-1]) | ((v[at[1:]] ^ v[at[:-1]]) & ~1 != 0)))
        of, at = of[new], at[new]
        order = np.lexsort((v[at] ^ k[at], of))  # leaders differ from key to key
        k, v = k[at[order]], v[at[order]]
        count = np.bincount(of, minlength=len(starts))
        first = np.cumsum(count) - count
        for n in range(2, small + 1):
            begin = first[count == n]
            for i in range(n if len(begin) else 0):
                for j in range(i + 1, n):
                    x, y = v[begin + i], v[begin + j]
                    good = (x & y & 1) == 0
                    yield None, x[good] & ~1, y[good] & ~1
        many = count[of] > small
        yield k[many], v[many] & ~1, None
        place = np.arange(len(of)) - first[of]
        for i in range(leaders):
            ends = np.flatnonzero(many & (place > i))
            x, y = v[first[of[ends]] + i], v[ends]
            good = (x & y & 1) == 0
            yield None, x[good] & ~1, y[good] & ~1

    def run(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nonlocal key0, head, size0
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        ends = np.append(starts[1:], len(k))
        left, right, hot, members = [], [], [], []
        # The first and the last group may go on in other calls; those between are whole, and tiny ones are expanded by size.
        size = ends - starts
        edge = (starts == 0) | (ends == len(k))
        for n in range(2, small + 1):
            of = starts[(size == n) & ~edge]
            for i in range(n if len(of) else 0):
                for j in range(i + 1, n):
                    x, y = v[of + i], v[of + j]
                    good = ((x & y & 1) == 0) & ((x ^ y) > 1)
                    left.append(x[good] & ~1), right.append(y[good] & ~1)
        for kk, x, y in large(k, v, starts[~edge & (size > small)], size[~edge & (size > small)]):
            if kk is None:
                left.append(x), right.append(y)
            else:
                hot.append(kk), members.append(x)
        for i in np.flatnonzero(edge):
            key, vs = k[starts[i]], v[starts[i] : ends[i]]
            if key != key0:
                key0, head, size0 = key, vs[:0], 0
            if size0:
                vs = vs[~np.isin(vs & ~1, head & ~1)]
            if len(vs) > 1:
                _, first = np.unique(vs & ~1, return_index=True)
                first.sort()
                vs = vs[first]
            if not len(vs):
                continue
            if not size0:  # leaders differ from key to key, whatever order the members came in
                vs = vs[np.argsort(vs ^ key, kind="stable")]
            old, total, both = len(head), size0 + len(vs), np.concatenate((head, vs))
            if total <= small:
                x, y = np.triu_indices(len(both), 1)
                x, y = x[y >= old], y[y >= old]
                head = both
            else:
                fresh = both if size0 <= small else vs  # it grows large just now, or was
                hot.append(np.full(len(fresh), key)), members.append(fresh & ~1)
                x, y = (z.ravel() for z in np.meshgrid(np.arange(min(leaders, len(both))), np.arange(old, len(both))))
                x, y = x[x < y], y[x < y]
                head = both[:leaders]
            size0 = total
            good = (both[x] & both[y] & 1) == 0
            left.append(both[x[good]] & ~1), right.append(both[y[good]] & ~1)
        a, b, kk, m = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (left, right, hot, members))
        pair = np.arange(len(a) + len(kk)) < len(a)
        key_ = pa.array(np.concatenate((np.zeros(len(a), np.int64), kk)), mask=pair)
        return pa.RecordBatch.from_arrays([key_, pa.array(np.concatenate((np.minimum(a, b), m))), pa.array(np.concatenate((np.maximum(a, b), np.zeros(len(m), np.int64))), mask=~pair)], _NAMES)

    return run


def _told(bits: int, low: int) -> np.ndarray:
    """The bytes of a pair (key, v) that a blob holds: what the bucket says of the key and the key's `low` last bytes, which are 0, go."""
    return np.r_[low : 8 - min(bits // 8, 8 - low), 8:16]


def _pack(bits: int, packed: int, low: int):
    """(bucket, blob) rows of (v, keys) rows: a blob is its pairs' numbers, without the bytes that need not be told."""
    told = _told(bits, low)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            k, v = np.concatenate(keys), np.concatenate(vs)
            of = (k.view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(of, kind="stable")
            of = of[order]
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            data = np.stack((k[order], v[order]), 1).view(np.uint8)[:, told]
            offsets = np.append(starts, len(of)).astype(np.int32) * len(told)
            blob = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            return pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int64)), blob], ["bucket", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                keys.append(flat), vs.append(np.repeat(part.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)))
                n += len(flat)
                if n >= packed:
                    yield out()
                    keys, vs, n = [], [], 0
        if n:
            yield out()

    return run


def _unpack(small: int, leaders: int, held: int, bits: int, low: int):
    """GROUPS (raw false) of (bucket, blob) rows sorted by bucket; the pairs of a bucket of over `held` as (key, v, null, raw true)."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, told = groups(small, leaders), _told(bits, low)
        done: list[np.ndarray] = []  # whole buckets
        parts: list[np.ndarray] = []  # of the open one
        bucket, n, wide = None, 0, False

        def out() -> Iterator[pa.RecordBatch]:
            if done:
                x = np.concatenate(done)
                done.clear()
                order = np.argsort(x[:, 0])
                got = of(x[order, 0], x[order, 1])
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.zeros(got.num_rows, bool))], [*_NAMES, "raw"])

        def raw(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), pa.nulls(len(x), pa.int64()), pa.array(np.ones(len(x), bool))], [*_NAMES, "raw"])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raws = np.frombuffer(blob, np.uint8).reshape(-1, len(told))
                full = np.zeros((len(raws), 16), np.uint8)
                full[:, told] = raws
                x = full.view(np.int64)
                x[:, 0] |= np.uint64(b << 64 - bits).view(np.int64)
                if b != bucket:
                    done += parts
                    if sum(map(len, done)) >= BUCKET // 2:
                        yield from out()
                    bucket, parts, n, wide = b, [], 0, False
                n += len(x)
                if n <= held:
                    parts.append(x)
                    continue
                if not wide:
                    yield from map(raw, parts)
                    parts, wide = [], True
                yield raw(x)
        done += parts
        yield from out()

    return run


def _rows(small: int, leaders: int):
    """GROUPS of (key, v) rows sorted by key."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = groups(small, leaders)
        for batch in batches:
            if batch.num_rows:
                yield of(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    return run


def grouped(lists: DataFrame, small: int, leaders: int, ws: Scratch, name: str = "found", held: int = HELD, n: int | None = None, low: int = 0) -> DataFrame:
    """GROUPS of the rows (v long, keys array<long>) of `lists` without nulls, a written table unless their number of keys
    `n` is given; see `groups`. The `low` last bytes of every key are 0.

    The members of a key meet in one task, which holds `held` pairs at most, or streams them."""
    if n is None:
        n = lists.select(F.sum(F.size("keys"))).first()[0] or 0
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(32, max(1, (max(n // BUCKET, 4 * parts) - 1).bit_length()))
    blobs = lists.mapInArrow(_pack(bits, PACKED, low), "bucket long, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    found = ws.save(blobs.mapInArrow(_unpack(small, leaders, held, bits, low), f"{GROUPS}, raw boolean"), name)
    raw = found.where("raw")
    if raw.isEmpty():
        return found.drop("raw")
    rows = raw.select("key", F.col("a").alias("v")).repartition("key").sortWithinPartitions("key")
    more = ws.save(rows.mapInArrow(_rows(small, leaders), GROUPS), f"{name}-wide")
    return found.where("not raw").drop("raw").unionAll(more)
